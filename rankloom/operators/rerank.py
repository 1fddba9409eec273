"""Second-stage reranking: candidates with texts, pointwise, listwise, late interaction, hybrid, resuming.

The output replaces the first-stage scores and has the candidates of the input. Candidates whose query has no text are
skipped; a document without a text is scored with the empty one.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.functions.vector import maxsim_of_units, unit
from rankloom.operators.fusion import fuse
from rankloom.operators.runs import rank_run

DIGITS = 6
#: Added before list scores are rounded, so that halves go up.
HALF = 1e-12
PointScorer = Callable[[pd.Series, pd.Series], pd.Series]
ListScorer = Callable[[str, list[str]], list[float]]


def candidates(run: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, query_text, doc_text): the run with both texts. Catalyst broadcasts a side only if it is small."""
    asked = queries.where("text IS NOT NULL").select("query_id", F.col("text").alias("query_text"))
    texts = docs.select("doc_id", F.col("full_text").alias("doc_text"))
    return run.join(asked, "query_id").join(texts, "doc_id", "left").select("query_id", "doc_id", "rank", "query_text", F.coalesce("doc_text", F.lit("")).alias("doc_text"))


def pending(run: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates of queries that have no results yet."""
    return run.join(done.select("query_id").distinct(), "query_id", "left_anti")


def overlap(run: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``pointwise`` by the words in common, over the run and both texts: each text is cut into words once, before the joins."""
    asked = queries.where("text IS NOT NULL").select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    words = docs.select("doc_id", F.array_distinct(tokens(F.col("full_text"))).alias("words"))
    pairs = run.select("query_id", "doc_id").join(asked, "query_id").join(words, "doc_id", "left")
    found = F.coalesce(F.size(F.array_intersect("asked", "words")), F.lit(0))
    score = F.round(F.coalesce(F.try_divide(F.greatest(found, F.lit(0)), F.size("asked")), F.lit(0.0)), DIGITS)
    return rank_run(pairs.select("query_id", "doc_id", score.alias("score")), None, ("query_id",))


def overlap_score(query: Column, doc: Column) -> Column:
    """Share of the query's different words that the document has; 0 for a query without words. The scorer without a model."""
    asked = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, F.array_distinct(tokens(doc)))), F.size(asked)), F.lit(0.0)), DIGITS)


def pointwise(pairs: DataFrame, scorer: PointScorer | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): each pair scored by itself; without a scorer by the words in common.

    A scorer gets Arrow batches as two series of texts and returns a series of floats.
    """
    if scorer is None:
        score = overlap_score(F.col("query_text"), F.col("doc_text"))
    else:
        udf = F.pandas_udf(scorer, "double")
        score = F.round(udf("query_text", "doc_text"), DIGITS)
    return rank_run(pairs.select("query_id", "doc_id", score.alias("score")), None, ("query_id",))


def work_items(run: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, candidates, longest, place): the work of each query with the words of its longest document, the heaviest first.

    Documents (doc_id, word_count) that are missing count as empty. Only numbers are shuffled. The order is one over all queries,
    told by counts of how many queries have each length, which are few.
    """
    sized = run.join(docs.select("doc_id", "word_count"), "doc_id", "left").groupBy("query_id").agg(F.count("*").alias("candidates"), F.max(F.coalesce("word_count", F.lit(0))).alias("longest"))
    # A row for each length, so that the window without partitions is short.
    before = Window.orderBy(F.desc("longest")).rowsBetween(Window.unboundedPreceding, -1)
    levels = sized.groupBy("longest").agg(F.count("*").alias("n")).select("longest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("heavier"))
    place = F.row_number().over(Window.partitionBy("longest").orderBy("query_id"))
    return sized.withColumn("at", place).join(levels, "longest").select("query_id", "candidates", "longest", (F.col("heavier") + F.col("at")).cast("int").alias("place"))


def jaccard(queries: pd.Series, docs: pd.Series) -> pd.Series:
    """A pair scorer without a model, over batches: words in common as a share of all words of both."""
    out = []
    for q, d in zip(queries, docs, strict=True):
        a, b = _words(q), _words(d)
        out.append(len(a & b) / len(a | b) if a or b else 0.0)
    return pd.Series(out, dtype=float)


@functools.lru_cache(maxsize=10_000)
def _words(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"[^\W_]+", text.lower()))


def centred_overlap(query: str, docs: list[str]) -> list[float]:
    """A list scorer without a model: the words in common, less the mean of the list."""
    asked = _words(query)
    own = [len(asked & _words(d)) / len(asked) if asked else 0.0 for d in docs]
    mean = sum(own) / len(own)
    return [x - mean for x in own]


_SCORED = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])


def listwise(pairs: DataFrame, scorer: ListScorer = centred_overlap) -> DataFrame:
    """(query_id, doc_id, score, rank): all candidates of a query scored in one call, in the order of their ranks.

    A task holds one query's candidates with their texts, all that its run has.
    """

    def score(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rank", "ascending"), ("doc_id", "ascending")])
        out = scorer(rows["query_text"][0].as_py(), rows["doc_text"].to_pylist())
        return pa.table([rows["query_id"], rows["doc_id"], pa.array([round(float(x) + HALF, DIGITS) for x in out], pa.float64())], schema=_SCORED)

    return rank_run(pairs.groupBy("query_id").applyInArrow(score, "query_id string, doc_id string, score double"), None, ("query_id",))


def late_interaction(run: DataFrame, query_vectors: DataFrame, doc_vectors: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank) by MaxSim over (id, tokens) of queries and documents. JVM expressions only;
    vectors are brought to unit length once, before the joins.

    A query without vectors is skipped; a document without vectors scores 0.
    """
    q = query_vectors.select(F.col("id").alias("query_id"), F.transform("tokens", unit).alias("q"))
    d = doc_vectors.select(F.col("id").alias("doc_id"), F.transform("tokens", unit).alias("d"))
    scored = run.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id", "left")
    score = F.round(F.coalesce(maxsim_of_units(F.col("q"), F.col("d")), F.lit(0.0)), DIGITS)
    return rank_run(scored.select("query_id", "doc_id", score.alias("score")), None, ("query_id",))


def hybrid(run: DataFrame, queries: DataFrame, docs: DataFrame, method: str = "mnz", params: dict[str, float] | None = None, scorer: ListScorer = centred_overlap) -> DataFrame:
    """Fuses the runs, then reranks the whole fused list of each query."""
    return listwise(candidates(fuse(run, method, params), queries, docs), scorer)
