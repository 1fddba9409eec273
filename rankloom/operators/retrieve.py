"""First-stage retrieval: exact dense search, BM25 over an inverted index, learned-sparse dot products.

Dense and sparse search score blocks of documents against blocks of queries, both of bounded size, and hand on the best k of
each block only: no row is written for a pair of a query and a document. Text search goes over documents as they are or over a
stored index, of which it reads the buckets of the asked terms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.text import analyze_es, tokens
from rankloom.functions.vector import sound
from rankloom.operators.runs import TOP_K, rank_run
from rankloom.session import cut_lineage, shuffle_partitions, small_table
from rankloom.sources.store import is_complete

DIGITS = 6
#: Most documents and queries of a block.
BLOCK = 16_384
_PAIRS = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("score", pa.float64())])
_POSTINGS_DDL = "term string, id string, tf bigint, dl bigint, bucket int"
_PAIRS_DDL = "query_id string, doc_id string, score double"


def _best(scores: np.ndarray, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row, ties by name; ``names`` has the place of each column in the order of names."""
    n = scores.shape[1]
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= floor[:, None])
    else:
        row, col = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((names[col], -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _places(ids: list[str]) -> np.ndarray:
    out = np.empty(len(ids), np.int64)
    out[np.argsort(np.array(ids, dtype=object), kind="stable")] = np.arange(len(ids))
    return out


def _blocks(key: str, rows: int, block: int, cores: int = 1) -> tuple[Column, int]:
    """Number of an id's block, and how many there are: as few as the block size allows, but enough for the cores."""
    n = max(1, -(-rows // block), min(cores, -(-rows // 64)))
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), n


def _cogrouped(left: DataFrame, right: DataFrame, blocks: int, score: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """Scores each pair of blocks in a task of its own, as far as hashing has it."""
    n = max(blocks, shuffle_partitions(left.sparkSession))
    left, right = left.repartition(n, "d", "q"), right.repartition(n, "d", "q")
    return left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInArrow(score, _PAIRS_DDL)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _dense_block(k: int):  # noqa: ANN202
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return _PAIRS.empty_table()
        matrix = lambda t: t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        d, q, ids = matrix(docs), matrix(queries), docs["id"].to_pylist()
        names, out = _places(ids), []
        for at in range(0, len(q), 1024):
            scores = np.round(q[at : at + 1024] @ d.T, DIGITS)
            row, col = _best(scores, k, names)
            out.append(pa.table([queries["id"].take(pa.array(row + at)), docs["id"].take(pa.array(col)), pa.array(scores[row, col])], schema=_PAIRS))
        return pa.concat_tables(out)

    return run


def dense_topk(queries: DataFrame, docs: DataFrame, k: int = TOP_K, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): for each query the ``k`` documents of highest inner product, negative ones too.

    Both sides are (id, embedding). Null ids and vectors that are null, empty, all zero or not finite don't count; vectors must
    then be of one length. Repeated rows count once, an id with several vectors with its best. Scores are rounded to 6
    digits, ties go to the smaller id; with fewer than ``k`` documents all come out.
    """
    pick = lambda df: df.where(F.col("id").isNotNull() & sound(F.col("embedding"))).select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    queries, docs = pick(queries), pick(docs)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    d_block, d_n = _blocks("id", docs.count(), block)
    q_block, q_n = _blocks("id", queries.count(), block, -(-cores // d_n))
    once = lambda df: df.withColumn("mark", F.xxhash64("embedding")).dropDuplicates(["id", "mark"]).drop("mark")
    queries, docs = once(queries), once(docs)
    left = docs.withColumn("d", d_block).withColumn("q", _every(q_n))
    right = queries.withColumn("q", q_block).withColumn("d", _every(d_n))
    local = _cogrouped(left, right, d_n * q_n, _dense_block(k))
    best = local.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return rank_run(best, k, ("query_id",))


def _sparse_block(k: int, positive: bool):  # noqa: ANN202
    def run(docs: pa.Table, queries: pa.Table) -> pa.Table:
        if not docs.num_rows or not queries.num_rows:
            return _PAIRS.empty_table()
        vocabulary = pc.unique(queries["term"].combine_chunks())
        docs = docs.filter(pc.is_in(docs["term"], value_set=vocabulary))
        if not docs.num_rows:
            return _PAIRS.empty_table()
        ids = docs["id"].combine_chunks().dictionary_encode()
        names, term = _places(ids.dictionary.to_pylist()), pc.index_in(docs["term"], value_set=vocabulary).to_numpy()
        order = np.lexsort((ids.indices.to_numpy(), term))
        term, doc, weight = term[order], ids.indices.to_numpy()[order], docs["weight"].to_numpy()[order]
        begin = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        queries = queries.sort_by([("id", "ascending"), ("term", "ascending")])
        q_ids = queries["id"].to_pylist()
        q_term, q_weight = pc.index_in(queries["term"], value_set=vocabulary).to_numpy(), queries["weight"].to_numpy()
        starts = [i for i in range(len(q_ids)) if i == 0 or q_ids[i] != q_ids[i - 1]] + [len(q_ids)]
        out_q, out_d, out_s = [], [], []
        for a, b in zip(starts, starts[1:], strict=False):
            scores, hit = np.zeros(len(names)), np.zeros(len(names), bool)
            for t, w in zip(q_term[a:b], q_weight[a:b], strict=True):
                span = slice(begin[t], begin[t + 1])
                scores[doc[span]] += w * weight[span]  # a document has a term once
                hit[doc[span]] = True
            at = np.flatnonzero(hit)
            if not len(at):
                continue
            own = np.round(scores[at], DIGITS)
            if positive:
                at, own = at[own > 0], own[own > 0]
            if len(at):
                _, col = _best(own[None, :], k, names[at])
                out_q += [q_ids[a]] * len(col)
                out_d.append(at[col])
                out_s.append(own[col])
        if not out_d:
            return _PAIRS.empty_table()
        return pa.table([pa.array(out_q, pa.string()), ids.dictionary.take(pa.array(np.concatenate(out_d))), pa.array(np.concatenate(out_s))], schema=_PAIRS)

    return run


def _added(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("string").alias("id"), "term", F.col("weight").cast("double").alias("weight")).dropna().groupBy("id", "term").agg(F.sum("weight").alias("weight"))


def sparse_topk(queries: DataFrame, docs: DataFrame, k: int = TOP_K, positive: bool = True, block: int = BLOCK, doc_count: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): for each query the ``k`` documents of highest sparse inner product.

    Both sides are (id, term, weight); repeated coordinates are added up. With ``positive`` only scores above 0 come out, so a
    query may have fewer documents or none. Documents without a term of any query are left out before the shuffle. Rows with
    a null don't count. Scores are rounded to 6 digits, ties go to the smaller id.
    """
    queries = _added(queries)
    asked = queries.agg(F.countDistinct("id").alias("ids"), F.countDistinct("term").alias("terms")).first()
    docs = _added(docs.join(_asked_terms(queries, asked["terms"]), "term", "left_semi"))
    n = docs.agg(F.approx_count_distinct("id")).first()[0] if doc_count is None else doc_count
    return _scored(queries, docs, asked["ids"], n, k, positive, block)


#: Most terms of the queries that are broadcast to the documents; beyond it they meet in a shuffle.
MAX_TERMS = 1_000_000


def _asked_terms(queries: DataFrame, count: int) -> DataFrame:
    terms = queries.select("term").distinct()
    return F.broadcast(terms) if count <= MAX_TERMS else terms


def _scored(queries: DataFrame, docs: DataFrame, query_count: int, doc_count: int, k: int, positive: bool, block: int) -> DataFrame:
    """The search itself, over coordinates that are added up. The few terms of the queries are copied for each block of documents."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    q_block, q_n = _blocks("id", query_count, block)
    d_block, d_n = _blocks("id", doc_count, block, -(-cores // q_n))
    left = docs.withColumn("d", d_block).withColumn("q", _every(q_n))
    right = queries.withColumn("q", q_block).withColumn("d", _every(d_n))
    return rank_run(_cogrouped(left, right, d_n * q_n, _sparse_block(k, positive)), k, ("query_id",))


def analyzed(text: Column, language: str | None = None) -> Column:
    """Terms of a text: plain tokens, or with Spanish stopwords dropped and stems taken (language ``es``)."""
    return analyze_es(text) if language == "es" else tokens(text)


def postings(docs: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """(id, term, tf): the inverted index, one row for each document and term. Null keys don't count; texts of one key are
    indexed together."""
    terms = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.explode(analyzed(F.col(text), language)).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def index_with_lengths(docs: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """(id, term, tf, dl): the inverted index with each document's length. Spread by document, so that one shuffle serves both."""
    index = postings(docs.select(key, text).repartition(shuffle_partitions(docs.sparkSession), key), key, text, language)
    return index.withColumn("dl", F.sum("tf").over(Window.partitionBy("id")))


def doc_stats(docs: DataFrame, key: str, text: str, language: str | None = None) -> DataFrame:
    """(id, dl): terms of each document, of empty ones too."""
    sized = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.size(analyzed(F.col(text), language)).alias("dl"))
    return sized.groupBy("id").agg(F.sum("dl").alias("dl"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class Hits:
    """What a search needs of an index: (id, term, tf, dl) of the asked terms, (term, df) of them, documents, and words of all."""

    postings: DataFrame
    terms: DataFrame
    docs: int
    words: int


def _hits(docs: DataFrame, key: str, text: str, language: str | None, asked: DataFrame, count: int) -> Hits:
    """Of documents that are not indexed. They are cut into terms once; only asked terms, and a row with the length of each
    document, go on and are written."""
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), analyzed(F.col(text), language).alias("terms"))
    own = own.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms")).withColumn("dl", F.size("terms"))
    wanted = _asked_terms(asked.select("term").union(small_table(docs.sparkSession, [("",)], "term string")), count)
    each = own.select("id", "dl", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).join(wanted, "term", "left_semi")
    rows = cut_lineage(each.groupBy("id", "term", "dl").agg(F.count("*").alias("tf")))
    total = rows.where("term = ''").agg(F.count("*").alias("n"), F.sum("dl").alias("words")).first()
    found = rows.where("term <> ''")
    return Hits(found, found.groupBy("term").agg(F.count("*").alias("df")), total["n"], total["words"] or 0)


@dataclass(frozen=True)
class TextIndex:
    """A stored inverted index: postings (bucket, term, id, tf, dl) and terms (bucket, term, df, cf), both in a folder for each
    bucket of terms, the number of documents and of their words, and how texts were cut into terms."""

    postings: DataFrame
    terms: DataFrame
    docs: int
    words: int
    buckets: int
    language: str | None

    def hits(self, asked: DataFrame) -> Hits:
        """The rows of the asked terms; only the buckets that have some are read."""
        marked = asked.select("term").distinct().withColumn("bucket", _bucket(self.buckets))
        read = [r[0] for r in marked.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        of = lambda df: df.where(F.col("bucket").isin(read)).join(marked, ["bucket", "term"], "left_semi").drop("bucket")
        return Hits(of(self.postings), of(self.terms).select("term", "df"), self.docs, self.words)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "full_text", language: str | None = None, buckets: int = 64) -> None:
    """Writes the inverted index of ``docs``; the folder with its totals is written last and completes it.

    Documents are cut into terms once. Null keys don't count; texts of one key are indexed together; a null text has no terms.
    """
    index = index_with_lengths(docs, key, text, language).withColumn("bucket", _bucket(buckets))
    spark = docs.sparkSession
    index.repartition(shuffle_partitions(spark), "bucket", "term").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(_POSTINGS_DDL).parquet(f"{path}/postings")
    terms = stored.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    counted = docs.where(F.col(key).isNotNull()).agg(F.countDistinct(key).alias("docs"))
    words = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    counted.crossJoin(words).withColumns({"buckets": F.lit(buckets), "language": F.lit(language).cast("string")}).write.mode("overwrite").parquet(f"{path}/totals")  # two single rows


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """The index at ``path``; an error if it was not written to its end."""
    if not is_complete(spark, f"{path}/totals"):
        raise RuntimeError(f"{path} has no complete index")
    total = spark.read.parquet(f"{path}/totals").first()
    postings = spark.read.schema(_POSTINGS_DDL).parquet(f"{path}/postings")
    terms = spark.read.schema("term string, df bigint, cf bigint, bucket int").parquet(f"{path}/terms")
    return TextIndex(postings, terms, total["docs"], total["words"], total["buckets"], total["language"])


def _found(queries: DataFrame, docs: DataFrame | TextIndex, query_key: str, doc_key: str, query_text: str, doc_text: str, language: str | None) -> tuple[DataFrame, int, Hits]:
    """The queries' terms (id, term, tf), how many queries have any, and the documents' rows with these terms."""
    asked = postings(queries, query_key, query_text, docs.language if isinstance(docs, TextIndex) else language)
    counts = asked.agg(F.countDistinct("id").alias("ids"), F.countDistinct("term").alias("terms")).first()
    hits = docs.hits(asked) if isinstance(docs, TextIndex) else _hits(docs, doc_key, doc_text, language, asked, counts["terms"])
    return asked, counts["ids"], hits


def bm25_topk(queries: DataFrame, docs: DataFrame | TextIndex, query_key: str = "query_id", doc_key: str = "doc_id", query_text: str = "text", doc_text: str = "text", k: int = TOP_K, k1: float = 0.9, b: float = 0.4, language: str | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 with idf = ln(1 + (N - df + 0.5) / (df + 0.5)), over documents or a stored index.

    The idf is put on the few terms of the queries and the saturated frequency on the documents' terms. Only rows of asked
    terms are shuffled. Queries without terms have no rows; without documents there are none.
    """
    asked, count, hits = _found(queries, docs, query_key, doc_key, query_text, doc_text, language)
    mean = hits.words / hits.docs if hits.words else 1.0
    saturated = F.col("tf") / (F.col("tf") + F.lit(k1) * (1 - F.lit(b) + F.lit(b) * F.col("dl") / F.lit(mean)))
    idf = F.log(1 + (F.lit(hits.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return _search(asked, count, hits, F.col("tf") * idf, saturated, k, block)


def learned_sparse_topk(queries: DataFrame, docs: DataFrame | TextIndex, query_key: str = "query_id", doc_key: str = "doc_id", query_text: str = "text", doc_text: str = "text", k: int = TOP_K, language: str | None = "es", block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank) by weights without a model: ln(1 + tf) on both sides, and ln(1 + N / df) once."""
    asked, count, hits = _found(queries, docs, query_key, doc_key, query_text, doc_text, language)
    return _search(asked, count, hits, F.log1p("tf") * F.log(1 + F.lit(hits.docs) / F.col("df")), F.log1p("tf"), k, block)


def _search(asked: DataFrame, count: int, hits: Hits, query_weight: Column, doc_weight: Column, k: int, block: int) -> DataFrame:
    """Weights of query terms are an expression over ``tf`` and ``df``, those of documents over ``tf`` and ``dl``."""
    weighted = asked.join(hits.terms, "term").select("id", "term", query_weight.alias("weight"))
    return _scored(weighted, hits.postings.select("id", "term", doc_weight.alias("weight")), count, hits.docs, k, True, block)


def csr_rows(sparse: DataFrame) -> DataFrame:
    """(id, entries): sparse vectors as maps, duplicates added up (the compressed-row form). One vector's terms are few."""
    summed = sparse.dropna().groupBy("id", "term").agg(F.sum("weight").alias("weight"))
    return summed.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "weight")))).alias("entries"))


def union_runs(runs: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Runs under the names of their models, as one table."""
    out = None
    for name, run in runs:
        named = run.select(F.lit(name).alias("model"), "query_id", "doc_id", "score", "rank")
        out = named if out is None else out.unionByName(named)
    return out
