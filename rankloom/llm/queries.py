"""The queries of the operators in this folder, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import full_text, word_count
from rankloom.llm import leakage, neighbours, packing, quality, reading, splitting, tokens, topn
from rankloom.session import ship_package
from rankloom.sources.tables import read_table


def _p1_rows(spark: SparkSession, folder: str) -> DataFrame:
    corpus = read_table(spark, folder, "corpus", "docid", "title", "text")
    fields = F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("body")), F.struct(F.lit("full_text").alias("field"), full_text(F.col("title"), F.col("text")).alias("body")))
    return corpus.where(F.col("docid").isNotNull()).select("docid", F.explode(fields).alias("f")).select("docid", "f.field", "f.body")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_texts(_p1_rows(spark, folder), "body")
    return pieces.where("pieces > 1").select("docid", "field").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every row; repeated rows have their pieces each."""
    return splitting.split_texts(_p1_rows(spark, folder), "body").where("pieces > 1")


def p1_layout(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of a text must add up to: rows split, characters covered, pieces over the limit, gaps, overlaps out of bounds."""
    pieces = p1_pieces(spark, folder)
    cut = F.col("piece") > 0
    # Places of a cut are ends of one piece and, less the overlap, starts of the next.
    totals = pieces.groupBy("docid", "field").agg(
        F.count_if(F.col("piece") == 0).alias("rows"), F.sum(F.when(F.col("piece") == F.col("pieces") - 1, F.col("stop"))).alias("chars"),
        F.count_if((F.col("stop") - F.col("start") > splitting.LIMIT) | (F.length("piece_text") != F.col("stop") - F.col("start"))).alias("wrong"),
        (F.sum(F.when(F.col("piece") < F.col("pieces") - 1, F.col("stop"))) - F.sum(F.when(cut, F.col("start")))).alias("shared"), F.count_if(cut).alias("cuts"),
    )
    low, high = splitting.OVERLAP - splitting.SLACK, splitting.OVERLAP
    return totals.select("docid", "field", "rows", F.col("chars").cast("bigint").alias("chars"), "wrong", F.col("shared").between(low * F.col("cuts"), high * F.col("cuts")).alias("overlapping"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "doc_embeddings", "id", "embedding")
    asked = read_table(spark, folder, "query_embeddings", "id", "embedding")
    return neighbours.nearest(docs, asked).select("query_id", "doc_id")


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the exact neighbours that the index finds, for the query ids divisible by 20."""
    docs = read_table(spark, folder, "doc_embeddings", "id", "embedding")
    asked = read_table(spark, folder, "query_embeddings", "id", "embedding").where(F.expr("try_cast(id AS bigint)") % 20 == 0)
    exact = neighbours.nearest_exact(docs, asked).select("query_id", "doc_id")
    found = neighbours.nearest(docs, asked).select("query_id", "doc_id").withColumn("hit", F.lit(1))
    return exact.join(found, ["query_id", "doc_id"], "left").agg(F.count("*").alias("exact"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))


def _p3(spark: SparkSession, folder: str) -> DataFrame:
    corpus = read_table(spark, folder, "corpus", "docid", "title", "text")
    return packing.pack_items(corpus.select("docid", word_count(full_text(F.col("title"), F.col("text"))).alias("words")), "docid", "words")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p3(spark, folder).where("pieces > 1").select("docid").distinct()


def p3_bins(spark: SparkSession, folder: str) -> DataFrame:
    return _p3(spark, folder)


def p3_items(spark: SparkSession, folder: str) -> DataFrame:
    """What was packed: words and pieces of each docid, however they were placed."""
    return _p3(spark, folder).groupBy("docid").agg(F.sum("words").cast("bigint").alias("words"), F.count("*").cast("bigint").alias("pieces"))


def p3_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What any packing must keep: items, pieces and words in all, and no container over its capacity."""
    bins = _p3(spark, folder).groupBy("container").agg(F.sum("words").alias("words"), F.count("*").alias("pieces"), F.count_if(F.col("piece") == 0).alias("items"))
    return bins.agg(F.sum("items").alias("items"), F.sum("pieces").alias("pieces"), F.sum("words").alias("words"), F.count_if(F.col("words") > packing.CAPACITY).alias("overfull"))


def p3_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used, the least number possible by their words, and the share of their space that is used."""
    bins = _p3(spark, folder).groupBy("container").agg(F.sum("words").alias("words"))
    return bins.agg(F.count("*").alias("containers"), F.ceil(F.sum("words") / packing.CAPACITY).alias("least"), F.max("words").alias("fullest"), F.round(F.sum("words") / (F.count("*") * packing.CAPACITY), 4).alias("fill"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    run = read_table(spark, folder, "retrieval_run", "model", "query_id", "doc_id", "score")
    return topn.top_n(run, ["model", "query_id"], "doc_id", "score", 10).select("model", "query_id", "doc_id")


def p4_ranked(spark: SparkSession, folder: str) -> DataFrame:
    run = read_table(spark, folder, "retrieval_run", "model", "query_id", "doc_id", "score")
    return topn.top_n(run, ["model", "query_id"], "doc_id", "score", 10)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.not_prose(read_table(spark, folder, "corpus", "docid", "text"), read_table(spark, folder, "prose_labels", "docid", "label"))


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    corpus = read_table(spark, folder, "corpus", "docid", "paragraph", "text", "word_count")
    model = quality.fit_prose_model(corpus, read_table(spark, folder, "prose_labels", "docid", "label"))
    return quality.text_statistics(corpus, "text", model, claimed="word_count")


def p5_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Of the statistics, what SQL can recount."""
    corpus = read_table(spark, folder, "corpus", "docid", "text", "word_count")
    return quality.text_statistics(corpus, "text", claimed="word_count").select("docid", F.col("words").cast("bigint").alias("words"), "words_claimed_right")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(read_table(spark, folder, "documents", "doc_id", "text"), "text").select("doc_id", "ids")


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode_ids(p6_ids(spark, folder), "ids").select("doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents", "doc_id", "text")
    return leakage.leaked_items(docs, read_table(spark, folder, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    corpus = read_table(spark, folder, "corpus", "docid", "text")
    prose = quality.fit_prose_model(corpus, read_table(spark, folder, "prose_labels", "docid", "label"))
    return reading.reading_levels(read_table(spark, folder, "documents", "doc_id", "text"), read_table(spark, folder, "reading_labels", "doc_id", "grade"), prose)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


_QUERIES = [p1_found, p1_pieces, p1_layout, p2_found, p2_recall, p3_found, p3_bins, p3_items, p3_totals, p3_fill, p4_found, p4_ranked, p5_found, p5_statistics, p5_word_counts, p6_ids, p6_decoded, p7_found, p8_found]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this folder, by name."""
    return {q.__name__: _shipped(q) for q in _QUERIES}


# Python's white space for DuckDB's regular expressions, whose \s knows ASCII only.
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_FULL = rf"CASE WHEN coalesce(title, '') <> '' THEN regexp_replace(title || '. ' || coalesce(text, ''), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') ELSE coalesce(text, '') END"
_TOP = """
SELECT model, query_id, doc_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
    SELECT model, query_id, doc_id, max(score) AS score FROM retrieval_run
    WHERE model IS NOT NULL AND query_id IS NOT NULL AND doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL))
WHERE rank <= 10"""
_ITEMS = f"SELECT docid, max(len(regexp_extract_all({_FULL}, '[^{_SPACE}]+'))) AS words FROM corpus WHERE docid IS NOT NULL GROUP BY docid"


def _sound(table: str) -> str:
    return f"SELECT DISTINCT id, embedding FROM {table} WHERE id IS NOT NULL AND len(embedding) = 128 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express."""
    return {
        "p1_found": f"SELECT DISTINCT docid, 'text' AS field FROM corpus WHERE docid IS NOT NULL AND length(text) > 2000 UNION SELECT DISTINCT docid, 'full_text' FROM corpus WHERE docid IS NOT NULL AND length({_FULL}) > 2000",
        "p1_layout": f"""
WITH r AS (SELECT docid, unnest([{{'field': 'text', 'body': text}}, {{'field': 'full_text', 'body': {_FULL}}}], recursive := true) FROM corpus WHERE docid IS NOT NULL)
SELECT docid, field, count(*) AS rows, CAST(sum(length(body)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS wrong, true AS overlapping FROM r WHERE length(body) > 2000 GROUP BY ALL""",
        "p2_found": f"""
WITH d AS ({_sound('doc_embeddings')}), q AS ({_sound('query_embeddings')}),
s AS (SELECT q.id AS query_id, d.id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 12) AS sim FROM q, d)
SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS n FROM (SELECT query_id, doc_id, max(sim) AS sim FROM s GROUP BY ALL)) WHERE n <= 10""",
        "p3_found": f"SELECT docid FROM ({_ITEMS}) WHERE words > 512",
        "p3_items": f"SELECT docid, CAST(words AS BIGINT) AS words, CAST(greatest(1, ceil(words / 512.0)) AS BIGINT) AS pieces FROM ({_ITEMS})",
        "p3_totals": f"SELECT count(*) AS items, CAST(sum(greatest(1, ceil(words / 512.0))) AS BIGINT) AS pieces, CAST(sum(words) AS BIGINT) AS words, CAST(0 AS BIGINT) AS overfull FROM ({_ITEMS})",
        "p4_found": f"SELECT model, query_id, doc_id FROM ({_TOP})",
        "p4_ranked": _TOP,
        "p5_word_counts": f"SELECT docid, CAST(coalesce(len(regexp_extract_all(text, '[^{_SPACE}]+')), 0) AS BIGINT) AS words, coalesce(word_count = coalesce(len(regexp_extract_all(text, '[^{_SPACE}]+')), 0), false) AS words_claimed_right FROM corpus",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
