"""The core's queries over the tables of a folder, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import naming
from rankloom.functions.text import light_stem_es, snippet
from rankloom.functions.vector import sound, split_vector
from rankloom.operators import corpus, encode, evaluate, fusion, qrels, rerank, retrieve, runs, stats
from rankloom.schema import STRATEGIES, strategy_table
from rankloom.session import ship_package, small_table
from rankloom.sources.tables import read_table

MAX_WORDS = 400
PHIS = (0.8, 0.9, 0.95, 0.98)
TOKENS = 4
#: The run that is reranked, the one whose queries are done, the one of token vectors, and those that the hybrid fuses.
FIRST_STAGE, DONE, VECTORS, HYBRID = "lexico", "cruzado", "denso_corto", ("denso_corto", "denso_largo", "lexico")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "corpus", "docid", "title", "text", "loaded_at")


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "judgements")


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return qrels.build_qrels(_judgements(spark, d))


def _run(spark: SparkSession, d: str) -> DataFrame:
    return runs.prepare_run(read_table(spark, d, "retrieval_run", "model", "query_id", "doc_id", "score"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return runs.models_of(read_table(spark, d, "retrieval_run", "model", "query_id", "doc_id", "score"))


def _models(spark: SparkSession, d: str) -> list[str]:
    return [r[0] for r in read_table(spark, d, "retrieval_run", "model").where("model IS NOT NULL").distinct().orderBy("model").collect()]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return qrels.query_map(read_table(spark, d, "queries"), "query_id", "text", "issued_at")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return corpus.format_and_count(_corpus(spark, d))


# --- corpus and judgements


def corpus_format_count(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d).select("docid", "full_text", "word_count")


def corpus_wordcount_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus.filter_by_words(_counted(spark, d), MAX_WORDS).select("docid", "word_count")


def corpus_kept_report(spark: SparkSession, d: str) -> DataFrame:
    return corpus.kept_report(_counted(spark, d), MAX_WORDS)


def corpus_lookup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.doc_lookup(_corpus(spark, d))


def corpus_snippets(spark: SparkSession, d: str) -> DataFrame:
    return corpus.doc_lookup(_corpus(spark, d)).select("doc_id", snippet(F.col("full_text"), 80).alias("shown"))


def qrels_build(spark: SparkSession, d: str) -> DataFrame:
    return _qrels(spark, d)


def qrels_test_rows(spark: SparkSession, d: str) -> DataFrame:
    return qrels.build_qrels(qrels.test_rows(_judgements(spark, d), "test", 1.0, False))


def qrels_split(spark: SparkSession, d: str) -> DataFrame:
    return qrels.build_qrels(qrels.split_or_first(_judgements(spark, d), "train"))


def qrels_split_fallback(spark: SparkSession, d: str) -> DataFrame:
    return qrels.build_qrels(qrels.split_or_first(_judgements(spark, d), "corpus"))


def qrels_graded(spark: SparkSession, d: str) -> DataFrame:
    graded = _judgements(spark, d).withColumn("grade", F.ceil(F.col("match_score") * 3).cast("int"))
    return qrels.build_qrels(graded, relevance="grade")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return corpus.filter_by_words(corpus.doc_lookup(_corpus(spark, d)), MAX_WORDS)


def qrels_prune(spark: SparkSession, d: str) -> DataFrame:
    return qrels.prune_qrels(_qrels(spark, d), _kept(spark, d))


def qrels_prune_report(spark: SparkSession, d: str) -> DataFrame:
    return qrels.prune_report(_qrels(spark, d), qrels_prune(spark, d))


def query_map_prune(spark: SparkSession, d: str) -> DataFrame:
    texts = qrels.query_map(_judgements(spark, d), "id", "query", "judged_at")
    return qrels.prune_queries(texts, qrels_prune(spark, d))


def query_map_last(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d)


# --- retrieval


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.dense_topk(*(read_table(spark, d, t, "id", "embedding").where(sound(F.col("embedding"), 128)) for t in ("query_embeddings", "doc_embeddings")), k=100)


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.term_stats(retrieve.postings(corpus.doc_lookup(_corpus(spark, d)), "doc_id", "full_text"))


def bm25_doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.doc_stats(corpus.doc_lookup(_corpus(spark, d)), "doc_id", "full_text")


def bm25_stems_es(spark: SparkSession, d: str) -> DataFrame:
    terms = retrieve.postings(corpus.doc_lookup(_corpus(spark, d)), "doc_id", "full_text").select("term").distinct()
    return terms.select("term", light_stem_es(F.col("term")).alias("stem"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25_topk(_queries(spark, d), corpus.doc_lookup(_corpus(spark, d)), doc_text="full_text")


def bm25_topk_es(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25_topk(_queries(spark, d), corpus.doc_lookup(_corpus(spark, d)), doc_text="full_text", language="es")


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.learned_sparse_topk(_queries(spark, d), corpus.doc_lookup(_corpus(spark, d)), doc_text="full_text")


# --- runs and fusion


def run_rank(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)


def run_minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return runs.minmax(_run(spark, d)).select("model", "query_id", "doc_id", F.round("norm", 9).alias("norm"))


def run_candidates(spark: SparkSession, d: str) -> DataFrame:
    run = _run(spark, d)
    return run.groupBy("query_id").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("candidates"))


def _fused(method: str) -> Callable[[SparkSession, str], DataFrame]:
    params = next(s.params for s in STRATEGIES.values() if s.method == method)
    return lambda spark, d: fusion.fuse(_run(spark, d), method, params)


def fuse_all(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_all(_run(spark, d))


def fuse_rbc_phi_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(fusion.phi_sweep(_run(spark, d), PHIS), _qrels(spark, d), ("phi",), small_table(spark, [(p,) for p in PHIS], "phi double"))


def fuse_grid_metrics(spark: SparkSession, d: str) -> DataFrame:
    combos, judged = fusion.choices(_models(spark, d), 3, 3), _qrels(spark, d)
    return evaluate.evaluate(fusion.judged_grid(_run(spark, d), judged, combos), judged, ("combo", "strategy", "params"), fusion.grid_lists(spark, combos))


def fuse_grid(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fusion_grid(_run(spark, d), fusion.choices(_models(spark, d), 2, 3))


def fuse_combinations(spark: SparkSession, d: str) -> DataFrame:
    return fusion.combinations(spark, _models(spark, d), 2, 3)


# --- evaluation


def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_query(_run(spark, d), _qrels(spark, d), lists=_lists(spark, d))


def eval_run(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(_run(spark, d), _qrels(spark, d), lists=_lists(spark, d))


def eval_fused(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(_run(spark, d), "rrf", {"k": 60}).withColumn("model", F.lit("rrf"))
    return evaluate.evaluate(fused, _qrels(spark, d), lists=small_table(spark, [("rrf",)], "model string"))


def eval_graded_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluate(_run(spark, d), qrels_graded(spark, d), lists=_lists(spark, d)).select("model", "ndcg_10")


def eval_paired_t(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.paired_t(eval_per_query(spark, d), "ndcg_10")


def results_table(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.result_rows(eval_run(spark, d).withColumns({"strategy": F.lit(""), "params": F.lit(None).cast("string")}))
    return evaluate.markdown_lines(rows, evaluate.TITLES)


# --- encoding


def encode_plan(spark: SparkSession, d: str) -> DataFrame:
    return encode.chunk_plan(corpus.doc_lookup(_corpus(spark, d)), 200, 32768)


def encode_hashing(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_planned(corpus.doc_lookup(_corpus(spark, d)), encode.HashingEncoder, 32768, 200)


def encode_terms(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_sparse(corpus.doc_lookup(_corpus(spark, d)), "doc_id", "full_text", encode.TermEncoder).withColumn("weight", F.round("weight", 6))


def encode_assigned(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each band gets by their plan, and the longest of them."""
    rows = encode.planned(corpus.doc_lookup(_corpus(spark, d)), 200, 32768)
    return rows.groupBy("sequence", "batch").agg(F.count("*").alias("docs"), F.max("word_count").alias("longest"))


def encode_prompts(spark: SparkSession, d: str) -> DataFrame:
    return encode.prompted(_queries(spark, d), "Dada una consulta, encuentra el pasaje que la responde").select("query_id", "prompt")


# --- reranking


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return rerank.candidates(_run(spark, d).where(F.col("model") == FIRST_STAGE), _queries(spark, d), corpus.doc_lookup(_corpus(spark, d)))


def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


def rerank_pending(spark: SparkSession, d: str) -> DataFrame:
    run = _run(spark, d)
    return rerank.pending(run.where(F.col("model") == FIRST_STAGE), run.where(F.col("model") == DONE)).select("query_id", "doc_id", "rank")


def rerank_pointwise(spark: SparkSession, d: str) -> DataFrame:
    return rerank.overlap(_run(spark, d).where(F.col("model") == FIRST_STAGE), _queries(spark, d), corpus.doc_lookup(_corpus(spark, d)))


def rerank_pointwise_scored(spark: SparkSession, d: str) -> DataFrame:
    return rerank.pointwise(_pairs(spark, d), rerank.jaccard)


def rerank_work(spark: SparkSession, d: str) -> DataFrame:
    return rerank.work_items(_run(spark, d).where(F.col("model") == FIRST_STAGE), corpus.doc_lookup(_corpus(spark, d)))


def rerank_listwise(spark: SparkSession, d: str) -> DataFrame:
    return rerank.listwise(_pairs(spark, d))


def maxsim_topk(spark: SparkSession, d: str) -> DataFrame:
    parts = lambda t: corpus.latest_rows(read_table(spark, d, t, "id", "embedding").where(sound(F.col("embedding"), 128)), ["id"], [F.col("embedding")]).select("id", split_vector(F.col("embedding"), TOKENS).alias("tokens"))
    return rerank.late_interaction(_run(spark, d).where(F.col("model") == VECTORS), parts("query_embeddings"), parts("doc_embeddings"))


def hybrid_fuse_rerank(spark: SparkSession, d: str) -> DataFrame:
    run = _run(spark, d).where(F.col("model").isin(*HYBRID))
    return rerank.hybrid(run, _queries(spark, d), corpus.doc_lookup(_corpus(spark, d)))


# --- statistics, names


def judgements_per_query_hist(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(stats.judgements_per_query(_judgements(spark, d)), "judgements")


def judgements_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(stats.judgements_per_query(_judgements(spark, d)), "judgements")


def length_summary_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.summary(_counted(spark, d), "word_count")


def length_hist_unit(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_counted(spark, d), "word_count")


def length_hist_log(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_histogram(_counted(spark, d), "word_count")


def show_query(spark: SparkSession, d: str) -> DataFrame:
    return stats.show_query("100007", _queries(spark, d), _qrels(spark, d), corpus.doc_lookup(_corpus(spark, d)))


def random_query(spark: SparkSession, d: str) -> DataFrame:
    return stats.random_row(_queries(spark, d), "query_id", 7)


def model_slug_cache_key(spark: SparkSession, d: str) -> DataFrame:
    models = read_table(spark, d, "retrieval_run", "model").where("model IS NOT NULL").distinct().select(F.concat(F.lit("grupo/"), "model").alias("name"))
    key = naming.cache_key_of(F.lit("full"), F.lit("1.2"), F.lit(64), F.lit(256), F.when(F.col("name").contains("denso"), F.lit(400)))
    return models.select("name", naming.model_slug_of(F.col("name")).alias("slug"), naming.short_name_of(F.col("name")).alias("short"), key.alias("key"))


def fusion_strategies(spark: SparkSession, d: str) -> DataFrame:
    return strategy_table(spark).select("key", "method", F.col("label").alias("params"))


def embeddings_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the pieces that a matrix came in."""
    rows = read_table(spark, d, "doc_embeddings")
    return rows.groupBy("chunk").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint")).alias("numbers"))


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return corpus.fingerprint(_counted(spark, d), "docid", "word_count")


def qrels_nested(spark: SparkSession, d: str) -> DataFrame:
    return qrels.qrels_maps(_qrels(spark, d)).select("query_id", F.to_json("docs").alias("docs"))


_PLAIN = [
    corpus_format_count, corpus_wordcount_filter, corpus_kept_report, corpus_lookup, corpus_snippets, qrels_build, qrels_test_rows, qrels_split, qrels_split_fallback, qrels_graded, qrels_prune, qrels_prune_report,
    query_map_prune, query_map_last, dense_topk, bm25_term_stats, bm25_doc_stats, bm25_stems_es, bm25_topk, bm25_topk_es, sparse_topk, run_rank, run_minmax_norm, run_candidates, fuse_all,
    fuse_rbc_phi_sweep, fuse_grid_metrics, fuse_grid, fuse_combinations, eval_per_query, eval_run, eval_fused, eval_graded_ndcg, eval_paired_t, results_table, encode_plan, encode_assigned, encode_hashing, encode_terms,
    encode_prompts, rerank_candidates, rerank_pending, rerank_work, rerank_pointwise, rerank_pointwise_scored, rerank_listwise, maxsim_topk, hybrid_fuse_rerank, judgements_per_query_hist, judgements_summary,
    length_summary_stats, length_hist_unit, length_hist_log, show_query, random_query, model_slug_cache_key, fusion_strategies, embeddings_by_chunk, corpus_fingerprint, qrels_nested,
]
_FUSED = {"fuse_rrf": "rrf", "fuse_rbc": "rbc", "fuse_combmnz": "mnz", "fuse_isr": "isr", "fuse_borda": "bordafuse", "fuse_condorcet": "condorcet"}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the core, by name; the flagship first."""
    named = {**{n: _fused(m) for n, m in _FUSED.items()}, **{q.__name__: q for q in _PLAIN}}
    return {n: _shipped(named[n]) for n in ["eval_fused", *(n for n in named if n != "eval_fused")]}
