"""Whole pipelines: what is stored is not made again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import corpus, encode, evaluate, fusion, qrels, rerank, retrieve
from rankloom.schema import FusionStrategy
from rankloom.sources import store

Say = Callable[[str], None]
SCORED = "query_id string, doc_id string, score double, rank int"


@contextmanager
def timer(what: str, say: Say = print) -> Iterator[None]:
    """Says how long a block took."""
    began = time.perf_counter()
    yield
    say(f"{what}: {time.perf_counter() - began:.1f} s")


def executor_memory(spark: SparkSession) -> dict[str, tuple[int, int]]:
    """Of each executor, the bytes that it has for storage and those that are left; a few rows."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    return {(x := each.next())._1(): (int(x._2()._1()), int(x._2()._2())) for each in [status.iterator()] for _ in range(status.size())}


def observed(df: DataFrame, key: str = "query_id") -> tuple[DataFrame, Observation]:
    """``df`` with counts of its rows that are taken as it is written, and those counts."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(key).alias("keys")), seen


def progress(seen: Observation, seconds: float) -> str:
    """What was written, and how fast."""
    rows = seen.get["rows"]
    return f"{rows} rows of about {seen.get['keys']} keys, {rows / max(seconds, 1e-9):.1f} rows a second"


@dataclass(frozen=True)
class Dataset:
    """Where results are kept, and which data they are of."""

    root: str
    country: str = "full"
    version: str = "1.2"
    max_words: int | None = None

    def shared(self, name: str) -> str:
        """Path of a table that all models share."""
        return store.partition_path(f"{self.root}/{name}", country=self.country, version=self.version, max_words=self.max_words)

    def of_model(self, name: str, model: str, query_length: int, doc_length: int) -> str:
        """Path of a table that a model made with sequences of these lengths."""
        return store.partition_path(f"{self.root}/{name}", model=model, country=self.country, version=self.version, query_length=query_length, doc_length=doc_length, max_words=self.max_words)

    def own(self, spec: encode.EncoderSpec, name: str) -> str:
        """Path of a table of one model."""
        return self.of_model(name, spec.name, spec.max_query_length, spec.max_doc_length)

    def reranked(self, reranker: str, first_stage: str) -> str:
        """Path of a reranker's run over a first stage; of a hybrid, the first stage is the name of its fusion."""
        return store.partition_path(self.shared("reranked"), reranker=reranker, over=first_stage)


def cached(spark: SparkSession, data: Dataset, spec: encode.EncoderSpec) -> dict[str, bool]:
    """Which tables of a baseline are there, so that a run makes only the others."""
    return store.status(spark, {**{n: data.shared(n) for n in ("docs", "qrels", "queries")}, **{n: data.own(spec, n) for n in ("doc_embeddings", "query_embeddings", "run")}})


def prepared(spark: SparkSession, data: Dataset, corpus_rows: DataFrame, judgements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, judgements, query texts), filtered by length and pruned, stored for all models."""
    docs = store.materialize(spark, data.shared("docs"), lambda: corpus.filter_by_words(corpus.doc_lookup(corpus_rows), data.max_words))
    pruned = store.materialize(spark, data.shared("qrels"), lambda: qrels.prune_qrels(qrels.build_qrels(judgements), docs))
    texts = store.materialize(spark, data.shared("queries"), lambda: qrels.prune_queries(qrels.query_map(judgements, "id", "query", "judged_at"), pruned))
    return docs, pruned, texts


def first_stage(spark: SparkSession, data: Dataset, model: str, query_length: int, doc_length: int) -> DataFrame:
    """The stored run of a model and its sequence lengths; an error if there is none."""
    run = store.load_or_fail(spark, data.of_model("run", model, query_length, doc_length), None)
    return run.select(F.lit(model).alias("model"), "query_id", "doc_id", "score", "rank")


def _baseline(spark: SparkSession, data: Dataset, spec: encode.EncoderSpec, corpus_rows: DataFrame, judgements: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Prepares, searches and evaluates; gives the run and its metrics. A stored run skips all that made it; a corpus that has
    changed since is an error."""
    docs, pruned, texts = prepared(spark, data, corpus_rows, judgements)
    path = data.own(spec, "run")
    if not store.is_complete(spark, path):
        store.guard(spark, docs, "doc_id", "word_count", data.own(spec, "corpus_mark"))
        search(texts, docs).select("query_id", "doc_id", "score", "rank").write.mode("overwrite").parquet(path)
    run = first_stage(spark, data, spec.name, spec.max_query_length, spec.max_doc_length)
    return run, evaluate.evaluate(run, pruned)


def dense_baseline(spark: SparkSession, data: Dataset, spec: encode.EncoderSpec, make: Callable[[], encode.Encoder], corpus_rows: DataFrame, judgements: DataFrame, k: int = 100, chunk_size: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Documents are encoded by their plan, queries with their prompt, and searched exactly."""

    def search(texts: DataFrame, docs: DataFrame) -> DataFrame:
        d = store.materialize(spark, data.own(spec, "doc_embeddings"), lambda: encode.encode_planned(docs, make, spec.max_doc_length, chunk_size, prompt=spec.doc_prompt))
        q = store.materialize(spark, data.own(spec, "query_embeddings"), lambda: encode.encode(texts, "query_id", "text", make, spec.query_prompt, is_query=True, length=spec.max_query_length))
        return retrieve.dense_topk(q, d, k)

    return _baseline(spark, data, spec, corpus_rows, judgements, search)


def text_baseline(spark: SparkSession, data: Dataset, spec: encode.EncoderSpec, corpus_rows: DataFrame, judgements: DataFrame, k: int = 100, language: str | None = "es") -> tuple[DataFrame, DataFrame]:
    """BM25 over a text index that is built once and opened by every search."""

    def search(texts: DataFrame, docs: DataFrame) -> DataFrame:
        path = data.own(spec, "index")
        if not store.is_complete(spark, f"{path}/totals"):
            retrieve.build_index(docs, path, language=language)
        return retrieve.bm25_topk(texts, retrieve.open_index(spark, path), k=k)

    return _baseline(spark, data, spec, corpus_rows, judgements, search)


def sparse_baseline(spark: SparkSession, data: Dataset, spec: encode.EncoderSpec, make: Callable[[], encode.SparseEncoder], corpus_rows: DataFrame, judgements: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """Both sides are encoded to weighted terms, which are stored and searched by their product."""

    def search(texts: DataFrame, docs: DataFrame) -> DataFrame:
        d = store.materialize(spark, data.own(spec, "doc_embeddings"), lambda: encode.encode_sparse(docs, "doc_id", "full_text", make, spec.doc_prompt, length=spec.max_doc_length))
        q = store.materialize(spark, data.own(spec, "query_embeddings"), lambda: encode.encode_sparse(texts, "query_id", "text", make, spec.query_prompt, is_query=True, length=spec.max_query_length))
        return retrieve.sparse_topk(q, d, k)

    return _baseline(spark, data, spec, corpus_rows, judgements, search)


def fuse_and_evaluate(run: DataFrame, judgements: DataFrame, models: Sequence[str], strategies: Sequence[FusionStrategy], smallest: int = 3, largest: int = 3) -> DataFrame:
    """Metrics of every combination of the models and every additive strategy, as one job."""
    combos = fusion.choices(models, smallest, largest)
    lists = fusion.grid_lists(run.sparkSession, combos, strategies)
    return evaluate.evaluate(fusion.judged_grid(run, judgements, combos, strategies), judgements, ("combo", "strategy", "params"), lists)


def rerank_stored(spark: SparkSession, path: str, run: DataFrame, queries: DataFrame, docs: DataFrame, scorer: rerank.ListScorer = rerank.centred_overlap, shards: int = 4, job: Callable[[DataFrame], DataFrame] | None = None, say: Say = lambda line: None) -> DataFrame:
    """Reranking that is written shard by shard and goes on where it was stopped; the shards go when the run is whole.

    ``job`` gives (query_id, doc_id, score, rank) of candidates with their texts: listwise by ``scorer``, if it isn't given;
    ``rerank.pointwise`` or ``rerank.late_interaction`` with their models bound, as well. What each shard wrote is said.
    """
    job = job or (lambda rest: rerank.listwise(rest, scorer))
    if not store.is_complete(spark, f"{path}/run"):
        pairs = rerank.candidates(run, queries, docs)
        pieces: list[tuple[Observation, float]] = []

        def shard(rest: DataFrame) -> DataFrame:
            out, seen = observed(job(rest))
            pieces.append((seen, time.perf_counter()))
            return out

        done = store.resume(spark, pairs, f"{path}/checkpoint", SCORED, shard, shards)
        for n, (seen, began) in enumerate(pieces):
            ended = pieces[n + 1][1] if n + 1 < len(pieces) else time.perf_counter()
            say(f"shard {n + 1} of {len(pieces)}: {progress(seen, ended - began)}")
        done.write.mode("overwrite").parquet(f"{path}/run")
        store.remove(spark, f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/run")


def hybrid_stored(spark: SparkSession, path: str, run: DataFrame, queries: DataFrame, docs: DataFrame, strategy: FusionStrategy, scorer: rerank.ListScorer = rerank.centred_overlap, shards: int = 4) -> DataFrame:
    """Fuses the runs, stores the fused lists whole, and reranks them as ``rerank_stored`` does."""
    fused = store.materialize(spark, f"{path}/fused", lambda: fusion.fuse(run, strategy.method, strategy.params))
    return rerank_stored(spark, path, fused, queries, docs, scorer, shards)
