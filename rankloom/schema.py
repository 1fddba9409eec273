"""Schemas of the data model, as DDL, and the configurations of fusion strategies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

CORPUS = "docid string, title string, text string"
QUERIES = "query_id string, text string"
QRELS = "query_id string, doc_id string, relevance int"
RUN = "model string, query_id string, doc_id string, score double, rank int"
DENSE = "id string, embedding array<float>"
SPARSE = "id string, term string, weight double"
MULTIVECTOR = "id string, tokens array<array<float>>"
METRICS = "model string, strategy string, params string, ndcg_10 double, recall_100 double, mrr_10 double, map double, p_10 double, p_50 double"


@dataclass(frozen=True)
class FusionStrategy:
    """A fusion method and its parameters."""

    method: str
    params: dict[str, float] | None = field(default=None, hash=False)

    @property
    def label(self) -> str:
        """The parameters as they stand in tables: names and values, joined by commas; empty without any."""
        shown = []
        for name, value in (self.params or {}).items():
            shown.append(f"{name}={value:g}")
        return ",".join(shown)


# The fusion methods with their usual parameters.
STRATEGIES = {
    "rrf": FusionStrategy("rrf", {"k": 60}),
    "rbc": FusionStrategy("rbc", {"phi": 0.95}),
    "combmnz": FusionStrategy("mnz"),
    "isr": FusionStrategy("isr"),
    "bordafuse": FusionStrategy("bordafuse"),
    "condorcet": FusionStrategy("condorcet"),
}


def strategy_table(spark: SparkSession, strategies: dict[str, FusionStrategy] = STRATEGIES) -> DataFrame:
    """(key, method, params, label) of the strategies; few rows."""
    rows = [(k, s.method, {n: float(v) for n, v in s.params.items()} if s.params else None, s.label) for k, s in strategies.items()]
    return spark.createDataFrame(rows, "key string, method string, params map<string,double>, label string")
