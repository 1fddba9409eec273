"""How the rows of an operator are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that outweighs moving the rows.

    A scan of a large table has more partitions than that and stays as it is, without a shuffle. Behind a shuffle, whose
    partitions adaptive execution settles only when it runs, rows are spread over the shuffle's partitions; nothing is run here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df
