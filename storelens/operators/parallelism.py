"""Input parallelism for CPU-heavy row-wise work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition when a scan yields fewer partitions than the cluster has cores.

    A small table stored as one parquet row group is read by one task; text cleaning on it
    would then run on one core. On large inputs (many files / row groups) the scan already
    has enough partitions and this is a no-op, so hot keys are still collapsed map-side by
    the partial aggregations that follow. The partition count is planning metadata (no job).
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
