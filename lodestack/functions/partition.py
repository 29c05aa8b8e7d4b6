"""Spreading of small inputs over idle cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


#: Most bytes, as the optimizer estimates them, of what is shuffled only to use more cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is small and its scan has fewer parts than that, else df itself.

    For work that is heavy by the row, on tables of a few files or row groups. A
    table over SPREAD_BYTES isn't shuffled, whatever the number of cores; a
    smaller spark.sql.files.maxPartitionBytes gives its scan more parts.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
