"""Spreading rows over the cluster before costly work on each."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input that make a partition on their own.
PARTITION = 128 << 20


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` over at least two partitions a core.

    Input large enough to be read in as many is left alone (the estimate is of the
    plan, nothing is run), so only small tables are shuffled. ``key`` must be
    unique enough to balance.
    """
    want = 2 * df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= want * PARTITION else df.repartition(want, *key)
