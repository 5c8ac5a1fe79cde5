"""Global ranks and running totals without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.plans.lineage import cut


#: So few rows are summed in one task.
SMALL = 500_000


def running_total(df: DataFrame, order: list[Column], n: str, name: str, rows: int | None = None) -> DataFrame:
    """``df`` with the sum of ``n`` over all rows before each in ``order``. ``rows`` is their number, where it is known.

    Rows are range-partitioned; each partition's sum (one row a partition) is
    broadcast as the base of its running total. Rows equal in ``order`` fall in
    one partition, so ``order`` should be unique.
    """
    if rows is not None and rows <= SMALL:
        return df.withColumn(name, F.coalesce(F.sum(n).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    by = [F.col(f"_o{i}") for i in range(len(order))]
    parts = cut(keyed.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))
    sums = parts.groupBy("_p").agg(F.sum(n).alias("_s"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    local = F.coalesce(F.sum(n).over(Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn("_local", local).join(F.broadcast(base), "_p")
    return out.withColumn(name, F.col("_base") + F.col("_local")).drop("_p", "_base", "_local", *[f"_o{i}" for i in range(len(order))])
