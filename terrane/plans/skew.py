"""Joins and groupings that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; so there are never more hot keys than this.
HOT_SHARE = 1000
#: Below this many rows a key is never worth splitting.
HOT_LEAST = 20_000
#: Rows of a few narrow columns up to which a table is broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of text in them.
BROADCAST_BYTES = 32 << 20


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str = "n", share: int = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame | None:
    """Of ``counts`` (one row per key with its number of rows ``n``) those above ``total / share``.

    At most ``share`` keys can be above it, so the result may be collected and
    broadcast whatever the size of the data. The result is a local relation:
    it holds the keys and ``n``; it is None when no key is hot.
    """
    spark = counts.sparkSession
    total = counts.agg(F.sum(n)).first()[0] or 0
    rows = counts.where((F.col(n) > total / share) & (F.col(n) > least)).select(*keys, n).collect()
    return spark.createDataFrame(rows, counts.select(*keys, n).schema) if rows else None


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` with ``right`` (one row per key) that never gathers a hot key's left rows.

    Hot keys' rows of ``left`` stay where they are and meet a broadcast of at
    most ``HOT_SHARE`` right rows; all others are shuffled. ``how`` is inner or
    left. Null keys match nothing.
    """
    keys = list(keys)
    if hot is None:
        return left.join(right, keys, how)
    mark = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    marked = left.join(mark, keys, "left")
    few = F.broadcast(right.join(mark, keys, "left_semi"))
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, keys, how)
    warm = marked.where(F.col("_hot")).drop("_hot").join(few, keys, how)
    return cold.unionByName(warm)


def small(df: DataFrame, most: int | None = None) -> bool:
    """Whether ``df`` (cut) has so few rows, and so little text in them, that it may be broadcast."""
    text = [F.octet_length(c).cast("bigint") for c, t in df.dtypes if t == "string"]
    size = sum((F.coalesce(c, F.lit(0).cast("bigint")) for c in text), F.lit(0).cast("bigint"))
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= (BROADCAST_ROWS if most is None else most) and total <= BROADCAST_BYTES


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", most: int | None = None, n: str | None = None) -> DataFrame:
    """Equi-join of ``left`` with ``right`` (one row per key, cut): ``right`` is broadcast if it is ``small``, else met by ``skew_join``.

    ``n`` is a column of ``right`` with about how many rows of ``left`` have the key, where there is one; else they are counted.
    """
    keys = list(keys)
    if small(right, most):
        return left.join(F.broadcast(right), keys, how)
    hot = hot_keys(right, keys, n) if n else hot_keys(left.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    return skew_join(left, right.hint("merge"), keys, hot, how)


def salted(row_id: Sequence[Column], salts: Column) -> Column:
    """The salt in ``[0, salts)`` of a row."""
    return F.pmod(F.xxhash64(*row_id), salts.cast("bigint")).cast("int")
