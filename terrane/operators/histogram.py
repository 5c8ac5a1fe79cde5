"""Histograms with at most six adaptive buckets.

Numbers get a bucket each when there are six distinct values or fewer, else
buckets of about equally many distinct values, half open, the last without end.
Other values are taken by falling count; with more than six, the sixth bucket is
``other``. Values fall to buckets by a join with as few rows as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import ids
from terrane.operators.collections import Collection
from terrane.plans.lineage import cut
from terrane.plans.ranks import running_total

BUCKETS = 6


def _label(low, high, kind: str) -> str:
    if kind == "double":
        n = lambda x: f"{x:.3g}"
        return f"{n(low)}-" if high is None else f"{n(low)}-{n(high)}"
    if high is None:
        return f"{low}-"
    return f"{low}" if high - low <= 1 else f"{low}-{high - 1}"


def _starts(n: int) -> list[int]:
    """Where the buckets of ``n`` distinct values begin: each takes its share of what is left."""
    out, at = [], 0
    for built in range(BUCKETS):
        out.append(at)
        at += (n - at) // (BUCKETS - built)
    return out


def uniform_buckets(c: Collection) -> DataFrame:
    """``(bucket, low, high, label)`` of a numeric collection."""
    kind = c.types["value"]
    distinct = cut(c.df.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")))
    n = distinct.count()
    if n <= BUCKETS:
        rows = [(i, r[0], None, str(r[0]) if kind != "double" else f"{r[0]:.3g}", True) for i, r in enumerate(distinct.orderBy("value").limit(BUCKETS).collect())]
    else:
        ranked = running_total(distinct.withColumn("one", F.lit(1)), [F.col("value")], "one", "rank", n)
        low = [r[0] for r in ranked.where(F.col("rank").isin(_starts(n))).orderBy("value").select("value").collect()]
        rows = [(i, v, low[i + 1] if i + 1 < len(low) else None, _label(v, low[i + 1] if i + 1 < len(low) else None, kind), False) for i, v in enumerate(low)]
    return c.df.sparkSession.createDataFrame(rows, f"bucket int, low {kind}, high {kind}, label string, single boolean")


def categorical_buckets(c: Collection) -> DataFrame:
    top = c.count_values().df.orderBy(F.desc("value"), "key").limit(BUCKETS + 1).collect()
    more = len(top) > BUCKETS
    rows = [(i, None if more and i == BUCKETS - 1 else r[0], "other" if more and i == BUCKETS - 1 else str(r[0])) for i, r in enumerate(top[:BUCKETS])]
    return c.df.sparkSession.createDataFrame(rows, f"bucket int, low {c.types['value']}, label string")


def assign(c: Collection) -> DataFrame:
    """``(key, value, bucket, label)``; values in no bucket are dropped."""
    if c.types["value"] in ("int", "bigint", "double", "float"):
        b = F.broadcast(uniform_buckets(c))
        on = F.when(F.col("single"), F.col("value") == F.col("low")).otherwise((F.col("low") <= F.col("value")) & (F.col("high").isNull() | (F.col("value") < F.col("high"))))
        return c.df.join(b, on).select("key", "value", "bucket", "label")
    b = categorical_buckets(c)
    rows = c.df.join(F.broadcast(b.where("low IS NOT NULL")), F.col("value") == F.col("low"), "left")
    other = b.where("low IS NULL").select("bucket").first()
    rows = rows.select("key", "value", "bucket", "label")
    return rows.fillna({"bucket": other[0], "label": "other"}) if other else rows.where("bucket IS NOT NULL")


def histogram(c: Collection) -> DataFrame:
    """``(bucket, label, n)``."""
    return assign(c).groupBy("bucket", "label").agg(F.count("*").alias("n"))


def histogram_change(c: Collection, id: ids.FeatureID, expression: str = "", swatch: bool = False):
    """A change that adds a histogram as a collection of keys to buckets, and the expression that made it."""
    from terrane import world as W

    tags = [("#histogram", "swatch" if swatch else "bars")]
    items = Collection(assign(c).select("key", F.col("bucket").alias("value")))
    text = W.add_expression(c.df.sparkSession, ids.FeatureID("expression", id.ns, id.value), [], expression)
    return W.merge_changes(None, W.add_collection(id, tags, items), text)


def origin_destination(c: Collection) -> Collection:
    """Of origin to destination ids: each origin with its number of valid destinations."""
    return c.count_valid_keys()


def compare(base: Collection, scenario: Collection) -> DataFrame:
    """A histogram's bars in two worlds side by side, by label, in buckets of both together."""
    both = Collection(base.df.select("key", "value").withColumn("_s", F.lit(0)).unionByName(scenario.df.select("key", "value").withColumn("_s", F.lit(1))))
    keyed = Collection(both.df.select(F.struct("_s", "key").alias("key"), "value"))
    bars = assign(keyed).groupBy("bucket", "label").agg(F.count_if(F.col("key._s") == 0).alias("n_base"), F.count_if(F.col("key._s") == 1).alias("n_scenario"))
    return bars
