"""Collections: ordered ``(key, value)`` rows, lazily mapped, filtered, joined and aggregated.

``ord`` is the iteration order. Operators that the order can't be seen through
(group-bys) drop it; ties that an unordered engine would leave open are broken by
key, and by order where there is one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import ids
from terrane.plans.lineage import cut
from terrane.plans.ranks import running_total

_INTS, _FLOATS = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}


def _order(type: str, c: str) -> list[Column]:
    return ids.id_sort(f"{c}.type", f"{c}.ns", f"{c}.value") if type == ids.ID else [F.col(c)]


class Collection:
    """A DataFrame of ``key``, ``value`` and, where order can be seen, ``ord``."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.types = dict(df.dtypes)

    # Constructors

    @classmethod
    def of(cls, spark: SparkSession, pairs: Iterable[tuple], schema: str) -> Collection:
        """From pairs; anything that is not a pair is an error."""
        pairs = list(pairs)
        if any(not isinstance(p, tuple) or len(p) != 2 for p in pairs):
            raise TypeError("a collection is made of pairs")
        return cls(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"ord bigint, {schema}"))

    @classmethod
    def from_list(cls, spark: SparkSession, values: Iterable, type: str) -> Collection:
        return cls.of(spark, list(enumerate(values)), f"key bigint, value {type}")

    @classmethod
    def from_dict(cls, spark: SparkSession, values: Mapping, key: str, value: str) -> Collection:
        return cls.of(spark, list(values.items()), f"key {key}, value {value}")

    @classmethod
    def from_columns(cls, df: DataFrame, key: Column, value: Column, ord: Column | None = None) -> Collection:
        return cls(df.select(*([ord.alias("ord")] if ord is not None else []), key.alias("key"), value.alias("value")))

    def _with(self, df: DataFrame) -> Collection:
        return Collection(df)

    @property
    def ordered(self) -> bool:
        return "ord" in self.types

    # Mapping: functions take and give columns, so they stay in the plan.

    def map(self, f: Callable[[Column], Column]) -> Collection:
        return self._with(self.df.withColumn("value", f(F.col("value"))))

    map_parallel = map

    def map_items(self, f: Callable[[Column], Column]) -> Collection:
        """``f`` takes a pair and gives a pair; both key and value are replaced."""
        keep = ["ord"] if self.ordered else []
        df = self.df.select(*keep, f(pair(F.col("key"), F.col("value"))).alias("p"))
        return self._with(df.select(*keep, F.col("p.first").alias("key"), F.col("p.second").alias("value")))

    def filter(self, f: Callable[[Column], Column]) -> Collection:
        """A predicate that is not a boolean is an error, a null result too."""
        test = f(F.col("value"))
        if self.df.select(test.alias("t")).dtypes[0][1] != "boolean":
            raise TypeError("a filter's function gives a boolean")
        return self._with(self.df.where(F.coalesce(test, F.raise_error(F.lit("a filter's function gave no boolean")).cast("boolean"))))

    def flatten(self) -> Collection:
        """Concatenate values that are arrays of ``(key, value)``; the outer keys go, repeated inner keys stay."""
        if not self.ordered:
            return self._with(self.df.select(F.inline("value")))
        inner = self.df.select(F.col("ord").alias("o"), F.posexplode("value").alias("i", "e")).select(F.struct("o", "i").alias("ord"), "e.*")
        return self._with(inner)

    @staticmethod
    def concat(*collections: Collection) -> Collection:
        return Collection(reduce(DataFrame.unionByName, [c.df.drop("ord") for c in collections]))

    # Limits

    def take(self, n: int) -> Collection:
        if n <= 0:
            return self._with(self.df.where(F.lit(False)))
        order = [F.col("ord")] if self.ordered else _order(self.types["key"], "key")
        return self._with(self.df.orderBy(*order).limit(n))

    def top(self, n: int) -> Collection:
        """The greatest values first; ties by key."""
        if self.types["value"] not in _INTS | _FLOATS:
            raise TypeError("top takes only integers or only floats")
        return self._with(self.df.orderBy(F.desc("value"), *_order(self.types["key"], "key")).limit(max(0, n)))

    # Aggregates

    def _group(self, by: str, value: Column) -> Collection:
        return self._with(self.df.groupBy(F.col(by).alias("key")).agg(value.alias("value")))

    def count_values(self) -> Collection:
        return self._group("value", F.count("*"))

    def count_keys(self) -> Collection:
        return self._group("key", F.count("*"))

    def count_valid_keys(self) -> Collection:
        return self._group("key", F.count_if(ids.is_valid(F.col("value"))))

    def sum_by_key(self) -> Collection:
        return self._group("key", F.sum("value"))

    def _one(self, value: Column) -> DataFrame:
        return self.df.agg(value.alias("value"))

    def count(self) -> DataFrame:
        return self._one(F.count("*"))

    def count_valid_ids(self) -> DataFrame:
        return self._one(F.count_if(ids.is_valid(F.col("value"))))

    def sum(self) -> DataFrame:
        return self._one(F.coalesce(F.sum("value"), F.lit(0).cast("bigint")))

    def percentiles(self) -> Collection:
        """Each value's share of values strictly below it.

        Values are counted first, so the running total is over distinct values.
        """
        counts = cut(self.df.groupBy("value").agg(F.count("*").alias("n")))
        total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(1)), F.count("*")).first()
        below = running_total(counts, [F.col("value")], "n", "below", distinct).select("value", (F.col("below") / total).alias("p"))
        keep = [c for c in ("ord", "key") if c in self.types]
        return self._with(self.df.join(below, "value", "left").select(*keep, F.col("p").alias("value")))

    # Joins

    def join_missing(self, joined: Collection) -> Collection:
        """All of this, and what of ``joined`` has a key that is not in this; in order of key."""
        more = joined.df.join(self.df.select("key").distinct(), "key", "left_anti").select("key", "value")
        return self._with(self.df.select("key", "value").unionByName(more).orderBy(*_order(self.types["key"], "key")))

    def keep_values_in(self, features: DataFrame) -> Collection:
        """Values that are ids of ``features``; a key that loses all its values keeps one null value."""
        kept = self.df.select("key", "value").join(features.select(F.struct("type", "ns", "value").alias("value")).distinct(), "value", "left_semi")
        return self._with(self.df.select("key").distinct().join(kept, "key", "left").select("key", "value"))


def pair(first: Column, second: Column) -> Column:
    return F.struct(first.alias("first"), second.alias("second"))


def first(p: Column) -> Column:
    return p["first"]


def second(p: Column) -> Column:
    return p["second"]


def call(f: Callable, *args):
    """Functions are Python functions over columns: calling one puts its expression in place."""
    return f(*args)
