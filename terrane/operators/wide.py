"""Entity, attribute, value rows into one wide row per entity.

Each entity's attributes are resolved to one value (the first not-null one in
order), gathered as a key-value map, and projected into typed columns. Values
that are not of their column's type are kept, with their key, in ``failed``.

Defined results: an entity without any known attribute has a row of nulls.
Null attributes are ignored, so are attributes that no column is asked for.
Repeated rows change nothing. Of two values at the same place the smaller one
counts. A column whose name is taken by an entity column gets the prefix
``value_``. An empty table gives no rows.

One entity with very many rows is reduced before each shuffle: to one row per
attribute, so no group is larger than the number of columns asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import typed

#: More columns than this are refused: the plan has one expression for each.
MOST_COLUMNS = 5000


def column_types(types: DataFrame, key: str = "tag_key", kind: str = "value_type") -> dict[str, str]:
    """The known keys and their types, as a bounded dict; of a key given twice the smaller type counts."""
    rows = types.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(kind).alias(kind)).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns")
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: r[0].encode())}


def attribute_maps(rows: DataFrame, entity: Sequence[str], key: str, value: str, order: str, known: Sequence[str]) -> DataFrame:
    """One row per entity with ``attributes``: known key to its first not-null value."""
    use = F.col(key).isin(*known) & F.col(value).isNotNull() if known else F.lit(False)
    first = (
        rows.select(*entity, F.when(use, F.col(key)).alias("_k"), F.when(use, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("_ov"))
        .groupBy(*entity, "_k")
        .agg(F.min("_ov").alias("_ov"))
    )
    pair = F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").alias("key"), F.col("_ov.v").alias("value")))
    return first.groupBy(*entity).agg(F.map_from_entries(F.collect_list(pair)).alias("attributes"))


def widen(maps: DataFrame, entity: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """``maps`` (from ``attribute_maps``) as typed columns and ``failed``, a map of the values that are not of their type."""
    taken = {e.lower() for e in entity} | {"failed"}
    cols, bad = [], []
    for k, kind in types.items():
        text = F.col("attributes")[k]
        good = typed(text, kind)
        cols.append(good.alias(f"value_{k}" if k.lower() in taken else k))
        if kind != "string":
            bad.append(F.when(text.isNotNull() & good.isNull(), F.struct(F.lit(k).alias("key"), text.alias("value"))))
    failed = F.map_from_entries(F.array_compact(F.array(*bad))) if bad else F.create_map().cast("map<string,string>")
    return maps.select(*entity, *cols, failed.alias("failed"))


def cast_failures(wide: DataFrame, entity: Sequence[str], key: str = "tag_key", value: str = "tag_value") -> DataFrame:
    return wide.select(*entity, F.explode("failed").alias(key, value))
