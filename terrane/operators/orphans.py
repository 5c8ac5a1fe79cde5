"""References to records that do not exist.

Signed counts are kept per key. A *delta* is one change of a key's state:

* a reference that appears is ``refs +1``, one that is withdrawn ``refs -1``,
* a record that is delivered is ``exists +1``, one that is deleted ``exists -1``.

Rows come in batches, are delivered again and are deleted in later batches, so
only transitions are deltas: a batch is set against what is known (the references
counted so far and the state of its keys), and what was counted before counts
nothing again. Deltas then add up (``fold``), in any order of batches. Keys with
positive references and no existence are the current orphans; keys whose record
exists but came later than their first reference are *late*.

Defined results: references with a null key are no references; a record with a
null key names nothing. Repeated deliveries of one reference count once, at the
earliest ``loaded_at``, whichever batch it comes in. A record of which any row is
deleted is deleted. A null time never makes a reference late. Empty tables give
an empty report. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.plans.lineage import cut
from terrane.plans.skew import hot_keys, skew_join, small

REF = ("ref_table", "owner_id", "ref_ord", "key")
STATE = ("key", "refs", "exists", "deleted", "first_ref", "first_seen")


def references(df: DataFrame, table: str, owner: Column, ord: Column, key: Column, at: str = "loaded_at", gone: Column | None = None) -> DataFrame:
    """``df`` as references ``(ref_table, owner_id, ref_ord, key, at, gone)``, repeated deliveries folded into the first; ``gone`` marks rows that withdraw one."""
    gone = F.lit(0) if gone is None else F.coalesce(gone, F.lit(False))
    rows = df.select(F.lit(table).alias("ref_table"), owner.cast("string").alias("owner_id"), ord.cast("bigint").alias("ref_ord"), key.alias("key"), F.col(at).alias("at"), gone.cast("bigint").alias("gone"))
    return first_deliveries(rows.where(F.col("key").isNotNull()))


def first_deliveries(rows: DataFrame, keys: Sequence[str] = REF) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("at").alias("at"), F.max("gone").alias("gone"))


def records(df: DataFrame, key: Column, at: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """``df`` as records ``(key, at, gone)``, one row per key."""
    rows = df.select(key.alias("key"), F.col(at).alias("at"), F.col(deleted).isNotNull().cast("bigint").alias("gone"))
    return first_deliveries(rows.where(F.col("key").isNotNull()), ["key"])


def _delta(refs, exists, deleted, first_ref, first_seen) -> list[Column]:
    null = F.lit(None).cast("timestamp")
    n = lambda c, x: (c if isinstance(c, Column) else F.lit(c)).cast("bigint").alias(x)
    at = lambda c, x: (null if c is None else F.col(c)).alias(x)
    return [F.col("key"), n(refs, "refs"), n(exists, "exists"), n(deleted, "deleted"), at(first_ref, "first_ref"), at(first_seen, "first_seen")]


def reference_deltas(refs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Deltas of ``references``, set against those ``known``: a first delivery and a first withdrawal count, others do not."""
    new, gone = F.lit(1), F.col("gone")
    if known is not None:
        # Met by the whole reference, so the references of a hot key stay spread.
        had = known.select(*[F.col(c).alias(f"_{c}") for c in (*REF, "gone")])
        refs = refs.join(had.hint("merge"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REF], "left")
        new = F.when(F.col("_key").isNotNull(), 0).otherwise(1)
        gone = F.when(F.col("_gone") > 0, 0).otherwise(F.col("gone"))
    return refs.select(*_delta(new - gone, 0, 0, "at", None))


def existence_deltas(recs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Deltas of ``records``, set against the ``state`` so far: a first delivery and a first deletion count, others do not."""
    new, gone = F.lit(1), F.col("gone")
    if state is not None:
        had = state.select(F.col("key").alias("_key"), (F.col("exists") + F.col("deleted")).alias("_had"), F.col("deleted").alias("_deleted"))
        recs = recs.join(had.hint("merge"), F.col("key") == F.col("_key"), "left")
        new = F.when(F.col("_had") > 0, 0).otherwise(1)
        gone = F.when(F.col("_deleted") > 0, 0).otherwise(F.col("gone"))
    return recs.select(*_delta(0, new - gone, gone, None, "at"))


def fold(*deltas: DataFrame) -> DataFrame:
    """The state of each key from any deltas or earlier states; partial sums are taken before the shuffle."""
    rows = deltas[0].select(*STATE)
    for d in deltas[1:]:
        rows = rows.unionByName(d.select(*STATE))
    return rows.groupBy("key").agg(*[F.sum(c).alias(c) for c in STATE[1:4]], F.min("first_ref").alias("first_ref"), F.min("first_seen").alias("first_seen"))


def advance(refs: DataFrame, recs: DataFrame, known: DataFrame | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(references, state)`` after a batch of references and records, from those before it."""
    deltas = [reference_deltas(refs, known), existence_deltas(recs, state)]
    return (refs if known is None else first_deliveries(known.unionByName(refs))), fold(*deltas, *([state] if state is not None else []))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.where((F.col("refs") > 0) & (F.col("exists") <= 0))


def suspects(state: DataFrame) -> DataFrame:
    """Keys of which at least one reference is an orphan or came before its record."""
    return state.where((F.col("refs") > 0) & ((F.col("exists") <= 0) | (F.col("first_ref") < F.col("first_seen"))))


def orphans(refs: DataFrame, state: DataFrame) -> DataFrame:
    """Every reference whose key is missing, deleted or came later, of ``advance``.

    Result: the reference and ``reason`` (missing, deleted, late). Only references
    of suspect keys are looked up: these are broadcast where they are small; else
    references are shuffled by key, those of hot keys excepted.
    """
    state = cut(state)
    refs = refs.where("gone = 0")
    found = suspects(state).select("key", "exists", "deleted", "first_seen")
    # Hot are the keys with most references, suspect or not: it is those rows that would move.
    met = refs.join(F.broadcast(found), "key") if small(found) else skew_join(refs, found.hint("merge"), ["key"], hot_keys(state, ["key"], "refs"))
    reason = F.when(F.col("exists") > 0, F.when(F.col("first_seen") > F.col("at"), "late")).when(F.col("deleted") > 0, "deleted").otherwise("missing")
    return met.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*REF, "at", "reason")


def orphan_report(found: DataFrame, by: Sequence[str] = ("ref_table",)) -> DataFrame:
    """Orphan references per table, month of the reference's first delivery and reason."""
    return found.groupBy(*by, F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_refs"))


def feature_key(type: Column, ns: Column, value: Column) -> Column:
    """Types hold no slash and values are numbers, so the text is unambiguous. Null in any part gives null."""
    return F.concat(type, F.lit("/"), ns, F.lit("/"), value.cast("string"))
