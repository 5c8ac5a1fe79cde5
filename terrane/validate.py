"""What is wrong with features, found for all of them at once.

Defined results: a feature has a row for each kind of fault, none if it is good.
Paths need two points, each with a place of its own or of a point that exists;
closed ones at least three corners, anticlockwise. Areas need paths that exist,
are closed and have three points or more. Features without paths or references are
judged by their ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane import ids
from terrane.world import KEY, Change, World


def _turn(ring: Column) -> Column:
    """Twice the signed area of a closed path in degrees, from its first point: positive when anticlockwise."""
    lat, lng = lambda p: p["lat"] - ring[0]["lat"], lambda p: F.pmod(p["lng"] - ring[0]["lng"] + 180.0, F.lit(360.0)) - 180.0
    legs = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: lng(a) * lat(b) - lng(b) * lat(a))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def faults(world: World, features: DataFrame) -> DataFrame:
    """``(type, ns, value, fault)`` of ``features`` that are in, or are to be added to, the world."""
    known = world.features.select(*KEY, "points").unionByName(features.select(*KEY, "points"))
    path, n = F.col("type") == "path", F.coalesce(F.size("points"), F.lit(0))
    closed = F.coalesce((n > 1) & (F.get("points", F.lit(0)) == F.element_at("points", -1)), F.lit(False))
    own = F.array_compact(
        F.array(
            F.when(~ids.is_valid(F.struct(*KEY)), "id"), F.when(path & (F.greatest(n, F.size("refs")) < 2), "few points"),
            F.when(path & closed & (F.size(F.array_distinct("points")) < 3), "few corners"), F.when(path & closed & (n > 3) & (_turn(F.col("points")) < 0), "clockwise"),
        )
    )
    found = features.select(*KEY, F.explode(own).alias("fault"))
    id = F.struct(*KEY)
    # Points that a path has no place of its own for.
    asked = features.where(path).select(*KEY, F.posexplode("refs").alias("i", "ref"), "points").where(F.get("points", F.col("i")).isNull())
    placed = known.where("type = 'point'").where(F.get("points", F.lit(0)).isNotNull()).select(id.alias("ref"))
    found = found.unionByName(asked.join(placed, "ref", "left_anti").select(*KEY, F.lit("missing point").alias("fault")))
    uses = features.where("type = 'area'").select(*KEY, F.explode("refs").alias("ref"))
    rings = known.where("type = 'path'").select(id.alias("ref"), "points").dropDuplicates(["ref"])
    met = uses.join(rings.withColumn("_there", F.lit(True)), "ref", "left")
    wrong = F.when(F.col("_there").isNull(), "missing path").when(F.size("points") < 3, "few points of a path").when(F.get("points", F.lit(0)) != F.element_at("points", -1), "open path")
    return found.unionByName(met.select(*KEY, wrong.alias("fault")).where("fault IS NOT NULL")).distinct()


def checked(world: World, change: Change, invert: bool = True) -> Change:
    """``change`` if all that it adds is good; clockwise closed paths are turned round if ``invert``, else an error like any other fault."""
    if change.added is None:
        return change
    added = change.added
    if invert:
        turn = (F.col("type") == "path") & F.coalesce((F.size("points") > 3) & (F.get("points", F.lit(0)) == F.element_at("points", -1)) & (_turn(F.col("points")) < 0), F.lit(False))
        added = added.withColumn("_turn", turn).withColumn("points", F.when(F.col("_turn"), F.reverse("points")).otherwise(F.col("points"))).withColumn("refs", F.when(F.col("_turn"), F.reverse("refs")).otherwise(F.col("refs"))).drop("_turn")
    bad = faults(world, added).first()
    if bad is not None:
        raise ValueError(f"{ids.FeatureID(*bad[:3])}: {bad[3]}")
    return Change(added, change.ops, change.items)


