"""Feature ids: types, text forms, unsigned values, hashes and codecs.

An id is ``(type, ns, value)``; values are unsigned 64-bit numbers kept as the
bit pattern of a BIGINT, so they print and sort through ``unsigned`` and
``unsigned_order``. No result is the null id, ``/invalid//0`` in text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature types in order.
TYPES = ("point", "path", "area", "relation", "invalid", "collection", "expression")
TYPE_ORDER = {t: i for i, t in enumerate(TYPES)}
#: Namespaces.
OSM_NODE, OSM_WAY, OSM_RELATION = "openstreetmap.org/node", "openstreetmap.org/way", "openstreetmap.org/relation"
GB_UPRN, GB_CODEPOINT, UK_ONS = "ordnancesurvey.co.uk/open-uprn", "ordnancesurvey.co.uk/code-point", "statistics.gov.uk/datasets/regions"
GTFS, WORLDS = "gtfs", "worlds"
#: Short forms of ids in text.
ALIASES = {"n": ("point", OSM_NODE), "w": ("path", OSM_WAY), "a": ("area", OSM_WAY), "r": ("relation", OSM_RELATION), "gb/uprn": ("point", GB_UPRN), "gb/codepoint": ("point", GB_CODEPOINT), "uk/ons": ("area", UK_ONS)}

ID = "struct<type:string,ns:string,value:bigint>"


@dataclass(frozen=True, order=True)
class FeatureID:
    type: str
    ns: str
    value: int

    def __str__(self) -> str:
        return f"/{self.type}/{self.ns}/{self.value % (1 << 64)}"

    def is_valid(self) -> bool:
        return self.type != "invalid" and self.ns != ""

    def column(self) -> Column:
        return F.struct(F.lit(self.type).alias("type"), F.lit(self.ns).alias("ns"), F.lit(signed(self.value)).cast("bigint").alias("value"))


INVALID = FeatureID("invalid", "", 0)


def signed(value: int) -> int:
    value %= 1 << 64
    return value - (1 << 64) if value >> 63 else value


def parse(text: str) -> FeatureID:
    """``/type/ns/value`` or a short form such as ``/n/123``; raises on anything else."""
    parts = text.strip().strip("/").split("/")
    for k in (2, 1):
        short = "/".join(parts[:k])
        if short in ALIASES and len(parts) == k + 1:
            type, ns = ALIASES[short]
            if ns == GB_CODEPOINT:
                return FeatureID(type, ns, postcode_value(parts[-1]))
            if ns == UK_ONS:
                raise ValueError("an ONS code needs its year")
            return FeatureID(type, ns, int(parts[-1]))
        if short == "uk/ons" and len(parts) == 4:
            return ons_boundary_id(parts[3], int(parts[2]))
    if len(parts) < 3 or parts[0] not in TYPE_ORDER:
        raise ValueError(f"not a feature id: {text!r}")
    return FeatureID(parts[0], "/".join(parts[1:-1]), int(parts[-1]))


def osm_node_id(v: int) -> FeatureID:
    return FeatureID("point", OSM_NODE, v)


def osm_way_id(v: int) -> FeatureID:
    return FeatureID("path", OSM_WAY, v)


def osm_way_area_id(v: int) -> FeatureID:
    return FeatureID("area", OSM_WAY, v)


def osm_relation_area_id(v: int) -> FeatureID:
    return FeatureID("area", OSM_RELATION, v)


def osm_relation_id(v: int) -> FeatureID:
    return FeatureID("relation", OSM_RELATION, v)


def postcode_value(postcode: str) -> int:
    """A postcode as a number: its letters and digits, in capitals, in base 36 after a leading one."""
    v = 1
    for c in postcode.replace(" ", "").upper():
        v = v * 36 + int(c, 36)
    return v


def value_postcode(v: int) -> str:
    out = ""
    while v > 1:
        v, d = divmod(v, 36)
        out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d] + out
    return out


def ons_boundary_id(code: str, year: int) -> FeatureID:
    """A boundary code (a letter and eight digits) of a year."""
    return FeatureID("area", UK_ONS, (year << 40) | ((ord(code[0].upper()) - 65) << 32) | int(code[1:]))


#: Fixed values of the two hashes.
_OFFSET, _PRIME, _M64 = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


def fnv1(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = (h * _PRIME & _M64) ^ b
    return h


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = (h ^ b) * _PRIME & _M64
    return h


# Columns ---------------------------------------------------------------------


def unsigned(value: Column) -> Column:
    return F.conv(F.hex(value), 16, 10)


def unsigned_order(value: Column) -> Column:
    return value.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def type_order(type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for t, i in TYPE_ORDER.items() for x in (t, i)]), type)


def id_text(id: Column) -> Column:
    return F.concat(F.lit("/"), id["type"], F.lit("/"), id["ns"], F.lit("/"), unsigned(id["value"]))


def is_valid(id: Column) -> Column:
    """Null ids are not valid."""
    return F.coalesce((id["type"] != "invalid") & (id["ns"] != ""), F.lit(False))


def id_sort(type: str = "type", ns: str = "ns", value: str = "value") -> list[Column]:
    """The total order of ids: type, namespace, unsigned value."""
    return [type_order(F.col(type)), F.col(ns), unsigned_order(F.col(value))]
