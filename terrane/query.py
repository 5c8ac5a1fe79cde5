"""The query algebra: tags, types, geometry, and their combinations, compiled to Columns.

A query has two readings. ``find`` goes through the search index: only features
with an indexed token are there (points whose only tag is their location are
not), only keys that begin with ``#`` (key and value) or ``@`` (key) are searched,
and ``is-valid`` finds nothing. ``matches`` looks at one feature's tags, and a
``typed`` query then ignores what is inside it. Both readings are kept because
results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import geo


class Query:
    def column(self, mode: str = "find", field=F.col) -> Column:
        """The reading ``mode`` for features whose columns ``field`` gives by name."""
        raise NotImplementedError

    def on(self, feature: Column) -> Column:
        """The ``matches`` reading for a feature that is a struct column."""
        return self.column("matches", lambda name: feature[name])

    def __and__(self, other: Query) -> Query:
        return And((self, other)).simplify()

    def __or__(self, other: Query) -> Query:
        return Or((self, other)).simplify()

    def simplify(self) -> Query:
        return self

    def to_dict(self) -> dict:
        raise NotImplementedError


def first_value(key: str, tags: Column | None = None) -> Column:
    """The value of the first tag with a key, null when there is none."""
    tags = F.col("tags") if tags is None else tags
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]


def indexed() -> Column:
    """Whether the search index holds a feature: all but points without a tag."""
    return (F.col("type") != "point") | (F.size("tags") > 0)


@dataclass(frozen=True)
class All(Query):
    def column(self, mode="find", field=F.col):
        return F.lit(True)

    def to_dict(self):
        return {"all": {}}


@dataclass(frozen=True)
class Empty(Query):
    def column(self, mode="find", field=F.col):
        return F.lit(False)

    def to_dict(self):
        return {"empty": {}}


@dataclass(frozen=True)
class IsValid(Query):
    def column(self, mode="find", field=F.col):
        return F.lit(False) if mode == "find" else (field("type") != "invalid") & (field("ns") != "")

    def to_dict(self):
        return {"isValid": {}}


@dataclass(frozen=True)
class Keyed(Query):
    key: str

    def column(self, mode="find", field=F.col):
        if mode == "find" and self.key[:1] not in ("#", "@"):
            return F.lit(False)
        return F.exists(field("tags"), lambda t: t["key"] == self.key)

    def to_dict(self):
        return {"keyed": self.key}


@dataclass(frozen=True)
class Tagged(Query):
    key: str
    value: str

    def column(self, mode="find", field=F.col):
        if mode == "find":
            # The index has a token for each tag; a repeated key is found by any of its values.
            return F.exists(field("tags"), lambda t: (t["key"] == self.key) & (t["value"] == self.value)) if self.key[:1] == "#" else F.lit(False)
        return F.coalesce(first_value(self.key, field("tags")) == self.value, F.lit(False))

    def to_dict(self):
        return {"tagged": {"key": self.key, "value": self.value}}


@dataclass(frozen=True)
class Typed(Query):
    type: str
    inner: Query

    def column(self, mode="find", field=F.col):
        own = field("type") == self.type
        return own & self.inner.column(mode, field) if mode == "find" else own

    def simplify(self):
        return Typed(self.type, self.inner.simplify())

    def to_dict(self):
        return {"typed": {"type": self.type, "query": self.inner.to_dict()}}


def _flat(kind, queries):
    out = []
    for q in queries:
        q = q.simplify()
        out += q.queries if isinstance(q, kind) else (q,)
    return tuple(out)


@dataclass(frozen=True)
class And(Query):
    queries: tuple

    def column(self, mode="find", field=F.col):
        out = F.lit(True)
        for q in self.queries:
            out = out & q.column(mode, field)
        return out

    def simplify(self):
        q = _flat(And, self.queries)
        return q[0] if len(q) == 1 else And(q)

    def to_dict(self):
        return {"intersection": [q.to_dict() for q in self.queries]}


@dataclass(frozen=True)
class Or(Query):
    queries: tuple

    def column(self, mode="find", field=F.col):
        out = F.lit(False)
        for q in self.queries:
            out = out | q.column(mode, field)
        return out

    def simplify(self):
        q = _flat(Or, self.queries)
        return q[0] if len(q) == 1 else Or(q)

    def to_dict(self):
        return {"union": [q.to_dict() for q in self.queries]}


@dataclass(frozen=True)
class IntersectsCap(Query):
    """Features within ``radius`` metres of a centre. A native box test stands before the exact one."""

    lat: float
    lng: float
    radius: float

    def column(self, mode="find", field=F.col):
        points, polygons = field("points"), field("polygons")
        box = geo.near_box(points, polygons, self.lat, self.lng, self.radius)
        touches = geo.cap_touches(field("type"), F.coalesce(points, F.array().cast(geo.PATH)), F.coalesce(polygons, F.array().cast(geo.AREA)), F.lit(self.lat), F.lit(self.lng), F.lit(self.radius))
        near = F.when(field("type") == "point", geo.distance(F.get(points, F.lit(0)), geo.ll(self.lat, self.lng)) <= self.radius).otherwise(touches)
        return F.coalesce(box & near, F.lit(False))

    def to_dict(self):
        return {"intersectsCap": {"lat": self.lat, "lng": self.lng, "radius": self.radius}}


@dataclass(frozen=True)
class IntersectsGeometry(Query):
    """Features that meet a point, path or area, by the rules of each pair of kinds."""

    kind: str
    coordinates: tuple  # ((lat, lng), ...) of a point or path; polygons of loops of points of an area

    def column(self, mode="find", field=F.col):
        return F.coalesce(geo.meets(field("type"), field("points"), field("polygons"), self.kind, self.coordinates), F.lit(False))

    def to_dict(self):
        return {f"intersects{self.kind.capitalize()}": self.coordinates}


@dataclass(frozen=True)
class MightIntersect(Query):
    """A candidate filter by tiles: as a predicate it is true of everything."""

    south: float
    west: float
    north: float
    east: float

    def column(self, mode="find", field=F.col):
        if mode != "find":
            return F.lit(True)
        return F.coalesce(F.exists(geo.vertices(field("points"), field("polygons")), lambda p: p["lat"].between(self.south, self.north) & p["lng"].between(self.west, self.east)), F.lit(False))

    def to_dict(self):
        return {"mightIntersect": [self.south, self.west, self.north, self.east]}


def intersecting(kind: str, coordinates) -> Query:
    """No geometry gives the empty query."""
    return IntersectsGeometry(kind, coordinates) if coordinates else Empty()


def intersects_feature(feature) -> Query:
    """Features that meet the geometry of one feature (a DataFrame of a row, of which geometry and kind are read); one without geometry meets nothing."""
    r = feature.select("type", "points", "polygons").first()
    if r is None or not (r[1] or r[2]):
        return Empty()
    if r[2]:
        return intersecting("area", tuple(tuple(tuple(tuple(p) for p in loop) for loop in poly) for poly in r[2]))
    return intersecting("point", tuple(r[1][0])) if r[0] == "point" else intersecting("path", tuple(tuple(p) for p in r[1]))


def intersects_cells(tokens) -> Query:
    """Features that meet any of the cells with these tokens."""
    from terrane.functions import cells, sphere as S

    loops = [tuple((float(a), float(b)) for a, b in S.latlng(cells.corners(cells.from_token(t)))) for t in tokens]
    return intersecting("area", tuple((x,) for x in loops))


def from_dict(d: dict) -> Query:
    (name, v), = d.items()
    if name == "tagged":
        return Tagged(v["key"], v["value"])
    if name == "typed":
        return Typed(v["type"], from_dict(v["query"]))
    if name in ("intersection", "union"):
        return (And if name == "intersection" else Or)(tuple(map(from_dict, v)))
    if name == "intersectsCap":
        return IntersectsCap(v["lat"], v["lng"], v["radius"])
    if name == "mightIntersect":
        return MightIntersect(*v)
    if name.startswith("intersects"):
        return IntersectsGeometry(name[10:].lower(), v)
    return {"all": All, "empty": Empty, "isValid": IsValid}[name]() if name != "keyed" else Keyed(v)


def tokens(tags: Column | None = None) -> Column:
    """The search tokens of a feature's tags, sorted: ``*``, ``key=value`` of ``#`` keys and ``key`` of ``@`` keys, without the mark."""
    tags = F.col("tags") if tags is None else tags
    own = F.transform(
        F.filter(tags, lambda t: t["key"].startswith("#") | t["key"].startswith("@")),
        lambda t: F.when(t["key"].startswith("#"), F.concat(F.substring(t["key"], 2, 1 << 30), F.lit("="), t["value"])).otherwise(F.substring(t["key"], 2, 1 << 30)),
    )
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lit("*")), own)))
