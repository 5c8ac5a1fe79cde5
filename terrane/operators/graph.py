"""Street graphs: segments, edge costs, bounded shortest paths for many origins, and what follows from them.

Paths are cut into segments at graph nodes (ends of paths, points of more than
one path, points with tags) by window functions. Searches run over all origins at
once, as rounds of joins in which each origin's frontier is relaxed along
segments: the state is a table, so neither the graph nor the number of origins
has to fit in a task. A graph that is small, by count and bytes, is broadcast instead and
searched by a heap per origin, with the same results. A node is reached when
``distance + weight`` is *below* the limit.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions import geo, sphere
from terrane.operators.proximity import Grid, aside, cell_of, cover_box
from terrane.plans.lineage import cut
from terrane.plans.once import once
from terrane.plans.skew import small
from terrane.query import first_value
from terrane.world import KEY, World

#: Segments up to which the graph is broadcast to the searching tasks, as arrays of numbers of so many bytes each.
BROADCAST_SEGMENTS, SEGMENT_BYTES = 10_000_000, 16
#: Bytes of the arrays and of the names of nodes and paths, each once.
BROADCAST_BYTES = 256 << 20
WALKING_SPEED = 1.25
#: The tag of paths that join features to the network, and the key of a factor on a path's cost. Options ``connection`` (``key=value``) and ``weight`` name others.
CONNECTION, WEIGHT = ("network", "connection"), "network:weight"
#: Kinds of highway that no vehicle takes.
NO_VEHICLES = ("footway", "steps", "corridor", "path", "pedestrian", "cycleway", "bridleway", "escape", "proposed", "construction")


def text(id: Column) -> Column:
    return F.concat_ws("/", id["type"], id["ns"], id["value"].cast("string"))


def segments(world: World) -> DataFrame:
    """Directed segments ``(path, first, last, first_node, last_node, forward, metres, tags)`` between graph nodes, both ways."""
    paths = world.features.where("type = 'path'")
    steps = paths.select(text(F.struct(*KEY)).alias("path"), "tags", F.posexplode(F.arrays_zip(F.col("refs").alias("ref"), F.col("points").alias("at"))).alias("i", "p"))
    steps = steps.select("path", "tags", "i", text(F.col("p.ref")).alias("node"), F.col("p.at").alias("at"))
    per = Window.partitionBy("path")
    uses = steps.groupBy("node").agg(F.count_distinct("path").alias("paths"))
    tagged = world.features.where("type = 'point' AND size(tags) > 0").select(text(F.struct(*KEY)).alias("node"), F.lit(True).alias("tagged"))
    steps = steps.join(uses, "node").join(tagged, "node", "left")
    steps = steps.withColumn("leg", F.coalesce(geo.distance(F.lag("at").over(per.orderBy("i")), F.col("at")), F.lit(0.0)))
    steps = steps.withColumn("far", F.sum("leg").over(per.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.max("i").over(per))
    nodes = steps.where((F.col("i") == 0) | (F.col("i") == F.col("end")) | (F.col("paths") > 1) | F.coalesce("tagged", F.lit(False)))
    nxt = lambda c: F.lead(c).over(per.orderBy("i"))
    there = nodes.select("path", "tags", F.col("i").alias("a"), nxt("i").alias("b"), F.col("node").alias("from"), nxt("node").alias("to"), (nxt("far") - F.col("far")).alias("metres")).where("b IS NOT NULL")
    way = lambda a, b, u, v, ahead: F.struct(F.col(a).alias("first"), F.col(b).alias("last"), F.col(u).alias("first_node"), F.col(v).alias("last_node"), F.lit(ahead).alias("forward"))
    # Both directions from one row: the windows run once.
    return there.select("path", "tags", F.inline(F.array(way("a", "b", "from", "to", True), way("b", "a", "to", "from", False))), "metres")


# Weights: (usable, cost) of a segment ----------------------------------------


def _is(key: str, value: str) -> Column:
    return F.coalesce(first_value(key) == value, F.lit(False))


def _connection(o: Mapping[str, str]) -> Column:
    return _is(*(o["connection"].split("=", 1) if "connection" in o else CONNECTION))


def _base(o: Mapping[str, str]) -> Column:
    return F.col("metres") * F.coalesce(first_value(o.get("weight", WEIGHT)).try_cast("double"), F.lit(1.0))


def _highway(o: Mapping[str, str]) -> Column:
    return first_value("#highway").isNotNull() | _connection(o)


def _vehicle(o: Mapping[str, str], bus: bool) -> Column:
    way = ~_is("oneway", "yes") | F.col("forward")
    road = first_value("#highway").isNotNull() & ~F.coalesce(first_value("#highway").isin(*NO_VEHICLES), F.lit(False))
    if bus:
        way = way | _is("oneway:bus", "no")
        road = road & (~_is("access", "no") | _is("bus", "yes"))
    return way & (_connection(o) | road)


def weights(options: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """Usable and cost of segments by options ``mode`` (simple, highway, walk, bus, car, transit), ``walk:speed``, ``peak``, ``elevation...``.

    Walking costs metres *times* speed. An unknown mode is an error.
    """
    o = dict(options or {})
    mode = o.get("mode", "walk")
    speed = float(o.get("walk:speed", WALKING_SPEED))
    if mode == "simple":
        return F.lit(True), _base(o)
    if mode == "highway":
        usable, cost = _highway(o), _base(o)
    elif mode in ("walk", "transit"):
        usable, cost = _highway(o), _base(o) * speed
    elif mode in ("bus", "car"):
        usable, cost = _vehicle(o, mode == "bus"), _base(o)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "transit":
        timed = first_value("gtfs:peak") if o.get("peak", "no") == "yes" else first_value("gtfs:off-peak")
        gtfs = F.split("path", "/")[1] == "gtfs"
        usable = F.when(gtfs, F.col("forward")).otherwise(usable)
        cost = F.when(gtfs, F.coalesce(timed.try_cast("double"), cost)).otherwise(cost)
    if o.get("elevation") == "yes":
        up, down = float(o.get("elevation:uphill", 1.0)), float(o.get("elevation:downhill", 0.0))
        cost = cost + F.coalesce("climb", F.lit(0.0)) * 6 * up + F.coalesce("fall", F.lit(0.0)) * 6 * down
    return usable, cost


def with_climb(segs: DataFrame, world: World) -> DataFrame:
    """Segments with metres of climb and fall along their path's order, from the ``ele`` of its points; the last known one carries over gaps."""
    steps = world.features.where("type = 'path'").select(text(F.struct(*KEY)).alias("path"), F.posexplode("refs").alias("i", "ref")).withColumn("node", text(F.col("ref")))
    ele = world.features.where("type = 'point'").select(text(F.struct(*KEY)).alias("node"), first_value("ele").try_cast("double").alias("ele")).where("ele IS NOT NULL")
    per = Window.partitionBy("path").orderBy("i")
    known = steps.join(ele, "node", "left").withColumn("e", F.last("ele", True).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    d = F.coalesce(F.col("e") - F.lag("e").over(per), F.lit(0.0))
    climb = known.select("path", "i", F.greatest(d, F.lit(0.0)).alias("c"), F.greatest(-d, F.lit(0.0)).alias("f"))
    total = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = climb.select("path", "i", F.sum("c").over(total).alias("c"), F.sum("f").over(total).alias("f"))
    a = sums.select("path", F.least(F.lit(1 << 30), "i").alias("lo"), F.col("c").alias("c0"), F.col("f").alias("f0"))
    b = sums.select("path", F.col("i").alias("hi"), F.col("c").alias("c1"), F.col("f").alias("f1"))
    s = segs.withColumn("lo", F.least("first", "last")).withColumn("hi", F.greatest("first", "last"))
    return s.join(a, ["path", "lo"]).join(b, ["path", "hi"]).withColumn("climb", F.col("c1") - F.col("c0")).withColumn("fall", F.col("f1") - F.col("f0")).drop("lo", "hi", "c0", "c1", "f0", "f1")


def edges(segs: DataFrame, options: Mapping[str, str] | None = None) -> DataFrame:
    """``(a, b, path, cost)`` of usable segments."""
    usable, cost = weights(options)
    return segs.where(usable).select(F.col("first_node").alias("a"), F.col("last_node").alias("b"), "path", cost.alias("cost"))


# Searches --------------------------------------------------------------------


def reach(origins: DataFrame, graph: DataFrame, limit: float, broadcast_up_to: int = BROADCAST_SEGMENTS) -> DataFrame:
    """``(origin, node, distance, hops, via, prev)`` of every node within ``limit`` of ``origins`` ``(origin, node)``.

    Of ways of equal distance the one with the fewest segments is taken, then the
    least node before and the least path to it, so the result does not depend on
    how it is found. An origin may start at several nodes, all at distance 0.
    """
    graph = cut(graph)
    if _small(graph, broadcast_up_to):
        return _reach_broadcast(origins, graph, limit)
    return _reach_joins(origins, graph, limit)


def _small(graph: DataFrame, up_to: int) -> bool:
    """Whether ``graph`` (cut) may be broadcast as arrays: by segments, and by bytes of theirs and of the names, each once."""
    n = graph.count()
    if n > up_to:
        return False
    names = graph.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("x")) for k, c in ((0, "a"), (0, "b"), (1, "path"))]))).distinct()
    size = names.agg(F.coalesce(F.sum(F.octet_length("x") + 12), F.lit(0))).first()[0]
    return n * SEGMENT_BYTES + size <= BROADCAST_BYTES


_REACHED = "origin string, node string, distance double, hops int, via string, prev string"


def _reach_joins(origins: DataFrame, graph: DataFrame, limit: float) -> DataFrame:
    none = F.lit(None).cast("string")
    best = cut(origins.select("origin", "node", F.lit(0.0).alias("distance"), F.lit(0).alias("hops"), none.alias("via"), none.alias("prev")).distinct())
    frontier = best
    rank = F.struct("distance", "hops", "prev", "via")
    while True:
        step = frontier.select("origin", F.col("node").alias("a"), "distance", "hops").join(graph, "a")
        step = step.select("origin", F.col("b").alias("node"), (F.col("distance") + F.col("cost")).alias("distance"), (F.col("hops") + 1).alias("hops"), F.col("path").alias("via"), F.col("a").alias("prev")).where(F.col("distance") < limit)
        step = step.groupBy("origin", "node").agg(F.min(rank).alias("s"))
        old = best.select("origin", "node", rank.alias("_s"))
        # An equal way by another node changes where the node is reached from, but leads no way on.
        moved = (F.col("s.distance") < F.col("_s.distance")) | ((F.col("s.distance") == F.col("_s.distance")) & (F.col("s.hops") < F.col("_s.hops")))
        new = step.join(old, ["origin", "node"], "left").where("_s IS NULL OR s < _s")
        new = cut(new.select("origin", "node", "s.distance", "s.hops", "s.via", "s.prev", (F.col("_s").isNull() | moved).alias("on")))
        if new.isEmpty():
            return best
        best = cut(best.join(new.select("origin", "node"), ["origin", "node"], "left_anti").unionByName(new.drop("on")))
        frontier = new.where("on")


class _Compact:
    """A graph as arrays: nodes and paths are numbered in their order, segments lie by the node they leave."""

    #: Nodes whose ways are kept as lists at once.
    KEPT = 50_000

    def __init__(self, nodes: pa.Array, paths: pa.Array, a: np.ndarray, b: np.ndarray, via: np.ndarray, cost: np.ndarray):
        self.nodes, self.paths = nodes, paths
        order = np.argsort(a, kind="stable")
        self.to, self.via, self.cost = b[order], via[order], cost[order]
        self.starts = np.searchsorted(a[order], np.arange(len(nodes) + 1))
        self.ways: dict[int, list] = {}

    def numbers(self, names: pa.Array) -> np.ndarray:
        """Of nodes by name; -1 for those that no segment touches."""
        return _number(names, self.nodes)

    def out(self, v: int) -> list:
        if v not in self.ways:
            if len(self.ways) >= self.KEPT:
                self.ways.clear()
            s = slice(self.starts[v], self.starts[v + 1])
            self.ways[v] = list(zip(self.to[s].tolist(), self.via[s].tolist(), self.cost[s].tolist()))
        return self.ways[v]

    def search(self, begin: list[int], limit: float) -> dict[int, tuple]:
        """``(distance, hops, node before, path)`` by node."""
        best = {v: (0.0, 0, -1, -1) for v in begin}
        heap, done = [(0.0, 0, v) for v in begin], set()
        heapq.heapify(heap)
        push, pop, ways = heapq.heappush, heapq.heappop, self.ways
        while heap:
            d, h, v = pop(heap)
            if v in done:
                continue
            done.add(v)
            h += 1
            for b, path, cost in ways[v] if v in ways else self.out(v):
                far = d + cost
                if far < limit:
                    old = best.get(b)
                    if old is None or far < old[0] or far == old[0] and h < old[1]:
                        push(heap, (far, h, b))
                        best[b] = (far, h, v, path)
                    elif far == old[0] and h == old[1] and (v, path) < old[2:]:
                        best[b] = (far, h, v, path)
        return best


def _number(names: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(names, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def _column(df: DataFrame, name: str) -> pa.Array:
    """The different values of a column in order, for the driver."""
    got = df.select(name).distinct().toArrow().column(0).combine_chunks()
    return got.take(pc.sort_indices(got)).cast(pa.string())


def _compact(graph: DataFrame) -> _Compact:
    """``graph`` (cut) on the driver. Names come there once each; segments are numbered where they are."""
    nodes = _column(graph.select("a").union(graph.select("b")), "a")
    paths = _column(graph, "path")
    names = graph.sparkSession.sparkContext.broadcast((nodes, paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := list(batches):
            t = pa.Table.from_batches(rows).combine_chunks()
            col = lambda c: t[c].combine_chunks().cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(_number(col("a"), names.value[0])), pa.array(_number(col("b"), names.value[0])), pa.array(_number(col("path"), names.value[1])), t["cost"].combine_chunks()], ["a", "b", "via", "cost"])

    t = graph.select("a", "b", "path", F.col("cost").cast("double").alias("cost")).mapInArrow(run, "a int, b int, via int, cost double").toArrow()
    names.destroy()
    arrays = [t[c].to_numpy().astype(k) for c, k in (("a", np.int32), ("b", np.int32), ("via", np.int32), ("cost", float))]
    return _Compact(nodes, paths, *arrays)


#: Origins whose results make up one batch, and those whose starts are looked up at once, as each time all nodes are hashed.
TOGETHER, LOOKED_UP = 1000, 200_000


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    rows: list[pa.RecordBatch] = []
    for batch in batches:
        rows.append(batch)
        if sum(x.num_rows for x in rows) >= LOOKED_UP:
            yield pa.Table.from_batches(rows)
            rows = []
    if rows:
        yield pa.Table.from_batches(rows)


def _searched(origins: DataFrame, graph: DataFrame, limit: float, emit: Callable[[_Compact, pa.Array, list], pa.RecordBatch], schema: str, compact: _Compact | None = None) -> DataFrame:
    """What ``emit`` makes of some origins' names, and for each of them its ``search`` and the starts that no segment touches."""
    shared = graph.sparkSession.sparkContext.broadcast(compact or _compact(graph))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for rows in _gathered(batches):
            starts = rows.column("starts").combine_chunks()
            flat, offsets = starts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(starts).to_numpy())]).tolist()
            names, at = rows.column("origin").combine_chunks(), g.numbers(flat).tolist()
            for k in range(0, rows.num_rows, TOGETHER):
                found = []
                for i, j in zip(offsets[k : k + TOGETHER], offsets[k + 1 : k + TOGETHER + 1]):
                    alone = [flat[x].as_py() for x in range(i, j) if at[x] < 0] if -1 in at[i:j] else []
                    found.append((g.search(sorted(x for x in at[i:j] if x >= 0), limit), alone))
                yield emit(g, names.slice(k, TOGETHER), found)

    each = origins.groupBy("origin").agg(F.array_sort(F.collect_set("node")).alias("starts"))
    want = 4 * origins.sparkSession.sparkContext.defaultParallelism
    # Origins that are next to each other by name often are in place, and search the same nodes.
    return each.repartitionByRange(want, "origin").sortWithinPartitions("origin").mapInArrow(run, schema)


def _reach_broadcast(origins: DataFrame, graph: DataFrame, limit: float) -> DataFrame:
    def emit(g: _Compact, names: pa.Array, found: list) -> pa.RecordBatch:
        node, far = [], []
        for best, _ in found:
            node += best.keys()
            far += best.values()
        d, h, u, p = zip(*far) if far else ((), (), (), ())
        of = np.repeat(np.arange(len(found), dtype=np.int32), [len(best) for best, _ in found])
        lone = [(i, x) for i, (_, alone) in enumerate(found) for x in alone]
        known = lambda x, i: x.take(pa.array(np.where((i := np.array(i, np.int32)) < 0, 0, i), mask=i < 0))
        more = lambda x, rest, kind: pa.concat_arrays([x, pa.array(rest, kind)]) if lone else x
        none = [None] * len(lone)
        return pa.RecordBatch.from_arrays([
            names.take(pa.array(np.concatenate([of, np.array([i for i, _ in lone], np.int32)]))), more(known(g.nodes, node), [x for _, x in lone], pa.string()), more(pa.array(d, pa.float64()), [0.0] * len(lone), pa.float64()),
            more(pa.array(h, pa.int32()), [0] * len(lone), pa.int32()), more(known(g.paths, p), none, pa.string()), more(known(g.nodes, u), none, pa.string()),
        ], ["origin", "node", "distance", "hops", "via", "prev"])

    return _searched(origins, graph, limit, emit, _REACHED)


def starts(world: World, origins: DataFrame, graph: DataFrame) -> DataFrame:
    """Where searches begin: a point that touches a usable path at itself, an area at each of its points that does; others nowhere."""
    on = graph.select(F.col("a").alias("node")).distinct()
    points = origins.where("type = 'point'").select(text(F.struct(*KEY)).alias("origin"), text(F.struct(*KEY)).alias("node"))
    areas = world.area_points().join(origins.where("type = 'area'"), KEY, "left_semi").select(text(F.struct(*KEY)).alias("origin"), text(F.col("target")).alias("node"))
    return points.unionByName(areas).join(on, "node", "left_semi").select("origin", "node")


def ends(world: World, found: DataFrame) -> DataFrame:
    """``(node, destination, kind)``: where ``found`` (features) are met: points (kind 0) at themselves, areas (1) at each of their points."""
    points = found.where("type = 'point'").select(text(F.struct(*KEY)).alias("node"), text(F.struct(*KEY)).alias("destination"), F.lit(0).alias("kind"))
    areas = world.area_points().join(found.where("type = 'area'").select(*KEY), KEY, "left_semi").select(text(F.col("target")).alias("node"), text(F.struct(*KEY)).alias("destination"), F.lit(1).alias("kind"))
    return points.unionByName(areas).distinct()


def hits(origins: DataFrame, graph: DataFrame, limit: float, to: DataFrame, broadcast_up_to: int = BROADCAST_SEGMENTS) -> DataFrame:
    """``reachable`` of the search from ``origins`` (of ``starts``) for the ``ends`` ``to``: where the graph is broadcast, only what is found leaves the search."""
    graph, to = cut(graph), cut(to)
    if not _small(graph, broadcast_up_to):
        reached = _reach_joins(origins, graph, limit).select("origin", "node", "distance")
        points = reached.join(to.where("kind = 0"), "node")
        areas = reached.where("distance > 0").join(to.where("kind = 1"), "node")
        areas = areas.groupBy("origin", "destination", "kind").agg(F.min("distance").alias("distance"))
        return points.select("origin", "destination", "kind", "distance").unionByName(areas)
    g = _compact(graph)
    g.mark = _marked(g, to.where("kind = 0"))
    g.areas = _column(to.where("kind = 1"), "destination")
    at, area = _numbered(to.where("kind = 1").select("node", "destination"), (g.nodes, g.areas), "node int, destination int")
    order = np.argsort(at, kind="stable")
    g.area, g.area_starts = area[order], np.searchsorted(at[order], np.arange(len(g.nodes) + 1))

    def emit(g: _Compact, names: pa.Array, found: list) -> pa.RecordBatch:
        of, node, far = _flat(found)
        on = g.mark[node]
        rows = [(of[on], g.nodes.take(pa.array(node[on])), 0, far[on])]
        if len(g.area):
            n = np.where(far > 0, g.area_starts[node + 1] - g.area_starts[node], 0)
            each = np.repeat(np.arange(len(node)), n)
            met = g.area[np.repeat(g.area_starts[node], n) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)]
            order = np.lexsort((far[each], met, of[each]))
            key = (of[each].astype(np.int64) * len(g.areas) + met)[order]
            first = order[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else order
            rows.append((of[each[first]], g.areas.take(pa.array(met[first])), 1, far[each[first]]))
        kind = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in rows])
        return pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate([x[0] for x in rows]))), pa.concat_arrays([x[1] for x in rows]), pa.array(kind), pa.array(np.concatenate([x[3] for x in rows]))], ["origin", "destination", "kind", "distance"])

    return _searched(origins, graph, limit, emit, "origin string, destination string, kind int, distance double", g)


def _numbered(df: DataFrame, among: tuple[pa.Array, pa.Array], schema: str) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of names as numbers, on the driver; rows with a name that isn't known are left out."""
    shared = df.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := list(batches):
            t = pa.Table.from_batches(rows)
            x, y = (_number(t[i].combine_chunks().cast(pa.string()), shared.value[i]) for i in (0, 1))
            keep = (x >= 0) & (y >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(y[keep])], t.column_names)

    t = df.mapInArrow(run, schema).toArrow()
    return t[0].to_numpy().astype(np.int32), t[1].to_numpy().astype(np.int32)


def _marked(g: _Compact, nodes: DataFrame) -> np.ndarray:
    mark = np.zeros(len(g.nodes), bool)
    mark[_numbered(nodes.select("node", F.col("node").alias("same")), (g.nodes, g.nodes), "node int, same int")[0]] = True
    return mark


def _flat(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of searches the place in the batch, node and distance of all nodes."""
    node, far = [], []
    for best, _ in found:
        node += best
        far += [x[0] for x in best.values()]
    return np.repeat(np.arange(len(found), dtype=np.int32), [len(best) for best, _ in found]), np.array(node, np.int32), np.array(far, float)


def routes_to(origins: DataFrame, graph: DataFrame, limit: float, to: DataFrame, broadcast_up_to: int = BROADCAST_SEGMENTS) -> DataFrame:
    """``routes`` to the points among the ``ends`` ``to``, followed back within the search where the graph is broadcast."""
    graph, to = cut(graph), cut(to.where("kind = 0"))
    if not _small(graph, broadcast_up_to):
        return routes(_reach_joins(origins, graph, limit), to)
    g = _compact(graph)
    g.mark = _marked(g, to)

    def emit(g: _Compact, names: pa.Array, found: list) -> pa.RecordBatch:
        of, rows = [], []
        for i, (best, _) in enumerate(found):
            before = len(rows)
            for v in np.array(list(best), np.int32)[g.mark[np.array(list(best), np.int32)]].tolist():
                at, (d, h, u, via) = v, best[v]
                while via >= 0:
                    rows.append((v, h - 1, via, at, d))
                    at = u
                    d, h, u, via = best[at]
            of.append(len(rows) - before)
        v, o, p, n, d = zip(*rows) if rows else ((),) * 5
        take = lambda x, i: x.take(pa.array(i, pa.int32()))
        return pa.RecordBatch.from_arrays([take(names, np.repeat(np.arange(len(found)), of)), take(g.nodes, v), pa.array(o, pa.int32()), take(g.paths, p), take(g.nodes, n), pa.array(d, pa.float64())], ["origin", "destination", "ord", "via", "node", "cost"])

    return _searched(origins, graph, limit, emit, "origin string, destination string, ord int, via string, node string, cost double", g)


def uses(origins: DataFrame, graph: DataFrame, limit: float, to: DataFrame, broadcast_up_to: int = BROADCAST_SEGMENTS) -> DataFrame:
    """``paths_to_reach`` of ``routes_to``, counted within the search where the graph is broadcast."""
    graph, to = cut(graph), cut(to.where("kind = 0"))
    if not _small(graph, broadcast_up_to):
        return paths_to_reach(routes(_reach_joins(origins, graph, limit), to))
    g = _compact(graph)
    g.mark = _marked(g, to)

    def emit(g: _Compact, names: pa.Array, found: list) -> pa.RecordBatch:
        n: dict[int, int] = {}
        for best, _ in found:
            for v in np.array(list(best), np.int32)[g.mark[np.array(list(best), np.int32)]].tolist():
                last, (_, _, u, via) = -1, best[v]
                while via >= 0:
                    if via != last:
                        n[via] = n.get(via, 0) + 1
                        last = via
                    _, _, u, via = best[u]
        return pa.RecordBatch.from_arrays([g.paths.take(pa.array(list(n), pa.int32())), pa.array(list(n.values()), pa.int64())], ["path", "n"])

    return _searched(origins, graph, limit, emit, "path string, n bigint", g).groupBy("path").agg(F.sum("n").alias("n"))


def reached_area(origins: DataFrame, graph: DataFrame, limit: float, at: DataFrame, broadcast_up_to: int = BROADCAST_SEGMENTS) -> DataFrame:
    """``(origin, steradians)`` of the convex hull of what is reached of ``at`` ``(node, p)``; 0 of fewer than three places."""
    graph, at = cut(graph), cut(at)
    if not _small(graph, broadcast_up_to):
        placed = _reach_joins(origins, graph, limit).join(at, "node")
        hull = placed.groupBy("origin").agg(F.collect_list("p").alias("ps")).select("origin", geo.hull_of(F.col("ps")).alias("a"))
        return hull.select("origin", (F.coalesce(geo.area(F.col("a")), F.lit(0.0)) / geo.R / geo.R).alias("steradians"))
    g = _compact(graph)
    names = graph.sparkSession.sparkContext.broadcast(g.nodes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rows := list(batches):
            t = pa.Table.from_batches(rows)
            node = _number(t["node"].combine_chunks().cast(pa.string()), names.value)
            yield pa.RecordBatch.from_arrays([pa.array(node), t["lat"].combine_chunks(), t["lng"].combine_chunks()], ["node", "lat", "lng"]).filter(pa.array(node >= 0))

    t = at.select("node", "p.lat", "p.lng").mapInArrow(number, "node int, lat double, lng double").toArrow()
    g.place = np.full((len(g.nodes), 3), np.nan)
    g.place[t["node"].to_numpy()] = sphere.unit(np.column_stack([t["lat"].to_numpy(), t["lng"].to_numpy()]))

    def emit(g: _Compact, names: pa.Array, found: list) -> pa.RecordBatch:
        of, node, _ = _flat(found)
        v = g.place[node]
        known = ~np.isnan(v[:, 0])
        i, area = sphere.hull_areas(of[known], v[known])
        # Origins at which no place is known have no hull.
        return pa.RecordBatch.from_arrays([names.take(pa.array(i)), pa.array(area)], ["origin", "steradians"])

    return _searched(origins, graph, limit, emit, "origin string, steradians double", g)


def reachable(world: World, reached: DataFrame, found: DataFrame) -> DataFrame:
    """``(origin, destination, kind, distance)``: reached points, and areas through their reached points, that are in ``found`` (features). An area that touches only the start isn't recorded."""
    points = reached.select("origin", F.col("node").alias("destination"), F.lit(0).alias("kind"), "distance")
    on = world.area_points().select(text(F.struct(*KEY)).alias("destination"), text(F.col("target")).alias("node"))
    areas = reached.where("distance > 0").join(on, "node").groupBy("origin", "destination").agg(F.min("distance").alias("distance")).select("origin", "destination", F.lit(1).alias("kind"), "distance")
    keep = found.select(text(F.struct(*KEY)).alias("destination")).distinct()
    return points.unionByName(areas).join(keep, "destination", "left_semi").select("origin", "destination", "kind", "distance")


def closest(hits: DataFrame) -> DataFrame:
    """The nearest of ``reachable`` for each origin, points before areas, then by id."""
    return hits.groupBy("origin").agg(F.min(F.struct("distance", "kind", "destination")).alias("m")).select("origin", F.col("m.destination").alias("destination"), F.col("m.distance").alias("distance"))


def buildings(world: World) -> DataFrame:
    return world.features.where("type = 'area'").where(first_value("#building").isNotNull())


def building_access(world: World, reached: DataFrame) -> DataFrame:
    """``(key, value)``: each origin with the areas tagged ``#building`` that are reached from it."""
    return reachable(world, reached, buildings(world)).select(F.col("origin").alias("key"), F.col("destination").alias("value"))


def accessible_all(origins: DataFrame, hits: DataFrame, flip: bool = False) -> DataFrame:
    """``(key, value)``: origin to destination without the origin itself; an origin with none keeps a null, unless flipped."""
    pairs = hits.where("origin <> destination").select(F.col("origin").alias("key"), F.col("destination").alias("value"))
    if flip:
        return pairs.select(F.col("value").alias("key"), F.col("key").alias("value"))
    every = origins.select(text(F.struct(*KEY)).alias("key")).distinct()
    # The pairs, which may be very many, stay where they are.
    pairs = cut(pairs)
    return pairs.unionByName(every.join(pairs.select("key").distinct(), "key", "left_anti").withColumn("value", F.lit(None).cast("string")))


def routes(reached: DataFrame, destinations: DataFrame) -> DataFrame:
    """``(origin, destination, ord, via, node, cost)``: the steps of the way to each destination.

    Ways are followed back in rounds that double the number of steps, however long they are.
    """
    back = cut(reached.where("via IS NOT NULL"))
    at = back.join(destinations.select(F.col("destination").alias("node")).distinct(), "node", "left_semi")
    here = cut(at.select("origin", F.col("node").alias("destination"), "node"))
    up = back.select("origin", "node", F.col("prev").alias("to"))
    out = here
    while True:
        # Of ways whose last 2^k steps are known, the 2^k before those.
        met = cut(out.join(up.hint("merge"), ["origin", "node"]).select("origin", "destination", F.col("to").alias("node")))
        if met.isEmpty():
            break
        out = out.unionByName(met)
        onward = up.select("origin", F.col("node").alias("to"), F.col("to").alias("_to"))
        up = cut(up.join(onward.hint("merge"), ["origin", "to"]).select("origin", "node", F.col("_to").alias("to")))
    steps = out.join(back.hint("merge"), ["origin", "node"])
    return steps.select("origin", "destination", (F.col("hops") - 1).alias("ord"), "via", "node", F.col("distance").alias("cost"))


def paths_to_reach(steps: DataFrame) -> DataFrame:
    """``(path, n)``: the number of destinations' routes that use a path; a path taken in one run counts once."""
    w = Window.partitionBy("origin", "destination").orderBy("ord")
    runs = steps.withColumn("same", F.coalesce(F.lag("via").over(w) == F.col("via"), F.lit(False)))
    return runs.where("NOT same").groupBy(F.col("via").alias("path")).agg(F.count("*").alias("n"))


def degree(segs: DataFrame) -> DataFrame:
    return segs.groupBy(F.col("first_node").alias("node")).agg(F.count("*").alias("n"))


def network(world: World, segs: DataFrame, threshold: float) -> DataFrame:
    """Paths of the street network: those from whose component a point farther than ``threshold`` metres from their start is reached.

    Components are labelled by rounds of joins, in which each node takes the least
    label around it and then that label's own label, so labels travel twice as far
    each round. A start is kept if one of its component's four extreme nodes is far
    enough, and left out if no corner of the bounding box is; between the two all
    nodes of the component are measured.
    """
    e = cut(segs.select("first_node", "last_node").distinct())
    label = cut(e.select(F.col("first_node").alias("node"), F.col("first_node").alias("label")).distinct())
    while True:
        low = e.join(label, e.last_node == label.node).groupBy("first_node").agg(F.min("label").alias("low"))
        near = cut(label.join(low, label.node == low.first_node, "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("to")))
        over = near.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = cut(near.join(over, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("label")).alias("moved")))
        label = new.select("node", "label")
        if new.where("moved").isEmpty():
            break
    at = world.features.where("type = 'point'").select(text(F.struct(*KEY)).alias("node"), F.col("points")[0].alias("at"))
    placed = label.join(at, "node")
    far = placed.groupBy("label").agg(*[f(F.struct(F.col(f"at.{c}"), "at")).getField("at").alias(n) for n, f, c in (("s", F.min, "lat"), ("n", F.max, "lat"), ("w", F.min, "lng"), ("e", F.max, "lng"))])
    starts_ = segs.where("first = 0").select("path", F.col("first_node").alias("node")).distinct().join(placed, "node").join(far, "label")
    most = lambda ends: F.greatest(*[geo.distance(F.col("at"), x) for x in ends])
    corners = [geo.ll(F.col(y)["lat"], F.col(x)["lng"]) for y in ("s", "n") for x in ("w", "e")]
    # The farthest place of a box is a corner only while no part of it is a quarter of the globe aside.
    bound = (F.col("e.lng") - F.col("w.lng") <= 90.0) & (most(corners) <= threshold)
    starts_ = cut(starts_.select("path", "node", "label", "at", (most([F.col(x) for x in ("s", "n", "w", "e")]) > threshold).alias("far"), bound.alias("near")))
    open_ = starts_.where("NOT far AND NOT near")
    every = placed.select("label", F.col("at").alias("other"))
    reached = open_.select("node", "label", "at").distinct().join(every, "label").where(geo.distance(F.col("at"), F.col("other")) > threshold).select("node").distinct()
    return starts_.where("far").select("path").unionByName(open_.join(reached, "node", "left_semi").select("path")).distinct()


def _feet(points: DataFrame, paths: DataFrame, threshold: float) -> DataFrame:
    """``(id, path, i, foot, metres)``: for each point ``(id, at)`` its foot on each leg of ``paths`` (``path, points``) within ``threshold``, by cells of that size."""
    grid = Grid(threshold)
    paths = paths.select("path", F.transform("points", geo.wrapped).alias("points"))
    legs = paths.select("path", F.posexplode(F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "leg"))
    here = cut(cell_of(points.select("id", geo.wrapped(F.col("at")).alias("at")), grid, "at"))
    cells = cut(here.select("row", "col").distinct())
    # Of few points only the legs that lie in their cells are moved.
    legs = cover_box(legs, grid, threshold, F.array("leg.a", "leg.b"), cells if small(cells) else None)
    met = here.join(legs.hint("merge"), ["row", "col"])
    # The foot on a leg of a street's length: on a plane around the point. Each step is worked out once.
    k = F.cos(F.radians(F.col("at.lat")))
    met = once(met, _x=aside(F.col("leg.a.lng"), F.col("at.lng")) * k, _y=F.col("leg.a.lat") - F.col("at.lat"), _w=aside(F.col("leg.b.lng"), F.col("leg.a.lng")), _h=F.col("leg.b.lat") - F.col("leg.a.lat"))
    dx = F.col("_w") * k
    t = F.try_divide(-(F.col("_x") * dx + F.col("_y") * F.col("_h")), dx * dx + F.col("_h") * F.col("_h"))
    met = once(met, _t=F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0)))))
    met = once(met, foot=geo.ll(F.col("leg.a.lat") + F.col("_t") * F.col("_h"), aside(F.col("leg.a.lng") + F.col("_t") * F.col("_w"), F.lit(0.0))))
    return once(met, metres=geo.distance(F.col("at"), F.col("foot"))).where(F.col("metres") <= threshold)


def connect_nearest(points: DataFrame, paths: DataFrame, threshold: float) -> DataFrame:
    """``(id, path, leg, at, metres)``: for each point ``(id, at)`` the nearest of ``paths`` (``path, points``) within ``threshold``; ``leg`` is the index of the point before the place."""
    met = _feet(points, paths, threshold)
    return met.groupBy("id").agg(F.min(F.struct("metres", "path", "i", "foot")).alias("m")).select("id", "m.path", F.col("m.i").alias("leg"), F.col("m.foot").alias("at"), "m.metres")


def near_paths(points: DataFrame, paths: DataFrame, threshold: float) -> DataFrame:
    """``(id, path, at, metres)``: for each point ``(id, at)`` the nearest place on each of ``paths`` (``path, points``) within ``threshold``."""
    met = _feet(points, paths, threshold).groupBy("id", "path").agg(F.min(F.struct("metres", "i", "foot")).alias("m"))
    return met.select("id", "path", F.col("m.foot").alias("at"), "m.metres")
