"""Parent-child rows of unknown depth: paths, depths, roots, descendants and cycles.

Rows are spread over *fragments* by a hash of the child, so a fragment holds all
parent links of its own nodes. Chains are contracted within each fragment to the
nodes where they leave it (exits); what is left is a smaller graph of the nodes
that other fragments point at (entries). That quotient is solved the same way,
hashed anew, until it fits in one task, and its solution is expanded fragment by
fragment. Where chains are so long that few of their links are within a fragment,
a level contracts across fragments instead: each node that leads to one other and
drew heads while that one drew tails gives way to it. That is a quarter of a chain,
so there are ``O(log n)`` levels however long the chains are.

* ``cyclic_nodes`` looks at all links: a node may have several parents. Within a
  fragment strongly connected parts are found, dead ends dropped, and every node
  with one way on is replaced by that way; nodes with several ways stay in the
  quotient, so it never has more links than its graph. A cycle within a fragment
  shows at once, one across fragments once the quotient is labelled.
* ``paths`` follows each node's first parent (the smallest id by bytes) and gives
  path, depth and root. Where first parents lead into a cycle, the node nearest to
  it with a parent that has a path takes the first such parent instead.
* ``below`` looks at all links and gives every descendant of every node, in rounds
  that double the distance. A pair beyond it is joined at a node that is just so
  far from the ancestor, so rounds are few and a pair is made once for each such
  node, not once for each node between.

Defined results: links with a null end are ignored, repeated links count once. A
node that no parent leads to a root has no root, depth or path. A parent that is
no child itself is a root with depth 0. A node that is its own parent is a cycle.
A node on a cycle is its own descendant, at the length of its shortest cycle. No
links give no rows.

A child with very many parents is split into virtual nodes that share them; a
parent with very many children is met by a broadcast when paths are expanded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.plans.lineage import cut
from terrane.plans.skew import hot_keys, meet

#: Links to a fragment; a quotient of no more links is solved in one task.
FRAGMENT = 100_000
#: Parents of one child beyond which it is split.
MOST_PARENTS = 10_000
#: A quotient of at least this share of its graph's links is next contracted across fragments.
SHRINK = 0.8
#: After which a graph of at least this share, seen from both ends, is a core without chains.
CORE = 0.95


def links(df: DataFrame, child, parent) -> DataFrame:
    """Distinct links ``(child, parent)`` as text."""
    return df.select(child.cast("string").alias("child"), parent.cast("string").alias("parent")).where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct()


def strong(after: list[list[int]]) -> tuple[list[int], int]:
    """The strongly connected part of each node; parts are numbered so that links lead to lower numbers or stay."""
    n = len(after)
    part, low, seen, at = [-1] * n, [0] * n, [0] * n, [0] * n
    stack: list[int] = []
    clock = parts = 0
    for start in range(n):
        if seen[start]:
            continue
        trail = [start]
        while trail:
            v = trail[-1]
            if not seen[v]:
                clock += 1
                seen[v] = low[v] = clock
                stack.append(v)
            ways = after[v]
            while at[v] < len(ways):
                w = ways[at[v]]
                at[v] += 1
                if not seen[w]:
                    trail.append(w)
                    break
                if part[w] < 0:
                    low[v] = min(low[v], seen[w])
            else:
                trail.pop()
                if trail:
                    low[trail[-1]] = min(low[trail[-1]], low[v])
                if low[v] == seen[v]:
                    while True:
                        w = stack.pop()
                        part[w] = parts
                        if w == v:
                            break
                    parts += 1
    return part, parts


def _homes(edges: DataFrame, fragments: int, level: int) -> DataFrame:
    home = lambda c: F.pmod(F.xxhash64(F.lit(level), F.col(c)), F.lit(fragments)).cast("int")
    return edges.select(*edges.columns, home("child").alias("home"), home("parent").alias("phome"))


def _graph(pdf: pd.DataFrame) -> tuple[dict[str, int], list[list[int]], set[int]]:
    """Node numbers, links, and the numbers of nodes at home here."""
    number: dict[str, int] = {}
    after: list[list[int]] = []
    for c, p in zip(pdf["child"], pdf["parent"]):
        for x in (c, p):
            if x is not None and x not in number:
                number[x] = len(after)
                after.append([])
        if p is not None:
            after[number[c]].append(number[p])
    return number, after, {number[c] for c in pdf["child"]}


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """The quotient's links of one fragment. Rows without a parent name the entries."""
    entries = set(pdf.loc[pdf["parent"].isna(), "child"])
    number, after, home = _graph(pdf.where(pdf.notna(), None))
    name = list(number)
    part, parts = strong(after)
    members: list[list[int]] = [[] for _ in range(parts)]
    for v, c in enumerate(part):
        members[c].append(v)
    way: list[str | None] = [None] * parts
    out: set[tuple[str, str]] = set()
    for c in range(parts):
        if not any(v in home for v in members[c]):
            way[c] = name[members[c][0]]  # an exit
            continue
        on = {way[part[w]] for v in members[c] for w in after[v] if part[w] != c} - {None}
        mine = sorted(name[v] for v in members[c] if name[v] in entries)
        if len(on) == 1:
            (way[c],) = on
            out.update((v, way[c]) for v in mine)
        elif on:
            way[c] = fork = mine[0] if mine else name[members[c][0]]
            out.update((fork, x) for x in on)
            out.update((v, fork) for v in mine if v != fork)
    return pd.DataFrame(sorted(out), columns=["child", "parent"], dtype=object)


def _expand(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels of this fragment's nodes on cycles, given those of its entries and exits (rows with ``label``)."""
    labels = pdf.loc[pdf["label"].notna()]
    number, after, home = _graph(pdf.loc[pdf["label"].isna()])
    name = list(number)
    hubs: dict[str, int] = {}
    for node, label in zip(labels["child"], labels["label"]):
        if node not in number:
            continue
        if label not in hubs:
            hubs[label] = len(after)
            after.append([])
        v = number[node]
        if v in home:
            after[hubs[label]].append(v)
        else:
            after[v].append(hubs[label])
    part, parts = strong(after)
    size = [0] * parts
    for c in part:
        size[c] += 1
    label_of: dict[int, str] = {part[h]: label for label, h in hubs.items()}
    for v in range(len(name)):
        label_of.setdefault(part[v], name[v])
    out = [(name[v], label_of[part[v]]) for v in home if size[part[v]] > 1]
    return pd.DataFrame(out, columns=["node", "label"], dtype=object)


def _alive(edges: DataFrame) -> DataFrame:
    """Only nodes with a way in and a way on can lie on a cycle."""
    some = edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
    return some.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent")


def _spread(edges: DataFrame) -> DataFrame:
    """As ``_label``, in as many rounds as a core has links across: each node takes the greatest label that leads to it; those that lead back to their label's node are strong."""
    found = []
    # Each round settles at least the part of the greatest label.
    while not edges.isEmpty():
        label = cut(edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct().withColumn("label", F.col("node")))
        while True:
            came = edges.join(label, edges.child == label.node).groupBy("parent").agg(F.max("label").alias("came"))
            new = cut(label.join(came, label.node == came.parent, "left").select("node", F.greatest("label", F.coalesce("came", "label")).alias("label"), (F.col("came") > F.col("label")).alias("moved")))
            label = new.select("node", "label")
            if new.where("moved").isEmpty():
                break
        mark = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
        own = cut(edges.join(mark("child"), "child").join(mark("parent"), "parent").where("child_label = parent_label").select("child", "parent", F.col("child_label").alias("label")))
        back = cut(own.select("label", F.col("label").alias("node")).distinct())
        fresh = back
        while True:
            reach = own.join(fresh.select("label", F.col("node").alias("parent")), ["label", "parent"]).select("label", F.col("child").alias("node")).distinct()
            fresh = cut(reach.join(back, ["label", "node"], "left_anti"))
            if fresh.isEmpty():
                break
            back = cut(back.unionByName(fresh))
        size = back.groupBy("label").agg(F.count("*").alias("n")).where("n > 1")
        found.append(cut(back.join(size, "label", "left_semi").select("node", "label")))
        gone = back.select("node").distinct()
        edges = cut(_alive(edges.join(gone, edges.child == gone.node, "left_anti").join(gone, edges.parent == gone.node, "left_anti")))
    empty = edges.select(F.col("child").alias("node"), F.col("parent").alias("label")).limit(0)
    for f in found:
        empty = empty.unionByName(f)
    return empty


def _heads(level: int, node: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("coin"), F.lit(level), node), F.lit(2)) == 1


def _turned(edges: DataFrame) -> DataFrame:
    """Links the other way round: they have the same strong parts."""
    return edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))


def _merge(edges: DataFrame, fragment: int, level: int, stuck: int) -> DataFrame:
    """``_label`` by one contraction across fragments. ``stuck``: how many of these did not shrink the graph before."""
    n = edges.count()
    one = edges.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("to")).where("n = 1")
    gone = cut(one.where(_heads(level, F.col("child")) & ~_heads(level, F.col("to"))).select(F.col("child").alias("parent"), "to"))
    rest = cut(edges.join(gone.select(F.col("parent").alias("child")), "child", "left_anti"))
    met = cut(meet(rest, gone, ["parent"], "left"))
    short = cut(met.select("child", F.coalesce("to", "parent").alias("parent")).distinct())
    # What leads back to itself now is on a cycle with what gave way.
    loops = short.where("child = parent").select(F.col("child").alias("node"))
    quotient = cut(_alive(short.where("child <> parent")))
    m = quotient.count()
    labels = cut(_label(_turned(quotient), fragment, level + 1, stuck + 1 if m >= CORE * n else 0, True))
    own = loops.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    labels = cut(labels.unionByName(own))
    name = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
    # One that gave way is on a cycle if what it leads to is on one with something that leads to it.
    back = meet(meet(met.where("to IS NOT NULL"), name("child"), ["child"]), name("to"), ["to"]).where("_child = _to")
    return labels.unionByName(back.select(F.col("parent").alias("node"), F.col("_to").alias("label")).distinct())


def _label(edges: DataFrame, fragment: int, level: int = 0, stuck: int = 0, across: bool = False) -> DataFrame:
    """``(node, label)`` of the nodes on cycles of distinct links without loops; nodes of one strong part share a label."""
    n = edges.count()
    local = "node string, label string"
    if level and n <= fragment:
        whole = edges.withColumn("label", F.lit(None).cast("string")).withColumn("home", F.lit(0))
        return whole.groupBy("home").applyInPandas(lambda pdf: _expand(pdf), local)
    # A core without chains, seen from either end, has short ways: spreading labels along its links needs few rounds.
    if across:
        return _spread(edges) if stuck > 1 else _merge(edges, fragment, level, stuck)
    homed = cut(_homes(edges, max(2, -(-n // fragment)), level))
    out = homed.where("home <> phome")
    none = F.lit(None).cast("string")
    entries = out.select(F.col("parent").alias("child"), none.alias("parent"), F.col("phome").alias("home")).distinct()
    quotient = homed.select("child", "parent", "home").unionByName(entries).groupBy("home").applyInPandas(_contract, "child string, parent string")
    quotient = cut(quotient.distinct())
    rest = cut(_alive(quotient))
    labels = cut(_label(rest, fragment, level + 1, 0, rest.count() >= SHRINK * n))
    given = labels.select(F.col("node").alias("child"), none.alias("parent"), F.pmod(F.xxhash64(F.lit(level), F.col("node")), F.lit(max(2, -(-n // fragment)))).cast("int").alias("home"), "label")
    exits = out.select("home", F.col("parent").alias("node")).distinct().join(labels, "node").select(F.col("node").alias("child"), none.alias("parent"), "home", "label")
    rows = homed.select("child", "parent", "home", none.alias("label")).unionByName(given).unionByName(exits)
    return rows.groupBy("home").applyInPandas(_expand, local)


def cyclic_nodes(edges: DataFrame, fragment: int = FRAGMENT, most_parents: int = MOST_PARENTS) -> DataFrame:
    """``(node)``: every node that is its own ancestor, of ``links``."""
    edges = cut(edges)
    loops = edges.where("child = parent").select(F.col("child").alias("node"))
    plain = edges.where("child <> parent")
    many = plain.groupBy("child").agg(F.count("*").alias("n")).where(F.col("n") > most_parents)
    hot = hot_keys(many, ["child"], "n", least=most_parents)
    if hot is not None:
        mark = F.broadcast(hot)
        split = plain.join(mark, "child", "left")
        pieces = F.ceil(F.col("n") / most_parents)
        # Real ids get a leading n, virtual ones a leading v: they can't clash.
        virtual = F.concat(F.lit("v"), F.pmod(F.xxhash64("parent"), pieces), F.lit(":"), F.col("child"))
        part = F.when(F.col("n").isNotNull(), virtual)
        real = F.concat(F.lit("n"), F.col("child"))
        plain = split.select(F.coalesce(part, real).alias("child"), F.concat(F.lit("n"), F.col("parent")).alias("parent")).unionByName(
            split.where("n IS NOT NULL").select(real.alias("child"), part.alias("parent")).distinct()
        )
        found = _label(plain, fragment).where(F.col("node").startswith("n")).select(F.expr("substring(node, 2)").alias("node"))
    else:
        found = _label(plain, fragment).select("node")
    return found.unionByName(loops).distinct()


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each node's way to the first node that is not at home here: that node (``exit``, null at a cycle) and the nodes before it, or their number."""
    up = dict(zip(pdf["child"], pdf["parent"]))
    step = dict(zip(pdf["child"], pdf["seg"]))
    numbers = len(pdf) > 0 and not hasattr(pdf["seg"].iloc[0], "__len__")
    done: dict[str, tuple] = {}
    for v in up:
        trail, x, on = [], v, set()
        while x in up and x not in done and x not in on:
            trail.append(x)
            on.add(x)
            x = up[x]
        if x in done:
            leave, tail, loop = done[x]
        elif x in on:
            leave, tail, loop = None, None, True
        else:
            leave, tail, loop = x, None, False
        for y in reversed(trail):
            # Chains are linked lists until they are written, so shared ends are kept once.
            tail = None if loop else ((tail or 0) + step[y] if numbers else (y, tail))
            done[y] = (leave, tail, loop)
    rows = []
    for v, (leave, tail, loop) in done.items():
        seg = [] if not numbers else tail or 0
        while not numbers and tail:
            seg.extend(step[tail[0]])
            tail = tail[1]
        rows.append((v, leave, seg, loop))
    return pd.DataFrame(rows, columns=["node", "exit", "seg", "loop"])


def _onward(chains: DataFrame, above: DataFrame, full: bool) -> DataFrame:
    """``chains`` ``(node, exit, seg, loop)`` led on by what their exits' solution is: ``(node, seg, root, loop)``. An exit without a solution is a root."""
    above = above.select(F.col("node").alias("exit"), F.col("seg").alias("_seg"), F.col("root").alias("_root"), F.col("loop").alias("_loop"))
    met = meet(chains, above, ["exit"], "left")
    loop = F.col("loop") | F.coalesce("_loop", F.lit(False))
    seg = F.when(F.col("_root").isNull(), F.col("seg")).otherwise(F.concat("seg", "_seg") if full else F.col("seg") + F.col("_seg"))
    return met.select("node", F.when(~loop, seg).alias("seg"), F.when(~loop, F.coalesce("_root", "exit")).alias("root"), loop.alias("loop"))


def _climb(up: DataFrame, fragment: int, full: bool, level: int = 0, across: bool = False) -> DataFrame:
    """``(node, seg, root, loop)`` of links ``(child, parent, seg)`` with one parent each; ``seg`` is what lies from the node up to before its root, null with the root where ``loop``.

    ``seg`` of a link is the contracted chain it stands for, from the child to before
    the parent: the nodes if ``full``, else their number.
    """
    n = up.count()
    small = level and n <= fragment
    if across and not small:
        gone = up.where(_heads(level, F.col("child")) & ~_heads(level, F.col("parent")))
        gone = cut(gone.select(F.col("child").alias("parent"), F.col("parent").alias("to"), F.col("seg").alias("_seg")))
        rest = cut(up.join(gone.select(F.col("parent").alias("child")), "child", "left_anti"))
        seg = F.when(F.col("to").isNull(), F.col("seg")).otherwise(F.concat("seg", "_seg") if full else F.col("seg") + F.col("_seg"))
        short = cut(meet(rest, gone, ["parent"], "left").select("child", F.coalesce("to", "parent").alias("parent"), seg.alias("seg")))
        above = cut(_climb(short, fragment, full, level + 1, True))
        return above.unionByName(_onward(gone.select(F.col("parent").alias("node"), F.col("to").alias("exit"), F.col("_seg").alias("seg"), F.lit(False).alias("loop")), above, full))
    homed = _homes(up, 1 if small else max(2, -(-n // fragment)), level)
    kind = "array<string>" if full else "bigint"
    chains = homed.select("child", "parent", "seg", "home").groupBy("home").applyInPandas(_follow, f"node string, exit string, seg {kind}, loop boolean")
    if small:
        live = lambda c: F.when(~F.col("loop"), F.col(c))
        return chains.select("node", live("seg").alias("seg"), live("exit").alias("root"), "loop")
    chains = cut(chains)
    entries = homed.where("home <> phome").select(F.col("parent").alias("node")).distinct()
    # An entry on a local cycle leads to itself, so that all that lead to it are on or below a cycle as well.
    quotient = cut(chains.join(entries, "node", "left_semi").select(F.col("node").alias("child"), F.coalesce("exit", "node").alias("parent"), "seg"))
    return _onward(chains, cut(_climb(quotient, fragment, full, level + 1, quotient.count() >= SHRINK * n)), full)


def paths(edges: DataFrame, fragment: int = FRAGMENT, full: bool = True) -> DataFrame:
    """``(node, parent, root, depth, path)`` of every node of ``links``, path from the root down to the node; ``parent`` is the one on the path, else the first.

    Paths take as many nodes as depths add up to; without ``full`` they are left out
    and depth and root cost no more than the links.
    """
    edges = cut(edges)
    up = cut(edges.groupBy("child").agg(F.min("parent").alias("parent")))
    roots = cut(edges.select(F.col("parent").alias("node")).distinct().join(up.select(F.col("child").alias("node")), "node", "left_anti"))
    while True:
        solved = cut(_climb(up.withColumn("seg", F.array("child") if full else F.lit(1).cast("bigint")), fragment, full).select("node", "seg", "root"))
        lost = solved.where("root IS NULL").select(F.col("node").alias("child"))
        whole = solved.where("root IS NOT NULL").select(F.col("node").alias("parent")).unionByName(roots.select(F.col("node").alias("parent")))
        # Each round gives a path to all that first parents lead to one of these.
        other = cut(edges.join(lost, "child", "left_semi").join(whole, "parent", "left_semi").groupBy("child").agg(F.min("parent").alias("_other")))
        if other.isEmpty():
            break
        up = cut(up.join(other, "child", "left").select("child", F.coalesce("_other", "parent").alias("parent")))
    solved = solved.join(up.select(F.col("child").alias("node"), "parent"), "node")
    depth = F.size("seg") if full else F.col("seg")
    below = solved.select("node", "parent", "root", F.when(F.col("root").isNotNull(), depth.cast("int")).alias("depth"), *([F.when(F.col("root").isNotNull(), F.reverse(F.concat("seg", F.array("root")))).alias("path")] if full else []))
    top = roots.select("node", F.lit(None).cast("string").alias("parent"), F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.array("node").alias("path")] if full else []))
    return below.unionByName(top)


def descendants(solved: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` from the result of ``paths``: each node below another on its path. Other parents' descendants are in ``below``."""
    above = solved.where("path IS NOT NULL").select(F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "node"))
    return above.select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def below(edges: DataFrame) -> DataFrame:
    """``(node, descendant, distance)`` over all ``links``: every pair of a node and one below it, with the fewest links between them."""
    part = cut(edges.select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance")))
    known, reach = part, 1
    while True:
        # Pairs of up to ``reach`` links are known; those of up to twice as many pass a node at just that distance.
        far = part.where(F.col("distance") == reach).select(F.col("node").alias("top"), F.col("descendant").alias("node"))
        if far.isEmpty():
            return known
        met = known.join(far, "node").groupBy(F.col("top").alias("node"), "descendant").agg((F.min("distance") + reach).cast("int").alias("distance"))
        part = cut(met.join(known.select("node", "descendant"), ["node", "descendant"], "left_anti"))
        known, reach = known.unionByName(part), 2 * reach
