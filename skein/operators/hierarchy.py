"""Parent-child links to full hierarchies, by heavy-path decomposition.

The links form a directed graph: nodes may have several parents and lie on cycles. The steps:

1. `links`: distinct links with dense node ids; a node's primary parent is one of its parents, which gives a functional
   graph; `forest` gives depth, root and subtree size of every node by pointer doubling (rounds: log of the depth). Nodes
   that never reach a root lead to a cycle: each cycle is cut once, and only they are gone through again.
2. `chains`: every node's heavy child is the one with the largest subtree; heavy links join nodes to vertex-disjoint
   chains, labelled (chain, pos), of at most SEGMENT nodes, so that no window holds more. A path in the forest crosses at
   most log2(n) light links (and one for each SEGMENT nodes of its length), so its names are few chain segments,
   concatenated; pre-order numbers make the descendants of a node one interval (`intervals`).
3. `circular`: the strongly connected components. Labels run along a whole chain segment in one window step and over the
   light links in one join, so the rounds follow the number of light links on a path, not its length.
4. `reachable`: the fewest links from each root to each node over *all* links. The state is a set of chain entries
   (root, chain, pos, depth), of which each stands for all later nodes of its chain; only light links are joined, and a
   round writes only the entries that are new.
5. `tree`: the forest of shortest paths from the nearest roots. `below` walks its chain entries from *every* node, so
   descendants over all links come out as intervals of pre-order numbers; `descendants` spells them out as pairs.

Each round cuts its lineage in the shared checkpoint folder. Nothing is gathered in the driver but counts. Joins on nodes
that very many links share are salted (`skew.Salt`, whose hot keys are found once); in the joins of pointer doubling, the
side that may be skewed is the one that Spark splits by itself. Two remainders are finished by one task in memory once they
are counted to be small (IN_MEMORY): the nodes that lead to cycles, and what is left after nodes that evidently lie on no
cycle are gone. The results are the same as those of the rounds that go on otherwise; tests run both.

Defined cases: links with a null end are ignored; repeated links count once; a link to itself makes its file circular and
else counts for nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.skew import Salt, salted_join
from skein.session import cut, cut_with

#: The most nodes of a chain.
SEGMENT = 4096
#: Labels that are coloured at a time: each breaks up what is left independently of the others.
COLOURS = 4
#: A remainder of at most so many rows (of two numbers each) is finished by one task.
IN_MEMORY = 1_000_000
#: Rounds of taking away what lies on no cycle before nodes are coloured; more of them follow in the next pass.
TRIMS = 2


def _cut_open(df: DataFrame, condition: str) -> tuple[DataFrame, int]:
    """The table, written, and how many of its rows satisfy the condition."""
    df, seen = cut_with(df, n=F.count(F.when(F.expr(condition), 1)))
    return df, seen["n"]


@dataclass
class Links:
    """nodes(id, path); edges(u, v) without loops; loops(id)."""

    nodes: DataFrame
    edges: DataFrame
    loops: DataFrame


def links(edges: DataFrame, parent: str = "from_path", child: str = "to_path") -> Links:
    """Distinct links and ids of their ends. A file linked to by very many others is salted."""
    e = cut(edges.select(F.col(parent).alias("p"), F.col(child).alias("c")).where(F.col("p").isNotNull() & F.col("c").isNotNull()).distinct())
    names = e.select(F.col("p").alias("path")).union(e.select(F.col("c").alias("path"))).distinct()
    nodes = cut(names.select(F.monotonically_increasing_id().alias("id"), "path"))
    u = nodes.select(F.col("path").alias("p"), F.col("id").alias("u"))
    v = nodes.select(F.col("path").alias("c"), F.col("id").alias("v"))
    ids = cut(salted_join(e.join(u, "p"), v, "c", [F.col("u")], "inner").select("u", "v"))
    return Links(nodes, ids.where("u <> v"), ids.where("u = v").select(F.col("u").alias("id")))


def primary_parents(g: Links) -> DataFrame:
    """(id, parent): for every node one parent, or null. Of several the one with the fewest own parents, then the least id."""
    degree = g.edges.groupBy(F.col("v").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    best = (
        g.edges.join(degree, "u", "left").groupBy("v").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("u"))).alias("b"))
        .select(F.col("v").alias("id"), F.col("b.u").alias("parent"))
    )
    return g.nodes.select("id").join(best, "id", "left")


def forest(parents: DataFrame) -> DataFrame:
    """(id, parent, depth, root, size) of a table (id, parent), in which of each cycle the link into its least id is cut.

    After k rounds `anc` is the 2^k-th ancestor, `low` the least id on the way, and depth, root and size count up to there.
    Nodes whose ancestor stays open lead into a cycle; the nodes on the cycles are the image of `anc` as soon as taking the
    parent maps it onto itself, and `low` is their cycle's least id as soon as it equals that of the parent.
    """
    s, left = _cut_open(
        parents.select(
            "id", "parent", F.col("parent").alias("anc"), F.least("id", "parent").alias("low"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
            F.coalesce("parent", "id").alias("root"), F.lit(1).cast("long").alias("size"),
        ),
        "anc is not null",
    )
    before = -1
    while left:
        if left == before:
            open_ = s.where("anc is not null")
            again = open_ if left <= IN_MEMORY else _without_cycles(open_)
            if again is not None:
                rest = _one_task(again.select("id", "parent"), _forest_of, "id long, parent long, depth long, root long, size long") if left <= IN_MEMORY else forest(again)
                return cut(s.where("anc is null").select("id", "parent", "depth", "root", "size").unionByName(rest))
        before = left
        a = s.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("low").alias("low2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        more = s.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("more"))
        s, left = _cut_open(
            s.join(a, "anc", "left").join(more, "id", "left").select(
                "id", "parent", F.col("anc2").alias("anc"), F.least("low", "low2").alias("low"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
                F.coalesce("r2", "root").alias("root"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"),
            ),
            "anc is not null",
        )
    return s.select("id", "parent", "depth", "root", "size")


def _without_cycles(s: DataFrame) -> DataFrame | None:
    """(id, parent) of nodes that lead to cycles, once these are known, with each cycle cut; else None."""
    ring = cut(s.select(F.col("anc").alias("id")).distinct().join(s, "id").select("id", "parent", "low"))
    up = ring.select(F.col("id").alias("parent"), F.col("low").alias("low2"))
    on = ring.join(up, "parent", "left").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("parent").alias("up"), F.sum(F.when(F.col("low") == F.col("low2"), 0).otherwise(1)).alias("odd")
    ).first()
    if on.n != on.up or on.odd:
        return None
    least = ring.where("id = low").select("id", F.lit(True).alias("is_cut"))
    return s.select("id", "parent").join(least, "id", "left").select("id", F.when(F.col("is_cut").isNull(), F.col("parent")).alias("parent"))


def _one_task(rows: DataFrame, finish: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """finish(the columns as arrays) -> columns, of all rows together; for numbers of rows that are known to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is not None and t.num_rows:
            yield from pa.table(finish(*[c.to_numpy() for c in t.columns])).to_batches()

    return rows.coalesce(1).mapInArrow(run, schema)


def _forest_of(ids: np.ndarray, parents: np.ndarray) -> dict[str, np.ndarray]:
    """`forest` of nodes that all lead to cycles."""
    order = np.argsort(ids)
    ids, up = ids[order], np.searchsorted(ids[order], parents[order])
    state = np.zeros(len(ids), dtype=np.int8)
    for i in range(len(ids)):  # walk up until something known; what is met again on the same walk is a cycle
        path = []
        while not state[i]:
            state[i] = 1
            path.append(i)
            i = up[i]
        if state[i] == 1:
            ring = path[path.index(i) :]
            up[min(ring)] = -1
        state[path] = 2
    depth, root, size = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.ones(len(ids), np.int64)
    kids, level = np.argsort(up, kind="stable"), np.flatnonzero(up < 0)
    start, levels = np.searchsorted(up[kids], np.arange(len(ids) + 1)), []
    while len(level):
        levels.append(level)
        level = np.concatenate([kids[start[i] : start[i + 1]] for i in level])
        depth[level], root[level] = depth[up[level]] + 1, root[up[level]]
    for level in levels[:0:-1]:
        np.add.at(size, up[level], size[level])
    return {"id": ids, "parent": pa.array(ids[up], mask=up < 0), "depth": depth, "root": ids[root], "size": size}


def _components_of(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """(id, component) of the nodes that share a component with others, by depth-first search over the links."""
    ids, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    by = np.argsort(a, kind="stable")
    to, start = b[by].tolist(), np.searchsorted(a[by], np.arange(len(ids) + 1)).tolist()
    seen, low, component, count = [-1] * len(ids), [0] * len(ids), [-1] * len(ids), 0
    open_: list[int] = []
    for first in range(len(ids)):
        if seen[first] >= 0:
            continue
        todo = [(first, start[first])]
        while todo:
            n, i = todo.pop()
            if i == start[n]:
                seen[n] = low[n] = count
                count += 1
                open_.append(n)
            elif component[to[i - 1]] < 0:
                low[n] = min(low[n], low[to[i - 1]])
            while i < start[n + 1]:
                m = to[i]
                i += 1
                if seen[m] < 0:
                    todo += [(n, i), (m, start[m])]
                    break
                if component[m] < 0:
                    low[n] = min(low[n], seen[m])
            else:
                if low[n] == seen[n]:
                    while component[n] < 0:
                        component[open_.pop()] = n
    component = np.array(component)
    many = np.bincount(component, minlength=len(ids))[component] > 1
    return {"id": ids[many], "component": ids[component[many]]}


def chains(trees: DataFrame) -> DataFrame:
    """The forest with (chain, pos, heavy): chain is its head's id; pos counts from 0 at the head."""
    top = trees.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "id")).alias("t")).select(F.col("t.id").alias("id"), F.lit(True).alias("top"))
    t = cut(trees.join(top, "id", "left").withColumn("heavy", F.col("top").isNotNull() & (F.col("depth") % SEGMENT != 0)).drop("top"))
    s = t.select("id", F.when(F.col("heavy"), F.col("parent")).alias("anc"), F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("id")).alias("chain"))
    left = 1
    while left:
        a = s.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("chain").alias("c2"))
        s, left = _cut_open(s.join(a, "anc", "left").select("id", F.col("anc2").alias("anc"), F.coalesce("c2", "chain").alias("chain")), "anc is not null")
    head = trees.select(F.col("id").alias("chain"), F.col("depth").alias("head_depth"))
    return cut(t.join(s.select("id", "chain"), "id").join(head, "chain").withColumn("pos", F.col("depth") - F.col("head_depth")).drop("head_depth"))


def decompose(g: Links) -> DataFrame:
    """(chain, id, parent, depth, root, size, heavy, pos) of every node."""
    return chains(forest(primary_parents(g)))


def light_links(g: Links, t: DataFrame) -> DataFrame:
    """The links that no chain holds."""
    inner = t.where("heavy").select(F.col("parent").alias("u"), F.col("id").alias("v"))
    return cut(g.edges.join(inner, ["u", "v"], "left_anti"))


def _runs(alive: DataFrame) -> DataFrame:
    """alive(id, chain, pos) with `seg`: the same for neighbours in a chain without a gap between them."""
    return alive.withColumn("seg", F.col("pos") - F.row_number().over(Window.partitionBy("chain").orderBy("pos")))


class _Ends:
    """Links joined with tables of their ends; ends that very many links share are salted."""

    def __init__(self, e: DataFrame):
        self.u, self.v = Salt(e, "u", [F.col("v")], keep=cut), Salt(e, "v", [F.col("u")], keep=cut)

    def with_u(self, e: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
        return self.u.join(e, nodes.withColumnRenamed("id", "u"), how)

    def with_v(self, e: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
        return self.v.join(e, nodes.withColumnRenamed("id", "v"), how)


def _trim(alive: DataFrame, e: DataFrame, ends: _Ends) -> tuple[DataFrame, DataFrame, int, int]:
    """Without nodes that no cycle leads to or that lead to no cycle, as far as TRIMS rounds see; the links left between
    the others; the numbers of both."""
    before = count = -1
    for _ in range(TRIMS):
        ids = alive.select("id")
        e, n_links = _cut_open(ends.with_v(ends.with_u(e, ids, "left_semi"), ids, "left_semi"), "true")
        pins = e.select(F.col("v").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select(F.col("u").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        n = _runs(alive.select("id", "chain", "pos").join(pins.groupBy("id").agg(F.max("i").alias("i"), F.max("o").alias("o")), "id", "left"))
        w = Window.partitionBy("chain", "seg").orderBy("pos")
        n = n.withColumn("i", F.max("i").over(w)).withColumn("o", F.max("o").over(w.rowsBetween(0, Window.unboundedFollowing)))
        alive, count = _cut_open(n.where("i = 1 and o = 1").select("id", "chain", "pos"), "true")
        if count in (0, before):
            break
        before = count
    return alive, e, count, n_links


_F, _B = [f"f{i}" for i in range(COLOURS)], [f"b{i}" for i in range(COLOURS)]


def _colour(alive: DataFrame, e: DataFrame, ends: _Ends) -> DataFrame:
    """(id, chain, pos, seg, f0.., b0..): for each of COLOURS random labels of the nodes, the greatest of a node that leads
    to this one, and the greatest of a node that this one leads to."""
    s = _runs(alive).select("id", "chain", "pos", "seg", *[F.xxhash64("id", F.lit(i)).alias(c) for names in (_F, _B) for i, c in enumerate(names)])
    w = Window.partitionBy("chain", "seg").orderBy("pos")
    back = w.rowsBetween(0, Window.unboundedFollowing)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    before = None
    while True:
        s = s.select("id", "chain", "pos", "seg", *[F.max(c).over(w).alias(c) for c in _F], *[F.max(c).over(back).alias(c) for c in _B])
        s, now = cut_with(s, f=F.sum(sum(map(big, _F[1:]), big(_F[0]))), b=F.sum(sum(map(big, _B[1:]), big(_B[0]))))  # labels only grow
        if now == before:
            return s
        before = now
        none = [F.lit(None).cast("long")] * COLOURS
        told = (
            ends.with_u(e, s.select("id", *_F)).select(F.col("v").alias("id"), *_F, *[x.alias(c) for x, c in zip(none, _B)])
            .union(ends.with_v(e, s.select("id", *_B)).select(F.col("u").alias("id"), *[x.alias(c) for x, c in zip(none, _F)], *_B))
            .groupBy("id").agg(*[F.max(c).alias(f"t{c}") for c in (*_F, *_B)])
        )
        s = s.join(told, "id", "left").select("id", "chain", "pos", "seg", *[F.greatest(c, f"t{c}").alias(c) for c in (*_F, *_B)])


def circular(t: DataFrame, light: DataFrame, ends: _Ends) -> DataFrame:
    """(id, component) of the nodes on a cycle of two or more nodes; component is a number of the cycle's component.

    Every pass drops what evidently lies on no cycle and colours the rest in both directions: a node of which two colours
    are equal is in the component of the node that they come from. Links between nodes of different colours lie within no
    component and fall away, so the rest breaks up quickly.
    """
    alive, e, found = t.select("id", "chain", "pos"), light, None
    # A chain's own links must fall away too once colours part, so chains are cut where colours change.
    while True:
        alive, e, count, n_links = _trim(alive, e, ends)
        if not count:
            break
        if count + n_links <= IN_MEMORY:
            w = Window.partitionBy("chain", "seg").orderBy("pos")
            along = _runs(alive).select(F.col("id").alias("u"), F.lead("id").over(w).alias("v")).where("v is not null")
            last = _one_task(e.unionByName(along), _components_of, "id long, component long")
            found = last if found is None else found.union(last)
            break
        c = _colour(alive, e, ends)
        one = F.coalesce(*[F.when(F.col(f) == F.col(b), F.xxhash64(F.lit(i), f)) for i, (f, b) in enumerate(zip(_F, _B))])
        c = cut(c.select("id", "chain", "pos", one.alias("component"), F.xxhash64(*_F, *_B).alias("colours")))
        same = c.where("component is not null").select("id", "component")
        found = same if found is None else found.union(same)
        rest = c.where("component is null")
        colours = rest.select("id", "colours")
        e = ends.with_v(ends.with_u(e, colours.withColumnRenamed("colours", "cu")), colours.withColumnRenamed("colours", "cv")).where("cu = cv").select("u", "v")
        e = cut(e)
        # (chain, colours) is the new chain: its nodes keep their positions, so a change of colours is a gap.
        alive = rest.select("id", F.xxhash64("chain", "colours").alias("chain"), "pos")
    if found is None:
        return t.where(F.lit(False)).select("id", F.col("id").alias("component"))
    found = cut(found.select("id", F.col("component")))
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return salted_join(found, many, "component", [F.col("id")], "left_semi")


def _undominated(entries: DataFrame) -> DataFrame:
    """Without entries that an earlier entry of the same root and chain reaches with as few links."""
    w = Window.partitionBy("root", "chain").orderBy("pos", "depth").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.col("depth") - F.col("pos")
    return entries.withColumn("best", F.min(lead).over(w)).where(F.col("best").isNull() | (lead < F.col("best"))).drop("best")


def _hops(t: DataFrame, light: DataFrame, ends: _Ends) -> DataFrame:
    """(chain, at, to_chain, to_pos) of the light links."""
    place = t.select("id", "chain", "pos")
    from_ = place.select("id", "chain", F.col("pos").alias("at"))
    to = place.select("id", F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    return cut(ends.with_v(ends.with_u(light, from_), to).select("chain", "at", "to_chain", "to_pos"))


def _all(parts: list[DataFrame]) -> DataFrame:
    """The union of the parts, of which more than a few are written as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 8:
        parts[:] = [cut(out)]
        return parts[0]
    return out


def reachable(g: Links, t: DataFrame, light: DataFrame, ends: _Ends) -> DataFrame:
    """(root, id, depth): for each node that is no other's child every node it reaches, with the fewest links."""
    place = t.select("id", "chain", "pos")
    hops = _hops(t, light, ends)
    starts = g.edges.select(F.col("u").alias("id")).union(g.loops).distinct().join(g.edges.select(F.col("v").alias("id")).distinct(), "id", "left_anti")
    fresh, left = _cut_open(starts.join(place, "id").select(F.col("id").alias("root"), "chain", "pos", F.lit(0).cast("long").alias("depth")), "true")
    seen = [fresh]
    while left:
        new = (
            fresh.join(hops, "chain").where("at >= pos")
            .select("root", F.col("to_chain").alias("chain"), F.col("to_pos").alias("pos"), (F.col("depth") + F.col("at") - F.col("pos") + 1).alias("depth"))
            .groupBy("root", "chain", "pos").agg(F.min("depth").alias("depth"))
        )
        n, o = _undominated(new).alias("n"), _all(seen).alias("o")
        known = F.expr("n.root = o.root and n.chain = o.chain and o.pos <= n.pos and o.depth - o.pos <= n.depth - n.pos")
        fresh, left = _cut_open(n.join(o, known, "left_anti"), "true")
        seen.append(fresh)
    # Entries of a root in one chain overlap: of those that reach a node the one with the fewest links counts.
    nodes = t.select("id", "chain", F.col("pos").alias("at"))
    entries = cut(_all(seen))
    return salted_join(entries, nodes, "chain", [F.col("root")], "inner").where("at >= pos").groupBy("root", "id").agg(F.min(F.col("depth") + F.col("at") - F.col("pos")).alias("depth"))


def below(t: DataFrame, light: DataFrame, ends: _Ends) -> DataFrame:
    """(node, chain, pos): for every node the chains that it reaches over all links, itself included, each from its
    earliest place on. How many links it takes does not matter here, so one entry per node and chain is enough."""
    hops = _hops(t, light, ends)
    fresh, left = _cut_open(t.select(F.col("id").alias("node"), "chain", "pos"), "true")
    seen = [fresh]
    while left:
        new = (
            fresh.join(hops, "chain").where("at >= pos")
            .groupBy("node", F.col("to_chain").alias("chain")).agg(F.min("to_pos").alias("pos"))
        )
        known = F.expr("n.node = o.node and n.chain = o.chain and o.pos <= n.pos")
        fresh, left = _cut_open(new.alias("n").join(_all(seen).alias("o"), known, "left_anti"), "true")
        seen.append(fresh)
    return _all(seen).groupBy("node", "chain").agg(F.min("pos").alias("pos"))


def shortest_parents(g: Links, reach: DataFrame) -> DataFrame:
    """(id, parent): the parent on a shortest path from the nearest root, of several the one with the least path. Nodes
    that no root reaches have parents that none reaches either; they keep their primary parent."""
    near = cut(reach.groupBy("id").agg(F.min("depth").alias("depth")))
    short = (
        g.edges.join(near.select(F.col("id").alias("u"), F.col("depth").alias("du")), "u").join(near.select(F.col("id").alias("v"), F.col("depth").alias("dv")), "v")
        .where("dv = du + 1").join(g.nodes.select(F.col("id").alias("u"), "path"), "u")
        .groupBy(F.col("v").alias("id")).agg(F.min(F.struct("path", "u")).alias("b")).select("id", F.col("b.u").alias("short"))
    )
    return primary_parents(g).join(near, "id", "left").join(short, "id", "left").select("id", F.when(F.col("depth").isNull(), F.col("parent")).otherwise(F.col("short")).alias("parent"))


def intervals(t: DataFrame) -> DataFrame:
    """t with `pre`: pre-order numbers per tree, heavy child first. The descendants of a node in its tree have the numbers
    pre + 1 to pre + size - 1. Computed from chain head to chain head, so in at most log2(n) rounds."""
    w = Window.partitionBy("parent").orderBy(F.col("heavy").desc(), F.col("size").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    kids = t.where("parent is not null").withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    place = t.select(F.col("id").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("up_pos"))
    heads, left = _cut_open(
        t.where("id = chain").select("chain", "parent").join(kids.select(F.col("id").alias("chain"), "before"), "chain", "left").join(place, "parent", "left")
        .select("chain", "up", (F.coalesce("up_pos", F.lit(0)) + 1 + F.coalesce("before", F.lit(0)) - F.when(F.col("up").isNull(), 1).otherwise(0)).alias("pre")),
        "up is not null",
    )
    while left:
        a = heads.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("pre").alias("pre2"))
        heads, left = _cut_open(heads.join(a, "up", "left").select("chain", F.col("up2").alias("up"), (F.col("pre") + F.coalesce("pre2", F.lit(0))).alias("pre")), "up is not null")
    return t.join(heads.select("chain", F.col("pre").alias("head_pre")), "chain").withColumn("pre", F.col("head_pre") + F.col("pos")).drop("head_pre")


def paths(t: DataFrame, nodes: DataFrame, sep: str = " > ") -> DataFrame:
    """(id, full_path): the names from the root, put together from the chain segments between light links.

    One round takes every path a chain further up: the segment of names before its place in the chain is put in front.
    """
    named = t.join(nodes, "id")
    w = Window.partitionBy("chain").orderBy("pos")
    names = named.select("chain", "pos", F.array_join(F.collect_list("path").over(w), sep).alias("segment"))
    up = t.where("id = chain").select("chain", F.col("parent").alias("next")).join(t.select(F.col("id").alias("next"), F.col("chain").alias("up"), F.col("pos").alias("up_pos")), "next", "left").select("chain", "up", "up_pos")
    names = cut(names.join(up, "chain"))
    s, left = _cut_open(t.select("id", "chain", "pos").join(names, ["chain", "pos"]).select("id", F.col("up").alias("chain"), F.col("up_pos").alias("pos"), F.col("segment").alias("full_path")), "chain is not null")
    while left:
        s, left = _cut_open(
            s.join(names, ["chain", "pos"], "left").select(
                "id", F.col("up").alias("chain"), F.col("up_pos").alias("pos"),
                F.when(F.col("segment").isNull(), F.col("full_path")).otherwise(F.concat_ws(sep, "segment", "full_path")).alias("full_path"),
            ),
            "chain is not null",
        )
    return s.select("id", "full_path")


def hierarchy(edges: DataFrame, parent: str = "from_path", child: str = "to_path") -> DataFrame:
    """(path, root_path, depth) for every root and file that it reaches, and (path, '', -1) for every file on a cycle."""
    g = links(edges, parent, child)
    t = decompose(g)
    light = light_links(g, t)
    ends = _Ends(light)
    reach, ring = reachable(g, t, light, ends), circular(t, light, ends)
    names = g.nodes
    roots = names.select(F.col("id").alias("root"), F.col("path").alias("root_path"))
    reach = cut(reach)
    out = salted_join(salted_join(reach, names, "id", [F.col("root")], "inner"), roots, "root", [F.col("id")], "inner").select("path", "root_path", F.col("depth").cast("int").alias("depth"))
    ring = ring.select("id").union(g.loops).distinct().join(names, "id")
    return out.unionByName(ring.select("path", F.lit("").alias("root_path"), F.lit(-1).alias("depth")))


def _spans(n: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, descendants, n_descendants) from the chain entries of every node; a node is not its own descendant."""
    chain = n.groupBy("chain").agg(F.first("root_path").alias("root_path"), F.min("pre").alias("head"), F.max("pre").alias("end"))
    own = n.select(F.col("id").alias("node"), F.col("chain").alias("own"), F.col("pre").alias("self"))
    e = entries.join(chain, "chain").join(own, "node").withColumn("first", F.col("head") + F.col("pos"))
    # Numbers along a chain run on from its head, so the rest of a chain is one interval; its own place splits it.
    e = e.select("node", "root_path", F.explode(F.when(
        F.col("chain") == F.col("own"),
        F.array(F.struct(F.col("first"), (F.col("self") - 1).alias("last")), F.struct((F.greatest(F.col("self") + 1, "first")).alias("first"), F.col("end").alias("last"))),
    ).otherwise(F.array(F.struct(F.col("first"), F.col("end").alias("last"))))).alias("x")).select("node", "root_path", "x.first", "x.last").where("first <= last")
    w = Window.partitionBy("node", "root_path").orderBy("first")
    e = e.withColumn("gap", F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1)).withColumn("run", F.sum("gap").over(w))
    e = e.groupBy("node", "root_path", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return e.groupBy(F.col("node").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("root_path", "first", "last"))).alias("descendants"), F.sum(F.col("last") - F.col("first") + 1).alias("n_descendants")
    )


def tree(edges: DataFrame, parent: str = "from_path", child: str = "to_path") -> DataFrame:
    """One row per node. full_path is a shortest path from its nearest root, depth its number of links; a node that no root
    reaches hangs below the node of its cycle where that was cut. `roots` are all roots that reach it, with the fewest
    links from each. `descendants` are all nodes that it reaches over any link, n_descendants in number: intervals of the
    pre-order numbers `pre` of the tree of root_path, both ends included (`descendants` below gives the pairs). `size`
    and pre to `last` are the node's own subtree in the forest of the full paths."""
    g = links(edges, parent, child)
    first = decompose(g)
    light = light_links(g, first)
    reach = cut(reachable(g, first, light, _Ends(light)))
    t = chains(forest(shortest_parents(g, reach)))
    light = light_links(g, t)
    ends = _Ends(light)
    entries, ring = below(t, light, ends), circular(t, light, ends)
    ring = ring.union(g.loops.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.max("component").alias("component"))
    root = g.nodes.select(F.col("id").alias("root"), F.col("path").alias("root_path"))
    n = cut(intervals(t).join(root, "root"))
    roots = reach.join(root, "root").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("root_path", F.col("depth").cast("int").alias("depth")))).alias("roots"))
    spans = _spans(n, entries)
    full = n.join(g.nodes, "id").join(paths(t, g.nodes), "id").join(ring, "id", "left").join(roots, "id", "left").join(spans, "id", "left")
    return full.select(
        "path", "root_path", "full_path", "depth", "size", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), F.col("component").isNotNull().alias("is_circular"),
        F.coalesce("roots", F.array().cast("array<struct<root_path: string, depth: int>>")).alias("roots"),
        F.coalesce("descendants", F.array().cast("array<struct<root_path: string, first: bigint, last: bigint>>")).alias("descendants"),
        F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
    )


def descendants(rows: DataFrame) -> DataFrame:
    """(path, descendant): the pairs that the intervals of `tree` stand for."""
    at = rows.select("path", F.explode("descendants").alias("x")).select("path", "x.root_path", F.explode(F.sequence("x.first", "x.last")).alias("pre"))
    return at.join(rows.select("root_path", "pre", F.col("path").alias("descendant")), ["root_path", "pre"]).select("path", "descendant")
