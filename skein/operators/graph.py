"""The dependency graph: maintenance of edges, bounded walks, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.schemas import FAR
from skein.session import cut, cut_with

#: Slices into which the steps of every node are dealt.
SLICES = 8


def replace_out_edges(edges: DataFrame, sources: DataFrame, new: DataFrame) -> DataFrame:
    """The edges with all out-edges of sources(from_path) replaced by the new ones; each edge once."""
    return edges.select("from_path", "to_path").join(sources.select("from_path").distinct(), "from_path", "left_anti").unionByName(new.select("from_path", "to_path")).distinct()


def drop_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges without those that begin or end in nodes(path)."""
    gone = nodes.select("path").distinct()
    return edges.join(gone.withColumnRenamed("path", "from_path"), "from_path", "left_anti").join(gone.withColumnRenamed("path", "to_path"), "to_path", "left_anti").select(*edges.columns)


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("to_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("from_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))


def _walk(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(path, depth): the fewest steps(a, b) from any of seeds(path). The steps are written once; a round joins the frontier
    with them and takes away what was seen. Frontiers are distinct, so a hub that many nodes lead to is one row in the next
    round; the many steps of a hub itself are dealt over SLICES, as those of all nodes are. Rows are counted while they are
    written."""
    steps = cut(steps.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SLICES)).cast("int").alias("slice")))
    seen = cut(seeds.select("path").distinct().withColumn("depth", F.lit(0)))
    slices = F.explode(F.array(*[F.lit(i) for i in range(SLICES)])).alias("slice")
    front = seen
    for d in range(1, depth + 1):
        reached = steps.join(front.select(F.col("path").alias("a"), slices), ["a", "slice"]).select(F.col("b").alias("path")).distinct()
        front, count = cut_with(reached.join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(d)), n=F.count(F.lit(1)))
        if not count["n"]:
            break
        seen = seen.unionByName(front)
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(path, depth) of all nodes within `depth` links of the seeds, whichever way the links point."""
    e = edges.select("from_path", "to_path").where("from_path is not null and to_path is not null").distinct()
    both = e.select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).union(e.select(F.col("to_path").alias("a"), F.col("from_path").alias("b")))
    return _walk(both, seeds, depth)


def dependencies(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(path, depth) of all nodes that the seeds lead to within `depth` links."""
    e = edges.where("from_path is not null and to_path is not null").select(F.col("from_path").alias("a"), F.col("to_path").alias("b")).distinct()
    return _walk(e, seeds, depth)


def states(walked: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """walked with `state` by depth; with files(path), those not reached are unrelated and far."""
    out = walked
    if files is not None:
        rest = files.select("path").distinct().join(walked.select("path"), "path", "left_anti")
        out = walked.unionByName(rest.withColumn("depth", F.lit(FAR)))
    d = F.col("depth")
    return out.withColumn("state", F.when(d == 0, "CHANGED").when(d == 1, "TOUCHED").when(d == 2, "ANCESTOR").otherwise("UNRELATED"))


def tree_listing(edges: DataFrame, start: str, depth: int) -> list[tuple[int, str, bool]]:
    """(level, path, seen before) of the tree of dependencies in pre-order; a path is opened where it is met first.

    The order is that of a walk, so it is made on the driver, of the subgraph within `depth` links of one file.
    """
    sub = dependencies(edges, edges.sparkSession.createDataFrame([(start,)], "path string"), depth)
    rows = edges.join(sub.where(F.col("depth") < depth).select(F.col("path").alias("from_path")), "from_path", "left_semi").select("from_path", "to_path").distinct().toLocalIterator()
    below: dict[str, list[str]] = {}
    for r in rows:
        below.setdefault(r.from_path, []).append(r.to_path)
    out, seen, stack = [], {start}, [(1, x) for x in sorted(below.get(start, []), reverse=True)]
    out.append((0, start, False))
    while stack:
        level, path = stack.pop()
        again = path in seen
        out.append((level, path, again))
        seen.add(path)
        if not again and level < depth:
            stack += [(level + 1, x) for x in sorted(below.get(path, []), reverse=True)]
    return out
