"""Import strings to files: candidates in order of preference, of which the first that exists wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import salted_join

# The endings tried for an import without one, in order.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
KNOWN = r"\.(ts|tsx|js|jsx)$"


def normalise(path: Column) -> Column:
    """Without `.` and `..` segments."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(base: Column) -> Column:
    """The paths that an import may mean: itself with a known ending, a `.js` ending replaced, endings added."""
    stem = F.regexp_replace(base, r"\.js$", "")
    exact = F.when(base.rlike(KNOWN), F.array(base)).otherwise(F.array().cast("array<string>"))
    swapped = F.when(F.endswith(base, F.lit(".js")), F.array(*[F.concat(stem, F.lit(s)) for s in SUFFIXES])).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(exact, swapped, F.array(*[F.concat(base, F.lit(s)) for s in SUFFIXES])))


def _first_existing(tried: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, to_path) of tried(keys, base): the first candidate of each that is a file. What very many files import is one
    base to look up; their rows, which share it, are dealt over slices when they get its file."""
    each = tried.select("base").distinct().select("base", F.posexplode(candidates(F.col("base"))).alias("rank", "to_path"))
    there = each.join(files.select(F.col("path").alias("to_path")).distinct(), "to_path", "left_semi")
    found = there.groupBy("base").agg(F.min_by("to_path", "rank").alias("to_path"))
    return salted_join(tried, found, "base", [F.col(k) for k in keys], "inner").select(*keys, "to_path")


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, source, to_path): imports(from_path, source) that begin with a dot, against files(path)."""
    folder = F.regexp_replace("from_path", r"/?[^/]*$", "")
    tried = imports.where(F.startswith("source", F.lit("."))).select("from_path", "source", normalise(F.concat_ws("/", folder, "source")).alias("base")).distinct()
    return _first_existing(tried, files, ["from_path", "source"])


def workspace_names(packages: DataFrame) -> DataFrame:
    """packages(name, src_dir, main) under their names and their names without scope; the last of equal ones wins."""
    p = packages.withColumn("n", F.monotonically_increasing_id())
    both = p.select(F.col("name").alias("alias"), "src_dir", "main", "n").union(p.where(F.startswith("name", F.lit("@"))).select(F.regexp_replace("name", r"^@[^/]+/", ""), "src_dir", "main", "n"))
    return both.groupBy("alias").agg(F.max_by(F.struct("src_dir", "main"), "n").alias("p")).select("alias", "p.src_dir", "p.main")


def resolve_workspace(imports: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """(from_path, source, to_path): imports that name a package of the workspace, or a path below one.

    The package table is a dimension of the workspace (one row per package folder); a name is looked up by equality with
    the import's first one or two segments, so no theta join is needed.
    """
    names = workspace_names(packages)
    named = imports.where(~F.startswith("source", F.lit(".")) & ~F.startswith("source", F.lit("node:"))).distinct()
    keys = F.array_distinct(F.array("source", F.substring_index("source", "/", 1), F.substring_index("source", "/", 2)))
    hit = named.select("from_path", "source", F.explode(keys).alias("alias")).join(names, "alias")
    best = hit.groupBy("from_path", "source").agg(F.max_by(F.struct("alias", "src_dir", "main"), F.length("alias")).alias("p")).select("from_path", "source", "p.*")
    rest = F.expr("substring(source, length(alias) + 2)")
    entry = F.when(F.col("main").isNotNull(), F.concat_ws("/", F.regexp_replace("src_dir", r"/?[^/]*$", ""), "main")).otherwise(F.concat_ws("/", "src_dir", F.lit("index")))
    base = F.when(F.col("source") == F.col("alias"), normalise(entry)).otherwise(normalise(F.concat_ws("/", "src_dir", rest)))
    return _first_existing(best.select("from_path", "source", base.alias("base")), files, ["from_path", "source"])


def edges_from(resolved: DataFrame) -> DataFrame:
    """Distinct (from_path, to_path)."""
    return resolved.where(F.col("to_path").isNotNull()).select("from_path", "to_path").distinct()
