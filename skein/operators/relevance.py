"""Nearest vectors to a task, and scores that mix them with the distance in the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.config import Relevance
from skein.functions.vectors import cosine
from skein.session import cut


def most_similar(vectors: DataFrame, query: Sequence[float], key: str = "file_path", vector: str = "vector", threshold: float = 0.65, k: int = 50) -> DataFrame:
    """(key, score): the k best rows with a score of at least the threshold; equal scores by key. The query vector is a
    literal, so each task scores its rows and sends on its own best k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("score")).where(F.col("score") >= threshold).orderBy(F.col("score").desc(), key).limit(k)


def depth_score(depth: Column) -> Column:
    return F.when(depth == 0, 1.0).when(depth == 1, 0.8).when(depth == 2, 0.5).otherwise(0.0)


def score(walked: DataFrame, similar: DataFrame | None, settings: Relevance = Relevance(), max_depth: int = 2) -> DataFrame:
    """walked(path, depth) with semantic, graph_score, final, included and reason. similar: (path, score).

    A file without a similarity gets 0.5 up to depth 1 and 0.3 beyond; changed files always count fully and are in,
    neighbours are in, deeper ones by the threshold up to max_depth.
    """
    near = walked.where(F.col("depth") <= max_depth)
    known = near.join(similar.select("path", F.col("score").alias("found")), "path", "left") if similar is not None else near.withColumn("found", F.lit(None).cast("double"))
    d = F.col("depth")
    out = known.withColumn("semantic", F.coalesce("found", F.when(d <= 1, 0.5).otherwise(0.3))).withColumn("graph_score", depth_score(d))
    final = F.when(d == 0, 1.0).otherwise(settings.semantic_weight * F.col("semantic") + settings.graph_weight * F.col("graph_score"))
    out = out.withColumn("final", final)
    reason = F.when(d == 0, "directly changed").when(d == 1, F.format_string("imports or is imported, score %.2f", "final")).when(
        F.col("final") >= settings.threshold, F.format_string("two links away, score %.2f", "final")
    ).otherwise(F.format_string("below threshold, score %.2f", "final"))
    return out.withColumn("included", (d <= 1) | (F.col("final") >= settings.threshold)).withColumn("reason", reason).drop("found")


def ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with `rank`, the place in its group. The rows are sorted by ranges over all partitions; a row's rank is its place
    in its own range and the number of the group's rows in the ranges before, so no task holds a whole group."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut(df.repartitionByRange(n, group, *order).withColumn("__range", F.spark_partition_id()))
    so_far = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(so_far), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order))
    return x.withColumn("__place", place).join(before, [group, "__range"]).withColumn("rank", (F.col("__place") + F.col("__before")).cast("int")).drop("__range", "__place", "__before")


def rank(scored: DataFrame) -> DataFrame:
    """The included files with their bucket and place in it, best first; equal scores by path."""
    bucket = F.when(F.col("depth") == 0, "changed").when(F.col("depth") == 1, "touched").otherwise("ancestor")
    return ranked(scored.where("included").withColumn("bucket", bucket), "bucket", [F.col("final").desc(), F.col("path")])


def most_similar_each(vectors: DataFrame, queries: DataFrame, by: list[str], threshold: float, k: int, key: str = "file_path") -> DataFrame:
    """(key, *by, score): for each of queries(*by, q) the k best of the vectors with the same `by` and a score of at least
    the threshold; equal scores by key. Every task sends on only its own k best of each query."""
    scored = vectors.join(queries, by).select(key, *by, cosine(F.col("vector"), F.col("q")).alias("score")).where(F.col("score") >= threshold)
    return scored.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), key))).where(F.col("__r") <= k).drop("__r")


def score_lines(scored: DataFrame) -> DataFrame:
    """(path, line): each file's scores as a line of text, left out or not."""
    kind = F.when(F.col("depth") == 0, "changed").when(F.col("depth") == 1, "touched").otherwise("ancestor")
    shown = F.format_string("%-9s %-45s semantic=%.2f graph=%.2f final=%.2f", F.when(F.col("included"), kind).otherwise("left out"), "path", "semantic", "graph_score", "final")
    return scored.select("path", shown.alias("line"))
