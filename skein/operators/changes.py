"""Change detection: the corpus held against the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.schemas import FAR


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the latest `order`, the greatest of equal ones. Partial maxima keep hot keys small."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *others)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rows.columns if c != key])


def changed_by_hash(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """(path, change): files of the corpus(path, hash) that the index(path, hash) does not hold (new) or holds with another
    hash (changed). Removed files are no change."""
    stored = index.select("path", F.col("hash").alias("stored"), F.lit(True).alias("known"))
    joined = corpus.select("path", "hash").join(stored, "path", "left")
    return joined.where(F.col("known").isNull() | ~F.col("hash").eqNullSafe(F.col("stored"))).select("path", F.when(F.col("known").isNull(), "new").otherwise("changed").alias("change"))


def missing_on_disk(corpus: DataFrame, index: DataFrame) -> DataFrame:
    return index.select("path").join(corpus.select("path"), "path", "left_anti")


def choose_changes(git: DataFrame, is_repository: bool, corpus: DataFrame, index: DataFrame) -> tuple[DataFrame, str]:
    """(changed paths, strategy): git's list if it has any existing file, else the hashes; `hybrid` if those find more."""
    by_hash = changed_by_hash(corpus, index).select("path")
    if not is_repository:
        return by_hash, "hash"
    listed = git.select("path").join(corpus.select("path"), "path", "left_semi")
    if not listed.isEmpty():
        return listed, "git"
    return by_hash, "git" if by_hash.isEmpty() else "hybrid"


def classify(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, state, depth) of all files and of changed ones outside them: CHANGED at 0, UNRELATED far away."""
    c = changed.select("path").distinct().withColumn("hit", F.lit(True))
    hit = F.col("hit").isNotNull()
    return files.select("path").distinct().join(c, "path", "full_outer").select(
        "path", F.when(hit, "CHANGED").otherwise("UNRELATED").alias("state"), F.when(hit, 0).otherwise(FAR).cast("int").alias("depth")
    )


def repair_plan(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """(path, action): delete what is gone from disk, reindex what has another hash, keep the rest; new files stay out."""
    now = corpus.select("path", F.col("hash").alias("now"), F.lit(True).alias("there"))
    return index.select("path", "hash").join(now, "path", "left").select(
        "path", F.when(F.col("there").isNull(), "delete").when(~F.col("hash").eqNullSafe(F.col("now")), "reindex").otherwise("keep").alias("action")
    )
