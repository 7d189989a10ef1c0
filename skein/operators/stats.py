"""Statistics of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import extension, round_half_up
from skein.operators.graph import in_degrees


def totals(files: DataFrame) -> DataFrame:
    """Files, tokens, symbol tokens, reduction in whole percent and the last time of indexing."""
    raw, sym = F.coalesce(F.sum("token_count"), F.lit(0)), F.coalesce(F.sum("symbol_token_count"), F.lit(0))
    return files.agg(F.count(F.lit(1)).alias("files"), raw.alias("tokens"), sym.alias("symbol_tokens"), F.max("last_indexed").alias("last_indexed")).withColumn(
        "reduction", F.when(F.col("tokens") > 0, round_half_up((1 - F.col("symbol_tokens") / F.col("tokens")) * 100)).otherwise(0).cast("int")
    )


def by_extension(files: DataFrame) -> DataFrame:
    """Files per extension, most first; files without one count as other."""
    ext = extension(F.col("path"))
    return files.groupBy(F.when(ext == "", "other").otherwise(ext).alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "ext")


def most_imported(edges: DataFrame, n: int = 5) -> DataFrame:
    return in_degrees(edges.select("from_path", "to_path").distinct()).orderBy(F.col("n").desc(), "path").limit(n)
