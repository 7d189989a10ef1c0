"""Reading the engine's tables: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """The table `name` below `sf_dir`; only the named columns, if given, so that the scan reads no others.

    Zone-less timestamps become TIMESTAMP in the session's zone (UTC), which watermarks and joins expect.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns is not None:
        df = df.select(*columns)
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over enough partitions, by a hash of the keys, for work that takes far longer than reading: a file of a few
    blocks would otherwise be worked on by as few tasks. The number is explicit, so it is not coalesced away. A table that
    is read in as many blocks anyway (by the planner's estimate of its size) is left as it is, without a shuffle."""
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    jvm = spark._jvm
    block = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if 4 * parts * block <= size < 1 << 60:  # beyond that the size is not known
        return df
    return df.repartition(parts, *keys)
