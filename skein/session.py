"""Session helpers: defaults for local runs, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Settings of a local session; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g", name: str = "skein") -> SparkSession:
    """A local session with this engine's defaults."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for k, v in LOCAL_CONF.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names. Where that is unset, a local master takes a
    local folder (tests, local runs); on a cluster it is an error, since executors would each write to a disk of their own.
    The folder is removed when the driver ends."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = named or f"file://{tempfile.gettempdir()}"
    where = f"{named.rstrip('/')}/skein-{sc.applicationId}"
    if where not in _FOLDERS:
        _FOLDERS.add(where)
        atexit.register(_remove, spark, where)
    return where


def _remove(spark: SparkSession, where: str) -> None:
    try:
        sc = spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 the session has ended; local folders can still go
        if where.startswith("file:"):
            shutil.rmtree(where.removeprefix("file:").replace("//", "/"), True)


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it again, so that later plans start there.

    A table survives the loss of executors as a checkpoint does; besides, its size is known to the planner, and it carries
    none of the inferred constraints that multiply in loops of joins until planning stands still.
    """
    return cut_with(df)[0]


def cut_with(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """`cut`, and aggregates over the rows, which are observed while they are written, so they cost no job of their own."""
    path, schema = f"{shared_folder(df.sparkSession)}/skein-{uuid.uuid4().hex}", df.schema
    seen = Observation() if figures else None
    (df.observe(seen, *[c.alias(k) for k, c in figures.items()]) if seen else df).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), seen.get if seen else {}
