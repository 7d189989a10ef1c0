"""Keyed tables kept as Parquet folders: upsert, delete and cascade by anti-joins, swapped in as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.schemas import SCHEMA_VERSION, TABLES


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of delta in place of those with equal keys. delta has each key once."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta.select(*base.columns))


def insert_missing(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of delta whose keys it has not."""
    return base.unionByName(delta.select(*base.columns).dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def delete(base: DataFrame, gone: DataFrame, key: str, gone_key: str = "path") -> DataFrame:
    return base.join(gone.select(F.col(gone_key).alias(key)).distinct(), key, "left_anti").select(*base.columns)


def set_state(files: DataFrame, states: DataFrame) -> DataFrame:
    """files with the states(path, state) given for some of them."""
    return files.join(states.select("path", F.col("state").alias("__s")), "path", "left").withColumn("state", F.coalesce("__s", "state")).select(*files.columns)


def cascade_delete(files: DataFrame, symbols: DataFrame, vectors: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without gone(path) and all that hangs on it."""
    from skein.operators.graph import drop_nodes

    return delete(files, gone, "path"), delete(symbols, gone, "file_path"), delete(vectors, gone, "file_path"), drop_nodes(edges, gone)


class Store:
    """The engine's tables below one folder. A version of a table is a folder of its own; a small pointer file names the
    current one and is replaced by a rename, so readers see the old or the new version and never a part."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.root}/meta.json")):
            self._put("meta.json", json.dumps({"version": SCHEMA_VERSION}))

    def _put(self, name: str, text: str) -> None:
        tmp = self._path(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        # A rename that replaces its target, so that readers always find one or the other.
        sc = self.spark.sparkContext
        kinds = getattr(sc._jvm, "org.apache.hadoop.fs.Options$Rename")
        how = sc._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else self._fs.getUri(), sc._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(tmp), self._fs.makeQualified(self._path(f"{self.root}/{name}")), how)

    def _get(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        return "".join(r.value for r in self.spark.read.text(p.toString()).collect())

    @property
    def version(self) -> int:
        return json.loads(self._get("meta.json"))["version"]

    def read(self, name: str) -> DataFrame:
        schema, _ = TABLES[name]
        current = self._get(f"{name}.current")
        if current is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{current}")

    def write(self, name: str, df: DataFrame) -> None:
        schema, _ = TABLES[name]
        version, old, older = uuid.uuid4().hex, self._get(f"{name}.current"), self._get(f"{name}.before")
        df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.parquet(f"{self.root}/{name}/{version}")
        self._put(f"{name}.current", version)
        if old:  # jobs may still read it; the one before it goes
            self._put(f"{name}.before", old)
        if older:
            self._fs.delete(self._path(f"{self.root}/{name}/{older}"), True)

    def upsert(self, name: str, delta: DataFrame) -> None:
        self.write(name, upsert(self.read(name), delta, TABLES[name][1]))

    def upsert_files(self, delta: DataFrame) -> None:
        """File rows; a file that is indexed again loses its vector, which no longer fits."""
        self.upsert("indexed_files", delta)
        self.write("embeddings", delete(self.read("embeddings"), delta, "file_path"))

    def remove(self, gone: DataFrame) -> None:
        names = ("indexed_files", "symbol_maps", "embeddings", "graph_edges")
        f, s, v, e = cascade_delete(*[self.read(n) for n in names], gone)
        for name, df in zip(names, (f, s, v, e)):
            self.write(name, df)

    def lookup(self, name: str, keys: Iterable[str]) -> DataFrame:
        """The rows of some keys; the filter reaches the scan."""
        return self.read(name).where(F.col(TABLES[name][1][0]).isin(list(keys)))
