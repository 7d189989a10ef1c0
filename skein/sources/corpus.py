"""Corpus sources: folders of source files, changes in a git checkout, workspace packages.

The file walk runs on the driver (names only, pruned by ignore patterns before descending); contents are read by the
executors, so the driver never holds them. Spark's own binary source is not used, as it skips names with a leading
underscore or dot and empty files.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import GIT_EXTENSIONS, WALK_EXTENSIONS, has_extension
from skein.sources import ignore


def walk(root: str | Path, patterns: Iterable[str] = (), extensions: Iterable[str] = WALK_EXTENSIONS) -> list[str]:
    """Relative paths of the files with the extensions, sorted; ignored folders are not entered."""
    match, wanted, out = re.compile(ignore.combined(patterns)), {e.lower() for e in extensions}, []
    for folder, folders, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if rel == "." else rel + "/"
        folders[:] = [f for f in folders if not (match.match(prefix + f) or match.match(prefix + f + "/x"))]
        out += [prefix + f for f in files if os.path.splitext(f)[1].lower() in wanted and not match.match(prefix + f)]
    return sorted(out)


def read_corpus(spark: SparkSession, root: str | Path, patterns: Iterable[str] = (), extensions: Iterable[str] = WALK_EXTENSIONS, names: DataFrame | None = None) -> DataFrame:
    """(path, content, length, modification_time) of a folder that the executors can read; only of names(path), if given."""
    root = str(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    f = Path(root, p)
                    data, stat = f.read_bytes(), f.stat()
                except OSError:  # gone since the walk
                    continue
                rows.append((p, data, len(data), datetime.fromtimestamp(stat.st_mtime, timezone.utc)))
            yield pd.DataFrame(rows, columns=["path", "content", "length", "modification_time"])

    if names is None:
        names = spark.createDataFrame([(p,) for p in walk(root, patterns, extensions)], "path string")
    else:
        names = names.select("path").distinct().where(has_extension(F.col("path"), tuple(extensions)) & ~ignore.ignored(F.col("path"), patterns))
    return names.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInPandas(run, "path string, content binary, length long, modification_time timestamp")


def hashed(corpus: DataFrame, content: str = "content") -> DataFrame:
    """The corpus with `hash`: SHA-256 of the bytes, in hexadecimal digits; null for null contents."""
    return corpus.withColumn("hash", F.sha2(F.col(content).cast("binary"), 256))


# Folders whose files never count as changed.
NO_CHANGES = ("packages/", ".skein/", ".claude/")


def git_changes(spark: SparkSession, root: str | Path, patterns: Iterable[str] = ()) -> tuple[DataFrame, bool]:
    """(changed paths, is a repository): changed against HEAD, untracked and newly staged files, each once.

    Without a first commit all known files count; a failing git gives a repository without changes.
    """
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True, text=True, check=True).stdout
    try:
        inside = run("rev-parse", "--is-inside-work-tree").strip() == "true"
    except (OSError, subprocess.CalledProcessError):
        inside = False
    names: list[str] = []
    if inside:
        try:
            # Names end with a zero, so none is quoted, and are relative to the folder.
            names = (run("diff", "--name-only", "-z", "--relative", "HEAD") + run("ls-files", "-z", "--others", "--exclude-standard") + run("diff", "--cached", "--name-only", "-z", "--relative", "--diff-filter=A")).split("\0")
        except subprocess.CalledProcessError:
            try:
                names = run("ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0")
            except subprocess.CalledProcessError:
                names = []
    match = re.compile(ignore.combined(patterns))
    kept = dict.fromkeys(n for n in names if os.path.splitext(n)[1].lower() in GIT_EXTENSIONS and not n.startswith(NO_CHANGES) and not match.match(n))
    return spark.createDataFrame([(n,) for n in kept], "path string"), inside


#: Folders whose children are packages, and folders that hold a package's sources, first found first.
PACKAGE_FOLDERS = ("packages", "apps", "libs", "services", "modules")
SOURCE_FOLDERS = ("src", "lib", "dist", ".")


def workspace(root: str | Path) -> tuple[str | None, list[dict]]:
    """(kind of workspace, its packages): name, directory, src_dir and main of every named package."""
    root = Path(root)

    def manifest(p: Path) -> dict:
        try:
            return json.loads(p.read_text())
        except (OSError, ValueError):
            return {}

    kinds = (("nx", root.joinpath("nx.json").exists()), ("turborepo", root.joinpath("turbo.json").exists()), ("pnpm", root.joinpath("pnpm-workspace.yaml").exists()), ("npm", "workspaces" in manifest(root / "package.json")))
    kind = next((k for k, there in kinds if there), None)
    packages = []
    for folder in PACKAGE_FOLDERS if kind else ():
        for child in sorted(root.joinpath(folder).glob("*/package.json")):
            m, where = manifest(child), child.parent
            if m.get("name"):
                src = next(s for s in SOURCE_FOLDERS if where.joinpath(s).is_dir())
                packages.append({"name": m["name"], "directory": str(where.relative_to(root)), "src_dir": str((where / src).relative_to(root)), "main": m.get("main")})
    return kind, packages
