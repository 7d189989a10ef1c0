"""The engine as one object: build an index, run a task over what changed, statistics, reports, repair, graph views."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import config as settings
from skein.extract.symbols import with_symbols
from skein.functions import text
from skein.operators import budget, changes, graph, ledger, relevance, resolve, stats
from skein.operators.store import Store
from skein.sources import corpus as files
from skein.session import cut, cut_with
from skein.sources import ignore
from skein.streaming import upkeep

#: A function (texts of a column) -> vector column; None runs on the graph alone.
Embedder = Callable[[Column], Column]


@dataclass
class Context:
    """What a task gets: the manifest (every file that was looked at, with its level, tokens, score and the reason), the
    figures, the text, and a notice if the budget was raised."""

    manifest: DataFrame
    strategy: str
    budget: int
    raw_tokens: int
    used_tokens: int
    text: str
    notice: str = ""


class Engine:
    def __init__(self, spark: SparkSession, root: str, state: str | None = None, tokens: Callable[[Column], Column] = text.token_estimate, embedder: Embedder | None = None, embed: Callable[[str], Sequence[float] | None] | None = None):
        """tokens counts the tokens of a text column; embedder embeds columns; embed embeds a task's text on the driver."""
        self.spark, self.root, self.tokens, self.embedder, self.embed = spark, root.rstrip("/"), tokens, embedder, embed
        self.folder = state or f"{self.root}/.skein"
        self.store = Store(spark, f"{self.folder}/tables")
        self.config = settings.load(f"{self.folder}/config.json")
        self.patterns = [*ignore.load(self.root), ".skein/", *self.config.ignore]

    def corpus(self, names: DataFrame | None = None) -> DataFrame:
        """The files of the folder, or only those of names(path), of which no others are read."""
        return files.hashed(files.read_corpus(self.spark, self.root, self.patterns, names=names)).withColumn("source", F.decode("content", "UTF-8")).withColumn("language", text.language(F.col("path")))

    def index_rows(self, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of indexed_files, rows of symbol_maps) of corpus files; one pass of extraction feeds both."""
        s = with_symbols(corpus)
        c = {n: F.coalesce(n, F.array().cast(s.schema[n].dataType)) for n in ("exports", "imports", "classes", "types")}
        rendered = text.symbol_text(F.col("path"), c["exports"], c["imports"], c["types"])
        s = cut(s.withColumn("token_count", self.tokens(rendered)).withColumn("raw_token_count", self.tokens(F.col("source"))).withColumn("now", F.current_timestamp()))
        f = s.select(
            "path", "hash", F.lit("UNRELATED").alias("state"), F.col("raw_token_count").alias("token_count"), F.col("token_count").alias("symbol_token_count"),
            text.summary_line(F.col("path"), c["exports"], c["imports"], c["classes"], c["types"]).alias("summary"), F.col("now").alias("last_indexed"), F.col("modification_time").alias("last_changed"),
        )
        m = s.select(F.col("path").alias("file_path"), "language", "exports", "imports", "classes", "functions", "types", "token_count", "raw_token_count", F.col("now").alias("recorded_at"))
        return f, m

    def edges(self, symbols: DataFrame, known: DataFrame) -> DataFrame:
        imports = symbols.select(F.col("file_path").alias("from_path"), F.explode("imports.source").alias("source")).where(F.col("source").isNotNull())
        found = resolve.resolve_relative(imports, known)
        _, packages = files.workspace(self.root)
        if packages:
            p = self.spark.createDataFrame([(x["name"], x["src_dir"], x["main"]) for x in packages], "name string, src_dir string, main string")
            found = found.unionByName(resolve.resolve_workspace(imports, p, known))
        return resolve.edges_from(found).withColumn("recorded_at", F.current_timestamp())

    def build_index(self) -> None:
        """Everything from scratch. Unlike an update in place, no edge of a former build stays."""
        f, m = self.index_rows(self.corpus())
        self.store.write("indexed_files", f)
        self.store.write("symbol_maps", m)
        self.store.write("graph_edges", self.edges(self.store.read("symbol_maps"), self.store.read("indexed_files")))
        if self.embedder:
            self._embed(self.store.read("symbol_maps"))

    def _embed(self, symbols: DataFrame) -> None:
        s = symbols.join(self.store.read("indexed_files").select(F.col("path").alias("file_path"), "summary"), "file_path")
        described = text.embedding_text(F.col("file_path"), F.col("summary"), text.symbol_text(F.col("file_path"), F.col("exports"), F.col("imports"), F.col("types")))
        v = s.select("file_path", self.embedder(described).alias("vector")).where("vector is not null")
        self.store.upsert("embeddings", v.select("file_path", "vector", F.size("vector").alias("dimensions"), F.lit("own").alias("model"), F.current_timestamp().alias("created_at")))

    def update(self, paths: DataFrame) -> None:
        """Index some files again: rows, symbols and all their out-edges are replaced. Only these files are read."""
        paths = cut(paths.select("path").distinct())
        f, m = self.index_rows(self.corpus(paths))
        self.store.upsert_files(f)
        self.store.upsert("symbol_maps", m)
        changed = self.store.read("symbol_maps").join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi")
        new = self.edges(changed, self.store.read("indexed_files"))
        kept = self.store.read("graph_edges").join(paths.withColumnRenamed("path", "from_path"), "from_path", "left_anti")
        self.store.write("graph_edges", kept.unionByName(new))
        if self.embedder:
            self._embed(changed)

    def repair(self, log: str | None = None) -> list[tuple[str, int]]:
        """Bring the index in line with the folder, without new files; the number of files per action. log: a folder for
        the actions, a line each."""
        plan = cut(changes.repair_plan(self.corpus(), self.store.read("indexed_files")))
        counts = [(r.action, r.n) for r in plan.groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy("action").collect()]
        if log:
            plan.where("action <> 'keep'").select(F.concat_ws(" ", "action", "path").alias("value")).write.mode("append").text(log)
        gone, stale = plan.where("action = 'delete'").select("path"), plan.where("action = 'reindex'").select("path")
        if not gone.isEmpty():
            self.store.remove(gone)
        if not stale.isEmpty():
            self.update(stale)
        return counts

    def start_stream(self, events: DataFrame, checkpoint: str, **trigger):
        """Follow a stream of watch events: what was removed goes, what changed is indexed again."""
        return upkeep.follow(events, self.store, self.update, checkpoint, **trigger)

    def run_task(self, task: str, limit: int | None = None, escalate: bool = True, use_overrides: bool = True, record: str | None = None) -> Context | None:
        """The context of a task within its budget; None if nothing changed. record: a session to note the task under."""
        now, index = cut(self.corpus().drop("content")), self.store.read("indexed_files")
        git, is_repository = files.git_changes(self.spark, self.root, self.patterns)
        changed, strategy = changes.choose_changes(git, is_repository, now, index)
        changed, seen = cut_with(changed, n=F.count(F.lit(1)))
        n = seen["n"]
        if not n:
            return None
        over = settings.load_overrides(f"{self.folder}/overrides.json") if use_overrides else {"include": [], "exclude": []}
        size = configured = limit or self.config.budget.max_tokens
        if escalate and self.config.budget.escalate:
            size = self.spark.range(1).select(budget.escalated(F.lit(size), F.lit(n))).first()[0]
        walked = graph.neighbourhood(self.store.read("graph_edges"), changed, self.config.graph.max_depth).join(now.select("path"), "path", "left_semi")
        similar = None
        query = self.embed(task) if self.embed and task.strip() else None
        if query is not None:
            r = self.config.relevance
            similar = relevance.most_similar(self.store.read("embeddings"), query, threshold=r.threshold, k=r.top_k).withColumnRenamed("file_path", "path")
        scored = cut(relevance.score(walked, similar, self.config.relevance, self.config.graph.max_depth))
        ranked = relevance.rank(scored)
        ranked = ranked.where((F.col("bucket") == "changed") | ~F.col("path").isin(over["exclude"]))
        wanted = self.spark.createDataFrame([(p, n + i) for i, p in enumerate(dict.fromkeys(over["include"]), 1)], "path string, rank int")
        forced = wanted.join(now.select("path"), "path", "left_semi").join(changed, "path", "left_anti").select("path", F.lit("changed").alias("bucket"), "rank")
        ranked = ranked.join(forced.select("path"), "path", "left_anti")
        symbols = self.store.read("symbol_maps").select(F.col("file_path").alias("path"), text.symbol_text(F.col("file_path"), F.col("exports"), F.col("imports"), F.col("types")).alias("symbol_text"), F.col("token_count").alias("symbols"))
        rows = ranked.select("path", "bucket", "rank").unionByName(forced).join(now.select("path", "source"), "path").join(symbols, "path", "left").join(index.select("path", F.col("summary").alias("summary_text")), "path", "left")
        rows = rows.where((F.col("bucket") == "changed") | F.col("symbol_text").isNotNull())
        rows = rows.withColumn("full", self.tokens(F.col("source"))).withColumn("summary", self.tokens(F.coalesce("summary_text", F.lit("")))).withColumn("symbols", F.coalesce("symbols", F.lit(0)))
        rows = cut(rows)
        task_tokens = self.spark.range(1).select(self.tokens(F.lit(task))).first()[0]
        # Directories are a summary of the paths: as many as the tree has, not as it has files.
        folders = [r.d for r in now.select(F.explode(text.directories(F.col("path"))).alias("d")).distinct().orderBy("d").toLocalIterator()]
        skeleton = "PROJECT STRUCTURE:\n" + "\n".join(folders)
        n_skeleton = self.spark.range(1).select(self.tokens(F.lit(skeleton))).first()[0] if folders else 0
        fitted = cut(budget.cascade(rows.select("path", "bucket", "rank", "full", "symbols", "summary"), self.spark.createDataFrame([(size,)], "budget long"), task_tokens, n_skeleton))
        shown = fitted.join(rows.select("path", "source", "symbol_text", "summary_text"), "path")
        content = F.when(F.col("level") == "full", F.concat(F.lit("// FILE: "), "path", F.lit("\n"), F.coalesce("source", F.lit("")))).when(F.col("level") == "symbols", F.concat(F.lit("// SYMBOLS: "), "path", F.lit("\n"), "symbol_text")).otherwise(F.coalesce("summary_text", F.lit("")))
        slots = {r["bucket"]: r["content"] for r in budget.slot_text(shown.where("kept"), "bucket", "rank", content).collect()}
        raw = now.join(index.select("path", "hash", "token_count"), ["path", "hash"], "left").agg(F.coalesce(F.sum(F.coalesce("token_count", self.tokens(F.col("source")))), F.lit(0))).first()[0] + task_tokens
        used = fitted.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] + task_tokens
        shows_skeleton = bool(folders) and not fitted.agg(F.coalesce(F.bool_or("no_skeleton"), F.lit(False))).first()[0]
        used += n_skeleton if shows_skeleton else 0
        rule = "━" * 50
        body = "\n\n".join([f"{rule}\nTASK: {task}\nBUDGET: {used} of {size} tokens\n{rule}", *[slots[b] for b in ("changed", "touched", "ancestor") if b in slots], *([skeleton] if shows_skeleton else [])])
        if record is not None:
            self.record(record, task, raw, used)
        settings.clear_overrides(f"{self.folder}/overrides.json")
        # Of what the scores left out the manifest tells the reason; the files of the lists of overrides have none.
        why = scored.select("path", F.col("final").alias("score"), "reason")
        left = scored.where("not included").select("path", F.lit("ancestor").alias("bucket"), F.lit("excluded").alias("level"), F.lit(0).alias("tokens"), F.lit(False).alias("kept"))
        manifest = fitted.select("path", "bucket", "level", "tokens", "kept").unionByName(left.join(fitted.select("path"), "path", "left_anti")).join(why, "path", "left")
        return Context(manifest.withColumn("reason", F.coalesce("reason", F.lit("asked for"))), strategy, size, raw, used, body, budget.escalation_notice(configured, size, n))

    def record(self, session: str, task: str, raw: int, used: int) -> None:
        import uuid

        one = self.spark.range(1).select(
            F.lit(str(uuid.uuid4())).alias("task_id"), F.lit(session).alias("session_id"), F.lit(task).alias("instruction"), F.lit(raw).cast("long").alias("raw_tokens"), F.lit(used).cast("long").alias("optimized_tokens"), F.current_timestamp().alias("completed_at")
        )
        saved, percent, _ = budget.savings(F.col("raw_tokens"), F.col("optimized_tokens"))
        self.store.upsert("task_records", one.withColumn("saved_tokens", saved).withColumn("reduction_percent", percent))
        from skein.operators.store import insert_missing

        self.store.write("sessions", insert_missing(self.store.read("sessions"), one.select("session_id", F.col("completed_at").alias("started_at")), ["session_id"]))

    def stats(self) -> dict[str, DataFrame]:
        f = self.store.read("indexed_files")
        return {"totals": stats.totals(f), "extensions": stats.by_extension(f), "most_imported": stats.most_imported(self.store.read("graph_edges"))}

    def report(self, as_of: str, to: str | Path | None = None) -> str:
        """The ledger as Markdown: the week, all time, the last five tasks."""
        t = self.store.read("task_records")
        w, a = ledger.weekly(t, as_of).first(), ledger.all_time(t).first()
        lines = ["# Token report", "", f"Week of {as_of}: {w.tasks} tasks, {w.saved} of {w.raw} tokens saved ({w.avg_percent} %), room for {w.remaining_tasks} more.", f"All time: {a.tasks} tasks, {a.saved} of {a.raw} tokens saved ({a.avg_percent} %).", "", "| task | tokens | saved |", "|-|-|-|"]
        lines += [f"| {r.instruction} | {r.optimized_tokens} | {r.reduction_percent} % |" for r in ledger.recent(t, 5).collect()]
        out = "\n".join(lines) + "\n"
        if to:
            Path(to).write_text(out)
        return out

    def dependency_tree(self, path: str, depth: int = 3) -> str:
        rows = graph.tree_listing(self.store.read("graph_edges"), path, depth)
        return "\n".join("  " * level + name + (" (circular)" if again else "") for level, name, again in rows)

    def importers(self, path: str, shown: int = 5) -> str:
        """How many files a file imports and is imported by, and the first of the latter."""
        e = self.store.read("graph_edges").select("from_path", "to_path").distinct()
        r = e.agg(F.count(F.when(F.col("from_path") == path, 1)).alias("out"), F.count(F.when(F.col("to_path") == path, 1)).alias("into")).first()
        first = [x.from_path for x in e.where(F.col("to_path") == path).orderBy("from_path").limit(shown).collect()]
        rest = [f"  and {r.into - shown} more"] if r.into > shown else []
        return "\n".join([f"imports {r.out}, imported by {r.into}", *[f"  {p}" for p in first], *rest])

    def graph_svg(self, path: str, depth: int = 3) -> str:
        """The dependencies of a file within some links, one row of boxes per number of links."""
        e = self.store.read("graph_edges")
        d = graph.dependencies(e, self.spark.createDataFrame([(path,)], "path string"), depth)
        place: dict[str, tuple[int, int]] = {}
        count: dict[int, int] = {}
        for r in d.orderBy("depth", "path").select("path", "depth", text.node_label(F.col("path")).alias("label")).toLocalIterator():
            place[r.path] = (20 + 240 * count.get(r.depth, 0), 20 + 90 * r.depth)
            count[r.depth] = count.get(r.depth, 0) + 1
        inner = d.select(F.col("path").alias("from_path"))
        links = e.join(inner, "from_path", "left_semi").join(d.select(F.col("path").alias("to_path")), "to_path", "left_semi").select("from_path", "to_path").distinct().toLocalIterator()
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        lines = [f'<line x1="{place[r.from_path][0] + 110}" y1="{place[r.from_path][1] + 40}" x2="{place[r.to_path][0] + 110}" y2="{place[r.to_path][1]}" stroke="#888"/>' for r in links]
        boxes = [f'<g><rect x="{x}" y="{y}" width="220" height="40" fill="#eef" stroke="#446"/><text x="{x + 8}" y="{y + 25}" font-size="12">{esc(p if len(p) <= 28 else "..." + p[-25:])}</text></g>' for p, (x, y) in place.items()]
        width, height = 260 * max(count.values(), default=1), 90 * (max(count, default=0) + 1) + 20
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">' + "".join(lines + boxes) + "</svg>"
