"""Queries over the code-index tables, one or more per operator, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.extract.symbols import with_symbols
from skein.functions import text
from skein.operators import budget, changes, graph, ledger, relevance, resolve, stats, store
from skein.session import cut
from skein.sources import corpus, ignore
from skein.sources.tables import spread, table
from skein.streaming import upkeep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2025-09-17"
PATTERNS = ("node_modules/", "*.min.js", "**/gen/**", "third_party/", "src/ui/*.ts", "vendor/")
HUB = "platform-core/src/shared/index.ts"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# Names of tables and columns, and the endings that imports are tried with, in their order.
# Parts of the SQL that several queries share.
_INDEX = "(SELECT path, arg_max(hash, struct_pack(a := last_indexed, b := hash)) AS hash FROM indexed_files WHERE path IS NOT NULL GROUP BY path)"
_DISK = "(SELECT path, sha256(max(source)) AS hash, max(source) AS source FROM parse_results WHERE source IS NOT NULL GROUP BY path)"
_EDGES = "(SELECT DISTINCT from_path, to_path FROM graph_edges)"
_FILES = "(SELECT path, max(token_count) AS token_count, max(symbol_token_count) AS symbol_token_count, max(last_indexed) AS last_indexed, max(summary) AS summary FROM indexed_files GROUP BY path)"
_UTF16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_ONCE = "(SELECT DISTINCT ON (task_id) * FROM task_records WHERE completed_at IS NOT NULL ORDER BY task_id, completed_at)"
_FIGURES = "count(*) AS tasks, CAST(coalesce(sum(raw_tokens), 0) AS BIGINT) AS raw, CAST(coalesce(sum(optimized_tokens), 0) AS BIGINT) AS optimized, CAST(coalesce(sum(saved_tokens), 0) AS BIGINT) AS saved, CAST(coalesce(floor(avg(reduction_percent) + 0.5), 0) AS INT) AS avg_percent"
_SYMBOLS = "(SELECT DISTINCT ON (file_path) * FROM symbol_maps ORDER BY file_path, recorded_at DESC, token_count DESC)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files", ["path", "hash", "last_indexed"]).where("path is not null").groupBy("path").agg(F.max_by("hash", F.struct("last_indexed", "hash")).alias("hash"))


def _disk(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "parse_results", ["path", "source"]).where("source is not null").groupBy("path").agg(F.max("source").alias("source"))
    return corpus.hashed(one, "source")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_edges", ["from_path", "to_path"]).distinct()


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files").groupBy("path").agg(*[F.max(c).alias(c) for c in ("token_count", "symbol_token_count", "last_indexed", "summary")])


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbol_maps")
    return s.groupBy("file_path").agg(F.max_by(F.struct(*[c for c in s.columns if c != "file_path"]), F.struct("recorded_at", "token_count")).alias("r")).select("file_path", "r.*")


@query("corpus_hash", f"SELECT path, hash, CAST(ceil({_UTF16.format('source')} / 4) AS INT) AS tokens FROM {_DISK}")
def corpus_hash(spark: SparkSession, d: str) -> DataFrame:
    return _disk(spark, d).select("path", "hash", text.token_estimate(F.col("source")).alias("tokens"))


_CHANGED = f"(SELECT d.path, CASE WHEN i.path IS NULL THEN 'new' ELSE 'changed' END AS change FROM {_DISK} d LEFT JOIN {_INDEX} i ON i.path = d.path WHERE i.hash IS NULL OR i.hash <> d.hash)"


@query("change_detect", f"SELECT * FROM {_CHANGED}")
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    return changes.changed_by_hash(_disk(spark, d), _index(spark, d))


@query("classify_files", f"SELECT coalesce(i.path, c.path) AS path, CASE WHEN c.path IS NULL THEN 'UNRELATED' ELSE 'CHANGED' END AS state, CASE WHEN c.path IS NULL THEN 999 ELSE 0 END AS depth FROM {_INDEX} i FULL JOIN {_CHANGED} c ON c.path = i.path")
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.classify(_index(spark, d), change_detect(spark, d))


@query("repair_plan", f"SELECT i.path, CASE WHEN d.path IS NULL THEN 'delete' WHEN i.hash IS DISTINCT FROM d.hash THEN 'reindex' ELSE 'keep' END AS action FROM {_INDEX} i LEFT JOIN {_DISK} d ON d.path = i.path")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    return changes.repair_plan(_disk(spark, d), _index(spark, d))


@query("ignore_filter", f"SELECT DISTINCT path FROM indexed_files WHERE NOT regexp_matches(path, '{ignore.combined(PATTERNS)}')")
def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files", ["path"]).where(~ignore.ignored(F.col("path"), PATTERNS)).distinct()


@query("ext_breakdown", f"SELECT CASE WHEN e = '' THEN 'other' ELSE e END AS ext, count(*) AS n FROM (SELECT lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS e FROM {_FILES}) GROUP BY 1")
def ext_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_extension(_files(spark, d))


@query("skeleton_dirs", f"SELECT DISTINCT array_to_string(p[1:i], '/') AS dir FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM (SELECT string_split(path, '/') AS p FROM {_FILES}))")
def skeleton_dirs(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select(F.explode(text.directories(F.col("path"))).alias("dir")).distinct()


@query("language_counts", "SELECT CASE WHEN e IN ('.ts', '.tsx') THEN 'typescript' WHEN e IN ('.js', '.jsx') THEN 'javascript' WHEN e = '.py' THEN 'python' WHEN e = '.go' THEN 'go' WHEN e = '.rs' THEN 'rust' WHEN e = '.java' THEN 'java' ELSE 'unknown' END AS language, count(*) AS n FROM (SELECT lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS e FROM indexed_files) GROUP BY 1")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_files", ["path"]).groupBy(text.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


_IMPORTS = f"(SELECT file_path AS from_path, i.source AS source FROM (SELECT file_path, unnest(imports) AS i FROM {_SYMBOLS}) WHERE i.source IS NOT NULL)"


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(spark, d).select(F.col("file_path").alias("from_path"), F.explode("imports.source").alias("source")).where("source is not null")


@query("import_sources", f"SELECT source, count(*) AS n FROM {_IMPORTS} GROUP BY source")
def import_sources(spark: SparkSession, d: str) -> DataFrame:
    return _imports(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# The files are named as the imports name them: folder of the importing file and the import, with the endings of scripts.
_KNOWN = "(SELECT DISTINCT path FROM indexed_files)"


# A folder and the step up after it, taken away as often as paths of the tables have any.
_UP = "b"
for _ in range(8):
    _UP = f"regexp_replace({_UP}, '(^|/)(?:[^/.]|\\.[^/.])[^/]*/\\.\\.(/|$)', '\\1')"


@query(
    "resolve_imports",
    f"""
WITH base AS (SELECT DISTINCT from_path, source, {_UP} AS b FROM (SELECT *, regexp_replace(regexp_replace(from_path, '/?[^/]*$', '') || '/' || source, '/\\./', '/', 'g') AS b FROM {_IMPORTS} WHERE source LIKE '.%')),
tried AS (
  SELECT from_path, source, 0 AS rank, b AS to_path FROM base WHERE regexp_matches(b, '\\.(ts|tsx|js|jsx)$')
  UNION ALL SELECT from_path, source, 1 + s.i, regexp_replace(b, '\\.js$', '') || s.x FROM base, (SELECT unnest(range(8)) AS i, unnest(['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS x) s WHERE b LIKE '%.js'
  UNION ALL SELECT from_path, source, 9 + s.i, b || s.x FROM base, (SELECT unnest(range(8)) AS i, unnest(['.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS x) s)
SELECT from_path, source, arg_min(to_path, rank) AS to_path FROM tried WHERE to_path IN (SELECT path FROM {_KNOWN}) GROUP BY ALL""",
)
def resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_relative(_imports(spark, d), table(spark, d, "indexed_files", ["path"]))


@query(
    "resolve_workspace",
    f"SELECT DISTINCT from_path, source, '{HUB}' AS to_path FROM {_IMPORTS} WHERE source IN ('@platform-core/shared', '@platform-core/shared.js', 'shared') AND EXISTS (SELECT 1 FROM graph_edges WHERE to_path = '{HUB}')",
)
def resolve_workspace(spark: SparkSession, d: str) -> DataFrame:
    packages = spark.createDataFrame([("@platform-core/shared", "platform-core/src/shared", "shared/index.js"), ("@platform-core/shared.js", "platform-core/src/shared", "shared/index")], "name string, src_dir string, main string")
    known = _edges(spark, d).select(F.col("to_path").alias("path"))
    return resolve.resolve_workspace(_imports(spark, d), packages, known)


@query("edges_build", f"SELECT from_path, to_path FROM {_EDGES} WHERE to_path IS NOT NULL")
def edges_build(spark: SparkSession, d: str) -> DataFrame:
    return resolve.edges_from(table(spark, d, "graph_edges"))


_CHANGED_PATHS = f"(SELECT path FROM {_CHANGED} WHERE change = 'changed')"


@query(
    "edges_replace",
    "SELECT from_path, to_path FROM graph_edges WHERE from_path NOT LIKE 'amber-harbor/%' UNION SELECT from_path, to_path FROM graph_edges WHERE from_path LIKE 'amber-harbor/%' AND to_path LIKE 'amber-harbor/%'",
)
def edges_replace(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    own = e.where("from_path like 'amber-harbor/%'")
    return graph.replace_out_edges(e, own, own.where("to_path like 'amber-harbor/%'"))


_REMOVED = "(SELECT path FROM (SELECT path, arg_max(type, struct_pack(a := ts, b := type)) AS last FROM watch_events WHERE path IS NOT NULL AND type IN ('added', 'updated', 'removed') GROUP BY path) WHERE last = 'removed')"


def _removed(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.latest_state(table(spark, d, "watch_events")).where("type = 'removed'").select("path")


@query("edges_drop_nodes", f"SELECT from_path, to_path FROM {_EDGES} WHERE from_path NOT IN (SELECT path FROM {_REMOVED}) AND to_path NOT IN (SELECT path FROM {_REMOVED})")
def edges_drop_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.drop_nodes(_edges(spark, d), _removed(spark, d))


@query("top_imported", f"SELECT to_path AS path, count(*) AS n FROM {_EDGES} GROUP BY 1 ORDER BY n DESC, path LIMIT 5")
def top_imported(spark: SparkSession, d: str) -> DataFrame:
    return stats.most_imported(_edges(spark, d))


@query("out_degrees", f"SELECT from_path AS path, count(*) AS n FROM {_EDGES} GROUP BY 1")
def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degrees(_edges(spark, d))


_SEEDS = f"(SELECT path FROM {_CHANGED_PATHS})"


def _bfs_sql(depth: int, both: bool = True, seeds: str = _SEEDS) -> str:
    back = f" UNION SELECT to_path, from_path FROM {_EDGES}" if both else ""
    return f"WITH RECURSIVE s AS (SELECT from_path AS a, to_path AS b FROM {_EDGES}{back}), w AS (SELECT path, 0 AS depth FROM {seeds} UNION SELECT b, depth + 1 FROM w JOIN s ON s.a = w.path WHERE depth < {depth}) SELECT path, min(depth) AS depth FROM w GROUP BY path"


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return change_detect(spark, d).where("change = 'changed'").select("path")


@query("bfs_depth2", _bfs_sql(2))
def bfs_depth2(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, d), _seeds(spark, d), 2)


@query("bfs_depth3", f"WITH x AS ({_bfs_sql(3)}) SELECT path, depth, CASE depth WHEN 0 THEN 'CHANGED' WHEN 1 THEN 'TOUCHED' WHEN 2 THEN 'ANCESTOR' ELSE 'UNRELATED' END AS state FROM x")
def bfs_depth3(spark: SparkSession, d: str) -> DataFrame:
    return graph.states(graph.neighbourhood(_edges(spark, d), _seeds(spark, d), 3))


@query("dep_tree_reach", _bfs_sql(4, both=False))
def dep_tree_reach(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependencies(_edges(spark, d), _seeds(spark, d), 4)


_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


@query("knn_topk", f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, {_QUERY_VECTOR}) WHERE score >= 0.1 ORDER BY score DESC, vec_id LIMIT 50")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").first()["embedding"]
    return relevance.most_similar(v, q, "vec_id", "embedding", 0.1, 50).withColumn("score", F.round("score", 6))


# Of each file its latest row, if its vector fits; of each model the vector of the least path stands for a task.
_VECTORS = "(SELECT file_path, model, dimensions, vector FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY created_at DESC NULLS LAST, model DESC NULLS LAST) AS r FROM file_embeddings) WHERE r = 1 AND vector IS NOT NULL AND len(vector) = dimensions AND list_sum(list_transform(vector, lambda x: x * x)) > 0)"


def _knn_sql(threshold: float, k: int) -> str:
    return f"""(SELECT file_path, model, score FROM (SELECT *, row_number() OVER (PARTITION BY model, dimensions ORDER BY score DESC, file_path) AS r FROM (
  SELECT v.file_path, v.model, v.dimensions, list_cosine_similarity(v.vector::DOUBLE[], q.q::DOUBLE[]) AS score
  FROM {_VECTORS} v JOIN (SELECT model, dimensions, arg_min(vector, file_path) AS q FROM {_VECTORS} GROUP BY ALL) q ON q.model = v.model AND q.dimensions = v.dimensions) WHERE score >= {threshold}) WHERE r <= {k})"""


def _knn(spark: SparkSession, d: str, threshold: float, k: int) -> DataFrame:
    v = table(spark, d, "file_embeddings", ["file_path", "model", "dimensions", "vector", "created_at"]).groupBy("file_path").agg(F.max_by(F.struct("model", "dimensions", "vector"), F.struct("created_at", "model")).alias("r")).select("file_path", "r.*")
    v = v.where(F.expr("vector is not null and size(vector) = dimensions") & F.exists("vector", lambda x: x != 0))
    queries = v.groupBy("model", "dimensions").agg(F.min_by("vector", "file_path").alias("q"))
    return relevance.most_similar_each(v, queries, ["model", "dimensions"], threshold, k)


_SIMILAR = f"(SELECT file_path AS path, score FROM {_knn_sql(0.2, 200)})"
_SCORED = f"""(SELECT w.path, depth, coalesce(score, CASE WHEN depth <= 1 THEN 0.5 ELSE 0.3 END) AS semantic, CASE depth WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END AS graph_score FROM ({_bfs_sql(2)}) w LEFT JOIN {_SIMILAR} s ON s.path = w.path)"""
_FINAL = f"(SELECT *, CASE WHEN depth = 0 THEN 1.0 ELSE 0.4 * semantic + 0.6 * graph_score END AS final FROM {_SCORED})"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return relevance.score(bfs_depth2(spark, d), _knn(spark, d, 0.2, 200).select(F.col("file_path").alias("path"), "score"))


@query("hybrid_score", f"SELECT path, depth, round(semantic, 6) AS semantic, CAST(graph_score AS DOUBLE) AS graph_score, round(final, 6) AS final, depth <= 1 OR final >= 0.45 AS included FROM {_FINAL}")
def hybrid_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("path", "depth", F.round("semantic", 6).alias("semantic"), "graph_score", F.round("final", 6).alias("final"), "included")


_RANKED = f"(SELECT path, bucket, row_number() OVER (PARTITION BY bucket ORDER BY final DESC, path) AS rank FROM (SELECT *, CASE depth WHEN 0 THEN 'changed' WHEN 1 THEN 'touched' ELSE 'ancestor' END AS bucket FROM {_FINAL} WHERE depth <= 1 OR final >= 0.45))"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return relevance.rank(_scored(spark, d).withColumn("final", F.round("final", 9)))


_RANKED = _RANKED.replace("ORDER BY final DESC", "ORDER BY round(final, 9) DESC")


@query("rank_buckets", f"SELECT path, bucket, CAST(rank AS INT) AS rank FROM {_RANKED}")
def rank_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("path", "bucket", "rank")


_COSTS = f"""(SELECT r.path, bucket, rank, coalesce(token_count, 0) AS "full", coalesce(symbol_token_count, 0) AS symbols, CAST(ceil({_UTF16.format("coalesce(summary, '')")} / 4) AS INT) AS summary FROM {_RANKED} r LEFT JOIN {_FILES} f ON f.path = r.path)"""
_DIRS = f"(SELECT DISTINCT array_to_string(p[1:i], '/') AS dir FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS i FROM (SELECT string_split(path, '/') AS p FROM {_FILES})))"
_SKELETON = f"(SELECT CAST(ceil((18 + sum(length(dir) + 1)) / 4) AS BIGINT) AS sk FROM {_DIRS})"


def _costs(spark: SparkSession, d: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return _ranked(spark, d).select("path", "bucket", "rank").join(_files(spark, d), "path", "left").select("path", "bucket", "rank", zero("token_count").alias("full"), zero("symbol_token_count").alias("symbols"), text.token_estimate(F.col("summary")).alias("summary"))


def _skeleton_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of the list of directories below its title, in one row."""
    return skeleton_dirs(spark, d).agg(F.ceil((F.lit(18) + F.sum(F.length("dir") + 1)) / 4).alias("tokens"))


def _fit_sql(rows: str, room: str) -> str:
    """First fit over rows(n, path, cost) by recursion."""
    return f"fit AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS path, 0::BIGINT AS used, false AS kept UNION ALL SELECT r.n, r.path, CASE WHEN fit.used + r.cost <= {room} THEN fit.used + r.cost ELSE fit.used END, fit.used + r.cost <= {room} FROM fit JOIN {rows} r ON r.n = fit.n + 1)"


@query("budget_greedy", f"WITH RECURSIVE items AS (SELECT row_number() OVER (ORDER BY rank) AS n, path, symbols AS cost FROM {_COSTS} WHERE bucket = 'touched'), {_fit_sql('items', '1500')} SELECT path FROM fit WHERE kept")
def budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    return budget.first_fit(cut(_costs(spark, d).where("bucket = 'touched'")), 1500, cost="symbols").select("path")


def _cascade_sql(budgets: tuple[int, ...]) -> str:
    one = []
    for b in budgets:
        one.append(f"""(WITH RECURSIVE c AS (SELECT * FROM {_COSTS}),
sums AS (SELECT coalesce(sum("full") FILTER (bucket = 'changed'), 0) AS ch, coalesce(sum(symbols) FILTER (bucket = 'touched'), 0) AS t, coalesce(sum(summary) FILTER (bucket = 'touched'), 0) AS s, coalesce(sum(summary) FILTER (bucket = 'ancestor'), 0) AS a, (SELECT sk FROM {_SKELETON}) AS sk FROM c),
f AS (SELECT 50 + ch + t + a + sk > {b} AS o1, o1 AND 50 + ch + s + a + sk > {b} AS o2, o2 AND 50 + ch + s + sk > {b} AS o3, o3 AND 50 + ch + s > {b} AS o4, greatest({b} - 50 - ch, 0) AS room FROM sums),
items AS (SELECT row_number() OVER (ORDER BY rank) AS n, path, summary AS cost FROM c WHERE bucket = 'touched'), {_fit_sql('items', '(SELECT room FROM f)')},
k AS (SELECT c.path, c.bucket, c."full", c.symbols, c.summary, o1, o3, CASE WHEN c.bucket = 'changed' THEN true WHEN c.bucket = 'ancestor' THEN NOT o2 ELSE NOT o4 OR coalesce(fit.kept, false) END AS kept FROM c CROSS JOIN f LEFT JOIN fit ON fit.path = c.path)
SELECT {b} AS budget, path, kept, CASE WHEN NOT kept THEN 'excluded' WHEN bucket = 'changed' THEN 'full' WHEN bucket = 'touched' AND NOT o1 THEN 'symbols' ELSE 'summary' END AS level,
  CAST(CASE WHEN NOT kept THEN 0 WHEN bucket = 'changed' THEN "full" WHEN bucket = 'touched' AND NOT o1 THEN symbols ELSE summary END AS INT) AS tokens, o3 AS no_skeleton FROM k)""")
    return " UNION ALL ".join(one)


_BUDGETS = (4000, 9000, 60000, 120000, 1500000)


@query("budget_cascade", _cascade_sql(_BUDGETS))
def budget_cascade(spark: SparkSession, d: str) -> DataFrame:
    budgets = spark.createDataFrame([(b,) for b in _BUDGETS], "budget int")
    return budget.cascade(cut(_costs(spark, d)), budgets, 50, _skeleton_tokens(spark, d)).select("budget", "path", "kept", "level", F.col("tokens").cast("int").alias("tokens"), "no_skeleton")


@query("savings", f"SELECT session_id, CAST(sum(raw_tokens) - sum(optimized_tokens) AS BIGINT) AS saved, CAST(CASE WHEN sum(raw_tokens) > 0 THEN floor((sum(raw_tokens) - sum(optimized_tokens)) * 100.0 / sum(raw_tokens) + 0.5) ELSE 0 END AS INT) AS percent, CASE WHEN sum(optimized_tokens) > 0 THEN floor(sum(raw_tokens) * 10.0 / sum(optimized_tokens) + 0.5) / 10 ELSE 1 END AS multiple FROM {_ONCE} GROUP BY 1")
def savings(spark: SparkSession, d: str) -> DataFrame:
    s = ledger.once(table(spark, d, "task_records")).groupBy("session_id").agg(F.sum("raw_tokens").alias("raw"), F.sum("optimized_tokens").alias("opt"))
    return s.select("session_id", *budget.savings(F.col("raw"), F.col("opt")))


@query("budget_escalation", f"SELECT repository, n, CAST(CASE WHEN n >= 10 THEN greatest(2000, 8000) WHEN n >= 5 THEN greatest(2000, 4000) ELSE 2000 END AS INT) AS budget FROM (SELECT string_split(path, '/')[1] AS repository, count(*) AS n FROM {_CHANGED} GROUP BY 1)")
def budget_escalation(spark: SparkSession, d: str) -> DataFrame:
    n = change_detect(spark, d).groupBy(F.split("path", "/")[0].alias("repository")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("repository", "n", budget.escalated(F.lit(2000), F.col("n")).alias("budget"))


@query("task_weekly", f"SELECT *, CAST(floor(greatest(200000 - optimized, 0) / CASE WHEN tasks > 0 THEN greatest(floor(optimized / tasks + 0.5), 1) ELSE 2000 END) AS BIGINT) AS remaining_tasks FROM (SELECT {_FIGURES} FROM {_ONCE} WHERE completed_at >= date_trunc('week', DATE '{AS_OF}') AND completed_at < date_trunc('week', DATE '{AS_OF}') + INTERVAL 7 DAY)")
def task_weekly(spark: SparkSession, d: str) -> DataFrame:
    return ledger.weekly(table(spark, d, "task_records"), AS_OF)


@query("task_by_week", f"SELECT strftime(date_trunc('week', completed_at), '%Y-%m-%d') AS week, {_FIGURES} FROM {_ONCE} GROUP BY 1")
def task_by_week(spark: SparkSession, d: str) -> DataFrame:
    return ledger.by_week(table(spark, d, "task_records"))


@query("task_alltime", f"SELECT {_FIGURES} FROM {_ONCE}")
def task_alltime(spark: SparkSession, d: str) -> DataFrame:
    return ledger.all_time(table(spark, d, "task_records"))


@query("task_session", f"SELECT session_id, {_FIGURES} FROM {_ONCE} GROUP BY 1")
def task_session(spark: SparkSession, d: str) -> DataFrame:
    return ledger.sessions(table(spark, d, "task_records"))


@query("task_recent", f"SELECT task_id, session_id, raw_tokens FROM {_ONCE} ORDER BY completed_at DESC, task_id LIMIT 10")
def task_recent(spark: SparkSession, d: str) -> DataFrame:
    return ledger.recent(table(spark, d, "task_records")).select("task_id", "session_id", "raw_tokens")


@query("index_stats", f"SELECT count(*) AS files, CAST(sum(token_count) AS BIGINT) AS tokens, CAST(sum(symbol_token_count) AS BIGINT) AS symbol_tokens, strftime(max(last_indexed), '%Y-%m-%d %H:%M:%S') AS last_indexed, CAST(floor((1 - sum(symbol_token_count) / sum(token_count)) * 100 + 0.5) AS INT) AS reduction FROM {_FILES}")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.totals(_files(spark, d)).withColumn("last_indexed", F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"))


@query(
    "summary_line",
    f"""WITH p AS (SELECT file_path, list_transform(exports, lambda x: x.name) AS e, list_transform(list_filter(imports, lambda x: NOT contains(x.source, '@types')), lambda x: string_split(x.source, '/')[-1]) AS u, list_transform(classes, lambda x: x.name) AS c, list_transform(types, lambda x: x.name) AS t FROM {_SYMBOLS}),
u AS (SELECT file_path, string_agg(m, ', ' ORDER BY i) AS u FROM (SELECT file_path, m, min(i) AS i FROM (SELECT file_path, unnest(u[1:3]) AS m, generate_subscripts(u[1:3], 1) AS i FROM p) GROUP BY ALL) GROUP BY 1),
q AS (SELECT p.file_path, concat_ws(' · ', CASE WHEN len(e) > 0 THEN 'exports: ' || array_to_string(e[1:4], ', ') || CASE WHEN len(e) > 4 THEN ', +' || (len(e) - 4) || ' more' ELSE '' END END, 'uses: ' || u.u, CASE WHEN len(c) > 0 THEN 'classes: ' || array_to_string(c, ', ') END, CASE WHEN len(t) > 0 THEN 'types: ' || array_to_string(t[1:3], ', ') END) AS r FROM p LEFT JOIN u ON u.file_path = p.file_path)
SELECT file_path, CASE WHEN r = '' THEN string_split(file_path, '/')[-1] ELSE string_split(file_path, '/')[-1] || ' - ' || r END AS summary FROM q""",
)
def summary_line(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("file_path", "exports", "imports", "classes", "types")]
    return _symbols(spark, d).select("file_path", text.summary_line(*c).alias("summary"))


_SYMBOL_TEXT = f"""(SELECT file_path, concat_ws(chr(10), 'FILE: ' || file_path,
  CASE WHEN len(exports) > 0 THEN 'EXPORTS:' || chr(10) || array_to_string(list_transform(exports, lambda x: '  ' || coalesce(x.signature, x.name, '')), chr(10)) END,
  CASE WHEN len(imports) > 0 THEN 'IMPORTS:' || chr(10) || array_to_string(list_transform(imports, lambda x: '  ' || array_to_string(coalesce(x.names, []), ', ') || ' ← ' || coalesce(x.resolved_path, x.source, '')), chr(10)) END,
  CASE WHEN len(types) > 0 THEN 'TYPES:' || chr(10) || array_to_string(list_transform(types, lambda x: '  ' || coalesce(x.definition, x.name, '')), chr(10)) END) AS symbol_text FROM {_SYMBOLS})"""


@query("symbol_text", f"SELECT file_path, symbol_text, CAST(ceil({_UTF16.format('symbol_text')} / 4) AS INT) AS tokens FROM {_SYMBOL_TEXT}")
def symbol_text(spark: SparkSession, d: str) -> DataFrame:
    s = _symbols(spark, d).select("file_path", text.symbol_text(F.col("file_path"), F.col("exports"), F.col("imports"), F.col("types")).alias("symbol_text"))
    return s.withColumn("tokens", text.token_estimate(F.col("symbol_text")))


@query(
    "embedding_text",
    f"SELECT s.file_path, concat_ws(chr(10), 'file: ' || s.file_path, CASE WHEN length(summary) > 0 THEN 'description: ' || summary END, 'symbols: ' || symbol_text) AS described FROM {_SYMBOL_TEXT} s LEFT JOIN (SELECT path, max(summary) AS summary FROM indexed_files GROUP BY path) i ON i.path = s.file_path",
)
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "indexed_files", ["path", "summary"]).groupBy(F.col("path").alias("file_path")).agg(F.max("summary").alias("summary"))
    return symbol_text(spark, d).join(i, "file_path", "left").select("file_path", text.embedding_text(F.col("file_path"), F.col("summary"), F.col("symbol_text")).alias("described"))


@query("slot_text", f"SELECT bucket, string_agg('SUMMARY: ' || path, chr(10) || chr(10) ORDER BY rank) AS content, CAST(count(*) AS INT) AS n FROM {_RANKED} GROUP BY bucket")
def slot_text(spark: SparkSession, d: str) -> DataFrame:
    return budget.slot_text(_ranked(spark, d), "bucket", "rank", F.concat(F.lit("SUMMARY: "), "path"))


@query("upsert_files", f"SELECT path, hash FROM {_DISK} UNION ALL SELECT path, hash FROM {_INDEX} WHERE path NOT IN (SELECT path FROM {_DISK})")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    return store.upsert(_index(spark, d), _disk(spark, d), ["path"])


@query("insert_missing", f"SELECT path, hash FROM {_INDEX} UNION ALL SELECT path, hash FROM {_DISK} WHERE path NOT IN (SELECT path FROM {_INDEX})")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    return store.insert_missing(_index(spark, d), _disk(spark, d), ["path"])


@query(
    "cascade_delete",
    f"SELECT 'indexed_files' AS tab, count(*) AS n FROM {_INDEX} WHERE path NOT IN (SELECT path FROM {_REMOVED}) UNION ALL SELECT 'symbol_maps', count(*) FROM symbol_maps WHERE file_path NOT IN (SELECT path FROM {_REMOVED}) UNION ALL SELECT 'file_embeddings', count(*) FROM file_embeddings WHERE file_path NOT IN (SELECT path FROM {_REMOVED}) UNION ALL SELECT 'graph_edges', count(*) FROM {_EDGES} WHERE from_path NOT IN (SELECT path FROM {_REMOVED}) AND to_path NOT IN (SELECT path FROM {_REMOVED})",
)
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    parts = store.cascade_delete(_index(spark, d), table(spark, d, "symbol_maps", ["file_path"]), table(spark, d, "file_embeddings", ["file_path"]), _edges(spark, d), _removed(spark, d))
    out = None
    for name, df in zip(("indexed_files", "symbol_maps", "file_embeddings", "graph_edges"), parts):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("watch_counts", "SELECT type, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS duration_ms FROM watch_events GROUP BY type")
def watch_counts(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.event_counts(table(spark, d, "watch_events"))


_BURSTS = """
WITH g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL {0} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, type ROWS UNBOUNDED PRECEDING) AS burst FROM (SELECT path, type, ts, lag(ts) OVER (PARTITION BY path ORDER BY ts, type) AS prev FROM watch_events WHERE path IS NOT NULL AND ts IS NOT NULL))
SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, count(*) AS n, arg_max(type, struct_pack(a := ts, b := type)) AS type FROM g GROUP BY path, burst"""


def _stamped(df: DataFrame) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return df.select("path", stamp("first_ts"), stamp("last_ts"), "n", "type")


@query("watch_debounce", _BURSTS.format("30 DAY"))
def watch_debounce(spark: SparkSession, d: str) -> DataFrame:
    return _stamped(upkeep.debounced(table(spark, d, "watch_events"), "30 days"))


@query("watch_latest", "SELECT path, arg_max(type, struct_pack(a := ts, b := type)) AS type FROM watch_events WHERE path IS NOT NULL AND type IN ('added', 'updated', 'removed') GROUP BY path")
def watch_latest(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.latest_state(table(spark, d, "watch_events")).select("path", "type")


def _replay(spark: SparkSession, d: str, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The result of a stream over the watcher's records, once all of them are read."""
    import uuid

    from skein.session import shared_folder

    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    # A stream reads folders; a table that is one file is found in its own folder by its name.
    path = f"{d}/watch_events.parquet"
    schema = spark.read.parquet(path).schema
    single = not any(f.endswith(".parquet") and "/watch_events.parquet/" in f for f in spark.read.parquet(path).inputFiles())
    source = spark.readStream.schema(schema)
    events = source.option("pathGlobFilter", "watch_events.parquet").parquet(d) if single else source.parquet(path)
    out = f"{where}/result"

    def keep(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(out)

    stream = plan(events.withColumn("ts", F.col("ts").cast("timestamp")))
    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_counts", SQL["watch_counts"])
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d, upkeep.event_counts, "complete")


@query("stream_latest", SQL["watch_latest"])
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d, upkeep.latest_state, "complete").select("path", "type")


def _symbols_of(language: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "parse_results").where((F.col("language") == language) & F.col("source").isNotNull()).dropDuplicates(["path", "source"])
        return with_symbols(spread(rows, "path", "source")).select("path", "exports", "imports", "classes", "functions", "types")

    return run


@query("stream_debounce", SQL["watch_debounce"])
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    return _stamped(_replay(spark, d, lambda e: upkeep.debounced(e, "30 days"), "complete"))


@query("state_counts", f"WITH x AS ({_bfs_sql(2)}), s AS (SELECT f.path, CASE depth WHEN 0 THEN 'CHANGED' WHEN 1 THEN 'TOUCHED' WHEN 2 THEN 'ANCESTOR' ELSE 'UNRELATED' END AS state FROM (SELECT path FROM {_FILES} UNION SELECT path FROM x) f LEFT JOIN x ON x.path = f.path) SELECT state, count(*) AS n FROM s GROUP BY state")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    walked = graph.states(bfs_depth2(spark, d), _files(spark, d))
    return walked.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("score_range", f"SELECT round(min(final), 6) AS least, round(max(final), 6) AS greatest, count(*) AS n FROM {_FINAL}")
def score_range(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).agg(F.round(F.min("final"), 6).alias("least"), F.round(F.max("final"), 6).alias("greatest"), F.count(F.lit(1)).alias("n"))


@query("knn_files", f"SELECT file_path, model, round(score, 6) AS score FROM {_knn_sql(0.3, 20)}")
def knn_files(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, 0.3, 20).select("file_path", "model", F.round("score", 6).alias("score"))


# Declarations that begin their line, by language; what a regular expression can tell of the symbols.
_TS = ("typescript", "javascript")
_DECLARED = (
    ("function", ("python",), r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)"), ("function", ("go",), r"(?m)^func[ \t]+(?:\([^)\n]*\)[ \t]*)?(\w+)"),
    ("function", ("rust",), r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:async|const|unsafe)[ \t]+)*fn[ \t]+(\w+)"),
    ("class", ("python",), r"(?m)^[ \t]*class[ \t]+(\w+)"), ("class", ("java",), r"(?m)^[ \t]*(?:(?:public|abstract|final|static)[ \t]+)*class[ \t]+(\w+)"), ("class", _TS, r"(?m)^[^\n'\"/*]*?\bclass[ \t]+(\w+)"),
    ("import", _TS, r"""(?m)^import\b[^;'"]*?['"]([^'"\n]+)['"]"""), ("import", ("java",), r"(?m)^import[ \t]+(?:static[ \t]+)?([\w.*]+)[ \t]*;"), ("import", ("rust",), r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([^;\n]+);"),
    ("type", ("typescript",), r"(?m)^[ \t]*(?:export[ \t]+)?(?:declare[ \t]+)?(?:interface|type|enum|const enum)[ \t]+(\w+)[^\n]*[={]"), ("type", ("go",), r"(?m)^type[ \t]+(\w+)[ \t]+"),
    ("type", ("rust",), r"(?m)^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?(?:struct|enum|trait)[ \t]+(\w+)"),
)


def _declared_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    text_ = "replace(replace(source, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    one = [
        f"SELECT path, language, '{kind}' AS kind, unnest(regexp_extract_all({text_}, {quoted(pattern)}, 1)) AS name FROM parse_results WHERE source IS NOT NULL AND language IN ({', '.join(map(quoted, languages))})"
        for kind, languages, pattern in _DECLARED
    ]
    return f"SELECT DISTINCT * FROM ({' UNION ALL '.join(one)})"


@query("symbols_declared", _declared_sql())
def symbols_declared(spark: SparkSession, d: str) -> DataFrame:
    """(path, language, kind, name) of functions, classes, types and imports that begin a line."""
    rows = table(spark, d, "parse_results", ["path", "language", "source"]).where("source is not null").dropDuplicates(["path", "source"])
    s = with_symbols(spread(rows, "path", "source"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("names")) for k, c in (("function", "functions.name"), ("class", "classes.name"), ("import", "imports.source"), ("type", "types.name"))])
    found = s.select("path", "language", F.explode(kinds).alias("x")).select("path", "language", "x.kind", F.explode("x.names").alias("name"))
    told = " or ".join(f"kind = '{k}' and language in {languages!r}".replace(",)", ")") for k, languages, _ in _DECLARED)
    return found.where(told).distinct()


for _language in ("typescript", "javascript", "python", "go", "rust", "java"):
    QUERIES[f"symbols_{_language}"] = _symbols_of(_language)
