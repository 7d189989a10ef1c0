"""Queries of the general data problems: orphan references, hierarchies, rolling totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import hierarchy, orphans, rolling
from skein.session import cut
from skein.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _changes(spark: SparkSession, d: str, when: Callable[[str], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(references, log of changes) of the tables, or of their rows for whose column of time `when` holds."""
    read = lambda name, columns, ts: (lambda t: t.where(when(ts)) if when else t)(table(spark, d, name, columns))
    refs = cut(orphans.reference_deltas(
        {
            "graph_edges": (read("graph_edges", ["from_path", "to_path", "recorded_at"], "recorded_at"), "from_path", "to_path", "recorded_at"),
            "symbol_maps": (read("symbol_maps", ["file_path", "recorded_at"], "recorded_at"), "file_path", "file_path", "recorded_at"),
        }
    ))
    removed = read("watch_events", ["type", "path", "ts"], "ts").where("type = 'removed'")
    return refs, orphans.change_log(refs, read("indexed_files", ["path", "last_indexed"], "last_indexed"), "path", "last_indexed", removed)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs, log = _changes(spark, d)
    return orphans.orphan_references(refs, orphans.key_counts(cut(log)))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """The orphan keys with their counts, from a state that two batches of changes were merged into, the later one first."""
    early = lambda ts: F.coalesce(F.col(ts) < F.lit("2026-01-01").cast("timestamp"), F.lit(True))
    late = cut(_changes(spark, d, lambda ts: ~early(ts))[1])
    state = cut(orphans.merge_state(late, _changes(spark, d, early)[1]))
    return orphans.orphan_keys(orphans.key_counts(state)).select("target_path", "references", "existence", "appeared")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_path", "target_path")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "graph_edges", ["from_path", "to_path"]))


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tree(table(spark, d, "graph_edges", ["from_path", "to_path"]))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every file that a root reaches."""
    return p4_tree(spark, d).where("size(roots) > 0").select("path", "root_path", "full_path", F.col("depth").cast("int").alias("depth"), "is_circular", "n_descendants")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of files and their descendants."""
    return hierarchy.descendants(cut(p4_tree(spark, d)))


def _days(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "task_records", ["task_id", "session_id", "completed_at", "optimized_tokens", "saved_tokens"])
    return rolling.daily(tasks, "session_id", "task_id", "completed_at", "optimized_tokens", "saved_tokens")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.peak_days(_days(spark, d)).withColumnRenamed("entity", "session_id")


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    avg = lambda c: F.round(c, 6).alias(c)
    return rolling.rolling_totals(_days(spark, d)).select(
        F.col("entity").alias("session_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days", "n_tasks", "active_days", "optimized_total", "saved_total",
        avg("optimized_avg"), avg("saved_avg"), avg("optimized_per_day"), avg("saved_per_day"), "best_day_saved",
    )


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_report": p1_report, "p1_counts": p1_counts, "p4_found": p4_found, "p4_tree": p4_tree, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p6_found": p6_found, "p6_daily": p6_daily,
}

_P1 = """
WITH refs AS (
  SELECT 'graph_edges' AS ref_table, from_path AS ref_path, to_path AS target_path, min(recorded_at) AS recorded_at, count(*) AS n_rows FROM graph_edges WHERE to_path IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'symbol_maps', file_path, file_path, min(recorded_at), count(*) FROM symbol_maps WHERE file_path IS NOT NULL GROUP BY ALL),
files AS (SELECT path, min(last_indexed) AS a, max(last_indexed) AS b FROM indexed_files GROUP BY path),
gone AS (SELECT path, max(ts) AS r FROM watch_events WHERE type = 'removed' GROUP BY path),
cases AS (
  SELECT refs.*, CASE WHEN files.path IS NULL THEN 'missing' WHEN r > b THEN 'removed' WHEN recorded_at < a THEN 'early' END AS kind
  FROM refs LEFT JOIN files ON files.path = target_path LEFT JOIN gone ON gone.path = target_path)
"""
_P4 = """e AS (SELECT DISTINCT from_path AS u, to_path AS v FROM graph_edges WHERE from_path IS NOT NULL AND to_path IS NOT NULL),
roots AS (SELECT DISTINCT u FROM e WHERE u NOT IN (SELECT v FROM e WHERE u <> v)),
walk AS (SELECT u AS root, u AS node, 0 AS depth FROM roots UNION SELECT root, v, depth + 1 FROM walk JOIN e ON e.u = node WHERE depth < 400)"""
_P6 = """
WITH once AS (SELECT task_id, min(struct_pack(t := completed_at, s := session_id, o := coalesce(optimized_tokens, 0), v := coalesce(saved_tokens, 0))) AS r FROM task_records WHERE completed_at IS NOT NULL GROUP BY task_id),
days AS (SELECT r.s AS session_id, CAST(r.t AS DATE) AS day, count(*) AS n, sum(r.o) AS opt, sum(r.v) AS sav FROM once GROUP BY ALL),
span AS (SELECT session_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM days GROUP BY session_id),
full_days AS (SELECT span.session_id, span.day, coalesce(n, 0) AS n, (n IS NOT NULL)::INT AS active, coalesce(opt, 0) AS opt, coalesce(sav, 0) AS sav, sav AS best FROM span LEFT JOIN days USING (session_id, day)),
rolled AS (
  SELECT session_id, day, w AS window_days, sum(n) OVER x AS n_tasks, sum(active) OVER x AS active_days, sum(opt) OVER x AS opt, sum(sav) OVER x AS sav, max(best) OVER x AS best
  FROM full_days, (SELECT 7 AS w) WINDOW x AS (PARTITION BY session_id ORDER BY day ROWS 6 PRECEDING)
  UNION ALL
  SELECT session_id, day, w, sum(n) OVER x, sum(active) OVER x, sum(opt) OVER x, sum(sav) OVER x, max(best) OVER x
  FROM full_days, (SELECT 30 AS w) WINDOW x AS (PARTITION BY session_id ORDER BY day ROWS 29 PRECEDING))
"""
SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT ref_table, ref_path, target_path FROM cases WHERE kind IS NOT NULL",
    "p1_report": _P1 + "SELECT ref_table, strftime(recorded_at, '%Y-%m') AS month, kind, count(*) AS n_references, count(DISTINCT target_path) AS n_targets, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM cases WHERE kind IS NOT NULL GROUP BY ALL",
    "p1_counts": _P1 + """, rows AS (SELECT target_path, CAST(sum(n_rows) AS BIGINT) AS "references" FROM refs GROUP BY target_path),
kept AS (SELECT i.path, count(*) AS appeared, count(*) FILTER (r IS NULL OR last_indexed IS NULL OR last_indexed >= r) AS existence FROM indexed_files i LEFT JOIN gone ON gone.path = i.path GROUP BY i.path)
SELECT target_path, "references", coalesce(existence, 0) AS existence, coalesce(appeared, 0) AS appeared FROM rows LEFT JOIN kept ON kept.path = target_path WHERE coalesce(existence, 0) = 0""",
    "p4_found": f"""
WITH RECURSIVE {_P4},
trail AS (SELECT u AS a, v AS b FROM e UNION SELECT a, v FROM trail JOIN e ON e.u = b)
SELECT node AS path, root AS root_path, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY ALL
UNION ALL SELECT DISTINCT a, '', -1 FROM trail WHERE a = b""",
    "p4_paths": f"""
WITH RECURSIVE {_P4},
trail AS (SELECT u AS a, v AS b FROM e UNION SELECT a, v FROM trail JOIN e ON e.u = b),
below AS (SELECT a, count(*) FILTER (a <> b) AS n, count(*) FILTER (a = b) > 0 AS c FROM trail GROUP BY a),
near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
up AS (SELECT v, min(u) AS u FROM e JOIN near a ON a.node = u JOIN near b ON b.node = v WHERE b.depth = a.depth + 1 GROUP BY v),
named AS (SELECT node AS path, node AS root_path, node AS full_path FROM near WHERE depth = 0 UNION ALL SELECT v, root_path, full_path || ' > ' || v FROM named JOIN up ON up.u = named.path)
SELECT path, root_path, full_path, CAST(depth AS INT) AS depth, coalesce(c, false) AS is_circular, coalesce(n, 0) AS n_descendants FROM named JOIN near ON near.node = path LEFT JOIN below ON a = path""",
    "p4_descendants": """
WITH RECURSIVE e AS (SELECT DISTINCT from_path AS u, to_path AS v FROM graph_edges WHERE from_path IS NOT NULL AND to_path IS NOT NULL),
trail AS (SELECT u AS a, v AS b FROM e UNION SELECT a, v FROM trail JOIN e ON e.u = b)
SELECT DISTINCT a AS path, b AS descendant FROM trail WHERE a <> b""",
    "p6_found": _P6 + "SELECT session_id, window_days, strftime(max_by(day, struct_pack(t := sav, d := -epoch(day))), '%Y-%m-%d') AS peak_day FROM rolled GROUP BY session_id, window_days",
    "p6_daily": _P6 + """SELECT session_id, strftime(day, '%Y-%m-%d') AS day, window_days, CAST(n_tasks AS BIGINT) AS n_tasks, CAST(active_days AS BIGINT) AS active_days, CAST(opt AS BIGINT) AS optimized_total, CAST(sav AS BIGINT) AS saved_total,
  round(CASE WHEN n_tasks > 0 THEN opt / n_tasks END, 6) AS optimized_avg, round(CASE WHEN n_tasks > 0 THEN sav / n_tasks END, 6) AS saved_avg, round(opt / window_days, 6) AS optimized_per_day, round(sav / window_days, 6) AS saved_per_day, CAST(best AS BIGINT) AS best_day_saved FROM rolled""",
}
