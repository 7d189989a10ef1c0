"""The ledger of tasks: weekly, all-time and per-session figures; session totals are sums over tasks, never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import round_half_up


def once(tasks: DataFrame) -> DataFrame:
    """Each task once: exact copies fall together; tasks without an id or a time are left out."""
    others = [c for c in tasks.columns if c not in ("task_id", "completed_at")]
    good = tasks.where(F.col("task_id").isNotNull() & F.col("completed_at").isNotNull())
    return good.groupBy("task_id").agg(F.min(F.struct("completed_at", *others)).alias("r")).select("task_id", *[F.col(f"r.{c}").alias(c) for c in ("completed_at", *others)])


def _figures() -> list:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return [
        F.count(F.lit(1)).alias("tasks"), total("raw_tokens").alias("raw"), total("optimized_tokens").alias("optimized"), total("saved_tokens").alias("saved"),
        F.coalesce(round_half_up(F.avg("reduction_percent")), F.lit(0)).cast("int").alias("avg_percent"),
    ]


def weekly(tasks: DataFrame, as_of: str, budget: int = 200_000) -> DataFrame:
    """The week (from Monday, UTC) that holds as_of, with how many more tasks fit into the budget at its average cost."""
    week = F.date_trunc("week", F.lit(as_of).cast("timestamp"))
    rows = once(tasks).where((F.col("completed_at") >= week) & (F.col("completed_at") < week + F.expr("interval 7 days")))
    avg = F.when(F.col("tasks") > 0, F.greatest(round_half_up(F.col("optimized") / F.col("tasks")), F.lit(1))).otherwise(2000)
    return rows.agg(*_figures()).withColumn("remaining_tasks", F.floor(F.greatest(F.lit(budget) - F.col("optimized"), F.lit(0)) / avg).cast("long"))


def by_week(tasks: DataFrame) -> DataFrame:
    return once(tasks).groupBy(F.date_format(F.date_trunc("week", "completed_at"), "yyyy-MM-dd").alias("week")).agg(*_figures())


def all_time(tasks: DataFrame) -> DataFrame:
    return once(tasks).agg(*_figures())


def sessions(tasks: DataFrame) -> DataFrame:
    return once(tasks).groupBy("session_id").agg(*_figures())


def recent(tasks: DataFrame, n: int = 10) -> DataFrame:
    """The n latest tasks; equal times by id."""
    return once(tasks).orderBy(F.col("completed_at").desc(), "task_id").limit(n)
