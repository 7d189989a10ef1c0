"""Rolling totals over trailing periods: a two-stack monoid queue per entity over rows sorted inside their partitions.

The queue holds the days of the active window. Its front stack stores suffix folds and its back stack one running fold, so
a push, a pop and a query each cost a constant number of monoid operations on average and nothing is ever subtracted; the
aggregate may therefore be any monoid (sum, max, min, concatenation ...), invertible or not.

Daily sums are built first with map-side partial aggregation, so even an entity that holds most of the rows sends at most
one row per calendar day to its partition; state in Python is one window of one entity.

Defined cases: rows without an entity id are one entity of their own (null id); rows with null time count not at all;
null measures count as 0; a task id counts once (the copy with the earliest time, then the smallest measures), and every
row with a null task id counts by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Monoid = tuple[Any, Callable[[Any, Any], Any]]

#: (tasks, sum of optimized, sum of saved, greatest saved of a day, days with tasks)
DAY: Monoid = (
    (0, 0, 0, None, 0),
    lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2], b[3] if a[3] is None else a[3] if b[3] is None else max(a[3], b[3]), a[4] + b[4]),
)


class TwoStackQueue:
    """A queue that knows the fold of its elements, in order."""

    def __init__(self, monoid: Monoid):
        self.zero, self.plus = monoid
        self.front: list[tuple[Any, Any]] = []
        self.back: list[Any] = []
        self.back_fold = self.zero

    def __len__(self) -> int:
        return len(self.front) + len(self.back)

    def push(self, x: Any) -> None:
        self.back.append(x)
        self.back_fold = self.plus(self.back_fold, x)

    def pop(self) -> Any:
        if not self.front:
            fold = self.zero
            while self.back:
                x = self.back.pop()
                fold = self.plus(x, fold)
                self.front.append((x, fold))
            self.back_fold = self.zero
        return self.front.pop()[0]

    def fold(self) -> Any:
        return self.plus(self.front[-1][1], self.back_fold) if self.front else self.back_fold


def windows(days: Iterable[tuple[int, Any]], size: int, monoid: Monoid) -> Iterator[tuple[int, Any]]:
    """For each day from the first to the last of `days` (ascending, distinct) the fold over the `size` days that end with it."""
    queue, last = TwoStackQueue(monoid), None
    for day, x in days:
        for d in range(day if last is None else last + 1, day + 1):
            queue.push(x if d == day else monoid[0])
            if len(queue) > size:
                queue.pop()
            yield d, queue.fold()
        last = day


def daily(tasks: DataFrame, entity: str, task: str, ts: str, optimized: str, saved: str) -> DataFrame:
    """(entity, day, n, optimized, saved): each task once, summed per entity and calendar day (days since 1970, UTC)."""
    base = tasks.where(F.col(ts).isNotNull()).select(
        F.col(entity).alias("entity"), F.col(task).alias("task"), F.col(ts).alias("ts"),
        F.coalesce(F.col(optimized), F.lit(0)).cast("long").alias("opt"), F.coalesce(F.col(saved), F.lit(0)).cast("long").alias("sav"),
    )
    once = (
        base.where(F.col("task").isNotNull())
        .groupBy("task").agg(F.min(F.struct("ts", "entity", "opt", "sav")).alias("r"))
        .select("r.entity", "r.ts", "r.opt", "r.sav")
        .unionByName(base.where(F.col("task").isNull()).select("entity", "ts", "opt", "sav"))
    )
    return once.groupBy("entity", F.unix_date(F.to_date("ts")).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("opt").alias("opt"), F.sum("sav").alias("sav")
    )


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, list[tuple[int, Any]]]]:
    """The sorted rows of a partition, entity by entity; an entity has one row per day, so its list is short."""
    current, rows, started = None, [], False
    for pdf in batches:
        entities = pdf["entity"].astype(object).where(pdf["entity"].notna(), None)
        for e, day, n, opt, sav in zip(entities, pdf["day"].tolist(), pdf["n"].tolist(), pdf["opt"].tolist(), pdf["sav"].tolist()):
            if not started or e != current:
                if started:
                    yield current, rows
                current, rows, started = e, [], True
            rows.append((day, (n, opt, sav, sav, 1)))
    if started:
        yield current, rows


def _sorted(days: DataFrame) -> DataFrame:
    return days.repartition("entity").sortWithinPartitions("entity", "day")


def rolling_totals(days: DataFrame, sizes: Sequence[int] = (7, 30)) -> DataFrame:
    """A row per entity, day from its first to its last and window: totals, averages per task and per day, greatest day."""
    sizes = tuple(sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        names = ["entity", "day", "window_days", "n_tasks", "active_days", "optimized_total", "saved_total", "best_day_saved"]
        for e, rows in _entities(batches):
            for size in sizes:
                for d, (n, opt, sav, best, active) in windows(rows, size, DAY):
                    out.append((e, d, size, n, active, opt, sav, best))
                    if len(out) >= 20000:
                        yield pd.DataFrame(out, columns=names).astype({"best_day_saved": "Int64"})
                        out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"best_day_saved": "Int64"})

    kind = f"entity {days.schema['entity'].dataType.simpleString()}"
    rolled = _sorted(days).mapInPandas(run, f"{kind}, day int, window_days int, n_tasks long, active_days int, optimized_total long, saved_total long, best_day_saved long")
    per_task = lambda c: F.when(F.col("n_tasks") > 0, F.col(c) / F.col("n_tasks"))
    return rolled.select(
        "entity", F.date_from_unix_date("day").alias("day"), "window_days", "n_tasks", "active_days", "optimized_total", "saved_total",
        per_task("optimized_total").alias("optimized_avg"), per_task("saved_total").alias("saved_avg"),
        (F.col("optimized_total") / F.col("window_days")).alias("optimized_per_day"), (F.col("saved_total") / F.col("window_days")).alias("saved_per_day"),
        "best_day_saved",
    )


def peak_days(days: DataFrame, sizes: Sequence[int] = (7, 30)) -> DataFrame:
    """Per entity and window the day with the greatest saved total over the window that ends with it; the earliest of equals."""
    sizes = tuple(sizes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for e, rows in _entities(batches):
            for size in sizes:
                best = max(((fold[2], -d) for d, fold in windows(rows, size, DAY)))
                out.append((e, size, -best[1]))
            if len(out) >= 20000:
                yield pd.DataFrame(out, columns=["entity", "window_days", "day"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["entity", "window_days", "day"])

    kind = f"entity {days.schema['entity'].dataType.simpleString()}"
    return _sorted(days).mapInPandas(run, f"{kind}, window_days int, day int").select(
        "entity", "window_days", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("peak_day")
    )
