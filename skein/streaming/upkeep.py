"""Watch events: debounce per file, latest state per file, and upkeep of the stored tables in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.store import Store
from skein.session import cut


def debounced(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(path, first_ts, last_ts, n, type): bursts of events of a file with pauses of less than `gap`, of which the last
    event counts. On a stream in append mode, the watermark bounds the open bursts that are kept; in complete mode all are."""
    good = events.where(F.col("path").isNotNull() & F.col("ts").isNotNull())
    if good.isStreaming:
        good = good.withWatermark("ts", late)
    return good.groupBy("path", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.max_by("type", F.struct("ts", "type")).alias("type")
    ).select("path", "first_ts", "last_ts", "n", "type")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ms").alias("duration_ms"))


def latest_state(events: DataFrame) -> DataFrame:
    """(path, type, ts): the last added, updated or removed event of each file."""
    return events.where(F.col("path").isNotNull() & F.col("type").isin("added", "updated", "removed")).groupBy("path").agg(
        F.max(F.struct("ts", "type")).alias("r")
    ).select("path", "r.type", "r.ts")


def follow(events: DataFrame, store: Store, reindex: Callable[[DataFrame], None], checkpoint: str, **trigger):
    """Keep the store up with a stream of events: removed files go with all that hangs on them; the others are indexed
    again by `reindex(paths)`, which renews their rows, symbols, edges and vectors.

    The last event of every file is kept in the store, so an older one that comes in a later batch changes nothing. Files
    are keyed, so a batch that is run again changes nothing either. trigger: as for a stream writer; by default what is
    there is worked off and the stream ends.
    """

    def batch(df: DataFrame, _: int) -> None:
        known = store.read("watch_state").select("path", F.col("ts").alias("known"))
        last = cut(latest_state(df).join(known, "path", "left").where(F.col("known").isNull() | (F.col("ts") >= F.col("known"))).drop("known"))
        gone, todo = last.where("type = 'removed'").select("path"), last.where("type <> 'removed'").select("path")
        if not gone.isEmpty():
            store.remove(gone)
        if not todo.isEmpty():
            reindex(todo)
        store.upsert("watch_state", last)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
