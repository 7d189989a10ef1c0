"""References to records that do not exist: signed reference and existence counts per key, kept from change deltas.

Every change is a delta of a key at a time: a reference adds to the key's reference count and takes from it once retracted;
a row of a record adds to the key's existence count; a removal takes away what appeared before it. `change_log` is the
stored state: deltas summed by key and time, so copies, late rows and batches in any order add up (`merge_state`).
`key_counts` derives the removals' negative deltas and sums per key. A key with a positive reference count and an existence
count of zero is an orphan: its references are the report, by kind: missing (nothing ever appeared) or removed. A key whose
existence count was zero at the time when the reference was recorded, since nothing had appeared yet, is an orphan for the
time in between: early.

Defined cases: null keys are no references; exact copies of a reference are one reference of so many rows; a reference as
often retracted as recorded is none; a null time takes no part in a comparison, and a row without a time appeared with the
key's first row that has one; an empty referring table gives no row and an empty record table makes every reference an
orphan; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import salted_join

CASES = ("missing", "removed", "early")
Referring = Mapping[str, tuple[DataFrame, str, str, str]]


def reference_deltas(tables: Referring, retracted: Referring | None = None) -> DataFrame:
    """(ref_table, ref_path, target_path, recorded_at, n_rows) per distinct reference, n_rows being its rows less those
    retracted. tables: name -> (rows, column of the referrer, column of the key, column of the time)."""
    out = None
    for sign, group in ((1, tables), (-1, retracted or {})):
        for name, (df, source, key, ts) in group.items():
            one = df.select(
                F.lit(name).alias("ref_table"), F.col(source).alias("ref_path"), F.col(key).alias("target_path"),
                (F.col(ts) if sign > 0 else F.lit(None).cast("timestamp")).alias("recorded_at"), F.lit(sign).alias("n_rows"),
            )
            out = one if out is None else out.unionByName(one)
    return out.where(F.col("target_path").isNotNull()).groupBy("ref_table", "ref_path", "target_path").agg(F.min("recorded_at").alias("recorded_at"), F.sum("n_rows").alias("n_rows"))


def _log(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("target_path", "at").agg(*[F.sum(c).alias(c) for c in ("references", "appeared", "removed")])


def change_log(references: DataFrame, records: DataFrame, key: str, seen: str, removals: DataFrame | None = None, removal_key: str = "path", removal_ts: str = "ts") -> DataFrame:
    """(target_path, at, references, appeared, removed): the deltas of references (of `reference_deltas`), of the rows of
    the records and of their removals, summed by key and time."""
    delta = lambda df, k, at, **n: df.select(F.col(k).alias("target_path"), F.col(at).alias("at"), *[n.get(c, F.lit(0)).cast("long").alias(c) for c in ("references", "appeared", "removed")])
    out = delta(references, "target_path", "recorded_at", references=F.col("n_rows")).unionByName(delta(records, key, seen, appeared=F.lit(1)))
    if removals is not None:
        out = out.unionByName(delta(removals, removal_key, removal_ts, removed=F.lit(1)))
    return _log(out.where(F.col("target_path").isNotNull()))


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """The log after another batch of deltas, whatever the order of the batches."""
    return _log(old.unionByName(new))


def key_counts(log: DataFrame) -> DataFrame:
    """(target_path, references, existence, appeared, first_seen, removed_at): the signed sums of every key's deltas.

    The last removal of a key adds a negative delta for each row that appeared before it.
    """
    keys = log.groupBy("target_path").agg(
        F.sum("references").alias("references"), F.sum("appeared").alias("appeared"),
        F.min(F.when(F.col("appeared") > 0, F.col("at"))).alias("first_seen"), F.max(F.when(F.col("removed") > 0, F.col("at"))).alias("removed_at"),
    )
    ended = keys.where("removed_at is not null and first_seen is not null").select("target_path", "first_seen", "removed_at")
    before = salted_join(log.where("appeared <> 0").select("target_path", "at", "appeared"), ended, "target_path", [F.col("at")], "inner").where(F.coalesce("at", "first_seen") < F.col("removed_at"))
    taken = before.select("target_path", (-F.col("appeared")).alias("delta"))
    sums = keys.select("target_path", F.col("appeared").alias("delta")).unionByName(taken).groupBy("target_path").agg(F.sum("delta").alias("existence"))
    return keys.join(sums, "target_path").select("target_path", "references", "existence", "appeared", "first_seen", "removed_at")


def orphan_keys(counts: DataFrame) -> DataFrame:
    """The keys with positive references and zero existence."""
    return counts.where("references > 0 and existence <= 0")


def orphan_references(references: DataFrame, counts: DataFrame) -> DataFrame:
    """(ref_table, ref_path, target_path, recorded_at, n_rows, kind) of the references that are a case. counts: of the keys
    of these references at least.

    Keys referred to very often are salted: their references are dealt over slices and only their counts are repeated.
    """
    late = counts.where("references > 0 and existence > 0 and first_seen is not null").select("target_path", F.lit("early").alias("kind"), "first_seen")
    none = orphan_keys(counts).select("target_path", F.when(F.col("appeared") > 0, "removed").otherwise("missing").alias("kind"), F.lit(None).cast("timestamp").alias("first_seen"))
    joined = salted_join(references.where("n_rows > 0"), none.unionByName(late), "target_path", [F.col("ref_table"), F.col("ref_path")], "inner")
    return joined.where(F.col("first_seen").isNull() | (F.col("recorded_at") < F.col("first_seen"))).select("ref_table", "ref_path", "target_path", "recorded_at", "n_rows", "kind")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, month of the first reference (null where no time is known) and kind."""
    return orphans.groupBy("ref_table", F.date_format("recorded_at", "yyyy-MM").alias("month"), "kind").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("target_path").alias("n_targets"), F.sum("n_rows").alias("n_rows")
    )
