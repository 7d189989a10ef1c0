"""Equi-joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so at most 1 / HOT_SHARE keys can be hot, which bounds what is broadcast.
HOT_SHARE = 1 / 1024
#: Slices into which the rows of a hot key are dealt.
SALTS = 32


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """The keys that hold at least `share` of the rows that have one: at most 1/share rows, counted with map-side partial
    sums; the total is the sum of the same counts."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).scalar()
    return counts.where(F.col("__n") >= F.greatest(F.lit(2.0), total * share)).select(key)


class Salt:
    """Joins of tables that share their hot keys: those of `big` on `key`, found once, whose rows are dealt over `salts`
    slices by `spread`.

    Only the rows of the other side that belong to hot keys are repeated, so the extra volume is at most salts / share
    times the rows that it has per key. Null keys match nothing.
    """

    def __init__(self, big: DataFrame, key: str, spread: Sequence[Column], share: float = HOT_SHARE, salts: int = SALTS, keep: Callable[[DataFrame], DataFrame] = lambda df: df):
        """keep: applied to the table of hot keys, such as `cut` where it is used many times."""
        self.key, self.spread, self.salts = key, spread, salts
        self.hot = F.broadcast(keep(hot_keys(big, key, share).select(F.col(key).alias("__hot"))))

    def join(self, big: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
        """`how` is "left", "inner", "left_semi" or "left_anti"."""
        is_hot, key = F.col("__hot").isNotNull(), self.key
        slice_ = F.when(is_hot, F.pmod(F.xxhash64(*self.spread), F.lit(self.salts))).otherwise(F.lit(0)).cast("int")
        slices = F.when(is_hot, F.sequence(F.lit(0), F.lit(self.salts - 1))).otherwise(F.array(F.lit(0)))
        left = big.join(self.hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", slice_).drop("__hot")
        right = small.join(self.hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(slices)).drop("__hot")
        return left.join(right, [key, "__salt"], how).drop("__salt")


def salted_join(
    big: DataFrame, small: DataFrame, key: str, spread: Sequence[Column], how: str = "left", share: float = HOT_SHARE, salts: int = SALTS
) -> DataFrame:
    """Join `big` with `small` (one or few rows per key) on `key`; rows of hot keys are dealt over `salts` slices by `spread`."""
    return Salt(big, key, spread, share, salts).join(big, small, how)
