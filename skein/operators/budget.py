"""Packing ranked files into a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import round_half_up


def escalated(budget: Column, n_changed: Column, enabled: bool = True) -> Column:
    """A greater budget for changes of many files: at least 4000 from 5 on, 8000 from 10 on."""
    if not enabled:
        return budget
    return F.when(n_changed >= 10, F.greatest(budget, F.lit(8000))).when(n_changed >= 5, F.greatest(budget, F.lit(4000))).otherwise(budget)


def savings(raw: Column, optimized: Column) -> list[Column]:
    """saved, percent (whole, halves upwards, 0 for no tokens) and multiple (one decimal, 1 for no tokens)."""
    return [
        (raw - optimized).alias("saved"),
        F.when(raw > 0, round_half_up((raw - optimized) * 100.0 / raw)).otherwise(0).cast("int").alias("percent"),
        F.when(optimized > 0, F.floor(raw * 10.0 / optimized + 0.5) / 10).otherwise(F.lit(1.0)).alias("multiple"),
    ]


def escalation_notice(before: int, after: int, n_changed: int) -> str:
    """What to tell about a budget that was raised; empty if it was not."""
    return "" if after <= before else f"Budget raised from {before:,} to {after:,} tokens, since {n_changed} files changed; run without escalation to keep {before:,}."


def first_fit(items: DataFrame, room: Column | int, key: str = "path", cost: str = "cost", order: str = "rank", group: list[str] | None = None) -> DataFrame:
    """The items that fit into the room one after the other in their order; one that is too large is passed over.

    The choice depends on all before it, but room only shrinks: once an item of some cost is passed over, so are all later
    ones of that cost, and no more than room / cost of them fit. So for each cost only that many can be among the chosen,
    room * ln(room) rows of a group at most, whatever the number of items; only they meet in one task. Items without a cost
    always fit; those with a null cost never do.
    """
    g = group or []
    x = items.select(*g, key, F.col(order).alias("__order"), F.col(cost).cast("long").alias("__cost"), F.greatest((F.lit(room) if isinstance(room, int) else room).cast("long"), F.lit(0)).alias("__room"))
    some = x.where("__cost > 0 and __cost <= __room").withColumn("__slice", F.pmod(F.xxhash64(key), F.lit(32)))
    for by in (["__slice"], []):  # the first of each slice, then of all of them
        w = Window.partitionBy(*g, "__room", "__cost", *by).orderBy("__order", key)
        some = some.withColumn("__n", F.row_number().over(w)).where(F.expr("__n <= __room div __cost")).drop("__n")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__order", key])
        left, kept = int(pdf["__room"].iloc[0]), []
        for i, c in zip(pdf.index, pdf["__cost"]):
            if c <= left:
                left -= c
                kept.append(i)
        return pdf.loc[kept, [*g, key]]

    schema = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in [*g, key])
    kept = some.drop("__slice").groupBy(*g, "__room").applyInPandas(choose, schema).unionByName(x.where("__cost <= 0").select(*g, key))
    return items.join(kept, [*g, key], "left_semi")


def cascade(files: DataFrame, budgets: DataFrame, task_tokens: int = 0, skeleton_tokens: int | DataFrame = 0) -> DataFrame:
    """files(path, bucket, rank, full, symbols, summary) under each of budgets(budget): path, bucket, level, tokens, kept.

    While the total is above the budget: touched files go from symbols to their summaries, all at once; ancestors drop out;
    the skeleton drops out; then touched files are kept by first fit into what task and changed files leave. Task and
    changed files are never cut.
    """
    b = F.col("bucket")
    base = files.withColumn("tokens", F.when(b == "changed", F.col("full")).when(b == "touched", F.col("symbols")).otherwise(F.col("summary")))
    part = lambda name, c: F.coalesce(F.sum(F.when(b == name, F.col(c))), F.lit(0)).cast("long")
    sums = base.agg(part("changed", "tokens").alias("changed"), part("touched", "tokens").alias("touched"), part("touched", "summary").alias("squeezed"), part("ancestor", "tokens").alias("ancestor"))
    t = F.lit(task_tokens + 0)
    s = budgets.join(F.broadcast(sums), F.lit(True))  # one row of sums
    if isinstance(skeleton_tokens, DataFrame):
        s = s.join(F.broadcast(skeleton_tokens.toDF("__skeleton")), F.lit(True))  # one row
        skeleton_tokens = F.col("__skeleton")
    over1 = t + F.col("changed") + F.col("touched") + F.col("ancestor") + skeleton_tokens > F.col("budget")
    over2 = over1 & (t + F.col("changed") + F.col("squeezed") + F.col("ancestor") + skeleton_tokens > F.col("budget"))
    over3 = over2 & (t + F.col("changed") + F.col("squeezed") + skeleton_tokens > F.col("budget"))
    over4 = over3 & (t + F.col("changed") + F.col("squeezed") > F.col("budget"))
    flags = s.select("budget", over1.alias("squeeze"), over2.alias("no_ancestors"), over3.alias("no_skeleton"), over4.alias("fit"), (F.col("budget") - t - F.col("changed")).alias("room"))
    x = base.join(F.broadcast(flags), F.lit(True))  # a row per budget asked for
    x = x.withColumn("level", F.when(b == "changed", "full").when((b == "touched") & ~F.col("squeeze"), "symbols").otherwise("summary"))
    x = x.withColumn("tokens", F.when((b == "touched") & F.col("squeeze"), F.col("summary")).otherwise(F.col("tokens")))
    fitted = first_fit(x.where((b == "touched") & F.col("fit")), F.col("room"), cost="tokens", group=["budget"]).select("budget", "path", F.lit(True).alias("fits"))
    kept = F.when(b == "changed", True).when(b == "ancestor", ~F.col("no_ancestors")).otherwise(~F.col("fit") | F.col("fits").isNotNull())
    return x.join(fitted, ["budget", "path"], "left").select("budget", "path", "bucket", "rank", F.when(kept, F.col("level")).otherwise("excluded").alias("level"), F.when(kept, F.col("tokens")).otherwise(0).alias("tokens"), kept.alias("kept"), "no_skeleton")


def slot_text(items: DataFrame, group: str, order: str, text: Column, sep: str = "\n\n") -> DataFrame:
    """(group, content, n): the texts of each group in order, joined."""
    lists = items.withColumn("__t", text).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__t").alias("t")))).alias("l"))
    return lists.select(group, F.array_join(F.transform("l", lambda x: x["t"]), sep).alias("content"), F.size("l").alias("n"))
