"""Joins and running sums that keep hot keys and long tables out of single tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import partitions, staged

#: Shares that the left rows of hot or null keys are spread over; rows of one block of a running sum.
SPREAD, BLOCK = 4096, 4096


def hot_limit(total: int, p: int, least: int = 1000) -> int:
    """Rows that make a key hot: fewer than 4 * p keys can have more than total / (4 * p) rows each."""
    return max(least, total // (4 * p))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", total: int | None = None, least: int = 1000, merge: bool = False) -> DataFrame:
    """left joined (inner or left) with right, which has one row per key and, in weight, left's rows of that key.

    Rows of right whose weight makes them hot are broadcast: there are fewer than 4 * P of them for P shuffle
    partitions, whatever the data. All other keys are shuffled; left's rows of hot and of null keys are spread, so
    no task gets more than its share. Where nothing is hot this is a plain join. total is the sum of the weights,
    if known. weight is not in the result. With merge the shuffle is asked for, so the plan is one at every size.
    Rows are spread by monotonically_increasing_id, so left must come back in the same order when a task is run again,
    as scans and staged tables do.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how}")
    cols = [c for c in right.columns if c not in on and c != weight]
    facts = right.agg(F.sum(weight).alias("n"), F.max(weight).alias("most")).first()
    limit = hot_limit(total if total is not None else facts.n or 0, partitions(left.sparkSession), least)
    ask = (lambda d: d.hint("merge")) if merge else (lambda d: d)
    if (facts.most or 0) <= limit and how == "inner":
        return left.join(ask(right.drop(weight)), on)
    row = F.struct(F.lit(True).alias("_x"), *cols)
    spread = F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))
    null = reduce(Column.__or__, [F.col(k).isNull() for k in on])
    if (facts.most or 0) > limit:
        hot = right.filter(F.col(weight) > limit).select(*on, row.alias("_hot"))
        left = left.join(F.broadcast(hot), on, "left")
        null = null | F.col("_hot").isNotNull()
    left = left.withColumn("_s", F.when(null, spread).otherwise(F.lit(0)).cast("long"))
    # Always 0, but no constant to the optimizer, which would take _s out of the keys and leave hot rows together.
    zero = F.pmod(F.xxhash64(*on), F.lit(1)).cast("long")
    cold = right.filter(F.col(weight) <= limit).select(*on, zero.alias("_s"), row.alias("_cold"))
    out = left.join(ask(cold), [*on, "_s"], "left")
    got = F.coalesce("_hot", "_cold") if "_hot" in left.columns else F.col("_cold")
    if how == "inner":
        out = out.filter(got.isNotNull())
    keep = [F.col(f"`{c}`") for c in left.columns if c not in ("_s", "_hot")]
    return out.select(*keep, *[got[c].alias(c) for c in cols])


def with_group(df: DataFrame, key: list[str], *facts: Column) -> DataFrame:
    """df with facts (named aggregates) of each row's group by key; null where a key is null.

    Groups are counted with partial sums and joined by hot_join, so a group of any size stays spread, which a window
    over the group would gather in one task. df is read twice and must give the same rows both times.
    """
    null = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    groups = df.filter(~null).groupBy(*key).agg(F.count(F.lit(1)).alias("_gw"), *facts)
    out = hot_join(df, staged(groups, "groups"), key, "_gw", "left")
    return out.select(*[F.col(f"`{c}`") for c in [*df.columns, *[c for c in groups.columns if c not in (*key, "_gw")]]])


def sums_before(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df (one row per key, keys whole numbers from 0) with name: the sum of value over all smaller keys.

    Blocks of BLOCK keys are summed first, so the one window over the whole table sees one row per block.
    """
    d = df.withColumn("_sb_block", F.floor(F.col(key) / BLOCK))
    blocks = d.groupBy("_sb_block").agg(F.sum(value).alias("_sb_sum"))
    upto = Window.orderBy("_sb_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_sb_block", F.coalesce(F.sum("_sb_sum").over(upto), F.lit(0)).alias("_sb_before"))
    inside = F.sum(value).over(Window.partitionBy("_sb_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_sb_inside", F.coalesce(inside, F.lit(0))).join(blocks, "_sb_block")
    return d.withColumn(name, F.col("_sb_inside") + F.col("_sb_before")).drop("_sb_block", "_sb_inside", "_sb_before")
