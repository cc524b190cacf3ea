"""Profiling: summaries, weighted shares, crosstabs, contingency and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.stats import chi2_p_value, correlation_p_value
from quern.operators.skew import hot_join, sums_before
from quern.sources.shared import partitions, staged

POINTS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def percentiles(df: DataFrame, value: Column, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by and one column per point: exact percentiles with linear interpolation; nulls do not count.

    Distinct values are counted, their running counts come from range-sorted partitions, and each point is met where
    its two ranks lie, so no task gathers the values of a group.
    """
    by = by or []
    v = df.select(*by, value.cast("double").alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    r = running_total(v, [*by, "_v"], "_n")
    total = r.groupBy(*by).agg(F.sum("_n").alias("_t"), F.max("_upto").alias("_end"))
    r = r.join(total, by) if by else r.crossJoin(F.broadcast(total))  # one row
    last = F.col("_upto") - (F.col("_end") - F.col("_t")) - 1
    r = r.withColumns({"_first": last - F.col("_n") + 1, "_last": last})
    ends = []
    for name, q in points.items():
        at = F.lit(q) * (F.col("_t") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends.append(F.max(F.when(place.between(F.col("_first"), F.col("_last")), F.col("_v"))).alias(f"_{side}_{name}"))
    out = r.groupBy(*by).agg(F.max("_t").alias("_t"), *ends)

    def lerp(name: str, q: float) -> Column:
        at = F.lit(q) * (F.col("_t") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi).alias(name)

    return out.select(*by, *[lerp(n, q) for n, q in points.items()])


def describe(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, exact linear percentiles, max; nulls do not count."""
    by = by or []
    x = F.col(col).cast("double")
    out = df.filter(x.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    names = dict(zip(("p01", "p05", "p25", "median", "p75", "p95", "p99"), POINTS))
    q = percentiles(df, x, names, by)
    out = out.join(q, by) if by else out.join(F.broadcast(q), how="left")  # one row each
    return out.select(*by, "count", "mean", "std", "min", *names, "max")


def weighted_share(test: Column, weight: Column) -> Column:
    """Aggregate: weighted share of rows where test holds (null is false)."""
    return F.sum(weight * F.coalesce(test, F.lit(False)).cast("double")) / F.sum(weight)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """value, n, fraction."""
    c = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("_t"))  # one row
    return c.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_t")).alias("fraction"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).na.fill(0)


def row_shares(table: DataFrame, key: str, values: list[str]) -> DataFrame:
    total = sum((F.col(v) for v in values), F.lit(0))
    return table.select(key, *[(F.col(v) / total).alias(v) for v in values])


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof, p_value, min_expected of two columns; with one degree of freedom Yates' correction applies.

    Null values of either column do not count. The result is null where a side has fewer than two values.
    """
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows, cols = d.groupBy("a").agg(F.sum("o").alias("ra")), d.groupBy("b").agg(F.sum("o").alias("cb"))
    # Cells that are empty need no rows: sum (o - e)^2 / e = sum o^2 / e - n, and in a 2 x 2 table |o - e| is one number.
    r = rows.agg(F.sum("ra").alias("n"), F.count(F.lit(1)).alias("nr"), F.min("ra").alias("least_r"), F.sum(1 / F.col("ra")).alias("inv_r"))
    c = cols.agg(F.count(F.lit(1)).alias("nc"), F.min("cb").alias("least_c"), F.sum(1 / F.col("cb")).alias("inv_c"))
    cells = d.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(r))  # one row
    e = F.col("ra") * F.col("cb") / F.col("n")
    got = cells.agg(F.sum(F.col("o") * F.col("o") / e).alias("s"), F.max(F.abs(F.col("o") - e)).alias("gap")).crossJoin(r).crossJoin(c)
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    gap = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    chi2 = F.when(dof == 1, gap * gap * F.col("n") * F.col("inv_r") * F.col("inv_c")).when(dof > 1, F.col("s") - F.col("n"))
    return got.select(chi2.alias("chi2"), dof.alias("dof"), chi2_p_value(chi2, dof).alias("p_value"), F.when(dof > 0, F.col("least_r") * F.col("least_c") / F.col("n")).alias("min_expected"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, n, p_value: correlation of average ranks; null where a column is constant.

    Ranks come from the counts of distinct values, running over range-sorted partitions, and meet the rows by hot_join:
    values that many rows hold are broadcast, so a column of few values keeps all tasks busy.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    for c in ("x", "y"):
        v = d.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        v = running_total(v, c, "_n").select(c, "_n", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(f"r{c}"))
        d = hot_join(d, staged(v.withColumn("_k", F.col("_n")).drop("_n"), "ranks"), [c], "_k")
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    got = d.agg(rho.alias("rho"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("p_value", correlation_p_value(F.col("rho"), F.col("n")))


def running_total(df: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """df with _upto: the sum of value over keys up to each key, from sums of range-sorted partitions."""
    keys = [key] if isinstance(key, str) else key
    d = staged(df.repartitionByRange(partitions(df.sparkSession), *keys).withColumn("_pid", F.spark_partition_id()), "ranges")
    before = sums_before(d.groupBy("_pid").agg(F.sum(value).alias("_s")), "_pid", "_s", "_b")  # one row per partition
    inside = F.sum(value).over(Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_in", inside).join(F.broadcast(before.select("_pid", "_b")), "_pid").withColumn("_upto", F.col("_in") + F.col("_b")).drop("_pid", "_in", "_b")


def rate_table(df: DataFrame, col: str, test: Column) -> DataFrame:
    """value, accepted, short, short_pct per value of col."""
    g = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("accepted"), F.count_if(test).alias("short"))
    return g.withColumn("short_pct", F.col("short") * 100.0 / F.col("accepted"))
