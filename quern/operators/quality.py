"""Checks as data: every check is a row (check, passed, detail)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import PRESENT, finite, half_precision, has_flag
from quern.operators.profile import percentiles

SPLITS = ("train", "val", "test")

# Names and details of the split's checks, as reports compare them.
UNIQUE_ID, ONE_SPLIT, VALID_SPLIT = ("unique sample_id", "duplicated ids"), ("each file in exactly one split", "paths repeated"), ("split values valid", "invalid values")
ONE_CONTENT, ONE_GROUP = ("no identical content across splits", "hashes span >1 split"), ("no split group across splits", "groups span >1 split")
NONE_EXTRA, NONE_MISSING = ("only eligible samples in split", "ineligible samples present"), ("all eligible samples assigned", "eligible samples missing")
CLASSES = ("every expected class present in {}", "expected classes missing")


def check(df: DataFrame, name: str, bad: Column, detail: str) -> DataFrame:
    """One row: bad is an aggregate that must be 0; detail follows its value."""
    b = F.coalesce(bad, F.lit(0)).cast("long")
    return df.agg(b.alias("_b")).select(F.lit(name).alias("check"), (F.col("_b") == 0).alias("passed"), F.concat(F.col("_b").cast("string"), F.lit(" " + detail)).alias("detail"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Groups of key with how many rows are too many."""
    return df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra"))


def crossing(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("k"))


def split_checks(split: DataFrame, eligible: DataFrame, ratios: dict[str, float], tolerance: float = 0.01, expected: DataFrame | None = None) -> DataFrame:
    """Integrity of a split (sample_id, repo_path, word, sha256, split_group, split) against the eligible ids.

    expected: the words that must be in every split; all words of the split by default.
    """
    names = list(ratios)
    words = split.select("word").distinct() if expected is None else expected.select("word").distinct()
    ids = split.select("sample_id").distinct(), eligible.select("sample_id").distinct()
    rules = [
        (UNIQUE_ID, repeated(split, "sample_id"), F.sum("extra")),
        (ONE_SPLIT, repeated(split, "repo_path"), F.sum("extra")),
        (VALID_SPLIT, split, F.count_if(~F.coalesce(F.col("split").isin(names), F.lit(False)))),
        (ONE_CONTENT, crossing(split, "sha256"), F.count_if(F.col("k") > 1)),
        (ONE_GROUP, crossing(split, "split_group"), F.count_if(F.col("k") > 1)),
        (NONE_EXTRA, ids[0].join(ids[1], "sample_id", "left_anti"), F.count(F.lit(1))),
        (NONE_MISSING, ids[1].join(ids[0], "sample_id", "left_anti"), F.count(F.lit(1))),
    ]
    for s in names:
        here = split.filter(F.col("split") == s).select("word").distinct()
        rules.append(((CLASSES[0].format(s), CLASSES[1]), words.join(here, "word", "left_anti"), F.count(F.lit(1))))
    out = [check(rows, title, bad, detail) for (title, detail), rows, bad in rules]
    for s, r in ratios.items():
        got = split.agg(F.avg((F.col("split") == s).cast("double")).alias("f"))
        out.append(got.select(F.lit(f"{s} ratio ~ {r:.2f}").alias("check"), (F.abs(F.col("f") - r) <= tolerance).alias("passed"), F.format_string("%.4f", "f").alias("detail")))
    return all_of(out)


def index_leaks(idx: DataFrame) -> DataFrame:
    """Leaks between splits of a sequence index (sample_id, repo_path, sha256, split_group, aug_source, split)."""
    name = F.substring_index("repo_path", "/", -1)
    sources = idx.select(name.alias("aug_source"), F.col("split").alias("_s"))
    copies = idx.filter(F.coalesce("aug_source", F.lit("")) != "").join(sources, "aug_source")
    return all_of([
        check(repeated(idx, "sample_id"), "source appears once", F.sum("extra"), "repeated"),
        check(idx, "valid split", F.count_if(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))), "invalid"),
        *[check(crossing(idx, c), f"{c} in one split", F.count_if(F.col("k") > 1), "in more than one split") for c in ("repo_path", "sha256", "split_group")],
        check(copies, "copy with its source", F.count_if(F.col("split") != F.col("_s")), "copies apart from their source"),
    ])


def digest(df: DataFrame) -> DataFrame:
    """n, sha256 of a table, whatever the order of its rows and partitions: counts and sums of row hashes, hashed.

    Row hashes are added, not gathered, so the digest of any table is one small aggregate.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    return got.select("n", F.sha2(F.concat_ws(":", "n", *[F.coalesce(f"s{i}", F.lit(0)) for i in range(4)]), 256).alias("sha256"))


def parity(a: DataFrame, b: DataFrame, key: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """value, rows, only_a, only_b, max_diff, equal: how two tables of one key differ by column."""
    x = a.select(*key, *[F.col(v).alias(f"x_{v}") for v in values], F.lit(1).alias("_x"))
    y = b.select(*key, *[F.col(v).alias(f"y_{v}") for v in values], F.lit(1).alias("_y"))
    j = x.join(y, key, "full")
    cols = F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"x_{v}").cast("double").alias("x"), F.col(f"y_{v}").cast("double").alias("y")) for v in values])
    j = j.select("_x", "_y", F.explode(cols).alias("c"))
    out = j.groupBy("c.value").agg(
        F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("rows"), F.count_if(F.col("_y").isNull()).alias("only_a"), F.count_if(F.col("_x").isNull()).alias("only_b"),
        F.max(F.abs(F.col("c.x") - F.col("c.y"))).alias("max_diff"), F.count_if(~F.col("c.x").eqNullSafe(F.col("c.y")) & F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("unequal"),
    )
    return out.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.coalesce("max_diff", F.lit(0.0)) <= tolerance))


def rounding(frames: DataFrame, groups: list[str], rounded: Callable[[Column], Column] = half_precision) -> DataFrame:
    """What storing the groups' numbers rounded would lose: by group, and over all groups (group is null), the numbers of
    present frames, the largest of them, exact quantiles and the largest error in shoulder widths (su) and in pixels (px,
    times the frame's scale), values that are not finite, and values of absent frames that are not zero."""
    parts = []
    for g in groups:
        on = has_flag(F.col(f"{g}_flags"), PRESENT)
        parts.append(frames.select(F.lit(g).alias("group"), on.alias("on"), F.col("scale").cast("double").alias("scale"), F.explode(g).alias("v")))
    v = reduce(DataFrame.unionByName, parts).withColumn("x", F.col("v").cast("double")).withColumn("y", rounded(F.col("x")))
    v = v.withColumn("su", F.when(F.col("on"), F.abs(F.col("y") - F.col("x")))).withColumn("px", F.col("su") * F.col("scale"))
    facts = [
        F.count_if("on").alias("numbers"), F.max(F.when(F.col("on"), F.abs("x"))).alias("max_abs"), F.max("su").alias("max_su"), F.max("px").alias("max_px"),
        F.count_if(F.col("on") & ~finite(F.col("y"))).alias("not_finite"), F.count_if(~F.col("on") & (F.col("y") != 0)).alias("absent_not_zero"),
    ]
    out = []
    for by, rows in ((["group"], v), ([], v)):
        got = rows.groupBy(*by).agg(*facts)
        for c in ("su", "px"):
            q = percentiles(rows, F.col(c), {f"p99_{c}": 0.99, f"p999_{c}": 0.999}, by)
            got = got.join(q, by, "left") if by else got.join(F.broadcast(q), how="left")  # one row each
        out.append(got if by else got.withColumn("group", F.lit(None).cast("string")))
    return out[0].unionByName(out[1])


def rounding_checks(lost: DataFrame, px_p999: float, px_max: float) -> DataFrame:
    """Whether rounding's losses stay within limits, in pixels, over all groups."""
    whole = lost.filter("group is null")
    return all_of([
        check(whole, "error at 0.999", F.count_if(~(F.coalesce("p999_px", F.lit(0.0)) <= px_p999)), "beyond the limit"),
        check(whole, "largest error", F.count_if(~(F.coalesce("max_px", F.lit(0.0)) <= px_max)), "beyond the limit"),
        check(whole, "rounded values finite", F.sum("not_finite"), "not finite"),
        check(whole, "absent frames stay zero", F.sum("absent_not_zero"), "not zero"),
    ])


def map_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs or that one side lacks: key, left_value, right_value."""
    x, y = a.select(key, F.col(value).alias("left_value")), b.select(key, F.col(value).alias("right_value"))
    return x.join(y, key, "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
