"""Operators on per-clip time series: one row per (clip, frame). All are windows over the clip, so one shuffle on
the clip serves a chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clip(clip: str, frame: str) -> Window:
    return Window.partitionBy(clip).orderBy(frame)


def upto(clip: str, frame: str) -> tuple[Window, Window]:
    """All rows up to this one, and all from this one on: both grow row by row, the latter in descending order."""
    back = Window.partitionBy(clip).orderBy(frame)
    ahead = Window.partitionBy(clip).orderBy(F.desc(frame))
    return back.rowsBetween(Window.unboundedPreceding, 0), ahead.rowsBetween(Window.unboundedPreceding, 0)


def runs(df: DataFrame, mask: Column, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """clip, start, len of every run of frames where mask holds (frames count from 0 without gaps)."""
    hit = df.select(clip, frame, mask.alias("_m")).filter("_m")
    hit = hit.withColumn("_g", F.col(frame) - F.row_number().over(_clip(clip, frame)))
    return hit.groupBy(clip, "_g").agg(F.min(frame).alias("start"), F.count(F.lit(1)).alias("len")).drop("_g")


def longest_runs(df: DataFrame, mask: Column, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """clip, longest: the longest run, 0 where there is none."""
    best = runs(df, mask, clip, frame).groupBy(clip).agg(F.max("len").alias("longest"))
    return df.select(clip).distinct().join(best, clip, "left").withColumn("longest", F.coalesce("longest", F.lit(0).cast("long")))


def active_intervals(df: DataFrame, active: Column, min_run: int = 3, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """clip, start, end, frames from the first frame of the first to the last of the last run of min_run or more."""
    long = runs(df, active, clip, frame).filter(F.col("len") >= min_run)
    out = long.groupBy(clip).agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len") - 1).alias("end"))
    return out.withColumn("frames", F.col("end") - F.col("start") + 1)


def gap_fill(df: DataFrame, value: str, present: str, max_gap: int = 5, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """df with filled, is_present and interpolated.

    Inner gaps of at most max_gap frames are interpolated between the frames beside them; longer gaps and those at
    either end are zero and absent.
    """
    back, ahead = upto(clip, frame)
    at = F.struct(F.col(frame).alias("f"), F.col(value).cast("double").alias("v"))
    seen = F.when(F.col(present), at)
    out = df.withColumns({"_l": F.last(seen, True).over(back), "_r": F.last(seen, True).over(ahead)})
    gap = F.col("_r.f") - F.col("_l.f") - 1
    fill = F.coalesce(~F.col(present) & (gap <= max_gap), F.lit(False))
    w_ = (F.col(frame) - F.col("_l.f")) / (F.col("_r.f") - F.col("_l.f"))
    return out.withColumns({
        "filled": F.when(F.col(present), F.col(value).cast("double")).when(fill, F.col("_l.v") * (1 - w_) + F.col("_r.v") * w_).otherwise(F.lit(0.0)),
        "is_present": F.col(present) | fill,
        "interpolated": fill,
    }).drop("_l", "_r")


def carry(df: DataFrame, values: list[str], valid: Column, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """df with <value>_carried: the last valid frame's, for leading frames the first valid one's; and clip_ok."""
    back, ahead = upto(clip, frame)
    df = df.withColumn("measured", F.coalesce(valid, F.lit(False)))
    row = F.when(F.col("measured"), F.struct(*values))
    df = df.withColumn("_c", F.coalesce(F.last(row, True).over(back), F.last(row, True).over(ahead)))
    out = {f"{v}_carried": F.col(f"_c.{v}") for v in values} | {"clip_ok": F.col("_c").isNotNull()}
    return df.withColumns(out).drop("_c")


def quality(df: DataFrame, missing: Column, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """clip, n_frames, missing_frames, missing_frac, longest_missing_run."""
    base = df.groupBy(clip).agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(missing).alias("missing_frames"))
    base = base.withColumn("missing_frac", F.col("missing_frames") / F.col("n_frames"))
    return base.join(longest_runs(df, missing, clip, frame), clip).withColumnRenamed("longest", "longest_missing_run")


# Rejection codes.
TOO_FEW, NO_INTERVAL = "too_few_decoded_frames", "no_active_signing_interval"
ACTIVE_FRACTION, ACTIVE_RUN = "active_both_hands_missing_fraction", "active_both_hands_missing_run"
FULL_FRACTION, FULL_RUN = "both_hands_missing_fraction", "both_hands_missing_run"


def rejections(df: DataFrame, active: Column, min_frames: int = 30, min_run: int = 3, max_frac: float = 0.3, max_run: int = 15, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """Per clip: n_frames, start, end, reason (judged inside the active interval) and full_reason (whole clip).

    The first rule that fires names the reason; null is accepted.
    """
    full = quality(df, ~active, clip, frame)
    spans = active_intervals(df, active, min_run, clip, frame).drop("frames")
    inside = df.join(spans, clip).filter(F.col(frame).between(F.col("start"), F.col("end")))
    part = quality(inside.drop("start", "end"), ~active, clip, frame).select(clip, F.col("missing_frac").alias("_af"), F.col("longest_missing_run").alias("_ar"))
    out = full.join(spans, clip, "left").join(part, clip, "left")
    few = F.col("n_frames") < min_frames
    reason = F.when(few, TOO_FEW).when(F.col("start").isNull(), NO_INTERVAL).when(F.col("_af") > max_frac, ACTIVE_FRACTION).when(F.col("_ar") > max_run, ACTIVE_RUN)
    whole = F.when(few, TOO_FEW).when(F.col("missing_frac") > max_frac, FULL_FRACTION).when(F.col("longest_missing_run") > max_run, FULL_RUN)
    return out.select(clip, "n_frames", "start", "end", reason.alias("reason"), whole.alias("full_reason"))


def rest_frames(n: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Frames before and after the interval; both are n where there is none."""
    return F.coalesce(start, n), F.coalesce(n - 1 - end, n)


def grid(clips: DataFrame, rate: Column, target: float, clip: str = "clip") -> DataFrame:
    """clip, k, t on target frames a second from t0 to t1; clips: clip, n, t0, t1."""
    m = F.greatest(F.lit(1), F.bround(F.col("n") / rate * F.lit(target)).cast("int"))
    g = clips.select(clip, "t0", "t1", F.explode(F.sequence(F.lit(0), m - 1)).alias("k"))
    return g.select(clip, "k", F.least(F.col("t0") + F.col("k") / F.lit(target), F.col("t1")).alias("t"))


def measured_rate(target: float) -> Column:
    """Frames a second by n, t0 and t1; target where the clip has no length."""
    return F.when(F.col("t1") > F.col("t0"), (F.col("n") - 1) / (F.col("t1") - F.col("t0"))).otherwise(F.lit(target))


def brackets(frames: DataFrame, points: DataFrame, row: list[str], ties: list[str], clip: str = "clip") -> DataFrame:
    """points (clip, k, t) with x, y and a: the frames before and at or after t as structs of t and row, and t's place
    between them from 0 to 1.

    Frames and points of a clip are one run in order of time, in which the last frame so far is carried forward and,
    in descending order, backward: each clip is sorted twice, and no row meets all others. ties orders equal times.
    Points lie between the first and the last frame.
    """
    seen = F.struct("t", *row)
    blank = [F.lit(None).cast(t).alias(c) for c, t in frames.select(*ties).dtypes]
    f = frames.select(clip, "t", F.lit(None).cast("int").alias("k"), F.lit(1).alias("_kind"), *[F.col(c).alias(f"_tie_{c}") for c in ties], seen.alias("_f"))
    g = points.select(clip, "t", "k", F.lit(0).alias("_kind"), *[b.alias(f"_tie_{c}") for b, c in zip(blank, ties)], F.lit(None).cast(f.schema["_f"].dataType).alias("_f"))
    d = f.unionByName(g)
    order = ["t", "_kind", *[f"_tie_{c}" for c in ties], "k"]
    back = Window.partitionBy(clip).orderBy(*[F.col(c).asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(clip).orderBy(*[F.col(c).desc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"x": F.last("_f", True).over(back), "y": F.last("_f", True).over(ahead)}).filter("_kind = 0")
    d = d.withColumn("x", F.coalesce("x", "y"))
    span = F.col("y.t") - F.col("x.t")
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("x.t")) / F.when(span > 0, span).otherwise(1.0)))
    return d.select(clip, "k", "t", "x", "y", a.alias("a"))


def resample_uniform(df: DataFrame, value: str, present: str, target: float = 30.0, clip: str = "clip", time: str = "t", fps: Column | None = None) -> DataFrame:
    """clip, k, t, value, present on a grid of target frames a second from each clip's first time.

    Between two present frames values are interpolated, else the nearer frame's value and presence hold.
    """
    f = df.select(clip, F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"), F.col(present).alias("p"))
    clips = f.groupBy(clip).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    points = grid(clips, fps if fps is not None else measured_rate(target), target, clip)
    return brackets(f, points, ["v", "p"], ["v", "p"], clip).select(clip, "k", "t", *_between())


def _between() -> list[Column]:
    both, far = F.col("x.p") & F.col("y.p"), F.col("a") >= 0.5
    v = F.when(both, F.col("x.v") * (1 - F.col("a")) + F.col("y.v") * F.col("a")).when(far, F.col("y.v")).otherwise(F.col("x.v"))
    return [v.alias("value"), (both | F.when(far, F.col("y.p")).otherwise(F.col("x.p"))).alias("present")]


def resample_window(df: DataFrame, spans: DataFrame, value: str, present: str, window: int = 30, clip: str = "clip", frame: str = "frame") -> DataFrame:
    """clip, k, value, present: exactly window samples over each clip's interval (spans: clip, start, end)."""
    if window < 2:
        raise ValueError("window must be >= 2")
    step = (F.col("end") - F.col("start")).cast("double") / (window - 1)
    at = spans.select(clip, "start", "end", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("k")).withColumn("_p", F.col("start") + F.col("k") * step)
    at = at.select(clip, "k", F.floor("_p").cast("int").alias("_i"), F.least(F.floor("_p") + 1, F.col("end")).cast("int").alias("_j"), (F.col("_p") - F.floor("_p")).cast("float").cast("double").alias("a"))
    side = df.select(clip, F.col(frame).cast("int").alias("_f"), F.struct(F.col(value).cast("double").alias("v"), F.col(present).alias("p")).alias("_v"))
    out = at.join(side.select(clip, F.col("_f").alias("_i"), F.col("_v").alias("x")), [clip, "_i"]).join(side.select(clip, F.col("_f").alias("_j"), F.col("_v").alias("y")), [clip, "_j"])
    return out.select(clip, "k", *_between())


def nearest_in_time(df: DataFrame, target: Column, keep: list[str], clip: str = "clip", time: str = "t") -> DataFrame:
    """Per clip the row whose time is nearest to target (then the earlier one): clip and the columns of keep."""
    rank = F.struct(F.abs(F.col(time) - target), F.col(time))
    got = df.groupBy(clip).agg(F.min_by(F.struct(*keep), rank).alias("_r"))
    return got.select(clip, "_r.*")
