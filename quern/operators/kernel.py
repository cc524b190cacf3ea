"""The composed clip kernel: raw detections to normalised, packed frames, as one chain of windows over the clip.

Input rows are (clip, t, width, height, and for each group an array of x, y, z triples and a seen flag, with pose
visibilities). Everything is columns: resampling to the target rate, quality and rejection, gap filling, the
shoulder frame, normalisation, flags. One shuffle by clip serves the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import GROUPS, LEFT_SHOULDER, RIGHT_SHOULDER, distance_2d, finite, pack_flags
from quern.operators.timeseries import brackets, grid, measured_rate, rejections, rest_frames, upto

HANDS = ("left_hand", "right_hand")


def mix(x: Column, y: Column, a: Column) -> Column:
    """(1 - a) x + a y of two arrays."""
    return F.zip_with(x, y, lambda p, q: p * (1 - a) + q * a)


def _resampled(df: DataFrame, groups: list[str], target: float) -> DataFrame:
    """clip, frame, t, n_raw, fps and each group's array, seen flag (and pose_vis) on the target grid."""
    cols = [c for g in groups for c in (g, f"{g}_seen")] + ["pose_vis"]
    clips = df.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    clips = clips.withColumn("fps", measured_rate(target))
    out = brackets(df.select("clip", F.col("t").cast("double").alias("t"), "_n", *cols), grid(clips, F.col("fps"), target), cols, ["_n"])
    out = out.join(clips.select("clip", "n", "fps"), "clip").withColumnRenamed("k", "frame")
    far, a = F.col("a") >= 0.5, F.col("a")
    made = {}
    for g in groups:
        both = F.col(f"x.{g}_seen") & F.col(f"y.{g}_seen")
        made[g] = F.when(both, mix(F.col(f"x.{g}"), F.col(f"y.{g}"), a)).when(far, F.col(f"y.{g}")).otherwise(F.col(f"x.{g}"))
        made[f"{g}_seen"] = both | F.when(far, F.col(f"y.{g}_seen")).otherwise(F.col(f"x.{g}_seen"))
        if g == "pose":
            made["pose_vis"] = F.when(both, mix(F.col("x.pose_vis"), F.col("y.pose_vis"), a)).when(far, F.col("y.pose_vis")).otherwise(F.col("x.pose_vis"))
    return out.select("clip", F.col("frame").cast("long").alias("frame"), "t", F.col("n").alias("n_raw"), "fps", *[v.alias(k) for k, v in made.items()])


def _filled(df: DataFrame, group: str, max_gap: int) -> DataFrame:
    """df with group (and pose_vis) interpolated over short inner gaps, zero elsewhere; <group>_present, <group>_interp."""
    back, ahead = upto("clip", "frame")
    seen = F.col(f"{group}_seen")
    row = F.struct(F.col("frame").alias("f"), F.col(group).alias("v"), *([F.col("pose_vis").alias("u")] if group == "pose" else []))
    df = df.withColumns({"_l": F.last(F.when(seen, row), True).over(back), "_r": F.last(F.when(seen, row), True).over(ahead)})
    fill = F.coalesce(~seen & (F.col("_r.f") - F.col("_l.f") - 1 <= max_gap), F.lit(False))
    a = (F.col("frame") - F.col("_l.f")) / (F.col("_r.f") - F.col("_l.f"))

    def one(col: str, part: str) -> Column:
        return F.when(seen, F.col(col)).when(fill, mix(F.col(f"_l.{part}"), F.col(f"_r.{part}"), a)).otherwise(F.transform(col, lambda _: F.lit(0.0)))

    new = {f"{group}_interp": fill, f"{group}_present": seen | fill, group: one(group, "v")}
    if group == "pose":
        new["pose_vis"] = one("pose_vis", "u")
    return df.withColumns(new).drop("_l", "_r")


# Codes of clips that fail before they can be judged.
DETECTION_ERROR, PREPROCESSING_ERROR = "decode_or_mediapipe_error", "preprocessing_error"


def guarded(raw: DataFrame, groups: list[str] | None = None, **rules) -> tuple[DataFrame, DataFrame]:
    """preprocess with failures as rejections: (frames, clips), clips with error.

    raw may have error (text: the detector failed on the clip). Clips with one are rejected as DETECTION_ERROR; clips
    whose rows could not be processed (no time or size, arrays of another length or with values that are not finite)
    as PREPROCESSING_ERROR with the first such row's fault. All other clips are as preprocess gives them.
    """
    groups = groups or list(GROUPS)
    seen = lambda g: F.coalesce(f"{g}_seen", F.lit(False))
    faults = [F.when(F.col("t").isNull() | F.isnan(F.col("t").cast("double")), "time missing"), F.when(F.coalesce("width", F.lit(0)) <= 0, "width missing"), F.when(F.coalesce("height", F.lit(0)) <= 0, "height missing")]
    for g in groups:
        faults += [F.when(F.coalesce(F.size(g), F.lit(-1)) != 3 * GROUPS[g], f"{g} has another length"), F.when(seen(g) & ~F.forall(g, lambda v: finite(v.cast("double"))), f"{g} is not finite")]
    faults.append(F.when(F.coalesce(F.size("pose_vis"), F.lit(-1)) != GROUPS["pose"], "pose_vis has another length"))
    found = F.col("error") if "error" in raw.columns else F.lit(None).cast("string")
    judged = raw.withColumns({"_detector": found, "_fault": F.coalesce(*faults)})
    bad = judged.groupBy("clip").agg(F.max("_detector").alias("_detector"), F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.coalesce(F.col("t").cast("double"), F.lit(-1.0)))).alias("_fault"), F.count(F.lit(1)).alias("n_raw"))
    bad = bad.filter("_detector is not null or _fault is not null")
    frames, clips = preprocess(raw.drop("error").join(bad.select("clip"), "clip", "left_anti"), groups, **rules)
    code = F.when(F.col("_detector").isNotNull(), DETECTION_ERROR).otherwise(PREPROCESSING_ERROR)
    lost = bad.select("clip", "n_raw", code.alias("reason"), F.left(F.coalesce("_detector", "_fault"), F.lit(300)).alias("error"))
    return frames, clips.withColumn("error", F.lit("")).unionByName(lost, allowMissingColumns=True)


def preprocess(raw: DataFrame, groups: list[str] | None = None, target: float = 30.0, min_frames: int = 30, min_run: int = 3, max_frac: float = 0.3, max_run: int = 15, max_gap: int = 5, visible: float = 0.5, short: int = 30) -> tuple[DataFrame, DataFrame]:
    """(frames, clips): packed frames of accepted clips, and one row of statistics and reason for every clip."""
    groups = groups or list(GROUPS)
    for g in groups:
        raw = raw.withColumns({
            f"{g}_seen": F.coalesce(f"{g}_seen", F.lit(False)),
            g: F.transform(g, lambda v, i: v.cast("double") * F.when(i % 3 == 1, F.col("height")).otherwise(F.col("width"))),
        })
    raw = raw.withColumns({"_n": F.monotonically_increasing_id(), "pose_vis": F.transform("pose_vis", lambda v: v.cast("double"))})
    f = _resampled(raw, groups, target)
    hand = F.col("left_hand_seen") | F.col("right_hand_seen")
    verdict = rejections(f, hand, 0, min_run, max_frac, max_run)
    few = F.col("n_raw") < min_frames
    n_raw = f.groupBy("clip").agg(F.first("n_raw").alias("n_raw"), F.first("fps").alias("original_fps"), *[F.count_if(~F.col(f"{g}_seen")).alias(f"{g}_missing_frames") for g in groups])
    clips = verdict.join(n_raw, "clip")
    code = F.lit("too_few_decoded_frames")
    clips = clips.withColumns({"reason": F.when(few, code).otherwise(F.col("reason")), "full_reason": F.when(few, code).otherwise(F.col("full_reason"))})
    before, after = rest_frames(F.col("n_frames"), F.col("start"), F.col("end"))
    length = F.col("end") - F.col("start") + 1
    clips = clips.withColumns({"active_frames": F.coalesce(length, F.lit(0)), "rest_before": before, "rest_after": after, "short_active_interval": F.coalesce(length < short, F.lit(False))})
    f = f.join(clips.filter("reason is null").select("clip", "start", "end"), "clip")
    for g in groups:
        f = _filled(f, g, max_gap)
    at = lambda k, i: F.col("pose")[3 * k + i]
    left, right = LEFT_SHOULDER, RIGHT_SHOULDER
    scale = distance_2d(at(left, 0), at(left, 1), at(right, 0), at(right, 1))
    center = F.array(*[(at(left, i) + at(right, i)) / 2 for i in range(3)])
    f = f.withColumns({"_scale": scale, "_center": center})
    ok = F.col("pose_present") & (F.col("pose_vis")[left] >= visible) & (F.col("pose_vis")[right] >= visible) & (F.col("_scale") > 1e-6) & finite(F.col("_scale")) & F.forall("_center", finite)
    f = f.withColumn("shoulder_measured", F.coalesce(ok, F.lit(False)))
    back, ahead = upto("clip", "frame")
    body = F.when(F.col("shoulder_measured"), F.struct(F.col("_center").alias("center"), F.col("_scale").alias("scale")))
    f = f.withColumn("_b", F.coalesce(F.last(body, True).over(back), F.last(body, True).over(ahead)))
    lost = f.groupBy("clip").agg(F.count_if("shoulder_measured").alias("shoulder_frames_measured"), *[F.count_if(f"{g}_interp").alias(f"{g}_interpolated_frames") for g in groups])
    clips = clips.join(lost, "clip", "left")
    clips = clips.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("shoulder_frames_measured") == 0), "normalization_no_valid_shoulders").otherwise(F.col("reason")))
    f = f.filter("_b is not null").withColumns({"center": F.col("_b.center"), "scale": F.col("_b.scale")})
    new = {}
    for g in groups:
        new[g] = F.when(F.col(f"{g}_present"), _normalised(F.col(g))).otherwise(F.transform(g, lambda _: F.lit(0.0)))
        new[f"{g}_flags"] = pack_flags(F.col(f"{g}_seen"), F.col(f"{g}_present"), F.col(f"{g}_interp"))
    f = f.withColumns(new)
    keep = [c for g in groups for c in (g, f"{g}_flags")]
    return f.select("clip", "frame", *keep, "pose_vis", "center", "scale", "shoulder_measured", "start", "end"), clips


def _normalised(xyz: Column) -> Column:
    return F.transform(xyz, lambda v, i: (v - F.element_at("center", (i % 3) + 1)) / F.col("scale"))
