"""Stores of the first format (all groups in one array) to the packed one, judged again from the stored detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.arrays import GROUPS, pack_flags
from quern.operators.timeseries import active_intervals, rejections

_NAMES = list(GROUPS)
_FIRST = {g: sum(list(GROUPS.values())[:i]) for i, g in enumerate(GROUPS)}


def _flag(column: str, group: str) -> Column:
    return F.col(column)[_NAMES.index(group)]


def packed(frames: DataFrame, groups: list[str], dtype: dict[str, str] | str = "float") -> DataFrame:
    """Frames (clip, frame, coords: x, y, z of all landmarks, present, observed, interpolated: one flag a group in
    storage order, pose_vis, center, scale, shoulder_measured) as group columns with packed flags."""
    out: dict[str, Column] = {}
    for g in groups:
        kind = dtype if isinstance(dtype, str) else dtype[g]
        out[g] = F.slice("coords", 3 * _FIRST[g] + 1, 3 * GROUPS[g]).cast(f"array<{kind}>")
        out[f"{g}_flags"] = pack_flags(_flag("observed", g), _flag("present", g), _flag("interpolated", g))
    return frames.select("clip", "frame", *[v.alias(k) for k, v in out.items()], "pose_vis", "center", "scale", "shoulder_measured")


def convert(frames: DataFrame, clips: DataFrame, groups: list[str], expected: DataFrame | None = None, min_frames: int = 30, min_run: int = 3, max_frac: float = 0.3, max_run: int = 15, short: int = 30) -> tuple[DataFrame, DataFrame]:
    """(frames, clips) of the packed store: clips (clip, n_raw, reason) judged again, frames of the accepted ones.

    The rules run on the stored detections of the hands. expected (clip, reason) is an earlier judgement: a clip
    that comes out otherwise fails the query when its row is read. A clip without frames keeps the reason it has.
    """
    hand = _flag("observed", "left_hand") | _flag("observed", "right_hand")
    verdict = rejections(frames, hand, 0, min_run, max_frac, max_run).select("clip", "n_frames", "start", "end", F.col("reason").alias("_reason"))
    out = clips.select("clip", "n_raw", "reason").join(verdict, "clip", "left")
    few = F.when(F.col("n_raw") < min_frames, "too_few_decoded_frames").otherwise(F.col("_reason"))
    out = out.withColumn("reason", F.when(F.col("n_frames").isNull(), F.col("reason")).otherwise(few)).drop("_reason")
    if expected is not None:
        out = out.join(expected.select("clip", F.lit(True).alias("_known"), F.nullif(F.col("reason"), F.lit("")).alias("_want")), "clip", "left")
        same = F.col("_known").isNull() | F.col("reason").eqNullSafe(F.col("_want"))
        out = out.withColumn("n_raw", F.when(same, F.col("n_raw")).otherwise(F.raise_error(F.concat(F.lit("judged otherwise than before: "), F.col("clip").cast("string"))).cast("long"))).drop("_known", "_want")
    length = F.coalesce(F.col("end") - F.col("start") + 1, F.lit(0))
    out = out.withColumns({"active_frames": length, "short_active_interval": F.col("end").isNotNull() & (length < short)})
    keep = out.filter("reason is null and n_frames is not null").select("clip", "start", "end")
    return packed(frames, groups).join(keep, "clip"), out


def intervals(frames: DataFrame, min_run: int = 3) -> DataFrame:
    """clip, start, end, frames of the active interval by the packed hand flags."""
    hand = (F.col("left_hand_flags").bitwiseAND(F.lit(1)) != 0) | (F.col("right_hand_flags").bitwiseAND(F.lit(1)) != 0)
    return active_intervals(frames, hand, min_run)
