"""Fixed-length sequences: index, bins, statistics over time, batches, a forest baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.arrays import PRESENT, assemble, has_flag, lerp_presence
from quern.functions.text import tie_break

# Bins of active frames.
BINS = ((30, "<30"), (45, "30-44"), (60, "45-59"))


def interval_bin(frames: Column) -> Column:
    out = None
    for limit, name in BINS:
        out = F.when(frames < limit, name) if out is None else out.when(frames < limit, name)
    return out.otherwise(">=60")


def temporal_statistics(x: Column, size: int) -> Column:
    """[means, population stds, minima, maxima] of an array of W arrays of size floats, without a shuffle."""
    n = F.size(x).cast("double")

    def over(start: Column, step) -> Column:
        return F.aggregate(x, F.array_repeat(start, size), lambda acc, row: F.zip_with(acc, row, step))

    mean = F.transform(over(F.lit(0.0), lambda a, v: a + v), lambda s: s / n)
    square = F.aggregate(x, F.array_repeat(F.lit(0.0), size), lambda acc, row: F.zip_with(acc, F.zip_with(row, mean, lambda v, m: (v - m) * (v - m)), lambda a, d: a + d))
    std = F.transform(square, lambda s: F.sqrt(s / n))
    low = over(F.lit(float("inf")), lambda a, v: F.least(a, v.cast("double")))
    high = over(F.lit(float("-inf")), lambda a, v: F.greatest(a, v.cast("double")))
    return F.concat(mean, std, low, high)


def index(meta: DataFrame, frozen: DataFrame, mapping: DataFrame, windows: tuple[int, ...] = (30, 45, 60), short: int = 30) -> DataFrame:
    """One row per accepted clip: split from the frozen table, label, active frames, bin, stretch factors.

    meta: sample_id, start, end, reason (null: accepted). A clip that the frozen table lacks, a word that the mapping
    lacks and an interval under two frames fail the query when their row is read.
    """
    acc = meta.filter("reason is null").drop("reason")
    idx = acc.join(frozen.withColumn("_known", F.lit(True)), "sample_id", "left").join(mapping.withColumnRenamed("label", "_l"), "word", "left")
    frames = F.col("end") - F.col("start") + 1

    def must(test: Column, what: str, value: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), value).otherwise(F.raise_error(F.lit(what)).cast("long"))

    idx = idx.withColumn("active_frames", must(F.col("_known") & (frames >= 2), "clip missing from the frozen split or shorter than 2 frames", frames.cast("long")))
    idx = idx.withColumn("label", must(F.col("_l").isNotNull(), "unknown label", F.col("_l").cast("long"))).drop("_known", "_l")
    idx = idx.withColumns({"active_bin": interval_bin(F.col("active_frames")), "short_active_interval": F.col("active_frames") < short})
    return idx.withColumns({f"stretch_{w}": F.lit(float(w)) / F.col("active_frames") for w in windows})


def window_features(frames: DataFrame, spans: DataFrame, groups: list[str], window: int, clip: str = "clip") -> DataFrame:
    """clip, k, features: exactly window rows over each clip's interval (spans: clip, start, end), each assembled from
    the two frames beside its place. Between two present frames coordinates are interpolated, else the nearer frame's
    hold."""
    if window < 2:
        raise ValueError("window must be >= 2")
    step = (F.col("end") - F.col("start")).cast("double") / (window - 1)
    at = spans.select(clip, "start", "end", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("k")).withColumn("_p", F.col("start") + F.col("k") * step)
    at = at.select(clip, "k", F.floor("_p").alias("_i"), F.least(F.floor("_p") + 1, F.col("end")).alias("_j"), (F.col("_p") - F.floor("_p")).cast("float").cast("double").alias("a"))
    cols = [c for c in frames.columns if c not in (clip, "frame")]
    side = frames.select(clip, F.col("frame").cast("long").alias("_f"), F.struct(*cols).alias("_v"))
    j = at.join(side.select(clip, F.col("_f").alias("_i"), F.col("_v").alias("x")), [clip, "_i"]).join(side.select(clip, F.col("_f").alias("_j"), F.col("_v").alias("y")), [clip, "_j"])
    coords, present, vis, a = {}, {}, None, F.col("a")
    for g in groups:
        has_x, has_y = has_flag(F.col(f"x.{g}_flags"), PRESENT), has_flag(F.col(f"y.{g}_flags"), PRESENT)

        def between(name: str, has_x=has_x, has_y=has_y) -> Column:
            both = F.zip_with(f"x.{name}", f"y.{name}", lambda p, q: p * (1 - a) + q * a)
            return F.when(has_x & has_y, both).when(a >= 0.5, F.col(f"y.{name}")).otherwise(F.col(f"x.{name}"))

        coords[g], present[g] = between(g), lerp_presence(has_x, has_y, a)
        if g == "pose":
            vis = between("pose_vis")
    return j.select(clip, "k", assemble(coords, present, vis, groups).alias("features"))


def batches(df: DataFrame, key: str, size: int, seed: int | None = None, by: list[str] | None = None) -> DataFrame:
    """df with batch and place; in key order, or shuffled by the seeded hash; numbered within by."""
    from quern.operators.sampling import global_rank

    order = [F.col(key)] if seed is None else [tie_break(F.col(key), seed), F.col(key)]
    if by:
        df = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    else:
        df = global_rank(df, order)
    return df.withColumns({"batch": F.floor((F.col("_rank") - 1) / size), "place": ((F.col("_rank") - 1) % size)}).drop("_rank")


def forest_predictions(df: DataFrame, features: str = "embedding", label: str = "label", key: str = "vec_id", trees: int = 20, seed: int = 42) -> DataFrame:
    """key, y_true, y_pred of the rows outside the hash-train part, by a random forest of pyspark.ml."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    d = df.select(key, F.col(label).cast("double").alias("y"), array_to_vector(F.col(features).cast("array<double>")).alias("x"), (F.substring(tie_break(F.col(key), seed), 1, 1) < "c").alias("h"))
    model = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=8, seed=seed).fit(d.filter("h"))
    out = model.transform(d.filter("not h"))
    return out.select(key, F.col("y").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
