"""Readers with declared schemas, integrity checks and latest-wins views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.reconcile import latest
from quern.operators.skew import sums_before

METADATA = T.StructType([T.StructField("word", T.StringType()), T.StructField("videos", T.StringType())])
FILES = T.StructType([T.StructField(n, T.LongType() if n == "size_bytes" else T.StringType()) for n in ("repo_path", "folder", "filename", "size_bytes", "sha256")])
# Columns of a decode probe.
PROBE = T.StructType(
    [T.StructField("repo_path", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("download_ok", "sha256_match", "open_ok", "decode_ok", "has_audio")]
    + [T.StructField(n, T.StringType()) for n in ("container", "codec", "pix_fmt", "decode_error")]
    + [T.StructField(n, T.LongType()) for n in ("reported_frames", "decoded_frames", "width", "height")]
    + [T.StructField(n, T.DoubleType()) for n in ("avg_fps", "decoded_fps", "duration_s")]
)
FRAMES = T.StructType([
    T.StructField("clip_id", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("t", T.DoubleType()),
    *[T.StructField(g, T.ArrayType(T.FloatType())) for g in ("pose", "face", "left_hand", "right_hand", "pose_vis")],
    T.StructField("observed", T.ArrayType(T.BooleanType())),
])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """csv_row, word, filename exactly as stored: "null" and "nan" are words, blanks are "", the header must fit.

    Row numbers come from the file's own order: one file is read as one split per block, in order of offset.
    """
    head = spark.read.text(path).limit(1).first()
    if head is None or head[0].lstrip("﻿").strip() != "word,videos":
        raise ValueError(f"unexpected CSV header in {path}: {head and head[0]}")
    df = spark.read.csv(path, schema=METADATA, header=True, enforceSchema=False, nullValue=None, multiLine=False, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.na.fill("").withColumn("_m", F.monotonically_increasing_id())
    # One row per input split turns the split-wise numbers into one running number.
    pid = F.shiftright("_m", 33)
    base = df.groupBy(pid.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    base = sums_before(base, "_p", "_n", "_b")
    df = df.withColumn("_p", pid).join(F.broadcast(base.select("_p", "_b")), "_p")
    row = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return df.select(row.alias("csv_row"), "word", F.col("videos").alias("filename"))


def read_parts(spark: SparkSession, path: str, schema: T.StructType, key: str, success: str) -> DataFrame:
    """Rows of all Parquet parts under path, one per key: a success beats failures, then the newest part (by its column
    part where there is one, then by file name), then the last row of a part. No parts give a typed empty frame."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.option("mergeSchema", "true").parquet(path).withColumns({"_f": F.col("_metadata.file_name"), "_i": F.monotonically_increasing_id()})
    have = set(df.columns)
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in have})
    newest = ([F.coalesce("part", F.lit(-1))] if "part" in have else []) + [F.col("_f"), F.col("_i")]
    got = latest(df, [key], F.coalesce(F.col(success).cast("boolean"), F.lit(False)), newest)
    return got.select(*schema.names, *[c for c in df.columns if c not in schema.names and not c.startswith("_")])


def done_keys(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Keys that earlier runs have handled."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([schema[key]]))
    return spark.read.parquet(path).select(key).distinct()


def load_frames(spark: SparkSession, path: str, groups: list[str], clip: str = "clip") -> DataFrame:
    """Frames of a packed store with the columns of groups only, so a scan reads no others: clip, frame, each group's
    coordinates and flags, pose_vis with pose, and the active interval (start, end)."""
    wanted = [c for g in groups for c in (g, f"{g}_flags")] + (["pose_vis"] if "pose" in groups else [])
    return spark.read.parquet(path).select(clip, "frame", *wanted, "start", "end")


def load_sequence(spark: SparkSession, path: str, groups: list[str], window: int = 30, spans: DataFrame | None = None, clip: str = "clip") -> DataFrame:
    """clip, k, features: window rows of assembled features over each clip's interval (spans: clip, start, end, or the
    store's own). A row of another length or with a value that is not finite fails the query when it is read."""
    from quern.functions.arrays import feature_dim, finite
    from quern.operators.sequences import window_features

    f = load_frames(spark, path, groups, clip)
    if spans is None:
        spans = f.groupBy(clip).agg(F.first("start").alias("start"), F.first("end").alias("end"))
    x = window_features(f.drop("start", "end"), spans, groups, window, clip)
    ok = (F.size("features") == feature_dim(groups)) & F.forall("features", finite)
    return x.withColumn("features", F.when(ok, F.col("features")).otherwise(F.raise_error(F.lit("features of another length or not finite")).cast("array<float>")))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def synthetic_clips(spark: SparkSession, words: int = 3, per_class: int = 4, frames: int = 60, seed: int = 42) -> DataFrame:
    """clip_id, word, split, frame, t, x, y, observed: a sinusoid for each class plus noise, rest frames at both ends."""
    clip = spark.range(words * per_class * 2).select(F.col("id").alias("clip_id"), (F.col("id") % words).alias("_w"))
    split = F.when(F.col("clip_id") % 4 < 2, "train").when(F.col("clip_id") % 4 == 2, "val").otherwise("test")
    clip = clip.select("clip_id", "_w", F.concat(F.lit("word"), F.col("_w").cast("string")).alias("word"), split.alias("split"), (5 + F.col("clip_id") % 7).alias("_rest"))
    f = clip.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    phase = F.col("frame") * (1 + F.col("_w")) / 10.0
    on = (F.col("frame") >= F.col("_rest")) & (F.col("frame") < frames - F.col("_rest"))
    return f.select("clip_id", "word", "split", "frame", (F.col("frame") / 30.0).alias("t"), (F.sin(phase) + F.randn(seed) * 0.01).alias("x"), (F.cos(phase) + F.randn(seed + 1) * 0.01).alias("y"), on.alias("observed"))
