"""Array files: one zip of arrays for each clip, as a Spark data source that reads the wanted members only, and a sink.

A file holds one array per landmark group (frames, landmarks, 3), flags (frames, groups: one byte of bits), pose_vis,
center, scale, shoulder_measured and active_interval (first and last frame, or -1 and -1), and the clip's id. Files
without an id, as other programs write them, are named by their file name without its ending.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.arrays import GROUPS
from quern.functions.text import array_name
from quern.operators.quality import all_of, check
from quern.sources.listing import file_system, list_files

#: Bytes of files read by one partition, the cost of opening one, and the frames of an Arrow batch.
PARTITION, OPENING, FRAMES = 128 << 20, 4 << 20, 1024
_ORDER = list(GROUPS)
#: The other members, as (name, Spark type, numbers of a frame; None for one).
_SHARED = [("pose_vis", "array<float>", GROUPS["pose"]), ("center", "array<double>", 3), ("scale", "double", None), ("shoulder_measured", "boolean", None)]
_NUMPY = {"array<float>": np.float32, "array<double>": np.float64, "double": np.float64, "boolean": np.bool_}


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def wanted(groups: list[str]) -> list[tuple[str, str, int | None]]:
    """The shared members that frames with these groups have: pose_vis goes with pose."""
    return [m for m in _SHARED if m[0] != "pose_vis" or "pose" in groups]


class ArrayFiles(DataSource):
    """spark.read.format("array_files").option("groups", "left_hand,right_hand").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def _groups(self) -> list[str]:
        groups = [g for g in self.options.get("groups", ",".join(_ORDER)).split(",") if g]
        unknown = [g for g in groups if g not in GROUPS]
        if unknown or not groups:
            raise ValueError(f"unknown groups: {unknown}" if unknown else "no groups")
        return groups

    def schema(self) -> str:
        groups = self._groups()
        cols = [f"{g} array<float>, {g}_flags tinyint" for g in groups] + [f"{name} {kind}" for name, kind, _ in wanted(groups)]
        return ", ".join(["clip string", "frame int", *cols, "start int", "end int"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._groups(), int(self.options.get("partition_bytes", PARTITION)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, groups: list[str], size: int) -> None:
        self.path, self.groups, self.size = path, groups, size

    def partitions(self) -> list[InputPartition]:
        """Files in order of their paths, packed to partitions by their bytes; an unfinished file's name ends otherwise."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = file_system(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and f.path.endswith(".npz"))
        out, full = [Files([])], 0
        for path, size in found:
            if out[-1].paths and full + size + OPENING > self.size:
                out.append(Files([]))
                full = 0
            out[-1].paths.append(path)
            full += size + OPENING
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                yield from _batches(f, path, self.groups)


def _batches(f, path: str, groups: list[str]) -> Iterator[pa.RecordBatch]:
    """A file's frames; members that are not wanted are never read. A file that lacks one or has another shape fails."""

    def member(name: str, *shape: int) -> np.ndarray:
        if name not in z.files:
            raise ValueError(f"{path} has no {name}")
        a = z[name]
        if a.shape[1:] != shape or a.shape[0] != n:
            raise ValueError(f"{path}: {name} has the shape {a.shape}, not {(n, *shape)}")
        return a

    with np.load(f, allow_pickle=False) as z:
        if "flags" not in z.files:
            raise ValueError(f"{path} has no flags")
        n = z["flags"].shape[0]
        flags = member("flags", len(_ORDER)).astype(np.int8)
        cols: dict[str, np.ndarray] = {}
        for g in groups:
            cols[g] = member(g, GROUPS[g], 3).astype(np.float32).reshape(n, 3 * GROUPS[g])
            cols[f"{g}_flags"] = flags[:, _ORDER.index(g)]
        for name, kind, size in wanted(groups):
            cols[name] = member(name, *([] if size is None else [size])).astype(_NUMPY[kind])
        span = z["active_interval"] if "active_interval" in z.files else np.array([-1, -1])
        if span.shape != (2,):
            raise ValueError(f"{path}: active_interval has the shape {span.shape}, not (2,)")
        clip = str(z["clip"]) if "clip" in z.files else os.path.basename(path).removesuffix(".npz")
    start, end = (int(v) if v >= 0 else None for v in span)
    for i in range(0, n, FRAMES):
        k = min(FRAMES, n - i)
        data: dict[str, pa.Array] = {"clip": pa.array([clip] * k, pa.string()), "frame": pa.array(np.arange(i, i + k, dtype=np.int32))}
        data |= {c: _column(a[i : i + k]) for c, a in cols.items()}
        data |= {c: pa.array([v] * k, pa.int32()) for c, v in (("start", start), ("end", end))}
        yield pa.RecordBatch.from_pydict(data)


def _column(a: np.ndarray) -> pa.Array:
    if a.ndim == 1:
        return pa.array(a)
    ends = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(a).reshape(-1)))


def load_arrays(spark: SparkSession, path: str, groups: list[str] | None = None, partition_bytes: int = PARTITION) -> DataFrame:
    """Frames of the array files under path, as a packed store has them: clip, frame, each group with its flags, pose_vis
    with pose, center, scale, shoulder_measured, start, end. Only the members of the groups are read from the files."""
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("array_files").option("groups", ",".join(groups or _ORDER)).option("partition_bytes", partition_bytes).load(path)


def file_name(clip: str) -> str:
    """The name that functions.text.array_name gives."""
    return hashlib.sha1(clip.encode()).hexdigest()[:20] + ".npz"


def save_arrays(frames: DataFrame, path: str, compress: bool = False, dtype: str = "float32") -> DataFrame:
    """Write one array file per clip under path and return clip, file, bytes; it runs when its rows are read.

    frames: as load_arrays gives them; groups that the frames lack are left out. A clip's frames must be 0, 1, 2 ...,
    without gaps or repeats, and its interval one. A file is written under a name of its own and moved into place, so
    neither a lost task nor a second run leaves half a file. A clip is one file and so one task's work; clips without
    frames have no file.
    """
    groups = [g for g in _ORDER if g in frames.columns]
    members = wanted(groups)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        clip = str(pdf["clip"].iloc[0])
        pdf = pdf.sort_values("frame")
        n = len(pdf)
        if not np.array_equal(pdf["frame"].to_numpy(), np.arange(n)):
            raise ValueError(f"{clip}: frames are not 0 to {n - 1}, once each")
        spans = pdf[["start", "end"]].drop_duplicates()
        if len(spans) != 1:
            raise ValueError(f"{clip} has {len(spans)} intervals")
        flags = np.zeros((n, len(_ORDER)), np.uint8)
        out = {"clip": np.array(clip), "flags": flags, "active_interval": spans.fillna(-1).to_numpy(np.int32)[0]}
        for g in groups:
            out[g] = np.stack(pdf[g].to_numpy()).astype(dtype).reshape(n, GROUPS[g], 3)
            flags[:, _ORDER.index(g)] = pdf[f"{g}_flags"]
        for name, kind, size in members:
            out[name] = (pdf[name].to_numpy() if size is None else np.stack(pdf[name].to_numpy())).astype(_NUMPY[kind])
        body = io.BytesIO()
        (np.savez_compressed if compress else np.savez)(body, **out)
        fs, root = file_system(path)
        name = file_name(clip)
        tmp = f"{root}/{name}.{os.urandom(8).hex()}.tmp"
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(tmp) as f:
            f.write(body.getbuffer())
        fs.move(tmp, f"{root}/{name}")
        return pd.DataFrame({"clip": [clip], "file": [name], "bytes": [body.getbuffer().nbytes]})

    cols = ["clip", "frame", *[c for g in groups for c in (g, f"{g}_flags")], *[m[0] for m in members], "start", "end"]
    return frames.select(*cols).groupBy("clip").applyInPandas(write, "clip string, file string, bytes long")


def unreferenced(spark: SparkSession, path: str, clips: DataFrame, file: str = "array_file") -> DataFrame:
    """repo_path, size_bytes of array files that no row of clips names."""
    files = list_files(spark, path, "*.npz", hashes=False)
    return files.join(clips.select(clips[file].alias("filename")), "filename", "left_anti").select("repo_path", "size_bytes")


def file_checks(spark: SparkSession, path: str, frames: DataFrame) -> DataFrame:
    """Checks that the array files under path hold the frames of a store, clip by clip, and that no file is beside them."""
    mine = [g for g in _ORDER if g in frames.columns]
    files = load_arrays(spark, path, mine)
    kinds = {f.name: f.dataType for f in files.schema}
    want = frames.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
    j = want.withColumn("_w", F.xxhash64(*kinds)).select("clip", "frame", "_w").join(files.withColumn("_f", F.xxhash64(*kinds)).select("clip", "frame", "_f"), ["clip", "frame"], "full")
    names = frames.select("clip").distinct().select(array_name(F.col("clip")).alias("array_file"))
    return all_of([
        check(j, "array files have every frame", F.count_if(F.col("_f").isNull()), "missing"),
        check(j, "array files have no other frame", F.count_if(F.col("_w").isNull()), "not in the store"),
        check(j, "array files have the same values", F.count_if(F.col("_w") != F.col("_f")), "frames differ"),
        check(unreferenced(spark, path, names), "array files belong to clips", F.count(F.lit(1)), "files of no clip"),
    ])
