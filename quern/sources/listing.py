"""Listings of files, made by tasks: a level of folders at a time, each folder by the task that gets it."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.readers import exists
from quern.sources.shared import partitions, staged

_ENTRY = "repo_path string, folder string, filename string, is_folder boolean, size_bytes long"


def file_system(path: str):
    """(file system, path there) of a path or URI, for tasks that read files themselves."""
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    return fs, root.rstrip("/")


def opener(source: str):
    """A transport for fetch.fetch_all: the bytes of a file under source."""

    def get(path: str) -> bytes:
        fs, root = file_system(source)
        with fs.open_input_stream(f"{root}/{path}") as f:
            return f.read()

    return get


def list_files(spark: SparkSession, path: str, pattern: str = "*", hashes: bool = True, folders: list[str] | None = None, revision: str | None = None) -> DataFrame:
    """repo_path, folder, filename, size_bytes, sha256 of every file under path, in order of repo_path.

    folders restricts the listing to these folders and all below them; a revision is the folder of that name under path,
    and paths are relative to it. A folder or revision that is missing fails. Empty files are listed with size 0; they and
    all files of a listing without hashes have no sha256, as nothing was read that it could be of. Contents are read in
    blocks, so a file may be of any size. pattern is a shell pattern of file names; names of any form are listed. A tree
    takes one Spark job for each of its levels; the entries of one folder are listed by one task.
    """
    top = path.rstrip("/") + (f"/{revision}" if revision else "")
    missing = [at for at in ([f"{top}/{f.strip('/')}" for f in folders] if folders else [top]) if not exists(spark, at)]
    if missing:
        raise FileNotFoundError(f"no folder {missing[0]}")
    todo = spark.createDataFrame([(f.strip("/"),) for f in dict.fromkeys(folders or [""])], "repo_path string")
    levels = []
    while True:
        level = staged(todo.repartition(partitions(spark), "repo_path").mapInPandas(_list_level(top), _ENTRY), "listing")
        levels.append(level.filter("not is_folder"))
        todo = level.filter("is_folder").select("repo_path")
        if todo.isEmpty():
            break
    # Folders that lie in one another are reached twice.
    files = reduce(DataFrame.unionByName, levels).drop("is_folder").dropDuplicates(["repo_path"])
    files = files.filter(_matches(pattern)("filename")) if pattern != "*" else files
    if hashes:
        hashed = T.StructType([*files.schema, T.StructField("sha256", T.StringType())])
        files = files.repartition(partitions(spark), "repo_path").mapInPandas(_hash_files(top), hashed)
    else:
        files = files.withColumn("sha256", F.lit(None).cast("string"))
    return files.orderBy("repo_path")


def _matches(pattern: str):
    @F.pandas_udf("boolean")
    def fits(names: pd.Series) -> pd.Series:
        return names.map(lambda n: fnmatchcase(n, pattern))

    return fits


def _list_level(top: str):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = file_system(top)
        for pdf in frames:
            for folder in pdf["repo_path"]:
                at = f"{root}/{folder}" if folder else root
                rows = []
                for f in fs.get_file_info(FileSelector(at)):
                    rel = f.path[len(root) + 1 :]
                    rows.append((rel, folder, f.base_name, f.type == FileType.Directory, f.size or 0))
                yield pd.DataFrame(rows, columns=["repo_path", "folder", "filename", "is_folder", "size_bytes"])

    return work


def _hash_files(top: str, block: int = 1 << 20):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = file_system(top)

        def digest(rel: str) -> str:
            h = hashlib.sha256()
            with fs.open_input_stream(f"{root}/{rel}") as f:
                while data := f.read(block):
                    h.update(data)
            return h.hexdigest()

        for pdf in frames:
            yield pdf.assign(sha256=[digest(p) if n else None for p, n in zip(pdf["repo_path"], pdf["size_bytes"])])

    return work
