"""Registered queries of the dataset-curation operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A driver table; timestamps without zone become timestamps (UTC sessions), which watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def r6(c):
    return F.round(c, 6)


def samples(spark, sf_dir: str) -> DataFrame:
    """documents as labelled files: content hash, label, file names of several conventions, hash split."""
    d = table(spark, sf_dir, "documents")
    i, s = F.col("doc_id").cast("string"), F.col("source")
    m = F.col("doc_id") % 6
    name = (
        F.when(m == 0, F.concat(i, F.lit("-"), s, F.lit(".mp4")))
        .when(m == 1, F.concat(s, F.lit("_20240"), (1 + F.col("doc_id") % 9).cast("string"), F.lit("15_101500_"), (F.col("doc_id") % 7).cast("string"), F.lit(".mp4")))
        .when(m == 2, F.concat(s, F.lit("_video_"), i, F.lit(".mp4")))
        .when(m == 3, F.concat(s, F.lit("_"), i, F.lit(".mp4")))
        .when(m == 4, F.concat("lang", F.lit(".mp4")))
        .otherwise(F.concat(s, F.lit("_"), (F.col("doc_id") - 2).cast("string"), F.lit("_"), s, F.lit("_aug_0.mp4")))
    )
    h = F.substring(F.sha2(F.concat(F.lit("42:"), i), 256), 1, 1)
    split = F.when(h < "c", "train").when(h < "e", "val").otherwise("test")
    return d.select("doc_id", i.alias("sample_id"), s.alias("word"), "lang", "n_chars", F.sha2("text", 256).alias("sha256"), name.alias("filename"), F.concat("lang", F.lit("/"), name).alias("repo_path"), split.alias("split"))


#: The same as a SQL table expression.
SAMPLES = """samples AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS sample_id, source AS word, lang, n_chars, sha256(text) AS sha256, filename,
  lang || '/' || filename AS repo_path, CASE WHEN h < 'c' THEN 'train' WHEN h < 'e' THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, substr(sha256('42:' || doc_id), 1, 1) AS h, CASE doc_id % 6 WHEN 0 THEN doc_id || '-' || source || '.mp4'
    WHEN 1 THEN source || '_20240' || (1 + doc_id % 9) || '15_101500_' || (doc_id % 7) || '.mp4' WHEN 2 THEN source || '_video_' || doc_id || '.mp4'
    WHEN 3 THEN source || '_' || doc_id || '.mp4' WHEN 4 THEN lang || '.mp4'
    ELSE source || '_' || (doc_id - 2) || '_' || source || '_aug_0.mp4' END AS filename FROM documents))"""
PROXY = r"""CASE WHEN regexp_matches({f}, '(?i)^\d+-.+\.mp4$') THEN 'numericid-WORD' WHEN regexp_matches({f}, '(?i)^.+_\d{{8}}_\d{{6}}_\d+\.mp4$') THEN 'word_timestamp_n'
  WHEN regexp_matches({f}, '(?i)^.+_video_\d+\.mp4$') THEN 'word_video_n' WHEN regexp_matches({f}, '(?i)^.+_\d+\.mp4$') THEN 'word_n'
  WHEN regexp_matches({f}, '(?i)^[^_\d]+\.mp4$') THEN 'word_only' ELSE 'other' END"""
AUG = r"""CASE WHEN regexp_matches({f}, '(?i)_aug_\d+\.mp4$') THEN
  CASE WHEN ends_with(lower(regexp_replace({f}, '(?i)_aug_\d+\.mp4$', '')), '_' || lower({w})) THEN left(regexp_replace({f}, '(?i)_aug_\d+\.mp4$', ''), length(regexp_replace({f}, '(?i)_aug_\d+\.mp4$', '')) - length({w}) - 1)
  ELSE regexp_replace({f}, '(?i)_aug_\d+\.mp4$', '') END || '.mp4' END"""

from quern.plans import curation, profiling, series, stateful  # noqa: E402, F401
