"""Reconciling a metadata table with a file index: manifest, issues, validation, duplicate content, label audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import label_key, source_proxy, trim_space
from quern.operators.skew import hot_join, with_group
from quern.sources.shared import staged

# Issue and exclusion codes.
DUPLICATE_ROW, CONFLICTING_LABEL, FILE_MISSING = "duplicate_csv_row", "conflicting_label_for_file", "file_missing_in_repo"
AMBIGUOUS, NOT_IN_CSV, EMPTY_FIELD, MISSING_SHA = "ambiguous_filename", "repo_file_not_in_csv", "empty_word_or_filename", "missing_sha256"
NOT_PROBED, DOWNLOAD_FAILED, SHA_MISMATCH = "not_probed", "download_failed", "sha256_mismatch"
UNDECODABLE, TOO_FEW_FRAMES = "undecodable", "fewer_than_min_decoded_frames"


def manifest(rows: DataFrame, files: DataFrame) -> DataFrame:
    """One row per metadata row (csv_row, word, filename) and per file that none names.

    files: repo_path, folder, filename, size_bytes, sha256. issue is the first problem found, "" if there is none;
    file columns are null unless exactly one file has the name; sample_id is the path of eligible rows. One shuffle
    by file name serves the windows and the join.
    """
    by_file = Window.partitionBy("filename")
    m = rows.withColumns({
        "_conflict": F.min("word").over(by_file) != F.max("word").over(by_file),
        "_nth": F.row_number().over(Window.partitionBy("filename", "word").orderBy("csv_row")),
    })
    found = F.struct("repo_path", "folder", "size_bytes", "sha256")
    index = files.groupBy("filename").agg(F.count(F.lit(1)).alias("_files"), F.min_by(found, F.col("repo_path")).alias("_file"))
    m = m.join(index, "filename", "left").withColumn("_files", F.coalesce("_files", F.lit(0)))
    one = {c: F.when(F.col("_files") == 1, F.col(f"_file.{c}")) for c in ("repo_path", "folder", "size_bytes", "sha256")}
    issue = (
        F.when((trim_space(F.col("word")) == "") | (trim_space(F.col("filename")) == ""), EMPTY_FIELD)
        .when(F.col("_conflict"), CONFLICTING_LABEL)
        .when(F.col("_nth") > 1, DUPLICATE_ROW)
        .when(F.col("_files") == 0, FILE_MISSING)
        .when(F.col("_files") > 1, AMBIGUOUS)
        .when(one["sha256"].isNull(), MISSING_SHA)
        .otherwise("")
    )
    m = m.select("csv_row", "word", "filename", issue.alias("issue"), *[v.alias(k) for k, v in one.items()])
    orphans = files.join(rows.select("filename").distinct(), "filename", "left_anti")
    orphans = orphans.select(F.lit(-1).cast("long").alias("csv_row"), F.lit(None).cast("string").alias("word"), "filename", F.lit(NOT_IN_CSV).alias("issue"), "repo_path", "folder", "size_bytes", "sha256")
    m = m.unionByName(orphans)
    return m.withColumns({"source_proxy": source_proxy(F.col("filename")), "eligible_pre_probe": F.col("issue") == "", "sample_id": F.when(F.col("issue") == "", F.col("repo_path"))})


def exclusion(issue: Column, probed: Column, download_ok: Column, sha_ok: Column, decode_ok: Column, frames: Column, least: int) -> Column:
    """First reason why a row is not eligible, "" if it is; null booleans are false."""
    no = F.lit(False)
    return (
        F.when(issue != "", issue)
        .when(~probed, NOT_PROBED)
        .when(~F.coalesce(download_ok, no), DOWNLOAD_FAILED)
        .when(~F.coalesce(sha_ok, no), SHA_MISMATCH)
        .when(~F.coalesce(decode_ok, no), UNDECODABLE)
        .when(F.coalesce(frames, F.lit(0)) < least, TOO_FEW_FRAMES)
        .otherwise("")
    )


def validate(m: DataFrame, probe: DataFrame, least: int) -> DataFrame:
    """Manifest rows with the probe's columns, exclusion_reason and eligible; the probe has one row per path."""
    probe = unique(probe, ["repo_path"])
    v = m.join(probe, "repo_path", "left")
    reason = exclusion(F.col("issue"), F.col("download_ok").isNotNull(), F.col("download_ok"), F.col("sha256_match"), F.col("decode_ok"), F.col("decoded_frames"), least)
    return v.withColumn("exclusion_reason", reason).withColumn("eligible", F.col("exclusion_reason") == "")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing where keys repeat: the cardinality assertion of a many-to-one join."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n > 1, F.raise_error(F.lit("keys are not unique: " + ", ".join(keys))).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("_n", ok).filter("_n").drop("_n")


def content_groups(df: DataFrame, sha: str = "sha256", label: str = "word", path: str = "path", piece: int = 10_000) -> DataFrame:
    """Contents that several rows have: sha256, n_files, n_labels, labels, part, paths (sorted, joined by |).

    A content of more than piece files has several rows, numbered by part from 0: its paths are dealt out by hash,
    so none is left out and no row or task holds them all. Labels are few and on every row.
    """
    d = df.filter(F.col(sha).isNotNull()).select(F.col(sha).alias("sha256"), F.col(label).alias("_label"), F.col(path).cast("string").alias("_path"))
    g = d.groupBy("sha256", "_label").agg(F.count(F.lit(1)).alias("_n")).groupBy("sha256").agg(
        F.sum("_n").alias("n_files"), F.count("_label").alias("n_labels"), F.array_join(F.array_sort(F.collect_list("_label")), "|").alias("labels"),
    )
    g = staged(g.filter("n_files > 1").withColumn("_k", F.col("n_files")), "contents")
    d = hot_join(d.select("sha256", "_path"), g, ["sha256"], "_k")
    part = F.pmod(F.xxhash64("_path"), F.ceil(F.col("n_files") / piece)).cast("int")
    return d.groupBy("sha256", "n_files", "n_labels", "labels", part.alias("part")).agg(F.array_join(F.array_sort(F.collect_list("_path")), "|").alias("paths"))


def annotate_duplicates(df: DataFrame, eligible: Column, sha: str = "sha256", label: str = "word") -> DataFrame:
    """df with dup_group_size and dup_cross_label; 0 and false for rows that are not eligible.

    Groups are counted with partial sums and joined by hot_join: a content that many rows share stays spread, and so
    do the rows that are not eligible.
    """
    ok = F.coalesce(eligible, F.lit(False)) & F.col(sha).isNotNull()
    d = df.withColumn("_k", F.when(ok, F.col(sha)))
    d = with_group(d, ["_k"], F.count(F.lit(1)).alias("_n"), (F.min(label) != F.max(label)).alias("_cross"))
    return d.withColumns({"dup_group_size": F.coalesce("_n", F.lit(0)), "dup_cross_label": F.coalesce("_cross", F.lit(False))}).drop("_k", "_n", "_cross")


# The label audit's codes, and details that reports compare.
WHITESPACE, UPPERCASE, CLASSIFIER = ("whitespace", "leading/trailing/double whitespace"), ("uppercase", "contains uppercase characters"), ("classifier_suffix", "ends with -cl")


def audit_labels(df: DataFrame, label: str = "word") -> DataFrame:
    """label, n_samples, anomaly, detail: one row per label and oddity. Labels are never changed."""
    x = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_samples"))
    w, low = F.col("label"), F.lower("label")
    x = x.withColumn("k", label_key(w))
    half = F.floor(F.length("k") / 2).cast("int")
    odd = F.regexp_extract_all(low, F.lit(r"([^a-z0-9 \-_'])"), F.lit(1))

    def when(test: Column, kind: str, detail: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("anomaly"), detail.alias("detail")))

    found = F.array(
        when((w != trim_space(w)) | w.contains("  "), WHITESPACE[0], F.lit(WHITESPACE[1])),
        when(w != low, UPPERCASE[0], F.lit(UPPERCASE[1])),
        when(F.size(odd) > 0, "unusual_characters", F.array_join(odd, "")),
        when(w.rlike(r"(?U)\d"), "contains_digit", F.lit("")),
        when(low.rlike(r"(?U)-cl$|\bcl\b"), CLASSIFIER[0], F.lit(CLASSIFIER[1])),
        when((F.length("k") >= 4) & (F.length("k") % 2 == 0) & (F.left("k", half) == F.right("k", half)), "repeated_word", F.left("k", half)),
        when((F.length("k") >= 14) & ~w.rlike(r"[ \-_]"), "long_unseparated", F.length("k").cast("string")),
    )
    single = x.select("label", "n_samples", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("label", "n_samples", "f.*")
    near = x.groupBy("k").agg(F.array_sort(F.collect_list("label")).alias("g"), F.collect_list(F.struct("label", "n_samples")).alias("m")).filter(F.size("g") > 1)
    near = near.select(F.explode("m").alias("m"), F.array_join("g", " | ").alias("detail")).select("m.label", "m.n_samples", F.lit("near_duplicate_label").alias("anomaly"), "detail")
    # Of labels with one key the last in order stands for it.
    keys = x.groupBy("k").agg(F.max("label").alias("l"))
    cuts = x.filter(F.length("k") > 3).select("label", "n_samples", "k", F.explode(F.sequence(F.lit(2), F.length("k") - 2)).alias("i"))
    cuts = cuts.withColumns({"ka": F.left("k", F.col("i")), "kb": F.right("k", F.length("k") - F.col("i"))})
    cuts = cuts.join(keys.select(F.col("k").alias("ka"), F.col("l").alias("la")), "ka").join(keys.select(F.col("k").alias("kb"), F.col("l").alias("lb")), "kb")
    cuts = cuts.filter("la <> label and lb <> label").groupBy("label", "n_samples").agg(F.min_by(F.concat_ws(" + ", "la", "lb"), "i").alias("detail"))
    joined = cuts.select("label", "n_samples", F.lit("concatenation_of_labels").alias("anomaly"), "detail")
    return single.unionByName(near).unionByName(joined)


def latest(df: DataFrame, key: list[str], success: Column, order: list[Column]) -> DataFrame:
    """One row per key: a success beats failures, then the last in order wins."""
    w = Window.partitionBy(*key).orderBy(success.desc(), *[o.desc() for o in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def remaining(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work not done yet: the resume filter."""
    return work.join(done.select(*key).distinct(), key, "left_anti")
