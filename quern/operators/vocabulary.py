"""Choosing a sub-vocabulary: evidence per file and class, exclusion rules, ranking, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import after_first_slash, batch_id, tie_break
from quern.operators.profile import percentiles
from quern.operators.sampling import global_rank
from quern.operators.skew import with_group

SPLITS = ("train", "val", "test")
# Default limits of the rules.
RULES = {
    "max_cross_label_shared_clips": 0,
    "max_augmented_clips": 0,
    "exclude_multiword_labels": True,
    "exclude_label_audit_anomalies": True,
    "min_val_units": 6,
    "min_test_units": 6,
    "train_fraction_range": (0.60, 0.80),
    "max_within_class_duplicate_fraction": 0.10,
    "max_single_batch_share": 0.50,
    "min_source_patterns": 2,
}


def file_evidence(split: DataFrame) -> DataFrame:
    """split (repo_path, word, sha256, source_proxy, aug_source) with batch, cross_label, within_dup, augmented."""
    s = split.withColumn("batch", batch_id(after_first_slash(F.col("repo_path")), F.col("source_proxy")))
    s = with_group(s, ["sha256"], (F.min("word") != F.max("word")).alias("_labels"))
    s = with_group(s, ["sha256", "word"], (F.count(F.lit(1)) > 1).alias("_again"))
    flags = {"cross_label": F.coalesce("_labels", F.lit(False)), "within_dup": F.coalesce("_again", F.lit(False)), "augmented": F.coalesce("aug_source", F.lit("")) != ""}
    return s.withColumns(flags).drop("_labels", "_again")


def class_features(s: DataFrame, audit: DataFrame | None = None, word: str = "word") -> DataFrame:
    """One row per class; s has file_evidence's columns, split_group and split. audit: label, anomaly."""
    per = []
    for sp in SPLITS:
        here = F.col("split") == sp
        per += [F.count_if(here).alias(f"{sp}_clips"), F.count_distinct(F.when(here, F.col("split_group"))).alias(f"{sp}_units")]
    f = s.groupBy(word).agg(
        F.count(F.lit(1)).alias("clips"), F.count_distinct("sha256").alias("unique_clips"), F.count_distinct("split_group").alias("units"),
        F.count_if("cross_label").alias("cross_label_clips"), F.count_if("within_dup").alias("within_dup_clips"), F.count_if("augmented").alias("augmented_clips"),
        F.count_distinct("source_proxy").alias("source_patterns"), F.count_if(F.col("source_proxy") == "numericid-WORD").alias("numericid_clips"), *per,
    )
    batch = s.filter("batch is not null").groupBy(word, "batch").agg(F.count(F.lit(1)).alias("_n")).groupBy(word).agg(F.max("_n").alias("max_batch_clips"))
    f = f.join(batch, word, "left").withColumn("max_batch_clips", F.coalesce("max_batch_clips", F.lit(0).cast("long")))
    f = f.withColumns({
        "cross_label_fraction": F.col("cross_label_clips") / F.col("clips"),
        "augmented_fraction": F.col("augmented_clips") / F.col("clips"),
        "within_dup_fraction": 1 - F.col("unique_clips") / F.col("clips"),
        "max_batch_share": F.col("max_batch_clips") / F.col("clips"),
        "train_unit_fraction": F.try_divide("train_units", "units"),
        "min_eval_units": F.least("val_units", "test_units"),
        "multiword": F.col(word).rlike(r"[ _\-]"),
    })
    if audit is None:
        return f.withColumn("audit_anomalies", F.lit(""))
    found = audit.groupBy(F.col("label").alias(word)).agg(F.array_join(F.array_sort(F.collect_set("anomaly")), "|").alias("audit_anomalies"))
    return f.join(found, word, "left").withColumn("audit_anomalies", F.coalesce("audit_anomalies", F.lit("")))


def exclusion_reasons(r: dict = RULES, heavy: float = 0.5) -> Column:
    """All rules that a class (a row of class_features) fails, in order, joined by |."""
    c = F.col
    lo, hi = r["train_fraction_range"]
    checks = (
        ("augmentation_dominated", c("augmented_fraction") >= 0.5),
        ("augmented_copies", (c("augmented_clips") > r["max_augmented_clips"]) & (c("augmented_fraction") < 0.5)),
        ("fully_shared_with_other_labels", c("cross_label_fraction") >= 1.0),
        ("heavily_shared_with_other_labels", (c("cross_label_fraction") >= heavy) & (c("cross_label_fraction") < 1.0)),
        ("shares_clips_with_other_labels", (c("cross_label_clips") > r["max_cross_label_shared_clips"]) & (c("cross_label_fraction") < heavy)),
        ("multiword_label", c("multiword") & F.lit(bool(r["exclude_multiword_labels"]))),
        ("label_audit_anomaly", (c("audit_anomalies") != "") & F.lit(bool(r["exclude_label_audit_anomalies"]))),
        ("too_few_val_units", c("val_units") < r["min_val_units"]),
        ("too_few_test_units", c("test_units") < r["min_test_units"]),
        ("imbalanced_split", ~F.coalesce(c("train_unit_fraction").between(lo, hi), F.lit(False))),
        ("within_class_duplicates", c("within_dup_fraction") > r["max_within_class_duplicate_fraction"]),
        ("single_batch_dominated", c("max_batch_share") > r["max_single_batch_share"]),
        ("single_source_collection", c("source_patterns") < r["min_source_patterns"]),
    )
    return F.concat_ws("|", *[F.when(test, name) for name, test in checks])


def primary_reason(reasons: Column) -> Column:
    return F.split(reasons, r"\|")[0]


def defer(f: DataFrame, deferred: DataFrame, reason: str = "deferred_pending_inspection", word: str = "word") -> DataFrame:
    """f with reason appended to the reasons of the listed words."""
    d = deferred.select(word, F.lit(reason).alias("_d")).distinct()
    f = f.join(d, word, "left")
    return f.withColumn("reasons", F.concat_ws("|", F.when(F.col("reasons") != "", F.col("reasons")), "_d")).drop("_d")


def rank_candidates(pool: DataFrame, keys: list[str], seed: int, word: str = "word") -> DataFrame:
    """pool (one row per class) with rank 1..n: keys descending, then the seeded hash."""
    return global_rank(pool, [F.desc(k) for k in keys] + [tie_break(F.col(word), seed), F.col(word)], "rank")


def reason_counts(f: DataFrame, reasons: str = "reasons") -> DataFrame:
    """reason, n, n_primary."""
    x = f.select(F.posexplode(F.split(reasons, r"\|")).alias("i", "reason")).filter("reason <> ''")
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("i") == 0).alias("n_primary"))


def summary_counts(f: DataFrame) -> DataFrame:
    sums = ["clips", "unique_clips", "units", "cross_label_clips", "augmented_clips", "within_dup_clips"] + [f"{s}_{k}" for s in SPLITS for k in ("clips", "units")]
    got = f.agg(
        F.count(F.lit(1)).alias("classes"), *[F.sum(c).alias(c) for c in sums], F.min("clips").alias("min_clips"), F.max("clips").alias("max_clips"),
        (F.max("clips") / F.min("clips")).alias("class_imbalance_ratio"), F.min("val_units").alias("min_val_units"), F.min("test_units").alias("min_test_units"),
    )
    return got.join(F.broadcast(percentiles(f, F.col("clips"), {"median_clips": 0.5})), how="left")  # one row each


def label_mapping(words: DataFrame, word: str = "word") -> DataFrame:
    """word, label: places of the distinct words in code-point order, from 0."""
    w = words.filter(F.col(word).isNotNull()).select(word).distinct()
    return global_rank(w, [F.col(word)], "label").withColumn("label", (F.col("label") - 1).cast("int"))


def encode(df: DataFrame, mapping: DataFrame, word: str = "word") -> DataFrame:
    """df with label; a word that the mapping lacks fails the query when its row is read."""
    out = df.join(mapping.select(word, F.col("label").alias("_l")), word, "left")
    return out.withColumn("label", F.when(F.col("_l").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.col(word))).cast("int")).otherwise(F.col("_l"))).drop("_l")


def vocabulary_hash(mapping: DataFrame, word: str = "word") -> DataFrame:
    """n, vocabulary_sha256: SHA-256 of the words in order, joined by line feeds (one row per class is gathered)."""
    got = mapping.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(word)).alias("_w"))
    return got.select("n", F.sha2(F.array_join("_w", "\n"), 256).alias("vocabulary_sha256"))


def vocabulary_doc(f: DataFrame, name: str, word: str = "word") -> DataFrame:
    """name, document: a JSON document of the classes in order with their index and counts."""
    c = F.array_sort(F.collect_list(F.struct(F.col(word).alias("class"), "clips", "units")))
    got = f.agg(c.alias("_c"))
    classes = F.transform("_c", lambda x, i: F.struct(i.alias("index"), x["class"].alias("class"), x["clips"].alias("clips"), x["units"].alias("units")))
    digest = F.sha2(F.array_join(F.transform("_c", lambda x: x["class"]), "\n"), 256)
    return got.select(F.lit(name).alias("name"), F.to_json(F.struct(F.lit(name).alias("name"), F.size("_c").alias("num_classes"), digest.alias("vocabulary_sha256"), classes.alias("classes"))).alias("document"))
