"""Sinks: write-once tables with locks, compare-on-write, widening appends, staged merges, model exports."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.quality import digest
from quern.sources import commits
from quern.sources.readers import exists
from quern.sources.shared import new_path, remove, staged


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """Put a small file into place at once, over an older one."""
    commits.replace_file(spark, path, body)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def table_digest(df: DataFrame) -> str:
    return digest(df).first().sha256


def split_facts(df: DataFrame, split: str = "split", word: str = "word") -> dict:
    """Counts, shares, classes and digests of a split table: in all, by split, and of contents and split groups.

    Columns sha256, split_group and aug_source add their facts where df has them. Only single rows are gathered.
    """
    parts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(word).alias("classes")).collect()  # one row per split
    n = sum(r.n for r in parts)
    cross = df.groupBy(word, split).agg(F.count(F.lit(1)).alias("n"))
    facts = {
        "sha256": table_digest(df), "n_samples": n, "n_classes": df.select(word).distinct().count(), "class_counts_sha256": table_digest(cross),
        "counts": {r[0]: r.n for r in parts}, "fractions": {r[0]: round(r.n / n, 6) for r in parts}, "classes_per_split": {r[0]: r.classes for r in parts},
        "per_split_sha256": {r[0]: table_digest(df.filter(F.col(split).eqNullSafe(r[0]))) for r in parts},
    }
    for key, name in (("sha256", "duplicate_groups"), ("split_group", "split_groups")):
        if key in df.columns:
            g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(word).alias("words"), F.min(split).alias("s"))
            many = F.col("n") > 1
            row = g.agg(F.count(F.lit(1)).alias("units"), F.count_if(many).alias("multi_file"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("files_in_multi_file"), F.count_if(many & (F.col("words") > 1)).alias("cross_label"), F.max("n").alias("largest")).first()
            facts[name] = row.asDict() | {"per_split": {r[0]: r[1] for r in g.groupBy("s").count().collect()}}
    if "aug_source" in df.columns:
        facts["augmented_files"] = df.filter(F.coalesce("aug_source", F.lit("")) != "").count()
    return facts


def write_frozen(df: DataFrame, path: str, version: str, meta: dict | None = None, split: str = "split", word: str = "word") -> dict:
    """Write df once, partitioned by split, with class counts and a lock of its facts; refuses if the version is there."""
    spark, where = df.sparkSession, f"{path}/split_{version}"
    if any(exists(spark, where + end) for end in ("", ".lock.json", "_class_counts")):
        raise FileExistsError(f"{where} is frozen; make a new version instead")
    df.write.mode("errorifexists").partitionBy(split).parquet(where)
    saved = spark.read.schema(df.schema).parquet(where).select(*df.columns)
    saved.groupBy(word, split).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{where}_class_counts")
    lock = {"version": version} | split_facts(saved, split, word) | (meta or {})
    write_text(spark, where + ".lock.json", json.dumps(lock, indent=2, sort_keys=True))
    return lock


def read_lock(spark: SparkSession, path: str, version: str) -> dict:
    return json.loads(read_text(spark, f"{path}/split_{version}.lock.json"))


def read_frozen(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The frozen table; fails if its digest is not the lock's."""
    where = f"{path}/split_{version}"
    df = spark.read.parquet(where)
    if table_digest(df) != read_lock(spark, path, version)["sha256"]:
        raise RuntimeError(f"{where} differs from its lock")
    return df


def write_once(df: DataFrame, path: str) -> bool:
    """Write df, or check that what is there has the same rows; True if it was written now."""
    spark = df.sparkSession
    if exists(spark, path):
        old = spark.read.parquet(path)
        if sorted(old.columns) != sorted(df.columns) or table_digest(old.select(*df.columns)) != table_digest(df):
            raise FileExistsError(f"{path} holds something else; it is not overwritten")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def write_document(spark: SparkSession, path: str, doc: dict) -> bool:
    """Write a JSON document once; True if it was written now, an error if something else is there."""
    if not exists(spark, path):
        write_text(spark, path, json.dumps(doc, indent=1, ensure_ascii=False))
        return True
    if json.loads(read_text(spark, path)) != doc:
        raise FileExistsError(f"{path} is another document; it stays as it is")
    return False


# The keys of mapping and vocabulary documents.
def _mapping_document(words: list[str], split_sha256: str | None) -> dict:
    return {"num_classes": len(words), "vocabulary_sha256": digest_of_words(words), "frozen_split_sha256": split_sha256, "word_to_index": {w: i for i, w in enumerate(words)}}


def digest_of_words(words: list[str]) -> str:
    return hashlib.sha256("\n".join(words).encode()).hexdigest()


def _same(path: str, found: dict, meant: dict) -> None:
    """A document must be the one that its own class list gives."""
    wrong = sorted(k for k in meant if found.get(k) != meant[k])
    if wrong:
        raise ValueError(f"{path} does not agree with its class list in: {', '.join(wrong)}")


def save_mapping(mapping: DataFrame, path: str, word: str = "word", split_sha256: str | None = None) -> bool:
    """Save a label mapping (one row per class) with the digest of the split it is for; see write_document."""
    rows = mapping.select(word, "label").orderBy("label", word).collect()
    doc = _mapping_document([r[0] for r in rows], split_sha256)
    _same("the mapping table", {"word_to_index": {r[0]: r[1] for r in rows}, "num_classes": len({r[0] for r in rows})}, {k: doc[k] for k in ("word_to_index", "num_classes")})
    return write_document(mapping.sparkSession, path, doc)


def read_mapping(spark: SparkSession, path: str, split_sha256: str | None = None) -> dict:
    """The document, checked against itself and, where given, against the digest of the split."""
    doc = json.loads(read_text(spark, path))
    index = doc.get("word_to_index", {})
    _same(path, doc, _mapping_document(sorted(index, key=lambda w: (index[w], w)), doc.get("frozen_split_sha256")))
    if split_sha256 and doc["frozen_split_sha256"] != split_sha256:
        raise ValueError(f"{path} is for another split")
    return doc


def load_mapping(spark: SparkSession, path: str, word: str = "word", split_sha256: str | None = None) -> DataFrame:
    """word, label of a checked mapping document."""
    index = read_mapping(spark, path, split_sha256)["word_to_index"]
    return spark.createDataFrame(sorted(index.items(), key=lambda x: x[1]), f"{word} string, label int")


def write_vocabulary(spark: SparkSession, path: str, document: str, split_sha256: str | None = None) -> bool:
    """Write a vocabulary document (JSON text) once, with the digest of the split it was chosen on."""
    return write_document(spark, path, json.loads(document) | {"frozen_split": {"sha256": split_sha256}})


def read_vocabulary(spark: SparkSession, path: str, split_sha256: str | None = None) -> dict:
    """A vocabulary document: classes in order without repeats, their places as index, right count and digest.

    With split_sha256 it must have been chosen on that split.
    """
    doc = json.loads(read_text(spark, path))
    words = sorted({c["class"] for c in doc["classes"]})
    found = {"classes": [(c["index"], c["class"]) for c in doc["classes"]], "num_classes": doc["num_classes"], "vocabulary_sha256": doc["vocabulary_sha256"]}
    _same(path, found, {"classes": list(enumerate(words)), "num_classes": len(words), "vocabulary_sha256": digest_of_words(words)})
    if split_sha256 and (doc.get("frozen_split") or {}).get("sha256") != split_sha256:
        raise ValueError(f"{path} was chosen on another split")
    return doc


def append_widening(df: DataFrame, path: str) -> None:
    """Append rows whose columns may go beyond the table's; old rows read as null there."""
    df.write.mode("append").option("mergeSchema", "true").parquet(path)


def read_widened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def _adds_up(got: DataFrame, key: str, expected: DataFrame) -> None:
    counts = got.groupBy(key).count().join(expected.select(key, F.lit(1).alias("_e")), key, "full")
    bad = counts.filter("count is null or count > 1 or _e is null").limit(5).collect()  # for the message
    if bad:
        raise ValueError(f"shards do not add up: {[r[0] for r in bad]}")


def merge_shards(spark: SparkSession, shards: list[str], out: str, key: str, expected: DataFrame) -> DataFrame:
    """Union of shard tables, checked against the expected keys (none missing, extra or twice), then committed once."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(s) for s in shards])
    return publish(spark, out, {"rows": union}, lambda t: _adds_up(t["rows"], key, expected))["rows"]


def merge_stores(spark: SparkSession, shards: list[str], out: str, expected: DataFrame, key: str = "clip") -> dict[str, DataFrame]:
    """One store (tables clips and frames) of shard stores, checked, then made visible by one commit.

    Clips must be the expected keys, each once; frames must belong to accepted clips, have their length once each, and
    every accepted clip must have frames. Nothing is visible after a failure, and a later run starts afresh.
    """
    def union(name: str) -> DataFrame:
        parts = [spark.read.option("mergeSchema", "true").parquet(f"{s}/{name}") for s in shards]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("batch")

    def check(t: dict[str, DataFrame]) -> None:
        _adds_up(t["clips"], key, expected)
        ok = t["clips"].filter("reason is null").select(key)
        places = t["frames"].groupBy(key, "frame").count()
        for what, bad in (
            ("frames twice", places.filter("count > 1")),
            ("frames of no accepted clip", places.join(ok, key, "left_anti")),
            ("accepted clips without frames", ok.join(places.select(key), key, "left_anti")),
        ):
            some = [r[0] for r in bad.limit(5).collect()]
            if some:
                raise ValueError(f"{what}: {some}")

    return publish(spark, out, {"clips": union("clips"), "frames": union("frames")}, check)


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], check=None) -> dict[str, DataFrame]:
    """Write tables, check them as written, and make them visible together, once: a second publication is refused."""

    def build(now: dict[str, str], folder: str) -> dict[str, str]:
        if now:
            raise FileExistsError(f"{path} is there already")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{folder}/{name}")
        if check is not None:
            check({name: spark.read.parquet(f"{path}/{folder}/{name}") for name in tables})
        return {name: f"{folder}/{name}" for name in tables}

    commits.commit(spark, path, build)
    return {name: commits.table(spark, path, name) for name in tables}


def write_evaluation(predictions: DataFrame, path: str, vocabulary_size: int) -> None:
    """Predictions, confusion counts, per-class table, top confusions and metrics as five tables."""
    from quern.operators import evalmetrics as em

    cm = staged(em.confusion(predictions), "confusion")
    predictions.write.mode("overwrite").parquet(f"{path}/predictions")
    for name, df in (("confusion", cm), ("per_class", em.per_class(cm)), ("top_confusions", em.top_confusions(cm)), ("metrics", em.metrics(cm, vocabulary_size))):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_model(model, path: str, meta: dict) -> None:
    """A pyspark.ml model with its metadata; refuses to replace one."""
    spark = SparkSession.active()
    if exists(spark, path):
        raise FileExistsError(path)
    model.write().save(f"{path}/model")
    write_text(spark, f"{path}/meta.json", json.dumps(meta, sort_keys=True))


def load_model(spark: SparkSession, path: str):
    """(model, metadata) as save_model or export_model left them; the model's class is read from its own metadata."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark), json.loads(read_text(spark, f"{path}/meta.json"))


def export_model(spark: SparkSession, source: str, path: str, mapping: dict) -> dict:
    """Copy a saved model that was selected on validation, with its class mapping.

    Its metadata must say selected_on "val" and hold the mapping's digest.
    """
    model, meta = load_model(spark, source)
    if meta.get("selected_on") != "val":
        raise ValueError(f"{source} was not selected on validation")
    if meta.get("label_mapping_sha256") != mapping["vocabulary_sha256"]:
        raise ValueError(f"{source} was trained with another label mapping")
    save_model(model, path, meta | {"source": source})
    write_text(spark, f"{path}/class_mapping.json", json.dumps(mapping | {"index_to_class": {str(i): w for w, i in mapping["word_to_index"].items()}}, ensure_ascii=False))
    return meta


def save_table(df: DataFrame, path: str, compression: str = "zstd") -> int:
    """Write df as Parquet, all or nothing, and return the bytes of its files."""
    df.write.mode("errorifexists").option("compression", compression).parquet(path)
    return stored_bytes(df.sparkSession, path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    p, fs = commits.hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


def serialized_size(df: DataFrame, compression: str = "zstd") -> int:
    """Bytes of df as Parquet, measured on a copy that is removed again."""
    path = new_path(df.sparkSession, "size")
    try:
        return save_table(df, path, compression)
    finally:
        remove(df.sparkSession, path)


def upsert(df: DataFrame, path: str, key: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """Put df's rows (one per key) into the keyed table at path, replacing rows of the same key, and drop the keys of
    deleted. Each call is a commit (see commits): a run that fails at any step changes nothing, and of writers at
    once each works on the result of the other."""
    spark = df.sparkSession
    keys = df.select(*key)
    if deleted is not None:
        keys = keys.unionByName(deleted.select(*key))
    put = df if deleted is None else df.join(deleted.select(*key), key, "left_anti")

    def build(now: dict[str, str], folder: str) -> dict[str, str]:
        new = put
        if now:
            new = spark.read.parquet(f"{path}/{now['rows']}").join(keys.distinct(), key, "left_anti").unionByName(put)
        new.write.parquet(f"{path}/{folder}/rows")
        return {"rows": f"{folder}/rows"}

    commits.commit(spark, path, build)
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that upsert keeps."""
    return commits.table(spark, path, "rows")


def append_messages(df: DataFrame, path: str) -> None:
    """Insert messages: each call adds whole files, so readers see all of its rows or none."""
    df.write.mode("append").parquet(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than limit rows are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them as a table instead")
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def write_report(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame]) -> None:
    """Tables under headings in one Markdown file, and each whole as Parquet beside it; of tables too long for Markdown
    the report gives the number of rows and the folder."""

    def shown(df: DataFrame, folder: str) -> str:
        n = df.count()
        return markdown(df) if n <= 1000 else f"{n} rows, in {folder}"

    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    parts = [f"## {name}\n\n{shown(spark.read.parquet(f'{path}/{name}'), f'{path}/{name}')}\n" for name in tables]
    write_text(spark, f"{path}/report.md", f"# {title}\n\n" + "\n".join(parts))


def environment(spark: SparkSession) -> DataFrame:
    """One row of provenance: versions and the settings that change plans."""
    names = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")
    return spark.createDataFrame([(spark.version, {n: spark.conf.get(n, None) for n in names})], "version string, settings map<string,string>")
