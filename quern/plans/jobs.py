"""Jobs: each composes operators over paths and ends in a sink. python -m quern JOB --help lists a job's options."""

from __future__ import annotations

import argparse
import json
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from quern.functions import arrays, text
from quern.functions.arrays import OBSERVED
from quern.operators import convert, evalmetrics, experiment, graph, kernel, monitor, profile, quality, reconcile, recurrent, sampling, sequences, timeseries, vocabulary
from quern.operators.skew import with_group
from quern.sources import arrayfiles, commits, config, fetch, figures, listing, readers, sinks
from quern.sources.shared import partitions, staged
from quern.streaming import resume

JOBS: dict = {}


def job(*options: str):
    def add(f):
        JOBS[f.__name__.replace("_", "-")] = (f, options)
        return f

    return add


@job("path", "out", "pattern=*", "folders=", "revision=", "hashes=yes")
def list_files(spark, a):
    """The index of all files under a path, with their hashes; of a revision's folder and some folders of it only, where given."""
    folders = a.folders.split(",") if a.folders else None
    files = listing.list_files(spark, a.path, a.pattern, a.hashes == "yes", folders, a.revision or None)
    sinks.write_once(files, a.out)
    return spark.read.parquet(a.out).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("size_bytes") == 0).alias("empty"))


@job("sample", "source", "out", "frames=", "adopt=", "reprobe=no", "batches=8", "retries=4")
def probe_files(spark, a):
    """Fetch and hash the files of a sample from a source folder, in batches that an interrupted run keeps.

    Files that were fetched are not fetched again; failures are. With adopt, whole and matching rows of an earlier
    probe are taken over; with frames (repo_path, t), decoded frames and their rate are recorded, and files without
    any are decode failures, which reprobe=yes probes again.
    """
    sample, parts = spark.read.parquet(a.sample), f"{a.out}/parts"
    known = readers.read_parts(spark, parts, readers.PROBE, "repo_path", "download_ok")
    number = 1 + (known.agg(F.max("part")).first()[0] if "part" in known.columns else -1)
    if a.adopt and number == 0:
        old = readers.read_parts(spark, a.adopt, readers.PROBE, "repo_path", "download_ok").filter("download_ok and sha256_match")
        fetch.adopt(old, sample, "repo_path", "adopted").withColumn("part", F.lit(number)).write.mode("append").parquet(parts)
        known, number = readers.read_parts(spark, parts, readers.PROBE, "repo_path", "download_ok"), number + 1
    keep = F.col("download_ok") & (F.coalesce("decode_ok", F.lit(True)) if a.reprobe == "yes" else F.lit(True))
    done = staged(known.filter(keep).select("repo_path"), "probed")
    todo = sample.select("repo_path", "sha256").dropDuplicates(["repo_path"]).join(done, "repo_path", "left_anti")
    rate = staged(fetch.decoded_rate(spark.read.parquet(a.frames)), "rates") if a.frames else None
    for k in range(int(a.batches)):
        some = todo.filter(F.pmod(F.xxhash64("repo_path"), F.lit(int(a.batches))) == k).repartition(partitions(spark), "repo_path")
        got = fetch.fetch_all(some, listing.opener(a.source), int(a.retries))
        if rate is not None:
            got = got.join(rate, "repo_path", "left").withColumn("decode_ok", F.when(F.col("download_ok"), F.col("decoded_frames").isNotNull()))
        got.withColumns({"probe_origin": F.lit("probe"), "part": F.lit(number + k)}).write.mode("append").parquet(parts)
    rows = readers.read_parts(spark, parts, readers.PROBE, "repo_path", "download_ok")
    rows.write.mode("overwrite").parquet(f"{a.out}/results")
    rows = spark.read.parquet(f"{a.out}/results")
    lost = sample.select("repo_path").distinct().join(rows, "repo_path", "left_anti").agg(F.count(F.lit(1)).alias("without_record"))
    ok = rows.agg(F.count(F.lit(1)).alias("files"), F.count_if("download_ok").alias("fetched"), F.count_if(~F.col("sha256_match")).alias("other_content"), F.count_if(~F.col("decode_ok")).alias("not_decoded"))
    return ok.crossJoin(F.broadcast(lost))  # one row each


@job("csv", "files", "out")
def build_manifest(spark, a):
    """Reconcile the metadata CSV with the file index; manifest, duplicate groups, label audit."""
    m = reconcile.manifest(readers.read_metadata(spark, a.csv), spark.read.schema(readers.FILES).parquet(a.files))
    m = reconcile.annotate_duplicates(m, F.col("eligible_pre_probe"))
    sinks.write_once(m, f"{a.out}/manifest")
    m = spark.read.parquet(f"{a.out}/manifest")
    ok = m.filter("eligible_pre_probe")
    sinks.write_once(reconcile.content_groups(ok, path="repo_path"), f"{a.out}/duplicate_groups")
    sinks.write_once(reconcile.audit_labels(ok), f"{a.out}/label_audit")
    sizes = m.groupBy("issue", "folder", text.extension(F.col("filename")).alias("extension"))
    sinks.write_once(sizes.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")), f"{a.out}/summary")
    return m.groupBy("issue").count()


@job("manifest", "probe", "out", "min_frames=30")
def validate(spark, a):
    """Manifest rows with their first exclusion reason."""
    probe = readers.read_parts(spark, a.probe, readers.PROBE, "repo_path", "download_ok")
    v = reconcile.validate(spark.read.parquet(a.manifest), probe, int(a.min_frames))
    sinks.write_once(v, a.out)
    return v.groupBy("exclusion_reason").count()


@job("manifest", "out", "version=v1", "seed=42", "val=0.15", "test=0.15")
def make_split(spark, a):
    """Group-aware split of eligible samples, frozen."""
    s = spark.read.parquet(a.manifest).filter("eligible_pre_probe").select("sample_id", "repo_path", "filename", "word", "sha256", "source_proxy")
    s = graph.cut(graph.split_groups(s))
    val, test = float(a.val), float(a.test)
    out = sampling.assign_splits(s, {"train": 1 - val - test, "val": val, "test": test}, int(a.seed))
    out = with_group(graph.cut(out), ["sha256"], F.count(F.lit(1)).alias("dup_group_size"))
    lock = sinks.write_frozen(out, a.out, a.version, {"seed": int(a.seed)})
    return spark.createDataFrame([(k, v) for k, v in lock["counts"].items()], "split string, n long")


@job("manifest", "splits", "version=v1", "val=0.15", "test=0.15", "tolerance=0.01", "out=")
def verify_split(spark, a):
    """Every integrity check of a frozen split: its own, and that labels, contents and groups are those that the manifest
    gives now. With out, the checks and each class's shares of the splits as a report."""
    m = spark.read.parquet(a.manifest).filter("eligible_pre_probe")
    val, test = float(a.val), float(a.test)
    s = sinks.read_frozen(spark, a.splits, a.version)
    can = s.groupBy("word").agg(F.count_distinct("split_group").alias("k")).filter("k >= 3")
    checks = quality.split_checks(s, m.select("sample_id"), {"train": 1 - val - test, "val": val, "test": test}, float(a.tolerance), can)
    now = graph.cut(graph.split_groups(m.select("sample_id", "filename", "word", "sha256")))
    j = s.select("sample_id", "word", "sha256", "split_group").join(now.select("sample_id", *[F.col(c).alias(f"_{c}") for c in ("word", "sha256", "split_group")]), "sample_id")
    checks = quality.all_of([checks, *[quality.check(j, f"{c} is the manifest's", F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))), "differ") for c in ("word", "sha256", "split_group")]])
    if a.out:
        names = ["train", "val", "test"]
        shares = profile.row_shares(profile.crosstab(s, "word", "split", names), "word", names)
        spread = reduce(lambda x, y: x.unionByName(y), [profile.describe(shares, c).withColumn("split", F.lit(c)) for c in names])
        sinks.write_report(spark, a.out, "Split", {"checks": checks, "shares": shares, "spread": spread})
        return spark.read.parquet(f"{a.out}/checks")
    return checks


@job("splits", "out", "splits_wanted=train,val,test", "shards=4", "limit=", "version=v1", "vocabulary=", "classes=", "per_split=", "seed=42", "done=", "manifest=", "per_minute=60", "default_bytes=1000000", "estimate_only=no")
def plan_shards(spark, a):
    """Extraction list dealt round robin.

    Of a vocabulary's words only, where one is given, and of these the first classes and the first clips per class and
    split (train=20,val=5) in seeded order; without the clips that an earlier run has finished (done). With a manifest
    (sample_id, size_bytes) the bytes and minutes are estimated; estimate_only=yes writes no plan.
    """
    s = sinks.read_frozen(spark, a.splits, a.version)
    if a.vocabulary:
        lock = sinks.read_lock(spark, a.splits, a.version)
        words = [c["class"] for c in sinks.read_vocabulary(spark, a.vocabulary, lock["sha256"])["classes"]]
        s = sampling.select_samples(s, words, config.parse_per_split(a.per_split), int(a.classes) if a.classes else None, int(a.seed))
    elif a.classes or a.per_split:
        raise ValueError("classes and per_split choose from a vocabulary: pass one")
    s = s.filter(F.col("split").isin(a.splits_wanted.split(",")))
    if a.done:
        s = s.join(spark.read.option("mergeSchema", "true").parquet(a.done).select(F.col("clip").alias("sample_id")), "sample_id", "left_anti")
    if a.limit:
        s = sampling.top_per_group(s, ["split"], [F.col("sample_id")], int(a.limit))
    if a.manifest:
        sizes = spark.read.parquet(a.manifest).filter("sample_id is not null").select("sample_id", "size_bytes").dropDuplicates(["sample_id"])
        cost = fetch.estimate(s, s.join(sizes, "sample_id"), "size_bytes", float(a.default_bytes), float(a.per_minute))
        if a.estimate_only == "yes":
            return cost
        print(sinks.markdown(cost))
    elif a.estimate_only == "yes":
        raise ValueError("an estimate needs a manifest")
    s = sampling.round_robin(s, "sample_id", int(a.shards))
    s.write.mode("errorifexists").partitionBy("shard").parquet(a.out)
    return spark.read.parquet(a.out).groupBy("shard").count()


@job("raw", "out", "files_per_batch=8")
def preprocess(spark, a):
    """Raw detections to packed frames and clip statistics, by batches of files: files that an earlier run has handled
    are skipped, failures become rejected clips. A clip's rows must lie in one file."""
    schema = spark.read.parquet(a.raw).schema

    def step(batch, number):
        frames, clips = kernel.guarded(batch)
        frames.write.mode("overwrite").parquet(f"{a.out}/frames/batch={number:08d}")
        clips.write.mode("overwrite").parquet(f"{a.out}/clips/batch={number:08d}")

    resume.each_batch(spark, a.raw, schema, f"{a.out}/checkpoint", step, int(a.files_per_batch))
    return spark.read.option("mergeSchema", "true").parquet(f"{a.out}/clips").groupBy("reason").count()


@job("clips", "splits", "out", "version=v1")
def build_index(spark, a):
    """Sequence index of accepted clips, compared with an earlier one where there is one."""
    frozen = sinks.read_frozen(spark, a.splits, a.version).select("sample_id", "repo_path", "word", "split", "sha256", "split_group", "aug_source")
    mapping = vocabulary.label_mapping(frozen)
    sinks.save_mapping(mapping, f"{a.out}/label_mapping.json", split_sha256=sinks.read_lock(spark, a.splits, a.version)["sha256"])
    idx = sequences.index(spark.read.parquet(a.clips).select(F.col("clip").alias("sample_id"), "start", "end", "reason"), frozen, mapping)
    sinks.write_once(idx, f"{a.out}/index")
    return quality.index_leaks(spark.read.parquet(f"{a.out}/index"))


@job("splits", "audit", "out", "size=100", "seed=42", "version=v1", "deferred=")
def select_vocabulary(spark, a):
    """Rules, ranking and the first size classes; features, pairs, the document, and a report of reasons, batches and
    sizes. deferred (word) names classes that are set aside for inspection whatever the rules say."""
    s = vocabulary.file_evidence(sinks.read_frozen(spark, a.splits, a.version))
    f = vocabulary.class_features(s, spark.read.parquet(a.audit)).withColumn("reasons", vocabulary.exclusion_reasons())
    if a.deferred:
        f = vocabulary.defer(f, spark.read.parquet(a.deferred))
    sinks.write_once(f, f"{a.out}/features")
    f = spark.read.parquet(f"{a.out}/features")
    batch = s.filter("batch is not null").groupBy("batch").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("clips"))
    batches = batch.agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("splits") > 1).alias("in_several_splits"), F.max("clips").alias("largest"))
    sinks.write_report(spark, f"{a.out}/report", "Vocabulary", {"reasons": vocabulary.reason_counts(f), "primary": profile.value_counts(f.withColumn("reason", vocabulary.primary_reason(F.col("reasons"))), "reason"), "batches": batches, "eligible": vocabulary.summary_counts(f.filter("reasons = ''"))})
    top = vocabulary.rank_candidates(f.filter("reasons = ''"), ["min_eval_units", "source_patterns", "units"], int(a.seed)).filter(F.col("rank") <= int(a.size))
    sinks.write_once(graph.pair_treatment(graph.label_pairs(s)), f"{a.out}/pairs")
    sinks.write_vocabulary(spark, f"{a.out}/vocabulary.json", vocabulary.vocabulary_doc(top, f"top{a.size}").first().document, sinks.read_lock(spark, a.splits, a.version)["sha256"])
    return vocabulary.summary_counts(top)


@job("features", "out", "classes", "trees=50,100", "depth=10", "tag=", "mapping=", "export=")
def run_experiment(spark, a):
    """Forests on (sample_id, split, label, features) rows; the best on validation, evaluated and appended.

    A tag makes a variant's names its own. With a mapping document the labels must be its, and export writes the model
    with its classes.
    """
    if a.export and not a.mapping:
        raise ValueError("an export needs the mapping")
    tries = {f"rf{t}{'-' + a.tag if a.tag else ''}": {"numTrees": int(t), "maxDepth": int(a.depth)} for t in a.trees.split(",")}
    mapping = sinks.read_mapping(spark, a.mapping) if a.mapping else None
    words = sinks.load_mapping(spark, a.mapping) if a.mapping else None
    run = monitor.RunFigures(spark)
    with run:
        model, result = experiment.run(spark.read.parquet(a.features), tries, int(a.classes), mapping=words)
    sinks.append_widening(result, f"{a.out}/results")
    name = result.first().experiment
    bound = {"label_mapping_sha256": mapping["vocabulary_sha256"]} if mapping else {}
    sinks.save_model(model, f"{a.out}/{name}", {"experiment": name, "selected_on": "val", "resources": run.summary()} | bound)
    if a.export:
        sinks.export_model(spark, f"{a.out}/{name}", a.export, mapping)
    return sinks.read_widened(spark, f"{a.out}/results")


@job("features", "out", "classes", "window", "model=lstm", "hidden=128", "epochs=50", "seed=42")
def train_recurrent(spark, a):
    """A recurrent model on (sample_id, split, label, features) rows; selected on validation, evaluated and appended."""
    rows = spark.read.parquet(a.features)
    fitted, result = recurrent.run(rows, a.model, int(a.classes), int(a.window), {"hidden": int(a.hidden), "epochs": int(a.epochs)}, int(a.seed))
    recurrent.save(spark, f"{a.out}/{a.model}", fitted, {"experiment": a.model})
    curves = {"train loss": [(h["epoch"], h["train_loss"]) for h in fitted.history], "val macro F1": [(h["epoch"], h["val_macro_f1"]) for h in fitted.history]}
    sinks.write_text(spark, f"{a.out}/{a.model}.svg", figures.curves(curves, a.model))
    sinks.append_widening(result, f"{a.out}/results")
    return sinks.read_widened(spark, f"{a.out}/results")


@job("manifest", "out", "per_class=2", "target=500", "seed=42")
def select_sample(spark, a):
    """A sample over all classes for a first look, in seeded order, with its class counts."""
    pool = spark.read.parquet(a.manifest).filter("eligible_pre_probe")
    s = sampling.class_sample(pool, int(a.per_class), int(a.target), int(a.seed))
    sinks.write_once(s, f"{a.out}/sample")
    sinks.write_once(sampling.class_quotas(pool, int(a.per_class), int(a.target), int(a.seed)), f"{a.out}/class_counts")
    return spark.read.parquet(f"{a.out}/sample").groupBy("selection").count()


@job("sample", "manifest", "probe", "out")
def eda_report(spark, a):
    """Profile of the sample's probe results and of the whole manifest's labels."""
    m = spark.read.parquet(a.manifest)
    probe = readers.read_parts(spark, a.probe, readers.PROBE, "repo_path", "download_ok")
    s = spark.read.parquet(a.sample).join(probe, "repo_path", "left").withColumn("fps", F.coalesce("decoded_fps", "avg_fps"))
    ok = s.filter("coalesce(decode_ok, false)").withColumn("seconds", F.col("decoded_frames") / F.col("fps"))
    size = m.filter("eligible_pre_probe").groupBy("word").agg(F.count(F.lit(1)).alias("class_size"))
    w = ok.drop("class_size").join(size, "word").join(ok.groupBy("word").agg(F.count(F.lit(1)).alias("sampled")), "word").withColumn("w", F.col("class_size") / F.col("sampled"))
    shares = w.agg(*[profile.weighted_share(F.col("decoded_frames") < n, F.col("w")).alias(f"below_{n}") for n in (30, 45, 60)])
    stats = [profile.describe(ok, c).withColumn("column", F.lit(c)) for c in ("decoded_frames", "fps", "seconds", "width", "height")]
    sinks.write_report(spark, a.out, "Sample", {
        "issues": m.groupBy("issue").count(), "sources": profile.value_counts(m, "source_proxy"), "numbers": reduce(lambda x, y: x.unionByName(y), stats),
        "outcomes": profile.value_counts(s.withColumn("outcome", F.when(F.coalesce("decode_ok", F.lit(False)), "decoded").otherwise("not decoded")), "outcome"),
        "resolutions": profile.value_counts(ok.withColumn("resolution", F.format_string("%sx%s", "width", "height")), "resolution"), "weighted_shares": shares,
        "shared_labels": graph.label_components(graph.label_pairs(m.filter("eligible_pre_probe"))).withColumn("labels", F.array_join("labels", "|")),
    })
    return shares


@job("splits", "probe", "out", "n=400", "short=50", "copies=20", "seed=42", "which=train", "version=v1")
def select_benchmark(spark, a):
    """A fixed benchmark sample: short and copied clips by quota, the rest over quintiles of length."""
    s = sinks.read_frozen(spark, a.splits, a.version).filter(F.col("split") == a.which)
    probe = readers.read_parts(spark, a.probe, readers.PROBE, "repo_path", "download_ok").filter("coalesce(decode_ok, false)")
    pool = s.join(probe.select("repo_path", "decoded_frames", "width", "height"), "repo_path")
    steps = [("short", F.col("decoded_frames") < 30, int(a.short)), ("copy", F.coalesce("aug_source", F.lit("")) != "", int(a.copies))]
    sinks.write_once(sampling.coverage_sample(pool, steps, int(a.n), "decoded_frames", "word", int(a.seed)), a.out)
    return spark.read.parquet(a.out).groupBy("reason").count()


@job("store", "timings", "out", "total=108616")
def benchmark_report(spark, a):
    """Rejections, missing hands, runs and rates of an extraction run; timings: clip, total_s and its parts."""
    clips, t = commits.table(spark, a.store, "clips"), spark.read.parquet(a.timings)
    f = commits.table(spark, a.store, "frames")
    hand = lambda g: F.col(f"{g}_flags").bitwiseAND(F.lit(OBSERVED)) != 0
    gaps = timeseries.runs(f, ~(hand("left_hand") | hand("right_hand")))
    runs = gaps.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("len") <= 5).alias("up_to_5"), F.count_if(F.col("len").between(6, 15)).alias("up_to_15"), F.count_if(F.col("len") > 15).alias("longer"))
    rate = t.agg(F.count(F.lit(1)).alias("clips"), F.sum("total_s").alias("seconds")).withColumn("clips_per_minute", F.col("clips") * 60 / F.col("seconds"))
    rate = rate.withColumn("hours_for_all", F.lit(float(a.total)) / F.col("clips_per_minute") / 60)
    sinks.write_report(spark, a.out, "Extraction run", {"reasons": profile.value_counts(clips, "reason"), "seconds": profile.describe(t, "total_s"), "missing_hands": runs, "rate": rate})
    return rate


@job("store", "out", "min_frames=30", "max_frac=0.3", "max_run=15", "px_p999=0.5", "px_max=1.0")
def reevaluate(spark, a):
    """Judge stored clips again, inside the active interval and over the whole clip, and compare both reasons; and tell
    what storing half-precision numbers would cost, in bytes and in pixels of error, against the limits given."""
    f, clips = commits.table(spark, a.store, "frames").drop("start", "end"), commits.table(spark, a.store, "clips")
    hand = (F.col("left_hand_flags").bitwiseAND(F.lit(OBSERVED)) != 0) | (F.col("right_hand_flags").bitwiseAND(F.lit(OBSERVED)) != 0)
    v = timeseries.rejections(f, hand, int(a.min_frames), 3, float(a.max_frac), int(a.max_run))
    v = v.join(clips.select("clip", F.col("reason").alias("stored_reason")), "clip", "left")
    sinks.write_once(v, f"{a.out}/reevaluated")
    sizes = [(kind, sinks.serialized_size(f, kind)) for kind in ("none", "zstd")]
    groups = [g for g in arrays.GROUPS if g in f.columns]
    lost = staged(quality.rounding(f, groups), "rounding")
    checks = quality.rounding_checks(lost, float(a.px_p999), float(a.px_max))
    frame = spark.createDataFrame([(kind, arrays.bytes_per_frame(groups, kind)) for kind in ("float16", "float32")], "numbers string, bytes_per_frame int")
    sinks.write_report(spark, f"{a.out}/report", "Judged again", {"reasons": v.groupBy("stored_reason", "reason", "full_reason").count(), "bytes": spark.createDataFrame(sizes, "compression string, bytes long"), "precision": lost, "precision_checks": checks, "frames": frame})
    return spark.read.parquet(f"{a.out}/reevaluated").groupBy("reason").count()


@job("index", "audit", "out", "window=30")
def interval_audit(spark, a):
    """Which clips have short active intervals: rates by word kind, source and split, tests and examples."""
    i = spark.read.parquet(a.index).join(spark.read.parquet(a.audit).select(F.col("label").alias("word"), "anomaly").dropDuplicates(["word"]), "word", "left")
    i = i.withColumns({"short": F.col("active_frames") < int(a.window), "label_type": text.label_type(F.col("word")), "has_anomaly": F.col("anomaly").isNotNull()})
    tables = {f"by_{c}": profile.rate_table(i, c, F.col("short")) for c in ("label_type", "split", "has_anomaly", "active_bin")}
    tests = [profile.chi_square(i, c, "short").withColumn("column", F.lit(c)) for c in ("label_type", "split", "has_anomaly")]
    tables["chi_square"] = reduce(lambda x, y: x.unionByName(y), tests)
    tables["spearman"] = profile.spearman(i.withColumn("length", F.length("word")), "length", "active_frames")
    sinks.write_report(spark, a.out, "Short intervals", tables)
    return spark.read.parquet(f"{a.out}/chi_square")


@job("store", "out", "compress=yes", "numbers=float32")
def export_arrays(spark, a):
    """The frames of a packed store as one array file per clip, with the table of files."""
    files = arrayfiles.save_arrays(commits.table(spark, a.store, "frames"), f"{a.out}/arrays", a.compress == "yes", a.numbers)
    sinks.save_table(files, f"{a.out}/files")
    return spark.read.parquet(f"{a.out}/files").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@job("arrays_dir", "out", "groups=")
def import_arrays(spark, a):
    """Array files as a packed store's frames, of all groups or of some."""
    groups = a.groups.split(",") if a.groups else None
    sinks.save_table(arrayfiles.load_arrays(spark, a.arrays_dir, groups), f"{a.out}/frames")
    return spark.read.parquet(f"{a.out}/frames").agg(F.count_distinct("clip").alias("clips"), F.count(F.lit(1)).alias("frames"))


@job("store", "out", "expected=")
def convert_store(spark, a):
    """A store of the first format to the packed one; judged again and checked against an earlier judgement."""
    expected = spark.read.parquet(a.expected) if a.expected else None
    frames, clips = convert.convert(commits.table(spark, a.store, "frames"), commits.table(spark, a.store, "clips"), list(arrays.GROUPS), expected)
    sinks.save_table(clips, f"{a.out}/clips")
    sinks.save_table(frames, f"{a.out}/frames")
    return spark.read.parquet(f"{a.out}/clips").groupBy("reason").count()


@job("plan", "shard", "raw", "out", "files_per_batch=8", "approved=no", "most=5000")
def extract_shard(spark, a):
    """One shard of a plan: its clips' raw detections, processed resumably. Large shards need approval."""
    mine = spark.read.parquet(a.plan).filter(F.col("shard") == int(a.shard)).select(F.col("sample_id").alias("clip"))
    n = mine.count()
    if n > int(a.most) and a.approved != "yes":
        raise ValueError(f"{n} clips are more than {a.most}: pass --approved yes")
    schema = spark.read.parquet(a.raw).schema

    def step(batch, number):
        frames, clips = kernel.guarded(batch.join(mine, "clip", "left_semi"))
        run.write(frames, f"{a.out}/frames/batch={number:08d}", "frames")
        run.write(clips, f"{a.out}/clips/batch={number:08d}", "clips")

    run = monitor.RunFigures(spark)
    with monitor.ResourceMonitor() as m, run:
        resume.each_batch(spark, a.raw, schema, f"{a.out}/checkpoint", step, int(a.files_per_batch))
    facts = {"shard": int(a.shard), "planned": n, **m.summary(), **run.summary()}
    sinks.append_widening(spark.createDataFrame([Row(**{k: v for k, v in facts.items() if v is not None})]), f"{a.out}/runs")
    sinks.write_text(spark, f"{a.out}/run.json", json.dumps(facts))
    return spark.read.option("mergeSchema", "true").parquet(f"{a.out}/clips").groupBy("reason").count()


@job("plan", "shards", "splits", "out", "version=v1", "earlier=")
def merge_store(spark, a):
    """Union of the shards' stores, checked against the plan and the frozen split, then put into place; clips that an
    earlier store has too must have the same interval and lengths in both."""
    plan = spark.read.parquet(a.plan).select(F.col("sample_id").alias("clip"))
    clips = sinks.merge_stores(spark, a.shards.split(","), a.out, plan)["clips"]
    frozen = sinks.read_frozen(spark, a.splits, a.version).select(F.col("sample_id").alias("clip"), "split")
    stats = clips.join(frozen, "clip", "left").groupBy("split").agg(F.count(F.lit(1)).alias("clips"), F.count_if(F.col("reason").isNull()).alias("accepted"))
    sinks.write_report(spark, f"{a.out}/report", "Merged store", {"by_split": stats, "reasons": clips.groupBy("reason").count()})
    checks = _store_checks(spark, a.out, frozen)
    if a.earlier:
        old = commits.table(spark, a.earlier, "clips")
        both = quality.parity(old.join(clips.select("clip"), "clip", "left_semi"), clips.join(old.select("clip"), "clip", "left_semi"), ["clip"], ["n_raw", "n_frames", "start", "end"])
        sinks.save_table(both, f"{a.out}/parity")
        same = F.count_if(~F.col("equal") | (F.col("unequal") > 0))
        checks = quality.all_of([checks, quality.check(spark.read.parquet(f"{a.out}/parity"), "clips equal those of the earlier store", same, "columns differ")])
    return checks


def _store_checks(spark, store: str, frozen):
    """Checks of a packed store: records and frames agree, shapes, finite values, flags, intervals, split."""
    clips, f = commits.table(spark, store, "clips"), commits.table(spark, store, "frames")
    seen = f.select("clip").distinct()
    ok = clips.filter("reason is null")
    groups = [g for g in arrays.GROUPS if g in f.columns]
    bad_shape = reduce(lambda x, y: x | y, [F.size(g) != 3 * arrays.GROUPS[g] for g in groups])
    odd = reduce(lambda x, y: x | y, [~F.forall(g, lambda v: arrays.finite(v.cast("double"))) for g in groups])
    loose = reduce(lambda x, y: x | y, [arrays.has_flag(F.col(f"{g}_flags"), arrays.INTERPOLATED) & arrays.has_flag(F.col(f"{g}_flags"), OBSERVED) for g in groups])
    return quality.all_of([
        quality.check(quality.repeated(clips, "clip"), "one record per clip", F.sum("extra"), "repeated"),
        quality.check(ok.join(seen, "clip", "left_anti"), "accepted clips have frames", F.count(F.lit(1)), "without frames"),
        quality.check(seen.join(ok, "clip", "left_anti"), "frames belong to accepted clips", F.count(F.lit(1)), "without a record"),
        quality.check(f, "array shapes", F.count_if(bad_shape), "of another length"),
        quality.check(f, "values finite", F.count_if(odd), "not finite"),
        quality.check(f, "observed frames are not interpolated", F.count_if(loose), "both"),
        quality.check(ok, "intervals inside the clip", F.count_if((F.col("start") < 0) | (F.col("end") < F.col("start"))), "outside"),
        quality.check(clips.join(frozen, "clip", "left_anti"), "clips are in the frozen split", F.count(F.lit(1)), "unknown"),
    ])


@job("store", "splits", "out", "version=v1", "index=", "arrays_dir=")
def verify_store(spark, a):
    """Every check of a packed store, its missing hands inside and outside the interval and its size; of a sequence index,
    that it has the split's rows and no leaks; of array files, that they hold the store's frames and no others."""
    frozen = sinks.read_frozen(spark, a.splits, a.version).select(F.col("sample_id").alias("clip"), "split")
    f = commits.table(spark, a.store, "frames").withColumn("inside", F.col("frame").between(F.col("start"), F.col("end")))
    left, right = (arrays.has_flag(F.col(f"{g}_flags"), OBSERVED) for g in ("left_hand", "right_hand"))
    masks = f.groupBy("inside").agg(F.count(F.lit(1)).alias("frames"), F.count_if(~left & ~right).alias("both_missing"), F.count_if(left & right).alias("both_present"), F.max(F.col("scale")).alias("max_scale"))
    checks = _store_checks(spark, a.store, frozen)
    if a.index:
        idx = spark.read.parquet(a.index)
        cols = [c for c in ("word", "split", "sha256", "split_group") if c in idx.columns]
        full = sinks.read_frozen(spark, a.splits, a.version).select("sample_id", *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_known"))
        j = idx.join(full, "sample_id", "left")
        usable = commits.table(spark, a.store, "clips").filter("reason is null and start is not null").select(F.col("clip").alias("sample_id"))
        checks = quality.all_of([
            checks, quality.check(j, "index rows are in the frozen split", F.count_if(F.col("_known").isNull()), "unknown"),
            *[quality.check(j, f"index has the split's {c}", F.count_if(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_{c}"))), "differ") for c in cols],
            quality.check(idx.join(usable, "sample_id", "left_anti"), "index rows are accepted clips", F.count(F.lit(1)), "not accepted"),
            quality.index_leaks(idx),
        ])
    if a.arrays_dir:
        checks = quality.all_of([checks, arrayfiles.file_checks(spark, a.arrays_dir, commits.table(spark, a.store, "frames"))])
    size = spark.createDataFrame([(sinks.stored_bytes(spark, commits.folder(spark, a.store, "frames")), f.count())], "bytes long, frames long")
    sinks.write_report(spark, a.out, "Store", {"checks": checks, "masks": masks, "storage": size.withColumn("bytes_per_frame", F.col("bytes") / F.col("frames"))})
    return spark.read.parquet(f"{a.out}/checks")


@job("splits", "out", "version=v1")
def build_mapping(spark, a):
    """The label mapping of all words of a frozen split, bound to it by digest."""
    s = sinks.read_frozen(spark, a.splits, a.version)
    lock = sinks.read_lock(spark, a.splits, a.version)
    sinks.save_mapping(vocabulary.label_mapping(s), a.out, split_sha256=lock["sha256"])
    sinks.read_mapping(spark, a.out, lock["sha256"])
    return s.groupBy("split").agg(F.count_distinct("word").alias("classes"))


@job("index", "out", "windows=30,45,60")
def sequence_report(spark, a):
    """Bins, stretches and labels of a sequence index, by split."""
    i, windows = spark.read.parquet(a.index), [int(w) for w in a.windows.split(",")]
    kinds = [i.withColumn("kind", F.when(F.col("active_frames") < w, "up").when(F.col("active_frames") == w, "identity").otherwise("down")).groupBy("split", "kind").count().withColumn("window", F.lit(w)) for w in windows]
    labels = i.groupBy("word").agg(F.count(F.lit(1)).alias("clips"))
    tables = {"bins": i.groupBy("split", "active_bin").count(), "stretch": reduce(lambda x, y: x.unionByName(y), kinds), "frames": profile.describe(i, "active_frames", ["split"]), "clips_by_label": profile.describe(labels, "clips")}
    sinks.write_report(spark, a.out, "Sequences", tables)
    rows = spark.read.parquet(f"{a.out}/bins").groupBy("active_bin").agg(F.sum("count").alias("n")).orderBy("active_bin").collect()
    sinks.write_text(spark, f"{a.out}/bins.svg", figures.bars([(r[0], r[1]) for r in rows], "Active frames"))
    return spark.read.parquet(f"{a.out}/bins")


@job("store", "splits", "out", "vocabulary=", "windows=30,45,60", "version=v1")
def prepare_store(spark, a):
    """Mapping (of a vocabulary, where given), index and checked features of a packed store for every window."""
    lock = sinks.read_lock(spark, a.splits, a.version)
    frozen = sinks.read_frozen(spark, a.splits, a.version).select("sample_id", "repo_path", "word", "split", "sha256", "split_group", "aug_source")
    if a.vocabulary:
        words = [c["class"] for c in sinks.read_vocabulary(spark, a.vocabulary, lock["sha256"])["classes"]]
        frozen = frozen.filter(F.col("word").isin(words))
    mapping = vocabulary.label_mapping(frozen)
    sinks.save_mapping(mapping, f"{a.out}/label_mapping.json", split_sha256=lock["sha256"])
    clips = commits.table(spark, a.store, "clips").select(F.col("clip").alias("sample_id"), "start", "end", "reason").join(frozen.select("sample_id"), "sample_id", "left_semi")
    sinks.write_once(sequences.index(clips, frozen, mapping), f"{a.out}/index")
    idx = spark.read.parquet(f"{a.out}/index")
    have = set(commits.table(spark, a.store, "frames").columns)
    groups = [g for g in arrays.GROUPS if g in have]
    spans = idx.select(F.col("sample_id").alias("clip"), "start", "end")
    for w in map(int, a.windows.split(",")):
        x = readers.load_sequence(spark, commits.folder(spark, a.store, "frames"), groups, w, spans)
        rows = x.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("k", "features"))).alias("s")).select(F.col("clip").alias("sample_id"), F.flatten("s.features").alias("features"))
        sinks.write_once(rows.join(idx.select("sample_id", "split", "word", "label"), "sample_id"), f"{a.out}/features_w{w}")
    return quality.index_leaks(idx)


@job("out", "words=3")
def smoke_test(spark, a):
    """Synthetic clips through features, training, saving, loading and latency: the same model and metrics twice."""
    c = readers.synthetic_clips(spark, int(a.words))
    rows = c.groupBy("clip_id", "word", "split").agg(F.array_sort(F.collect_list(F.struct("frame", F.array("x", "y").alias("v")))).alias("s"))
    label = F.regexp_extract("word", "([0-9]+)$", 1).cast("int")
    rows = rows.select(F.col("clip_id").cast("string").alias("sample_id"), "split", "word", label.alias("label"), sequences.temporal_statistics(F.col("s.v"), 2).alias("features"))
    sinks.save_table(rows, f"{a.out}/features")
    rows = spark.read.parquet(f"{a.out}/features")
    found = [experiment.run(rows, {"rf": {"numTrees": 10, "maxDepth": 5}}, int(a.words), mapping=rows.select("word", "label").distinct()) for _ in range(2)]
    again = found[0][1].drop("train_seconds").exceptAll(found[1][1].drop("train_seconds")).count()
    sinks.save_model(found[0][0], f"{a.out}/model", {"experiment": "rf", "selected_on": "val"})
    model, _ = sinks.load_model(spark, f"{a.out}/model")
    x = rows.select("sample_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("x"))
    differ = experiment.predictions(found[0][0], x).exceptAll(experiment.predictions(model, x)).count()
    took = monitor.timed(spark, lambda: experiment.predictions(model, x).count(), 3, 1)
    sinks.save_table(evalmetrics.latency(took, "seconds", rows.count()), f"{a.out}/latency")
    return spark.createDataFrame([("same metrics again", again == 0, f"{again} rows differ"), ("reloaded model predicts the same", differ == 0, f"{differ} rows differ")], "check string, passed boolean, detail string")


@job("results", "out")
def experiment_report(spark, a):
    """All results, the best on validation, and the gap between train and test."""
    r = sinks.read_widened(spark, a.results)
    wide = r.groupBy("experiment").pivot("split", ["train", "val", "test"]).agg(F.first("accuracy").alias("accuracy"), F.first("macro_f1").alias("macro_f1"))
    wide = wide.withColumn("train_test_gap", F.col("train_accuracy") - F.col("test_accuracy")).orderBy(F.desc("val_macro_f1"), "experiment")
    sinks.write_report(spark, a.out, "Experiments", {"results": wide})
    rows = [(x.experiment, x.test_macro_f1) for x in wide.collect()]  # one row per experiment
    sinks.write_text(spark, f"{a.out}/macro_f1.svg", figures.bars(rows, "Test macro F1"))
    return wide.limit(1)


def main(argv: list[str] | None = None) -> int:
    """Run a job and print its small result; 1 if a check in it failed."""
    p = argparse.ArgumentParser(prog="quern")
    sub = p.add_subparsers(dest="job", required=True)
    for name, (f, options) in JOBS.items():
        q = sub.add_parser(name, help=f.__doc__)
        for o in options:
            key, eq, default = o.partition("=")
            q.add_argument("--" + key.replace("_", "-"), dest=key, default=default, required=not eq)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"quern {a.job}").getOrCreate()
    out = JOBS[a.job][0](spark, a)
    print(sinks.markdown(out))
    return int("passed" in out.columns and out.filter("not passed").limit(1).count() > 0)
