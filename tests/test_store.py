"""Stores from raw detections to checked features, and the documents, models and tables around them."""

import hashlib
import hmac
import json
import math

import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as ar
from quern.functions import stats, tokens
from quern.operators import convert, experiment, kernel, monitor
from quern.plans.jobs import main
from quern.sources import commits, config, fetch, figures, readers, sinks

GROUPS = list(ar.GROUPS)
RAW = "clip string, t double, width int, height int, " + ", ".join(f"{g} array<float>, {g}_seen boolean" for g in GROUPS) + ", pose_vis array<float>, error string"


def raw_rows(clip, n, hands=lambda i: 10 <= i < 50, error=None, pose=None):
    out = []
    for i in range(n):
        p = [0.0] * 99
        for k, x in ((ar.LEFT_SHOULDER, 0.6), (ar.RIGHT_SHOULDER, 0.4)):
            p[3 * k : 3 * k + 3] = [x, 0.4, 0.0]
        h = [0.5, 0.4 + i / 1000, 0.0] * 21
        out.append((clip, i / 30, 640, 480, pose if pose is not None else p, True, [0.1] * 1404, True, h, hands(i), h, False, [0.9] * 33, error))
    return out


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A frozen split of clips, their raw detections in three files, and the folder of all."""
    d = str(tmp_path_factory.mktemp("store"))
    names = [f"c{i:02d}" for i in range(12)]
    rows = [(n, f"v/{n}.mp4", f"w{i % 2}", ("train", "train", "train", "val", "test", "test")[i % 6], f"h{i}", n, "", 1) for i, n in enumerate(names)]
    split = spark.createDataFrame(rows, "sample_id string, repo_path string, word string, split string, sha256 string, split_group string, aug_source string, dup_group_size int")
    lock = sinks.write_frozen(split, f"{d}/splits", "v1")
    assert lock["counts"] == {"train": 6, "val": 2, "test": 4} and lock["duplicate_groups"]["units"] == 12 and len(set(lock["per_split_sha256"].values())) == 3
    for k in range(3):
        part = [r for n in names[4 * k : 4 * k + 4] for r in raw_rows(n, 60)]
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(f"{d}/raw")
    spark.createDataFrame([(n, i % 2) for i, n in enumerate(names)], "sample_id string, shard int").write.parquet(f"{d}/plan")
    return d


def test_errors_become_rejections(spark):
    rows = raw_rows("ok", 60) + raw_rows("broken", 40, error="RuntimeError: no stream") + raw_rows("short_pose", 40, pose=[0.0] * 10) + raw_rows("nan", 40, pose=[math.nan] * 99)
    frames, clips = kernel.guarded(spark.createDataFrame(rows, RAW))
    got = {r.clip: (r.reason, r.error) for r in clips.collect()}
    assert got["ok"] == (None, "") and got["broken"] == ("decode_or_mediapipe_error", "RuntimeError: no stream")
    assert got["short_pose"] == ("preprocessing_error", "pose has another length") and got["nan"] == ("preprocessing_error", "pose is not finite")
    assert {r.clip for r in frames.select("clip").distinct().collect()} == {"ok"}


def test_store_jobs(spark, store, tmp_path, capsys):
    d, out = store, str(tmp_path)
    for k in (0, 1):
        args = ["extract-shard", "--plan", f"{d}/plan", "--shard", str(k), "--raw", f"{d}/raw", "--out", f"{out}/shard{k}", "--files-per-batch", "2"]
        assert main(args) == 0 and main(args) == 0  # the second run finds nothing to do
    with pytest.raises(ValueError, match="approved"):
        main(["extract-shard", "--plan", f"{d}/plan", "--shard", "0", "--raw", f"{d}/raw", "--out", f"{out}/x", "--most", "2"])
    assert "peak_rss_mb" in json.loads(sinks.read_text(spark, f"{out}/shard0/run.json"))
    runs = sinks.read_widened(spark, f"{out}/shard0/runs")
    assert runs.count() == 2 and runs.agg(F.sum("rows_clips")).first()[0] == spark.read.parquet(f"{out}/shard0/clips").count()
    merged = ["merge-store", "--plan", f"{d}/plan", "--shards", f"{out}/shard0,{out}/shard1", "--splits", f"{d}/splits", "--out", f"{out}/store"]
    assert main(merged) == 0
    assert commits.table(spark, f"{out}/store", "clips").count() == 12
    with pytest.raises(ValueError, match="add up"):
        main([*merged[:4], f"{out}/shard0", *merged[5:-1], f"{out}/half"])
    assert main(["verify-store", "--store", f"{out}/store", "--splits", f"{d}/splits", "--out", f"{out}/verified"]) == 0
    assert main(["build-mapping", "--splits", f"{d}/splits", "--out", f"{out}/mapping.json"]) == 0
    assert main(["prepare-store", "--store", f"{out}/store", "--splits", f"{d}/splits", "--out", f"{out}/prepared", "--windows", "30"]) == 0
    assert main(["build-index", "--clips", commits.folder(spark, f"{out}/store", "clips"), "--splits", f"{d}/splits", "--out", f"{out}/index"]) == 0
    assert spark.read.parquet(f"{out}/index/index").count() == 12
    words = json.dumps({"name": "one", "num_classes": 1, "vocabulary_sha256": hashlib.sha256(b"w0").hexdigest(), "classes": [{"index": 0, "class": "w0"}]})
    sinks.write_vocabulary(spark, f"{out}/one.json", words, sinks.read_lock(spark, f"{d}/splits", "v1")["sha256"])
    assert main(["prepare-store", "--store", f"{out}/store", "--splits", f"{d}/splits", "--out", f"{out}/one", "--windows", "5", "--vocabulary", f"{out}/one.json"]) == 0
    assert spark.read.parquet(f"{out}/one/features_w5").agg(F.count(F.lit(1)), F.max("label")).first()[:] == (6, 0)
    x = spark.read.parquet(f"{out}/prepared/features_w30")
    assert x.count() == 12 and x.select(F.min(F.size("features")), F.max(F.size("features"))).first()[:] == (30 * ar.feature_dim(GROUPS),) * 2
    assert main(["sequence-report", "--index", f"{out}/prepared/index", "--out", f"{out}/sequences"]) == 0
    assert "<svg" in sinks.read_text(spark, f"{out}/sequences/bins.svg")
    spark.createDataFrame([("w0", "uppercase")], "label string, anomaly string").write.parquet(f"{out}/audit")
    assert main(["interval-audit", "--index", f"{out}/prepared/index", "--audit", f"{out}/audit", "--out", f"{out}/short"]) == 0
    assert main(["reevaluate", "--store", f"{out}/store", "--out", f"{out}/again"]) == 0
    same = spark.read.parquet(f"{out}/again/reevaluated")
    assert same.filter(~F.col("reason").eqNullSafe(F.col("stored_reason"))).count() == 0
    spark.createDataFrame([(f"c{i:02d}", 5.0 + i) for i in range(12)], "clip string, total_s double").write.parquet(f"{out}/timings")
    assert main(["benchmark-report", "--store", f"{out}/store", "--timings", f"{out}/timings", "--out", f"{out}/bench"]) == 0
    assert "clips_per_minute" in capsys.readouterr().out
    one = readers.load_sequence(spark, commits.folder(spark, f"{out}/store", "frames"), ["left_hand"], 5)
    assert one.count() == 60 and one.select(F.size("features")).first()[0] == 64


def test_preprocess_job_is_resumable(spark, store, tmp_path):
    args = ["preprocess", "--raw", f"{store}/raw", "--out", str(tmp_path), "--files-per-batch", "1"]
    assert main(args) == 0
    before = sorted(p.name for p in (tmp_path / "frames").iterdir() if p.name.startswith("batch"))
    assert len(before) == 3 and main(args) == 0
    assert sorted(p.name for p in (tmp_path / "frames").iterdir() if p.name.startswith("batch")) == before
    assert spark.read.parquet(f"{tmp_path}/clips").filter("reason is null").count() == 12


def test_sample_and_profile_jobs(spark, tmp_path):
    d = str(tmp_path)
    rows = [(f"s{i}", f"v/s{i}.mp4", f"w{i % 5}", f"h{i // 2}", "word_n", True, "", "") for i in range(80)]
    spark.createDataFrame(rows, "sample_id string, repo_path string, word string, sha256 string, source_proxy string, eligible_pre_probe boolean, issue string, aug_source string").write.parquet(f"{d}/manifest")
    probe = spark.createDataFrame([(f"v/s{i}.mp4", True, True, True, i % 9 > 0, 20 + i, 640, 480, 25.0, 24.5) for i in range(80)], "repo_path string, download_ok boolean, sha256_match boolean, open_ok boolean, decode_ok boolean, decoded_frames long, width long, height long, avg_fps double, decoded_fps double")
    probe.write.parquet(f"{d}/probe")
    assert main(["select-sample", "--manifest", f"{d}/manifest", "--out", f"{d}/eda", "--target", "20"]) == 0
    assert spark.read.parquet(f"{d}/eda/sample").count() >= 10
    assert main(["eda-report", "--sample", f"{d}/eda/sample", "--manifest", f"{d}/manifest", "--probe", f"{d}/probe", "--out", f"{d}/report"]) == 0
    assert "## weighted_shares" in sinks.read_text(spark, f"{d}/report/report.md")
    split = spark.read.parquet(f"{d}/manifest").select("sample_id", "repo_path", "word", "sha256", "aug_source", F.lit("train").alias("split"))
    sinks.write_frozen(split, f"{d}/splits", "v1")
    args = ["select-benchmark", "--splits", f"{d}/splits", "--probe", f"{d}/probe", "--out", f"{d}/bench", "--n", "30", "--short", "3"]
    assert main(args) == 0 and main(args) == 0
    got = spark.read.parquet(f"{d}/bench")
    assert got.count() == 30 and got.filter("reason = 'short'").count() == 3


def test_smoke_and_experiment_report(spark, tmp_path):
    assert main(["smoke-test", "--out", f"{tmp_path}/smoke"]) == 0
    rows = [("a", "train", 0.9, 0.9), ("a", "val", 0.7, 0.6), ("a", "test", 0.6, 0.6), ("b", "train", 0.8, 0.8), ("b", "val", 0.8, 0.8), ("b", "test", 0.7, 0.7)]
    sinks.append_widening(spark.createDataFrame(rows, "experiment string, split string, accuracy double, macro_f1 double"), f"{tmp_path}/results")
    assert main(["experiment-report", "--results", f"{tmp_path}/results", "--out", f"{tmp_path}/rep"]) == 0
    assert [r.experiment for r in spark.read.parquet(f"{tmp_path}/rep/results").collect()] == ["b", "a"]


def test_conversion_keeps_values_and_checks_the_judgement(spark, tmp_path):
    n = sum(ar.GROUPS.values())
    rows = []
    for clip, hands in (("ok", True), ("idle", False)):
        for i in range(40):
            flags = [True, True, hands, False]
            rows.append((clip, i, [float(k % 7) for k in range(3 * n)], flags, flags, [False] * 4, [0.5] * 33, [1.0, 2.0, 0.0], 2.0, True))
    f = spark.createDataFrame(rows, "clip string, frame long, coords array<double>, present array<boolean>, observed array<boolean>, interpolated array<boolean>, pose_vis array<double>, center array<double>, scale double, shoulder_measured boolean")
    clips = spark.createDataFrame([("ok", 40, None), ("idle", 40, None), ("few", 9, "too_few_decoded_frames")], "clip string, n_raw int, reason string")
    expected = spark.createDataFrame([("ok", ""), ("idle", "no_active_signing_interval")], "clip string, reason string")
    frames, out = convert.convert(f, clips, GROUPS, expected)
    got = {r.clip: (r.reason, r.start, r.end, r.active_frames) for r in out.collect()}
    assert got == {"ok": (None, 0, 39, 40), "idle": ("no_active_signing_interval", None, None, 0), "few": ("too_few_decoded_frames", None, None, 0)}
    row = frames.orderBy("frame").first()
    assert row.face[:3] == [float((99 + k) % 7) for k in range(3)] and row.left_hand_flags == 3 and row.right_hand_flags == 0
    assert convert.intervals(frames).first()[:] == ("ok", 0, 39, 40)
    with pytest.raises(Exception, match="judged otherwise"):
        convert.convert(f, clips, GROUPS, spark.createDataFrame([("ok", "x")], "clip string, reason string"))[1].collect()
    f.write.parquet(f"{tmp_path}/v1/frames")
    clips.write.parquet(f"{tmp_path}/v1/clips")
    assert main(["convert-store", "--store", f"{tmp_path}/v1", "--out", f"{tmp_path}/v2"]) == 0


def test_documents_are_checked(spark, tmp_path):
    d = str(tmp_path)
    m = spark.createDataFrame([("a", 0), ("b", 1)], "word string, label int")
    assert sinks.save_mapping(m, f"{d}/m.json", split_sha256="s1") and not sinks.save_mapping(m, f"{d}/m.json", split_sha256="s1")
    with pytest.raises(FileExistsError):
        sinks.save_mapping(m, f"{d}/m.json", split_sha256="s2")
    assert [tuple(r) for r in sinks.load_mapping(spark, f"{d}/m.json", split_sha256="s1").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError, match="another split"):
        sinks.read_mapping(spark, f"{d}/m.json", "s2")
    with pytest.raises(ValueError, match="word_to_index"):
        sinks.save_mapping(spark.createDataFrame([("a", 0), ("b", 2)], "word string, label int"), f"{d}/n.json")
    classes = [{"index": 0, "class": "a"}, {"index": 1, "class": "b"}]
    doc = {"name": "v", "num_classes": 2, "vocabulary_sha256": hashlib.sha256(b"a\nb").hexdigest(), "classes": classes}
    sinks.write_vocabulary(spark, f"{d}/v.json", json.dumps(doc), "s1")
    assert sinks.read_vocabulary(spark, f"{d}/v.json", "s1")["num_classes"] == 2
    with pytest.raises(ValueError, match="another split"):
        sinks.read_vocabulary(spark, f"{d}/v.json", "s2")
    for k, change in enumerate(({"num_classes": 3}, {"vocabulary_sha256": "0"}, {"classes": classes[::-1]})):
        sinks.write_text(spark, f"{d}/bad{k}.json", json.dumps(doc | change))
        with pytest.raises(ValueError, match="class list"):
            sinks.read_vocabulary(spark, f"{d}/bad{k}.json")
    rows = spark.createDataFrame([("a", "train", 0, [1.0]), ("b", "val", 1, [1.0]), ("a", "test", 1, [1.0])], "word string, split string, label int, features array<double>")
    got = {r.check: r.passed for r in experiment.preflight(rows, 2, 1, m).collect()}
    assert not got["labels agree with the mapping"] and got["labels in range"]


def test_models_come_back_and_only_selected_ones_are_exported(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(float(i % 2), Vectors.dense([i % 2, i])) for i in range(20)], ["label", "features"])
    model = RandomForestClassifier(numTrees=3, seed=1).fit(df)
    mapping = {"vocabulary_sha256": "x", "word_to_index": {"a": 0, "b": 1}}
    sinks.save_model(model, f"{tmp_path}/m", {"selected_on": "val", "label_mapping_sha256": "x"})
    back, meta = sinks.load_model(spark, f"{tmp_path}/m")
    assert meta["selected_on"] == "val" and back.transform(df).select("prediction").collect() == model.transform(df).select("prediction").collect()
    sinks.export_model(spark, f"{tmp_path}/m", f"{tmp_path}/e", mapping)
    again, _ = sinks.load_model(spark, f"{tmp_path}/e")
    assert again.transform(df).select("prediction").collect() == model.transform(df).select("prediction").collect()
    with pytest.raises(ValueError, match="mapping"):
        sinks.export_model(spark, f"{tmp_path}/m", f"{tmp_path}/f", mapping | {"vocabulary_sha256": "y"})
    sinks.save_model(model, f"{tmp_path}/n", {"selected_on": "train"})
    with pytest.raises(ValueError, match="validation"):
        sinks.export_model(spark, f"{tmp_path}/n", f"{tmp_path}/f", mapping)


def test_tables_grow_change_and_are_measured(spark, tmp_path):
    d = f"{tmp_path}/presence"
    rows = lambda *x: spark.createDataFrame(list(x), "room int, client string, at int")
    sinks.upsert(rows((1, "a", 1), (1, "b", 1)), d, ["room", "client"])
    sinks.upsert(rows((1, "a", 2), (2, "c", 2)), d, ["room", "client"])
    got = sinks.upsert(rows((3, "z", 3)), d, ["room", "client"], rows((1, "b", 0)))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2), (2, "c", 2), (3, "z", 3)]
    for k in range(2):
        sinks.append_messages(rows((k, "m", k)), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    big = spark.range(20_000).select(F.lit("same text").alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("y"))
    assert sinks.serialized_size(big, "zstd") < sinks.serialized_size(big, "none")
    assert sinks.save_table(big, f"{tmp_path}/t") == sinks.stored_bytes(spark, f"{tmp_path}/t") > 0
    with pytest.raises(ValueError, match="more than 5 rows"):
        sinks.markdown(big, 5)


def test_costs_are_sampled_and_timed(spark):
    with monitor.ResourceMonitor(0.01) as m:
        took = monitor.timed(spark, lambda: sum(range(1000)), 3, 1)
    s = m.summary()
    assert s["peak_rss_mb"] >= s["mean_rss_mb"] > 1 and took.count() == 3 and monitor.ResourceMonitor().summary() == {}


def test_tail_probabilities():
    assert stats.gamma_tail(0.5, 3.841458820694124 / 2) == pytest.approx(0.05) and stats.gamma_tail(4, 15.50731305586545 / 2) == pytest.approx(0.05)
    assert stats.gamma_tail(3, 2.5) == pytest.approx(math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2)) and stats.gamma_tail(1, 0) == 1
    assert stats.student_p(2.2281388519649385, 10) == pytest.approx(0.05) and stats.student_p(-1.0, 1) == pytest.approx(0.5) and stats.student_p(0.0, 7) == pytest.approx(1)


def test_tokens_are_those_of_the_standard_library(spark):
    import base64

    for secret in (b"short", b"k" * 100):
        rows = [(json.dumps({"id": i, "exp": 100 + i, "n": "é" * i}),) for i in range(8)]
        df = spark.createDataFrame(rows, "p string").withColumn("t", tokens.create_token(F.col("p"), secret))
        for r in df.collect():
            body = base64.urlsafe_b64encode(r.p.encode()).rstrip(b"=")
            assert r.t == (body + b"." + base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest()).rstrip(b"=")).decode()
        got = df.select("p", tokens.verify_token(F.col("t"), secret, F.lit(103)).alias("v"), tokens.verify_token(F.col("t"), b"other", F.lit(0)).alias("w"), tokens.verify_token(F.concat("t", F.lit("x")), secret, F.lit(0)).alias("x")).collect()
        assert [r.v for r in got] == [r.p if json.loads(r.p)["exp"] > 103 else None for r in got] and not any(r.w or r.x for r in got)
    assert spark.range(1).select(tokens.verify_token(F.lit("no token"), b"s", F.lit(0)), tokens.verify_token(F.lit("!.!"), b"s", F.lit(0))).first()[:] == (None, None)


def test_credentials_go_to_one_host(spark, tmp_path):
    c = fetch.HostCredential("Hub.example", "secret")
    assert c.headers("https://hub.example/a") == {"Authorization": "Bearer secret"} and "secret" not in repr(c)
    for url in ("http://hub.example/a", "https://cdn.example/a", "https://hub.example.evil/a", "https://hub.example:8443/a", "https://x@hub.example/a"):
        assert c.headers(url) == {}
    assert c.headers("https://hub.example/a", redirected=True) == {} and fetch.HostCredential("hub.example", None).headers("https://hub.example/") == {}
    want = hashlib.sha256(b"word,videos\n").hexdigest()
    fetch.download(spark, lambda p: b"word,videos\n", "m.csv", f"{tmp_path}/m.csv", want)
    assert (tmp_path / "m.csv").read_bytes() == b"word,videos\n"
    with pytest.raises(OSError, match="hash"):
        fetch.download(spark, lambda p: b"other", "m.csv", f"{tmp_path}/n.csv", want)


def test_settings_in_yaml_and_sizes(tmp_path):
    yaml = pytest.importorskip("yaml")
    p = tmp_path / "c.yaml"
    p.write_text(yaml.safe_dump({"dataset": {"revision": "a" * 40}, "split": {"ratios": {"train": 0.8, "val": 0.1, "test": 0.1}}, "sampling": {}, "preprocessing": {}, "paths": {"out": "x"}}))
    assert config.load_config(p).path("out") == tmp_path / "x"
    assert config.coord_dtype({"coord_dtype": "float16"}, "pose") == "float16" and config.coord_dtype({"coord_dtype": {"pose": "float32"}}, "pose") == "float32"
    assert config.parse_per_split(None) is None
    with pytest.raises(ValueError, match="unknown splits"):
        config.parse_per_split("dev=3")
    assert ar.bytes_per_frame(["pose", "left_hand", "right_hand"], "float32") == 3 * 75 * 4 + 33 * 4 + 21


def test_figures_are_svg():
    import xml.etree.ElementTree as ET

    for svg in (figures.bars([("a<b", 2), ("c", 0)], "T & x"), figures.bars([], "none"), figures.curves({"train": [(0, 1), (1, 0.5)], "val": [(0, 2)]}, "loss"), figures.heat([(0, 1, 3.0)], 2, "confusion")):
        assert ET.fromstring(svg).tag.endswith("svg")
