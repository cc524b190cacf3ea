"""Array files, listings, figures of runs, probes, and the options of jobs around them."""

import hashlib
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as ar
from quern.operators import monitor, quality
from quern.plans.jobs import main
from quern.sources import arrayfiles, commits, listing, readers, sinks

GROUPS = list(ar.GROUPS)
SCHEMA = "clip string, frame int, " + ", ".join(f"{g} array<float>, {g}_flags tinyint" for g in GROUPS) + ", pose_vis array<float>, center array<double>, scale double, shoulder_measured boolean, start int, end int"


def frame(clip, i, span=(1, 3)):
    r = np.random.default_rng(i)
    return (clip, i, *[x for g, n in ar.GROUPS.items() for x in (r.normal(size=3 * n).astype(np.float32).tolist(), i % 8)], [0.5] * 33, [0.1, 0.2, 0.3 + i], 2.0 + i, i % 2 == 0, *span)


@pytest.fixture(scope="module")
def frames(spark):
    rows = [frame(c, i, span) for c, n, span in (("a", 5, (1, 3)), ("b/ö", 3, (0, 2)), ("c", 1, (None, None))) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("compress", [False, True])
def test_a_written_store_reads_back(spark, frames, tmp_path, compress):
    if compress:  # more frames than a batch has
        frames = frames.union(spark.createDataFrame([frame("long", i, (7, 900)) for i in range(1100)], SCHEMA))
    for _ in range(2):  # a second run puts the same files into place
        files = {r.clip: r for r in arrayfiles.save_arrays(frames, f"file://{tmp_path}/x", compress).collect()}
    assert set(files) == {"a", "b/ö", "c"} | ({"long"} if compress else set()) and len(list((tmp_path / "x").iterdir())) == len(files)
    assert all((tmp_path / "x" / f.file).stat().st_size == f.bytes for f in files.values())
    back = arrayfiles.load_arrays(spark, f"{tmp_path}/x")
    assert back.exceptAll(frames).count() == frames.exceptAll(back).count() == 0
    checks = {r.check: r.passed for r in arrayfiles.file_checks(spark, f"{tmp_path}/x", frames).collect()}
    assert len(checks) == 4 and all(checks.values())
    other = frames.filter("clip <> 'c'").withColumn("scale", F.when(F.col("clip") == "a", 9.0).otherwise(F.col("scale")))
    checks = {r.check: r.passed for r in arrayfiles.file_checks(spark, f"{tmp_path}/x", other).collect()}
    assert checks == {"array files have every frame": True, "array files have no other frame": False, "array files have the same values": False, "array files belong to clips": False}


def test_only_wanted_members_are_read(spark, frames, tmp_path):
    one = arrayfiles.save_arrays(frames.filter("clip = 'a'"), str(tmp_path / "x")).first().file
    with zipfile.ZipFile(tmp_path / "x" / one) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(tmp_path / "x" / one, "w") as z:
        for n, body in parts.items():
            z.writestr(n, b"broken" if n == "face.npy" else body)
    (tmp_path / "x" / "half.npz.1.tmp").write_bytes(b"PK")  # left by a lost task
    got = arrayfiles.load_arrays(spark, str(tmp_path / "x"), ["left_hand"])
    assert got.columns == ["clip", "frame", "left_hand", "left_hand_flags", "center", "scale", "shoulder_measured", "start", "end"]
    assert got.exceptAll(frames.filter("clip = 'a'").select(got.columns)).count() == 0 and got.count() == 5
    with pytest.raises(Exception, match="face|magic|allow_pickle|member"):
        arrayfiles.load_arrays(spark, str(tmp_path / "x"), ["face"]).collect()
    with pytest.raises(Exception, match="unknown groups"):
        arrayfiles.load_arrays(spark, str(tmp_path / "x"), ["foot"])


def test_files_of_other_programs_and_faults(spark, frames, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    assert arrayfiles.load_arrays(spark, str(d)).count() == 0
    n = 4
    whole = {g: np.ones((n, k, 3), np.float16) for g, k in ar.GROUPS.items()} | {"flags": np.full((n, 4), 3, np.uint8), "pose_vis": np.ones((n, 33), np.float16), "center": np.zeros((n, 3), np.float32), "scale": np.ones(n, np.float32), "shoulder_measured": np.ones(n, bool), "active_interval": np.array([-1, -1], np.int32)}
    for k in range(6):
        np.savez(d / f"s{k}.npz", **whole)
    got = arrayfiles.load_arrays(spark, str(d), partition_bytes=1)
    assert got.rdd.getNumPartitions() == 6  # one group of files for each partition
    assert arrayfiles.load_arrays(spark, str(d)).rdd.getNumPartitions() == 1
    assert sorted({r.clip for r in got.select("clip").collect()}) == [f"s{k}" for k in range(6)] and got.filter("start is null and end is null").count() == 24
    np.savez(d / "bad.npz", **(whole | {"pose": np.ones((n, 2, 3))}))
    with pytest.raises(Exception, match="bad.npz: pose has the shape"):
        arrayfiles.load_arrays(spark, str(d)).collect()
    np.savez(d / "bad.npz", **{k: v for k, v in whole.items() if k != "scale"})
    with pytest.raises(Exception, match="bad.npz has no scale"):
        arrayfiles.load_arrays(spark, str(d), ["pose"]).collect()
    gap = frames.filter("clip = 'a' and frame <> 2")
    with pytest.raises(Exception, match="once each"):
        arrayfiles.save_arrays(gap, str(d)).collect()


def test_listing_sees_all_files(spark, tmp_path):
    rev = "a" * 40
    for p, body in (("v1/a.mp4", b"abc"), ("v1/deep/b.mp4", b""), ("v2/c.mp4", b"x" * 3_000_000), ("v2/_d.txt", b"x"), ("top.mp4", b"t")):
        (tmp_path / rev / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rev / p).write_bytes(body)
    (tmp_path / rev / "none").mkdir()
    got = listing.list_files(spark, str(tmp_path), revision=rev).collect()
    assert [r.repo_path for r in got] == ["top.mp4", "v1/a.mp4", "v1/deep/b.mp4", "v2/_d.txt", "v2/c.mp4"]
    by = {r.repo_path: r for r in got}
    assert (by["v1/deep/b.mp4"].size_bytes, by["v1/deep/b.mp4"].sha256, by["v1/deep/b.mp4"].folder) == (0, None, "v1/deep")
    assert by["v2/c.mp4"].sha256 == hashlib.sha256(b"x" * 3_000_000).hexdigest() and by["top.mp4"].folder == ""
    some = listing.list_files(spark, f"file://{tmp_path}/{rev}", "*.mp4", False, ["v1", "v1/deep", "none"]).collect()
    assert [(r.repo_path, r.sha256) for r in some] == [("v1/a.mp4", None), ("v1/deep/b.mp4", None)]
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tmp_path), revision="b" * 40)
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, f"{tmp_path}/{rev}", folders=["v1", "v9"])
    assert main(["list-files", "--path", str(tmp_path), "--revision", rev, "--out", f"{tmp_path}/index", "--folders", "v1,v2", "--pattern", "*.mp4"]) == 0
    assert spark.read.schema(readers.FILES).parquet(f"{tmp_path}/index").count() == 3


def test_figures_of_a_run(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/in")
    run = monitor.RunFigures(spark)
    with run:
        run.write(spark.range(1000).repartition(3), f"{tmp_path}/t", "rows")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(lambda b, n: run.write(b, f"{tmp_path}/s", "batch")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    s = run.summary()
    assert s["rows_rows"] == spark.read.parquet(f"{tmp_path}/t").count() and s["rows_batch"] == spark.read.parquet(f"{tmp_path}/s").count() == 100
    assert s["stream_batches"] == 1 and s["stream_rows"] == 100 and s["stream_rows_per_second"] > 0
    assert s["executors"] == 1 and s["tasks"] > 3 and s["failed_tasks"] == 0 and s["task_ms"] > 0 and s["shuffle_write_bytes"] > 0
    e = monitor.executors(spark).collect()
    assert len(e) == 1 and e[0].executor == "driver" and e[0].tasks >= s["tasks"]


def test_half_precision_is_that_of_numpy(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=3000) * 10.0 ** r.integers(-9, 6, 3000), [0.0, 1.0, 2.0**-14, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 65504.0, 65519.9, 65520.0, 1e9, 2047.5, 2048.5, 4096.0, 1023.9999], np.exp2(np.arange(-24, 16))])
    x = np.concatenate([x, -x])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").select("v", ar.half_precision(F.col("v")).alias("h"))
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float64)
    assert [r.h for r in df.collect()] == want.tolist()
    got = spark.sql("SELECT cast('NaN' AS double) AS v UNION ALL SELECT cast('-Infinity' AS double) UNION ALL SELECT null").select(ar.half_precision(F.col("v")).alias("h")).collect()
    assert str(got[0].h) == "nan" and got[1].h == float("-inf") and got[2].h is None


def test_rounding_is_measured_on_present_frames(spark, frames):
    lost = {r.group: r for r in quality.rounding(frames, GROUPS).collect()}
    pdf = frames.toPandas()
    for g in [*GROUPS, None]:
        x, px, su = [], [], []
        for k in GROUPS if g is None else [g]:
            on = pdf[(pdf[f"{k}_flags"] & ar.PRESENT) != 0]
            v = np.stack(on[k]).astype(np.float64)
            e = np.abs(v.astype(np.float16).astype(np.float64) - v)
            x.append(np.abs(v).ravel())
            su.append(e.ravel())
            px.append((e * on["scale"].to_numpy()[:, None]).ravel())
        x, px, su = (np.concatenate(p) for p in (x, px, su))
        r = lost[g]
        assert r.numbers == len(x) and r.max_abs == x.max() and r.not_finite == 0 and r.absent_not_zero > 0
        assert np.allclose([r.max_su, r.p99_su, r.p999_su], [su.max(), *np.quantile(su, [0.99, 0.999])], rtol=1e-9)
        assert np.allclose([r.max_px, r.p99_px, r.p999_px], [px.max(), *np.quantile(px, [0.99, 0.999])], rtol=1e-9)
    table = quality.rounding(frames, ["left_hand"])
    passed = {r.check: r.passed for r in quality.rounding_checks(table, 1e9, 1e-9).collect()}
    assert passed == {"error at 0.999": True, "largest error": False, "rounded values finite": True, "absent frames stay zero": False}


def test_probe_resumes_and_probes_again(spark, tmp_path, capsys):
    d, src = str(tmp_path), tmp_path / "src"
    src.mkdir()
    for k in range(6):
        (src / f"f{k}").write_bytes(b"x" * k)
    sha = lambda k: hashlib.sha256(b"x" * k).hexdigest()
    spark.createDataFrame([(f"f{k}", sha(k) if k < 5 else "0") for k in range(6)] + [("gone", "1")], "repo_path string, sha256 string").write.parquet(f"{d}/sample")
    spark.createDataFrame([("f0", True, True, 77), ("f1", True, False, 1), ("other", True, True, 1)], "repo_path string, download_ok boolean, sha256_match boolean, decoded_frames long").write.parquet(f"{d}/old")
    times = lambda ks: spark.createDataFrame([(f"f{k}", i / 10) for k in ks for i in range(11)], "repo_path string, t double")
    times(range(1, 4)).write.parquet(f"{d}/t1")
    args = ["probe-files", "--sample", f"{d}/sample", "--source", str(src), "--out", f"{d}/out", "--adopt", f"{d}/old", "--retries", "0", "--batches", "2"]
    assert main([*args, "--frames", f"{d}/t1"]) == 0
    got = {r.repo_path: r for r in spark.read.parquet(f"{d}/out/results").collect()}
    assert set(got) == {f"f{k}" for k in range(6)} | {"gone"} and got["f0"].probe_origin == "adopted" and got["f0"].decoded_frames == 77 and got["f1"].probe_origin == "probe"
    assert got["f3"].decode_ok and got["f3"].decoded_fps == pytest.approx(10) and got["f4"].decode_ok is False and got["f5"].sha256_match is False and not got["gone"].download_ok and got["gone"].decode_ok is None
    (src / "gone").write_bytes(b"g")
    (src / "f3").unlink()  # fetched already, so not needed
    times(range(1, 6)).write.parquet(f"{d}/t2")
    assert main([*args, "--frames", f"{d}/t2"]) == 0
    got = {r.repo_path: r for r in spark.read.parquet(f"{d}/out/results").collect()}
    assert got["gone"].download_ok and got["f3"].download_ok and got["f4"].decode_ok is False
    assert main([*args, "--frames", f"{d}/t2", "--reprobe", "yes"]) == 0
    got = {r.repo_path: r for r in spark.read.parquet(f"{d}/out/results").collect()}
    assert got["f4"].decode_ok and got["f4"].decoded_frames == 11 and got["f3"].decoded_frames == 11 and got["gone"].decode_ok is False
    assert "without_record" in capsys.readouterr().out


def test_options_of_the_jobs(spark, tmp_path, capsys):
    d = str(tmp_path)
    rows = [(f"s{i:03d}", f"v/s{i:03d}.mp4", f"s{i:03d}.mp4", f"w{i % 4}", f"h{i}", "word_n", ("train", "val", "test")[i // 4 % 3], f"s{i:03d}", "") for i in range(96)]
    split = spark.createDataFrame(rows, "sample_id string, repo_path string, filename string, word string, sha256 string, source_proxy string, split string, split_group string, aug_source string")
    lock = sinks.write_frozen(split, f"{d}/splits", "v1")
    split.drop("split", "split_group", "aug_source").withColumns({"eligible_pre_probe": F.lit(True), "size_bytes": F.lit(2_000_000)}).write.parquet(f"{d}/manifest")
    assert main(["verify-split", "--manifest", f"{d}/manifest", "--splits", f"{d}/splits", "--val", "0.3333", "--test", "0.3333", "--out", f"{d}/verified"]) == 0
    assert {r.check for r in spark.read.parquet(f"{d}/verified/checks").collect()} >= {"word is the manifest's", "split_group is the manifest's"} and spark.read.parquet(f"{d}/verified/spread").count() == 3
    spark.read.parquet(f"{d}/manifest").withColumn("sha256", F.when(F.col("sample_id") < "s002", "same").otherwise(F.col("sha256"))).write.parquet(f"{d}/changed")
    assert main(["verify-split", "--manifest", f"{d}/changed", "--splits", f"{d}/splits", "--val", "0.3333", "--test", "0.3333"]) == 1

    words = ["w0", "w2", "w3"]
    doc = {"name": "v", "num_classes": 3, "vocabulary_sha256": sinks.digest_of_words(words), "classes": [{"index": i, "class": w} for i, w in enumerate(words)]}
    sinks.write_vocabulary(spark, f"{d}/v.json", json.dumps(doc), lock["sha256"])
    plan = ["plan-shards", "--splits", f"{d}/splits", "--vocabulary", f"{d}/v.json", "--classes", "2", "--per-split", "train=3,val=1", "--manifest", f"{d}/manifest"]
    assert main([*plan, "--out", f"{d}/none", "--estimate-only", "yes"]) == 0
    assert "| 8 | 8000000.0 |" in capsys.readouterr().out and not (tmp_path / "none").exists()  # few are measured: the default size
    assert main([*plan, "--out", f"{d}/plan"]) == 0
    got = spark.read.parquet(f"{d}/plan")
    assert {(r[0], r[1]) for r in got.groupBy("split").count().collect()} == {("train", 6), ("val", 2)} and got.select("word").distinct().count() == 2
    spark.createDataFrame([(r.sample_id,) for r in got.limit(5).collect()], "clip string").write.parquet(f"{d}/done")
    assert main([*plan, "--out", f"{d}/rest", "--done", f"{d}/done"]) == 0 and spark.read.parquet(f"{d}/rest").count() == 3
    for bad, text in ((["--classes", "2"], "vocabulary"), (["--estimate-only", "yes"], "manifest")):
        with pytest.raises(ValueError, match=text):
            main(["plan-shards", "--splits", f"{d}/splits", "--out", f"{d}/bad", *bad])

    spark.createDataFrame([], "label string, anomaly string").write.parquet(f"{d}/audit")
    spark.createDataFrame([("w1",)], "word string").write.parquet(f"{d}/deferred")
    assert main(["select-vocabulary", "--splits", f"{d}/splits", "--audit", f"{d}/audit", "--out", f"{d}/voc", "--deferred", f"{d}/deferred"]) == 0
    reasons = {r.word: r.reasons for r in spark.read.parquet(f"{d}/voc/features").collect()}
    assert reasons["w1"].endswith("deferred_pending_inspection") and "deferred" not in reasons["w0"]
    assert spark.read.parquet(f"{d}/voc/report/reasons").filter("reason = 'deferred_pending_inspection' and n = 1").count() == 1

    mapping = spark.createDataFrame([("w0", 0), ("w1", 1)], "word string, label int")
    sinks.save_mapping(mapping, f"{d}/m.json")
    x = spark.range(60).select(F.col("id").cast("string").alias("sample_id"), F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.floor(F.col("id") / 2) % 3 + 1).cast("int")).alias("split"), F.concat(F.lit("w"), (F.col("id") % 2).cast("string")).alias("word"), (F.col("id") % 2).cast("int").alias("label"))
    x.withColumn("features", F.array(F.col("label") * 2.0, F.lit(1.0))).write.parquet(f"{d}/features")
    args = ["run-experiment", "--features", f"{d}/features", "--classes", "2", "--trees", "3", "--depth", "2", "--out", f"{d}/exp", "--tag", "mine"]
    with pytest.raises(ValueError, match="mapping"):
        main([*args, "--export", f"{d}/model"])
    assert main([*args, "--mapping", f"{d}/m.json", "--export", f"{d}/model"]) == 0
    assert spark.read.parquet(f"{d}/exp/results").first().experiment == "rf3-mine"
    meta = json.loads(sinks.read_text(spark, f"{d}/exp/rf3-mine/meta.json"))
    assert meta["resources"]["tasks"] > 0 and json.loads(sinks.read_text(spark, f"{d}/model/class_mapping.json"))["index_to_class"] == {"0": "w0", "1": "w1"}


def test_store_jobs_for_arrays(spark, frames, tmp_path):
    d = str(tmp_path)
    ids = [("a", 5, 1, 3), ("b/ö", 3, 0, 2)]
    clips = spark.createDataFrame([(c, n, n, s, e, None) for c, n, s, e in ids], "clip string, n_raw long, n_frames long, start int, end int, reason string")
    f = frames.filter("clip <> 'c'")
    for g in GROUPS:
        f = f.withColumn(f"{g}_flags", F.lit(3).cast("tinyint"))
    sinks.publish(spark, f"{d}/store", {"clips": clips, "frames": f})
    split = spark.createDataFrame([(c, f"v/{c}", f"w{k}", "train", f"h{k}", c, "") for k, (c, *_) in enumerate(ids)], "sample_id string, repo_path string, word string, split string, sha256 string, split_group string, aug_source string")
    sinks.write_frozen(split, f"{d}/splits", "v1")
    assert main(["export-arrays", "--store", f"{d}/store", "--out", f"{d}/x"]) == 0
    assert main(["import-arrays", "--arrays-dir", f"{d}/x/arrays", "--out", f"{d}/back", "--groups", "pose,left_hand"]) == 0
    back = spark.read.parquet(f"{d}/back/frames")
    assert back.exceptAll(f.select(back.columns)).count() == 0 and back.count() == f.count()
    split.withColumn("label", F.lit(0)).write.parquet(f"{d}/index")
    args = ["verify-store", "--store", f"{d}/store", "--splits", f"{d}/splits", "--arrays-dir", f"{d}/x/arrays"]
    assert main([*args, "--index", f"{d}/index", "--out", f"{d}/v1"]) == 0
    split.withColumn("word", F.lit("w0")).write.parquet(f"{d}/index2")
    assert main([*args, "--index", f"{d}/index2", "--out", f"{d}/v2"]) == 1
    bad = {r.check for r in spark.read.parquet(f"{d}/v2/checks").filter("not passed").collect()}
    assert bad == {"index has the split's word"}
    for k, c in enumerate((clips, clips.withColumn("end", F.col("end") - (F.col("clip") == "a").cast("int")))):
        c.write.parquet(f"{d}/s{k}/clips")
        f.write.parquet(f"{d}/s{k}/frames")
    split.select("sample_id").write.parquet(f"{d}/plan")
    merge = ["merge-store", "--plan", f"{d}/plan", "--splits", f"{d}/splits", "--earlier", f"{d}/store"]
    assert main([*merge, "--shards", f"{d}/s0", "--out", f"{d}/m0"]) == 0
    assert main([*merge, "--shards", f"{d}/s1", "--out", f"{d}/m1"]) == 1
    assert commits.table(spark, f"{d}/m1", "clips").count() == 2
    assert main(["reevaluate", "--store", f"{d}/store", "--out", f"{d}/again", "--px-max", "1e9", "--px-p999", "1e9"]) == 0
    report = spark.read.parquet(f"{d}/again/report/precision_checks")
    assert report.count() == 4 and report.filter("not passed").count() == 0
