import json

import pytest
from pyspark.sql import functions as F

from quern.operators import experiment
from quern.plans.jobs import main
from quern.sources import config, fetch


def test_config_is_checked(tmp_path):
    doc = {"dataset": {"revision": "a" * 40}, "split": {"ratios": {"train": 0.7, "val": 0.15, "test": 0.15}}, "sampling": {}, "preprocessing": {}, "paths": {"out": "data/x"}}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(doc))
    assert config.load_config(p).path("out") == tmp_path / "data/x"
    for change in ({"dataset": {"revision": "main"}}, {"split": {"ratios": {"train": 0.5}}}):
        p.write_text(json.dumps(doc | change))
        with pytest.raises(ValueError):
            config.load_config(p)
    prof = {"configurations": {"hands": ["l", "r"], "face": ["f"]}, "storage_profiles": {"hp": {"groups_to_store": ["l", "r"], "coord_dtype": {"l": "f4"}}}}
    assert config.with_profile(prof, "hp")["configurations"] == {"hands": ["l", "r"]} and "output" not in prof
    assert config.parse_per_split("train=20, val=5") == {"train": 20, "val": 5}


def test_fetch_retries_and_hashes(spark):
    calls, waits = [], []

    def get(path):
        calls.append(path)
        if path == "busy" and len(calls) < 3:
            raise fetch.TooManyRequests(900)
        if path == "gone":
            raise OSError("no")
        return b"abc"

    r = fetch.fetch_once(get, "busy", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 4, waits.append)
    assert r["download_ok"] and r["sha256_match"] and r["attempts"] == 3 and waits == [300, 300]
    waits.clear()
    assert not fetch.fetch_once(get, "gone", None, 6, waits.append)["download_ok"] and waits == [1, 2, 4, 8, 16, 30]
    df = spark.createDataFrame([("a", None), ("b", "00")], "repo_path string, sha256 string")
    got = {r.repo_path: r.sha256_match for r in fetch.fetch_all(df, lambda p: b"abc").collect()}
    assert got == {"a": None, "b": False}


def test_jobs_from_csv_to_vocabulary(spark, tmp_path, capsys):
    d = str(tmp_path)
    rows = [(f"w{c}", f"{'w%d_%d' % (c, i) if i % 2 else '%d-w%d%d' % (i, c, i)}.mp4") for c in range(4) for i in range(50)]
    (tmp_path / "m.csv").write_text("word,videos\n" + "".join(f"{w},{f}\n" for w, f in rows))
    spark.createDataFrame([(f"v/{f}", "v", f, 1, f"h{k // 2 if k < 6 else k}") for k, (_, f) in enumerate(rows)], "repo_path string, folder string, filename string, size_bytes long, sha256 string").write.parquet(f"{d}/files")
    assert main(["build-manifest", "--csv", f"{d}/m.csv", "--files", f"{d}/files", "--out", f"{d}/meta"]) == 0
    assert main(["make-split", "--manifest", f"{d}/meta/manifest", "--out", f"{d}/splits"]) == 0
    assert main(["verify-split", "--manifest", f"{d}/meta/manifest", "--splits", f"{d}/splits", "--tolerance", "0.03"]) == 0
    assert main(["verify-split", "--manifest", f"{d}/meta/manifest", "--splits", f"{d}/splits", "--val", "0.4"]) == 1
    assert main(["plan-shards", "--splits", f"{d}/splits", "--out", f"{d}/shards", "--limit", "10"]) == 0
    assert main(["select-vocabulary", "--splits", f"{d}/splits", "--audit", f"{d}/meta/label_audit", "--out", f"{d}/voc", "--size", "2"]) == 0
    assert "| split | n |" in capsys.readouterr().out
    with pytest.raises(FileExistsError):
        main(["make-split", "--manifest", f"{d}/meta/manifest", "--out", f"{d}/splits"])


def test_experiment_selects_on_validation(spark):
    f = spark.range(240).select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"), F.when(F.col("id") % 5 < 3, "train").when(F.col("id") % 5 == 3, "val").otherwise("test").alias("split"), (F.col("id") % 3).cast("int").alias("label"))
    f = f.withColumn("features", F.array((F.col("label") + F.rand(1) * 0.2).cast("double"), F.rand(2), F.rand(3)))
    _, out = experiment.run(f, {"tiny": {"numTrees": 1, "maxDepth": 0}, "good": {"numTrees": 5, "maxDepth": 4}}, 3)
    got = {r.split: r for r in out.collect()}
    assert got["test"].experiment == "good" and got["test"].accuracy > 0.95
    with pytest.raises(ValueError, match="val is not empty"):
        experiment.run(f.filter("split <> 'val'"), {"a": {"numTrees": 1}}, 3)
    with pytest.raises(ValueError, match="labels in range"):
        experiment.run(f, {"a": {"numTrees": 1}}, 2)
    assert experiment.matrix(["lstm"], ["hands"], [5, 30]) == ["hands_w05_lstm", "hands_w30_lstm"]
