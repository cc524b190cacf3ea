import pytest
from pyspark.sql import functions as F

from quern.operators import vocabulary
from quern.sources import listing, readers, sinks
from quern.streaming import resume, signals


def test_metadata_csv_keeps_words_and_order(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("word,videos\nnull,a.mp4\n,b.mp4\nnan,c.mp4\n\"x, y\",d.mp4\n")
    got = readers.read_metadata(spark, str(p)).orderBy("csv_row").collect()
    assert [tuple(r) for r in got] == [(0, "null", "a.mp4"), (1, "", "b.mp4"), (2, "nan", "c.mp4"), (3, "x, y", "d.mp4")]
    p.write_text("label,videos\na,b\n")
    with pytest.raises(ValueError):
        readers.read_metadata(spark, str(p))


def test_list_files(spark, tmp_path):
    (tmp_path / "v1" / "deep").mkdir(parents=True)
    (tmp_path / "v1" / "a.mp4").write_bytes(b"abc")
    (tmp_path / "v1" / "deep" / "b.mp4").write_bytes(b"b")
    (tmp_path / "v1" / "c.txt").write_bytes(b"x")
    got = {r.repo_path: r for r in listing.list_files(spark, str(tmp_path), "*.mp4").collect()}
    assert set(got) == {"v1/a.mp4", "v1/deep/b.mp4"} and got["v1/a.mp4"].size_bytes == 3 and got["v1/deep/b.mp4"].folder == "v1/deep"
    assert got["v1/a.mp4"].sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_parts_latest_wins(spark, tmp_path):
    out = str(tmp_path / "parts")
    schema = "repo_path string, download_ok boolean, decoded_frames long"
    assert readers.read_parts(spark, out, readers.PROBE, "repo_path", "download_ok").count() == 0
    for rows in ([("a", False, None), ("b", True, 5)], [("a", True, 7), ("b", False, None)], [("b", True, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(out)
    got = {r.repo_path: r for r in readers.read_parts(spark, out, readers.PROBE, "repo_path", "download_ok").collect()}
    assert got["a"].download_ok and got["a"].decoded_frames == 7 and got["b"].download_ok
    assert readers.done_keys(spark, out, readers.PROBE, "repo_path").count() == 2


def test_frozen_split_refuses_and_detects(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", f"w{i % 3}", ["train", "val"][i % 2]) for i in range(12)], "sample_id string, word string, split string")
    d = str(tmp_path)
    lock = sinks.write_frozen(df, d, "v1", {"seed": 42})
    assert lock["n_samples"] == 12 and lock["counts"] == {"train": 6, "val": 6}
    assert sinks.read_frozen(spark, d, "v1").select(*df.columns).exceptAll(df).count() == 0
    with pytest.raises(FileExistsError):
        sinks.write_frozen(df, d, "v1")
    df.limit(1).write.mode("append").partitionBy("split").parquet(f"{d}/split_v1")
    with pytest.raises(RuntimeError):
        sinks.read_frozen(spark, d, "v1")


def test_write_once_mapping_and_widening(spark, tmp_path):
    d = str(tmp_path)
    df = spark.range(5).withColumn("x", F.col("id") + 1)
    assert sinks.write_once(df, f"{d}/t") and not sinks.write_once(df.select("x", "id").repartition(3).select("id", "x"), f"{d}/t")
    with pytest.raises(FileExistsError):
        sinks.write_once(df.filter("id > 0"), f"{d}/t")
    m = vocabulary.label_mapping(spark.createDataFrame([("b",), ("a",), ("B",), ("é",)], "word string"))
    assert sinks.save_mapping(m, f"{d}/m.json") and not sinks.save_mapping(m, f"{d}/m.json")
    assert {r.word: r.label for r in sinks.load_mapping(spark, f"{d}/m.json").collect()} == {"B": 0, "a": 1, "b": 2, "é": 3}
    with pytest.raises(FileExistsError):
        sinks.save_mapping(m.filter("label < 2"), f"{d}/m.json")
    sinks.append_widening(spark.createDataFrame([(1,)], "a int"), f"{d}/w")
    sinks.append_widening(spark.createDataFrame([(2, "z")], "a int, b string"), f"{d}/w")
    assert {(r.a, r.b) for r in sinks.read_widened(spark, f"{d}/w").collect()} == {(1, None), (2, "z")}


def test_merge_shards(spark, tmp_path):
    d, want = str(tmp_path), spark.range(10).withColumnRenamed("id", "k")
    for i in range(2):
        spark.range(i, 10, 2).select(F.col("id").alias("k"), F.lit(i).alias("s")).write.parquet(f"{d}/s{i}")
    assert sinks.merge_shards(spark, [f"{d}/s0", f"{d}/s1"], f"{d}/all", "k", want).count() == 10
    with pytest.raises(ValueError):
        sinks.merge_shards(spark, [f"{d}/s0", f"{d}/s0"], f"{d}/bad", "k", want)


def test_evaluation_model_and_markdown(spark, tmp_path):
    p = spark.createDataFrame([(0, 0), (1, 0)], "y_true int, y_pred int")
    sinks.write_evaluation(p, str(tmp_path / "e"), 2)
    assert spark.read.parquet(str(tmp_path / "e" / "metrics")).first().accuracy == 0.5
    assert sinks.markdown(p.orderBy("y_true")).splitlines()[2:] == ["| 0 | 0 |", "| 1 | 0 |"]
    assert sinks.environment(spark).first().version == spark.version


def test_synthetic_clips(spark):
    c = readers.synthetic_clips(spark, 3, 4)
    assert c.select("clip_id").distinct().count() == 24 and {r[0] for r in c.select("split").distinct().collect()} == {"train", "val", "test"}
    assert c.filter("frame = 0 and observed").count() == 0


def test_resume_handles_each_file_once(spark, tmp_path):
    d = str(tmp_path)
    schema = "k long, ok boolean, v string"
    seen = []

    def step(df):
        seen.extend(r.k for r in df.collect())
        return df

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/in/{name}")

    put("a", [(1, False, "fail"), (2, True, "one")])
    s = spark.read.parquet(f"{d}/in/a").schema
    assert resume.ingest(spark, f"{d}/in/*", s, f"{d}/out", f"{d}/ck", step) == 1
    assert resume.ingest(spark, f"{d}/in/*", s, f"{d}/out", f"{d}/ck", step) == 0
    put("b", [(1, True, "again"), (2, False, "late failure"), (3, True, "new")])
    resume.ingest(spark, f"{d}/in/*", s, f"{d}/out", f"{d}/ck", step)
    assert sorted(seen) == [1, 1, 2, 2, 3]
    got = {r.k: r.v for r in resume.results(spark, f"{d}/out", ["k"], "ok").collect()}
    assert got == {1: "again", 2: "one", 3: "new"}


def test_presence_stream_joins_leaves_and_expires(spark, tmp_path):
    d = str(tmp_path / "in")
    schema = "room string, client string, ts timestamp, leave boolean"

    def put(rows):
        spark.createDataFrame(rows, "room string, client string, s int, leave boolean").select("room", "client", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "leave").coalesce(1).write.mode("append").parquet(d)

    put([("r", "a", 0, False), ("r", "b", 0, False)])
    stream = spark.readStream.schema(schema).parquet(d)
    q = signals.presence_stream(stream).writeStream.format("memory").queryName("presence").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        put([("r", "a", 20, False), ("r", "b", 21, True)])
        q.processAllAvailable()
        put([("r", "z", 100, False)])
        q.processAllAvailable()
        put([("r", "z", 110, False)])
        q.processAllAvailable()
        got = [(r.client, r.event, r.beats) for r in spark.sql("select * from presence").collect()]
    finally:
        q.stop()
    assert ("b", "left", 1) in got and ("a", "expired", 2) in got and got.count(("a", "joined", 0)) == 1 and ("z", "joined", 0) in got


def test_session_stream_equals_batch(spark, tmp_path):
    beats = spark.range(200).select((F.col("id") % 2).alias("room"), (F.col("id") % 4).alias("client"), F.timestamp_seconds(1_700_000_000 + F.col("id") * F.when(F.col("id") > 100, 13).otherwise(5)).alias("ts"))
    beats.write.parquet(str(tmp_path / "b"))
    late = spark.createDataFrame([(9, 9, 1_800_000_000)], "room long, client long, s long").select("room", "client", F.timestamp_seconds("s").alias("ts"))
    stream = spark.readStream.schema(beats.schema).parquet(str(tmp_path / "b")).withWatermark("ts", "1 minute")
    q = signals.presence_sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        late.write.mode("append").parquet(str(tmp_path / "b"))
        q.processAllAvailable()
        got = sorted(map(tuple, spark.sql("select * from sessions").collect()))
    finally:
        q.stop()
    assert got == sorted(map(tuple, signals.presence_sessions(beats).collect()))


def test_mailbox_cursor_and_fanout(spark):
    log = spark.createDataFrame([("r", "a", i) for i in range(1, 251)], "room string, to_client string, seq long")
    at = lambda after: spark.createDataFrame([("r", "a", after)], "room string, to_client string, after long")
    first = [r.seq for r in signals.mailbox_page(log, at(None)).orderBy("seq").collect()]
    assert first == list(range(1, 101)) and [r.seq for r in signals.mailbox_page(log, at(200)).orderBy("seq").collect()] == list(range(201, 251))
    assert [r.seq for r in signals.mailbox_page(log, at(None)).orderBy("seq").collect()] == first
    assert [r.c for r in signals.poll_replay(log).groupBy("poll").agg(F.count("*").alias("c")).orderBy("poll").collect()] == [100, 100, 50]
    live = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c"), ("q", "a")], "room string, client string")
    out = signals.leave_fanout(spark.createDataFrame([("r", "a")], "room string, client string"), live).collect()
    assert sorted(r.to_client for r in out) == ["b", "c"]
    assert {(r.room, r.client): (r.peer, r.offers) for r in signals.peers(live).collect()} == {("r", "a"): ("b", True), ("r", "b"): ("a", False), ("r", "c"): ("a", False)}
    kinds = ["ice", "offer", "ice", "leave", "ice", "answer"]
    st = spark.createDataFrame([("r", "a", i, k) for i, k in enumerate(kinds)], "room string, to_client string, seq int, type string")
    got = signals.message_states(st).orderBy("seq").collect()
    assert [r.action for r in got] == ["buffer_ice", "answer_offer", "add_ice", "reset", "buffer_ice", "set_answer"] and [r.buffered for r in got] == [1, 0, 0, 0, 1, 0]


def test_fanout_by_blocks_is_the_join_and_its_files_are_small(spark, tmp_path, monkeypatch):
    def plain(leaves, live):
        return sorted((r, a, b) for r, a in leaves for q, b in live if r == q and None not in (r, a, b) and a != b)

    leaves = [(i % 2, f"c{i % 40}") for i in range(90)] + [(0, None), (None, "c1"), (7, "c1")]
    live = [(i % 3, f"c{i}") for i in range(50)] * 2 + [(0, None), (None, "c2"), (1, "x")]
    kind = "room long, client string"
    for block in (1, 3, 512):
        monkeypatch.setattr(signals, "BLOCK", block)
        got = signals.leave_fanout(spark.createDataFrame(leaves, kind), spark.createDataFrame(live, kind)).collect()
        assert sorted((r.room, r.from_client, r.to_client) for r in got) == plain(leaves, live)
    many = spark.range(1500).select(F.lit(1).alias("room"), F.col("id").alias("client"))
    signals.leave_fanout(many, many).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1500 * 1499
    assert len(files) > 1 and sum(f.stat().st_size for f in files) < 1500 * 1500 * 0.6
