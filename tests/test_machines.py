import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.streaming import machines, signals

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
at = lambda s: T0 + dt.timedelta(seconds=s)


def streamed(spark, tmp_path, name, df, cuts):
    """A stream of df whose micro-batches hold the rows of each cut (conditions on column seq or ts)."""
    for i, c in enumerate(cuts):
        df.filter(c).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        for f in os.scandir(f"{tmp_path}/{name}"):
            if f.name.endswith(".parquet") and f.stat().st_mtime > time.time() - 60:
                os.utime(f.path, (1e9 + i, 1e9 + i)) if f.stat().st_mtime > 1e9 + 1000 else None
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def brute_leaves(rows, ttl, until):
    """Leaves of (room, client, second, leave, seq) rows, one room at a time, by walking through time."""
    out = []
    for room in {r[0] for r in rows}:
        live = {}

        def expire(upto):
            for end, c in sorted((t + ttl, c) for c, t in live.items()):
                if end < upto:
                    del live[c]
                    out.extend((room, c, o, "expired", end) for o in live if live[o] + ttl >= end)  # noqa: B023

        for _, c, t, leave, _ in sorted((r for r in rows if r[0] == room), key=lambda r: (r[2], r[4])):
            expire(t)
            if leave and c in live:
                del live[c]
                out.extend((room, c, o, "leave", t) for o in live)
            elif not leave:
                live[c] = t
        expire(until)
    return sorted(out)


def test_leaves_are_those_of_the_log_wherever_it_is_cut(spark, tmp_path):
    r = random.Random(1)
    rows = sorted(((r.randrange(3), f"c{r.randrange(4)}", r.randrange(600), r.random() < 0.1, i) for i in range(250)), key=lambda x: (x[2], x[4]))
    rows.append((9, "alone", 5000, False, 999))  # moves the watermark on: quiet rooms expire by timers
    df = spark.createDataFrame([(a, b, at(t), leave, s) for a, b, t, leave, s in rows], "room long, client string, ts timestamp, leave boolean, seq long")
    want = brute_leaves(rows, 30, 5000)
    assert {x[3] for x in want} == {"leave", "expired"}
    for name, edges in (("one", [10**6]), ("many", [50, 51, 200, 333, 10**6])):
        cuts = [(F.unix_seconds("ts") - int(T0.timestamp()) >= a) & (F.unix_seconds("ts") - int(T0.timestamp()) < b) for a, b in zip([-1, *edges], edges, strict=False)]
        stream = machines.leave_stream(streamed(spark, tmp_path, name, df, cuts), ttl=30)
        got = machines.replay(stream, f"{tmp_path}/out-{name}", f"{tmp_path}/ck-{name}")
        zero = int(T0.timestamp()) * 10**6
        assert sorted((x.room, x.from_client, x.to_client, x.reason, (x.at - zero) // 10**6) for x in got.collect()) == want


def test_a_room_is_the_work_of_many_tasks_and_its_fans_are_small(spark, tmp_path):
    """600 clients fall silent one after the other: 180,000 rows of one room, from more than one task."""
    rows = [(1, c, at(c), False, c) for c in range(600)] + [(2, -1, at(9000), False, 9999)]
    df = spark.createDataFrame(rows, "room long, client long, ts timestamp, leave boolean, seq long")
    out = machines.replay(machines.leave_stream(streamed(spark, tmp_path, "in", df, [F.lit(True)]), ttl=1000), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert out.count() == 600 * 599 // 2 and out.distinct().count() == 600 * 599 // 2
    assert out.select(F.input_file_name()).distinct().count() > 1
    for slices in (1, 3):
        stream = machines.leave_fans(streamed(spark, tmp_path, f"in{slices}", df, [F.lit(True)]), ttl=1000, slices=slices)
        fans = machines.replay(stream, f"{tmp_path}/fans{slices}", f"{tmp_path}/fck{slices}")
        assert fans.agg(F.sum(F.size("ats") + F.size("los"))).first()[0] <= 2 * 600 * slices
        assert machines.unfold(fans).exceptAll(out).count() == 0 and machines.unfold(fans).count() == out.count()


class Held:
    """A state handle that keeps its one list and its timers in memory."""

    def __init__(self):
        self.rows, self.timers = [], []
        self.getListState = lambda name, schema: self
        self.exists, self.get, self.put, self.clear = lambda: bool(self.rows), lambda: iter(self.rows), self._put, lambda: self._put([])
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: iter(self.timers), self.timers.remove, self.timers.append

    def _put(self, rows):
        self.rows = rows


def test_fans_that_end_anywhere_hold_the_same_leaves(monkeypatch):
    import pandas as pd

    r = random.Random(3)
    rows = sorted(((1, f"c{r.randrange(8)}", r.randrange(900), r.random() < 0.1, i) for i in range(400)), key=lambda x: (x[2], x[4]))
    want = brute_leaves(rows, 30, 899)
    for fan, stays, slab, batch in ((1024, 8192, 4096, 400), (1, 8192, 7, 400), (3, 2, 1, 33), (5, 1, 50, 1)):
        monkeypatch.setattr(machines, "FAN", fan), monkeypatch.setattr(machines, "STAYS", stays), monkeypatch.setattr(machines, "SLAB", slab)
        got, frames, most = [], [], 0
        cells = {(i, j): (machines.Room(30, "string"), Held()) for i in range(3) for j in range(3)}
        for (i, j), (room, held) in cells.items():
            room.init(held)
            mine = [(c, t, s, leave, (int(c[1]) % 3 == i) + 2 * (int(c[1]) % 3 == j)) for _, c, t, leave, s in rows]
            mine = [x for x in mine if x[4]]
            for b in range(0, len(mine), batch):
                frames += room.handleInputRows((1, i, j), iter([pd.DataFrame(mine[b : b + batch], columns=["client", "at", "seq", "leave", "side"])]), None)
            assert len(held.timers) == bool(held.rows)
            room._open(1)
            frames += [*room._expire(899), *room._close()]
        for _, froms, expired, ats, tos, los, his in (x for f in frames for x in f.itertuples(index=False)):
            most = max(most, len(froms))
            got += [(1, froms[n], to, "expired" if expired[n] else "leave", ats[n]) for to, lo, hi in zip(tos, los, his, strict=True) for n in range(lo, hi)]
        assert sorted(got) == want and most <= fan


def test_beats_travel_in_packs_and_fans_open_by_leave_in_many_tasks(spark, tmp_path):
    """Python gets a row for each slice of a batch, not for each beat; a file of fans is the work of more than one task."""
    import pyarrow as pa

    ts = pa.array([at(s) for s in range(100)], pa.timestamp("us", "UTC"))
    beats = pa.RecordBatch.from_pydict({"room": [s % 2 for s in range(100)], "own": [s % 3 for s in range(100)], "client": [f"c{s}" for s in range(100)], "at": list(range(100)), "seq": list(range(100)), "leave": [s % 7 == 0 for s in range(100)], "ts": ts})
    packs = [x for b in machines._pack(iter([beats])) for x in b.to_pylist()]
    assert len(packs) == 6 and all(x["ts"] == at(max(x["at"])) for x in packs)
    opened = [(x["room"], x["own"], *y) for x in packs for y in zip(x["client"], x["at"], x["seq"], x["leave"], strict=True)]
    assert sorted(opened, key=lambda y: y[3]) == [(s % 2, s % 3, f"c{s}", s, s, s % 7 == 0) for s in range(100)]
    schema = "room long, from_clients array<long>, expired array<boolean>, ats array<long>, to_clients array<long>, los array<int>, his array<int>"
    fans = [(1, [10 * k, 10 * k + 1, 10 * k + 2], [True, False, True], [5, 6, 7], [-1, -2, -3], [0, 1, 0], [3, 3, 1]) for k in range(40)]
    spark.createDataFrame(fans, schema).coalesce(1).write.parquet(f"{tmp_path}/fans")
    out = machines.unfold(spark.read.schema(schema).parquet(f"{tmp_path}/fans"))
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len({x.task for x in got}) > 1
    got = {k: [tuple(x)[1:5] for x in got if x.from_client // 10 == k] for k in range(40)}
    a, b, c = (0, "expired", 5), (1, "leave", 6), (2, "expired", 7)
    want = [(a, -1), (a, -3), (b, -1), (b, -2), (c, -1), (c, -2)]
    assert got == {k: [(10 * k + n, to, reason, t) for (n, reason, t), to in want] for k in range(40)}


@pytest.fixture
def log(spark):
    r = random.Random(2)
    kinds = ["ice", "ice", "ice", "offer", "answer", "leave"]
    rows = [(room, f"t{c}", s, r.choice(kinds)) for room in range(4) for c in range(2) for s in range(40)]
    return spark.createDataFrame(rows, "room long, to_client string, seq long, type string")


def test_the_machine_gives_the_rows_of_the_batch_query(spark, tmp_path, log):
    want = sorted(tuple(r) for r in signals.message_states(log).select("room", "to_client", "seq", "type", "action", "buffered").collect())
    for name, edges in (("one", [100]), ("many", [3, 4, 17, 30, 100])):
        cuts = [(F.col("seq") >= a) & (F.col("seq") < b) for a, b in zip([0, *edges], edges, strict=False)]
        # Files that overlap bring messages again: they are applied once.
        cuts = [c | (F.col("seq") == a - 1) for c, a in zip(cuts, [0, *edges], strict=False)]
        out = machines.replay(machines.message_stream(streamed(spark, tmp_path, name, log, cuts)), f"{tmp_path}/out-{name}", f"{tmp_path}/ck-{name}").collect()
        assert sorted(tuple(r)[:6] for r in out) == want
        assert all((r.action in ("answer_offer", "set_answer")) or not r.flushed for r in out)
        assert sum(len(r.flushed) for r in out) > 0


def test_pages_are_those_of_the_log_and_messages_expire(spark, tmp_path, log):
    messages = log.select("room", "to_client", "seq", (F.col("seq") * 3).alias("size"), F.timestamp_seconds(F.col("seq") + int(T0.timestamp())).alias("ts"))
    asked = [(room, "t1", p, after, at(t)) for room in range(4) for p, (after, t) in enumerate([(None, 39), (10, 39), (35, 39), (None, 70), (38, 120), (None, 5)])]
    polls = spark.createDataFrame(asked, "room long, to_client string, poll long, after long, ts timestamp")
    want = []
    for room, to, p, after, t in asked:
        sec = (t - T0).total_seconds()
        seen = [s for s in range(40) if (after is None or s > after) and s <= sec < s + 60][:7]
        want += [(room, to, p, s, 3 * s, i) for i, s in enumerate(seen, 1)]
    both = messages.withColumns({"poll": F.lit(None).cast("long"), "after": F.lit(None).cast("long")}).unionByName(polls.withColumns({"seq": F.lit(None).cast("long"), "size": F.lit(None).cast("long")}))
    zero = int(T0.timestamp())
    for name, edges in (("one", [1000]), ("many", [4, 20, 39, 60, 1000])):
        cuts = [(F.unix_seconds("ts") >= zero + a) & (F.unix_seconds("ts") < zero + b) for a, b in zip([0, *edges], edges, strict=False)]
        src = streamed(spark, tmp_path, name, both, cuts)
        stream = machines.mailbox_stream(src.filter("poll is null"), src.filter("poll is not null"), ttl=60, limit=7)
        got = machines.replay(stream, f"{tmp_path}/out-{name}", f"{tmp_path}/ck-{name}").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    # On a log that has not expired a page is the batch query's.
    cursors = spark.createDataFrame([(0, "t1", 10)], "room long, to_client string, after long")
    page = signals.mailbox_page(messages, cursors, limit=7).select("seq", "size", "place").collect()
    assert sorted(map(tuple, page)) == sorted((s, z, i) for room, to, p, s, z, i in want if (room, p) == (0, 1))


def test_the_store_itself_expires_messages(spark, tmp_path):
    now = dt.datetime.now(dt.UTC)
    rows = [(1, "a", 1, 5, now, None, None), (1, "a", 2, 6, now, None, None), (1, "a", None, None, now, 0, None)]
    df = spark.createDataFrame(rows, "room long, to_client string, seq long, size long, ts timestamp, poll long, after long")
    src = streamed(spark, tmp_path, "in", df, [F.col("poll").isNull(), F.col("poll").isNotNull()])
    stream = machines.mailbox_stream(src.filter("poll is null"), src.filter("poll is not null"), ttl=3600, native=True)
    # In processing time a stream goes on without data, so it is stopped here.
    with machines.rocksdb(spark):
        q = stream.writeStream.format("memory").queryName("pages").option("checkpointLocation", f"{tmp_path}/ck").start()
    until = time.time() + 90
    while q.isActive and spark.table("pages").count() < 2 and time.time() < until:
        time.sleep(1)
    q.stop()
    assert sorted((r.poll, r.seq, r.place) for r in spark.table("pages").collect()) == [(0, 1, 1), (0, 2, 2)]
