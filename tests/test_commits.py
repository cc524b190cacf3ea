import threading

import pytest
from pyspark.sql import functions as F

from quern.sources import commits, sinks

KEY = ["room", "client"]


@pytest.fixture
def rows(spark):
    return lambda *x: spark.createDataFrame(list(x), "room int, client string, at int")


def content(df):
    return sorted(map(tuple, df.collect()))


class Crash(BaseException):
    """The process ends: nothing runs afterwards, not even cleaning up."""


def test_a_crash_at_any_step_keeps_all_old_rows(spark, rows, tmp_path, monkeypatch):
    d = f"{tmp_path}/presence"
    old = [(1, "a", 1), (1, "b", 1), (2, "c", 1)]
    sinks.upsert(rows(*old), d, KEY)

    def crash(*_, **__):
        raise Crash

    def half(s, path, body):
        # An unfinished file under the next number, as a store without links leaves it.
        with open(path, "wb") as out:
            out.write(body[: len(body) // 2])
        raise Crash

    real = commits.create_new

    def late(s, path, body):
        real(s, path, body)
        raise Crash

    for name, step, want in (("head", crash, old), ("create_new", crash, old), ("create_new", half, old), ("create_new", late, [*old[:2], (2, "c", 2), (9, "z", 2)])):
        with monkeypatch.context() as m:
            m.setattr(commits, name, step)
            with pytest.raises(Crash):
                sinks.upsert(rows((2, "c", 2), (9, "z", 2)), d, KEY)
        assert content(sinks.current(spark, d)) == sorted(want)
    # The next writer goes on past the unfinished file and loses nothing.
    got = sinks.upsert(rows((5, "q", 3)), d, KEY, rows((1, "a", 0)))
    assert content(got) == [(1, "b", 1), (2, "c", 2), (5, "q", 3), (9, "z", 2)]
    assert commits.sweep(spark, d, keep=1) >= 1 and content(sinks.current(spark, d)) == content(got)


def test_a_failed_write_leaves_no_folder(spark, rows, tmp_path):
    d = f"{tmp_path}/t"
    sinks.upsert(rows((1, "a", 1)), d, KEY)
    broken = rows((2, "b", 2)).withColumn("at", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        sinks.upsert(broken, d, KEY)
    assert content(sinks.current(spark, d)) == [(1, "a", 1)] and len(list((tmp_path / "t").glob("data-*"))) == 1


def test_writers_at_once_lose_nothing(spark, rows, tmp_path):
    d = f"{tmp_path}/busy"
    sinks.upsert(rows((0, "start", 0)), d, KEY)
    errors = []

    def work(k):
        try:
            for i in range(3):
                sinks.upsert(rows((k, f"c{i}", i)), d, KEY)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert content(sinks.current(spark, d)) == sorted([(0, "start", 0)] + [(k, f"c{i}", i) for k in (1, 2, 3) for i in range(3)])


def test_the_writer_that_is_second_starts_again_on_the_new_base(spark, rows, tmp_path, monkeypatch):
    d, real, calls = f"{tmp_path}/race", commits.create_new, []
    sinks.upsert(rows((1, "a", 1)), d, KEY)

    def first_another(s, path, body):
        calls.append(path)
        if len(calls) == 1:
            sinks.upsert(rows((2, "other", 2)), d, KEY)
        return real(s, path, body)

    monkeypatch.setattr(commits, "create_new", first_another)
    assert content(sinks.upsert(rows((3, "mine", 3)), d, KEY)) == [(1, "a", 1), (2, "other", 2), (3, "mine", 3)]
    assert len(calls) == 3


def test_an_outrun_unfinished_commit_does_not_count(spark, rows, tmp_path):
    """A slow writer finishes its file after a later one was made on the old base: it must not think it won."""
    d = f"{tmp_path}/slow"
    one = commits.commit(spark, d, lambda now, f: {"rows": "x"})
    assert commits.create_new(spark, commits._file(d, one + 1), b"{")
    two = commits.commit(spark, d, lambda now, f: {"rows": "y"})
    assert two == one + 2 and not commits._holds(spark, d, one + 1) and commits._holds(spark, d, one) and commits.head(spark, d)[1] == {"rows": "y"}
    assert not commits.create_new(spark, commits._file(d, two), b"{}")


@pytest.fixture
def shards(spark, tmp_path):
    for k in (0, 1):
        spark.createDataFrame([(f"c{k}{i}", None if i else "bad", 0, 2) for i in range(3)], "clip string, reason string, start int, end int").write.parquet(f"{tmp_path}/s{k}/clips/batch=0")
        spark.createDataFrame([(f"c{k}{i}", f, 1.0) for i in (1, 2) for f in range(3)], "clip string, frame int, x double").write.parquet(f"{tmp_path}/s{k}/frames/batch=0")
    return [f"{tmp_path}/s0", f"{tmp_path}/s1"], spark.createDataFrame([(f"c{k}{i}",) for k in (0, 1) for i in range(3)], "clip string")


def test_clips_and_frames_show_together_or_not_at_all(spark, shards, tmp_path, monkeypatch):
    folders, plan = shards
    out = f"{tmp_path}/store"

    def crash(*_):
        raise Crash

    for name in ("create_new", "head"):
        with monkeypatch.context() as m:
            m.setattr(commits, name, crash)
            with pytest.raises(Crash):
                sinks.merge_stores(spark, folders, out, plan)
        assert commits.head(spark, out)[0] == 0  # nothing is visible
    got = sinks.merge_stores(spark, folders, out, plan)
    assert got["clips"].count() == 6 and got["frames"].count() == 12 and "batch" not in got["frames"].columns
    with pytest.raises(FileExistsError):
        sinks.merge_stores(spark, folders, out, plan)


def test_a_merge_that_does_not_add_up_is_refused(spark, shards, tmp_path):
    folders, plan = shards
    for some, match in ((folders[:1], "add up"), ([*folders, folders[0]], "add up")):
        with pytest.raises(ValueError, match=match):
            sinks.merge_stores(spark, some, f"{tmp_path}/bad", plan)
    f = spark.read.parquet(f"{folders[1]}/frames")
    for name, frames, match in (("twice", f.unionByName(f), "twice"), ("odd", f.withColumn("clip", F.lit("c10")), "twice|no accepted"), ("few", f.filter("clip = 'c11'"), "without frames")):
        spark.read.parquet(f"{folders[1]}/clips").write.parquet(f"{tmp_path}/{name}/clips")
        frames.write.parquet(f"{tmp_path}/{name}/frames")
        with pytest.raises(ValueError, match=match):
            sinks.merge_stores(spark, [folders[0], f"{tmp_path}/{name}"], f"{tmp_path}/bad", plan)
    assert commits.head(spark, f"{tmp_path}/bad")[0] == 0 and not list((tmp_path / "bad").glob("data-*"))


def test_small_files_are_replaced_at_once(spark, tmp_path):
    p = f"{tmp_path}/deep/note.json"
    for text in ("one", "two"):
        sinks.write_text(spark, p, text)
        assert sinks.read_text(spark, p) == text
    assert [x.name for x in (tmp_path / "deep").iterdir()] == ["note.json"]
