import hashlib
import math
import random
import re
import zlib

import pytest
from llm_helpers import corpus

from quern.llm import resample as op

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + m]) for m in range(1, n + 1) for i in range(len(w) - m + 1)]


def brute(rows, target, percent=10, min_words=20, seed=2024, n=1, size=10_000):
    """(doc_id, n_features, weight, score, drawn) of each row, and the ids in the order of their ranks."""
    at = lambda f: zlib.crc32(f.encode()) % size
    s, t = [0] * size, [0] * size
    for _, x in rows:
        for f in features(x, n):
            s[at(f)] += 1
    for x in target:
        for f in features(x, n):
            t[at(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + size) / ((s[b] + 1) * (sum(t) + size)))) for b in range(size)]
    out = []
    for i, x in rows:
        fs = features(x, n)
        weight = math.floor(sum(gain[at(f)] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= min_words])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, order[: len(order) * percent // 100]


def check(got, rows, target, **kw):
    out, order = brute(rows, target, **kw)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4])
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score) for r in got], key=key) == sorted([tuple(r[:4]) for r in out], key=key)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(order) + 1))
    assert [(r.score, r.doc_id) for r in drawn] == [(r[3], r[0]) for r in order]


TARGET = ["alpha1 beta2 gamma3 Ünï", None, "", "iota kappa lambda " * 30]


@pytest.mark.parametrize("kw", [{}, {"percent": 50, "n": 2, "size": 97}, {"percent": 100, "min_words": 0}, {"percent": 0}])
def test_all_cases(spark, docs_of, kw):
    rows, target = corpus(), spark.createDataFrame([(x, 1) for x in TARGET], "text string, rank int")
    mine = {("buckets" if k == "size" else k): v for k, v in kw.items()}
    check(op.resample(docs_of(rows), target, **mine).collect(), rows, TARGET, **kw)


def test_runs_ranges_and_copies(spark, docs_of, monkeypatch):
    """Many short runs, several ranges, pieces of a hot entry: the ranks are those of one sort."""
    monkeypatch.setattr(op, "RUN_ROWS", 50)
    monkeypatch.setattr(op, "MERGE_ROWS", 40)
    monkeypatch.setattr(op, "PIECE", 7)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefghij") + str(r.randrange(9)) for _ in range(r.randrange(15, 30)))) for i in range(900)]
    rows += [(None, "one text of no id " * 8)] * 300 + [(7, "x y z " * 9)] * 60 + [(7, "x y w " * 9)] * 5
    target = spark.createDataFrame([("a1 b2 c3 x y one",)], "text string")
    for percent in (10, 37, 90):
        check(op.resample(docs_of(rows, 6), target, percent=percent).collect(), rows, ["a1 b2 c3 x y one"], percent=percent)


def test_tournament_merges():
    r = random.Random(3)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randrange(50), r.randrange(3)) for _ in range(r.randrange(0, 40))) for _ in range(k)]
        tree, out = op.Tournament(runs), []
        while (x := tree.pop()) is not None:
            out.append(x)
        assert out == sorted(sum(runs, []))


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert op.resample(docs_of([]), none).collect() == []
    rows = [(i, "some words of a text " * 5 + str(i)) for i in range(40)]
    check(op.resample(docs_of(rows), none).collect(), rows, [])


def test_drawn_documents(spark, docs_of):
    rows = corpus() + [(100 + i, f"iota kappa lambda {i} " * 9) for i in range(60)]
    d, target = docs_of(rows), spark.createDataFrame([(x,) for x in TARGET], "text string")
    got = op.draw_documents(d, target, percent=20)
    ids = {r.doc_id for r in op.resample(d, target, percent=20).filter("rank is not null").collect()}
    assert got.columns == d.columns and {r.doc_id for r in got.collect()} == ids
