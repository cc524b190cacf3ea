import math
import random

import numpy as np
import pyarrow as pa
from llm_helpers import corpus, prose

from quern.llm import toxicity as tx
from quern.llm.common import text_buffer


def graded(n, seed):
    """Texts whose grade is the number of kinds of marked words in them."""
    r = random.Random(seed)
    marks, rows = ("mildly", "nasty", "horrid"), []
    for i in range(n):
        g = r.randrange(4)
        w = prose(seed * 1000 + i, r.randrange(10, 120)).split()
        for m in marks[:g]:
            w.insert(r.randrange(len(w)), m + "!")
        rows.append((i, " ".join(w), g))
    return rows


def test_held_out_grades_and_expected_severity(spark):
    rows = graded(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 3], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    assert model.labels == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in tx.severity(docs, model).collect()}
    held = [(g, out[i]) for i, _, g in rows if i % 3 == 0]
    assert np.mean([r.grade == g for g, r in held]) > 0.9
    assert np.mean([abs(r.expected_severity - g) for g, r in held]) < 0.35


def test_thresholds_share_weights():
    f, n = tx.features(*text_buffer(pa.array([t for _, t, _ in graded(400, 2)])))
    model = tx.OrdinalModel.fit(f, n, np.array([g for *_, g in graded(400, 2)]), [0, 1, 2, 3])
    s, mean, grade = model.score(f, n)
    order = np.argsort(s, kind="stable")
    assert (np.diff(mean[order]) >= -1e-9).all() and (np.diff(grade[order]) >= 0).all()


def test_sample_is_bounded_and_labels_may_be_odd(spark, docs_of):
    rows = corpus() + [(100 + i, prose(i) + (" vile and vilest" if i % 2 else "")) for i in range(60)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(None, 1), (101, None), (102, 0), (102, 0), (9999, 1)], "doc_id long, toxic int")
    model = tx.fit(docs, labels, sample=50)
    assert len(tx.severity(docs, model).collect()) == len(rows)
    clean = tx.drop_toxic(docs, model)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert {100 + i for i in range(60) if i % 2 == 0} <= left and not {100 + i for i in range(60) if i % 2} & left


def test_nothing_labelled_and_one_grade(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.toxic for r in tx.severity(docs_of(corpus()), tx.fit(docs_of(corpus()), none)).collect())
    zero = spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int")
    assert not any(r.toxic for r in tx.severity(docs_of(corpus()), tx.fit(docs_of(corpus()), zero)).collect())
    assert tx.severity(docs_of([]), tx.fit(docs_of([]), zero)).collect() == []


def test_driver_labels_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tx.fit(docs, labels.filter("doc_id % 4 <> 1"))
    got = tx.severity(docs, model).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 4 = 1"), "doc_id").collect()
    assert len(got) > 60
    assert np.mean([r.said == bool(r.toxic) for r in got]) > 0.93
    assert not any(r.said for r in got if not r.toxic)


def plain(w, theta, sets, grades):
    """Mean negative log-likelihood by the definition, text by text."""
    total = 0.0
    for fs, g in zip(sets, grades):
        s = sum(w[f] for f in fs)
        below = [1 / (1 + math.exp(-(t - s))) for t in theta]
        total -= math.log((below[g] if g < len(theta) else 1.0) - (below[g - 1] if g else 0.0))
    return total / len(sets)


def test_likelihood_gradients_and_expected_severity_by_brute_force():
    r = random.Random(7)
    sets = [sorted(r.sample(range(12), r.randrange(0, 6))) for _ in range(40)]
    grades = np.array([r.randrange(4) for _ in sets])
    w, theta = np.array([r.uniform(-1, 1) for _ in range(12)]), np.array([-0.7, 0.2, 1.4])
    col, row = np.array([f for s in sets for f in s]), np.array([i for i, s in enumerate(sets) for _ in s])
    loss, g_w, g_t = tx.loss_and_gradients(w, theta, col, row, grades)
    assert abs(loss - plain(w, theta, sets, grades)) < 1e-12
    for x, g in ((w, g_w), (theta, g_t)):
        for j in range(x.size):
            keep, step = x[j], 1e-6
            x[j] = keep + step
            up = plain(w, theta, sets, grades)
            x[j] = keep - step
            down = plain(w, theta, sets, grades)
            x[j] = keep
            assert abs((up - down) / (2 * step) - g[j]) < 1e-6
    model = tx.OrdinalModel([0, 1, 3, 7], w, theta)
    s, mean, grade = model.score(col, np.array([len(x) for x in sets]))
    for i, fs in enumerate(sets):
        z = sum(w[f] for f in fs)
        reach = [1.0] + [1 - 1 / (1 + math.exp(-(t - z))) for t in theta]
        p = [a - b for a, b in zip(reach, reach[1:] + [0.0])]
        assert abs(s[i] - z) < 1e-12 and abs(mean[i] - sum(x * y for x, y in zip(p, model.labels))) < 1e-12
        assert grade[i] == max(label for label, q in zip(model.labels, reach) if q >= 0.5)


def test_fit_reaches_a_minimum_that_no_small_step_lowers():
    rows = graded(300, 3)
    f, n = tx.features(*text_buffer(pa.array([t for _, t, _ in rows])))
    g = np.array([x for *_, x in rows])
    model = tx.OrdinalModel.fit(f, n, g, [0, 1, 2, 3], steps=3000)
    row, used = np.repeat(np.arange(n.size), n), np.unique(f)
    value = lambda w, t: tx.loss_and_gradients(w, t, f, row, g)[0] + tx.L1 * np.abs(w).sum()
    best, rng = value(model.weights, model.thresholds), np.random.default_rng(1)
    for _ in range(60):
        w = model.weights.copy()
        w[rng.choice(used, 5)] += rng.normal(0, 0.2, 5)
        assert value(w, np.sort(model.thresholds + rng.normal(0, 0.05, 3))) > best - 1e-3


def test_query_with_ties_repeats_and_long_texts_is_the_model_row_by_row(spark, docs_of):
    rows = corpus() + [(200, "vile " * 40_000), (201, "x" * 300_000), (202, "漢" * 50_000)]
    rows += [(300 + i, prose(i) + (" vile" if i % 2 else "")) for i in range(40)] + [(301, prose(1) + " vile")] * 3
    docs = docs_of(rows)
    labels = spark.createDataFrame([(300 + i, i % 2, i % 4 // 2) for i in range(40)] + [(301, 1, None), (None, 1, 1), (5, None, 0)], "doc_id long, toxic int, quality int")
    graded_ = tx.severity_grades(labels)
    assert sorted({r.severity for r in graded_.collect()}, key=str) == [0, 1, 2, None]
    model = tx.fit(docs, graded_, "severity", gather=4000)
    s, mean, grade = model.score(*tx.features(*text_buffer(pa.array([t for _, t in rows]))))
    want = sorted((str(i), round(float(a), 9), round(float(m), 9), int(g)) for (i, _), a, m, g in zip(rows, s, mean, grade))
    assert sorted((str(r.doc_id), round(r.score, 9), round(r.expected_severity, 9), r.grade) for r in tx.severity(docs, model).collect()) == want
    assert all(r.toxic == (r.grade >= 1) for r in tx.severity(docs, model).collect())


def test_driver_grades_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tx.fit(docs, tx.severity_grades(labels.filter("doc_id % 4 <> 1")), "severity")
    got = tx.severity(docs, model).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 4 = 1"), "doc_id").collect()
    assert np.mean([r.said == bool(r.toxic) for r in got]) > 0.93 and not any(r.said for r in got if not r.toxic)
