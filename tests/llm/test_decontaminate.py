import hashlib
import random
import re
import string

from llm_helpers import corpus, prose

from quern.llm import decontaminate as dc

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def brute(docs, items, n=10):
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            win.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    lens = {len(k) for k in win}
    out = []
    for i, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for m in lens:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in win:
                    hit.update(range(k, k + m))
                    ids |= win[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, *x[1:])


ITEMS = [(1, prose(1, 30)), (2, "ÜNÏ cödé, TEXT"), (3, None), (4, ""), (10, prose(1, 30)), (None, prose(4, 12)), (5, "... !"), (6, "one; two")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_all_cases(spark, docs_of):
    rows = corpus() + [(30, "Say: " + prose(1).upper().replace(" ", ", ")), (31, "a ünï cödé text b"), (32, "One-two one. two ONE TWO")]
    got = dc.contamination(docs_of(rows), bench(spark)).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
    assert sorted(got, key=key) == sorted(brute(rows, ITEMS), key=key)


def test_shuffle_path_gives_the_same(spark, docs_of, monkeypatch):
    rows = corpus()
    a = sorted(map(str, dc.contamination(docs_of(rows), bench(spark)).collect()))
    monkeypatch.setattr(dc, "MAX_WINDOWS", -1)
    monkeypatch.setattr(dc, "MAX_KEYS", -1)
    assert sorted(map(str, dc.contamination(docs_of(rows), bench(spark)).collect())) == a


def test_empty_sides(spark, docs_of):
    assert dc.contamination(docs_of([]), bench(spark)).collect() == []
    got = dc.contamination(docs_of(corpus()), bench(spark, [])).collect()
    assert len(got) == len(corpus()) and not any(r.contaminated for r in got)


def test_documents_and_spans_go(spark, docs_of):
    rows = corpus()
    d = docs_of(rows)
    clean = {i for i, *_, c in brute(rows, ITEMS) if not c}
    out = dc.decontaminate(d, bench(spark))
    assert out.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((i is None, i or 0) for i, *_, c in brute(rows, ITEMS) if not c)
    assert clean
    cut = dc.decontaminate(docs_of([(1, "Keep this! " + prose(1, 30) + " and, that."), (2, "clean  text")]), bench(spark), "spans").collect()
    assert {r.doc_id: r.text for r in cut} == {1: "Keep this and, that.", 2: "clean  text"}


def test_every_window_at_every_place_and_length(spark, docs_of):
    r = random.Random(5)
    items = [(k, " ".join(f"w{r.randrange(6)}" for _ in range(k))) for k in range(1, 15)]
    rows = [(i, " ".join(f"w{r.randrange(7)}" for _ in range(r.randrange(0, 40)))) for i in range(60)]
    rows += [(100 + k, prose(k, k) + " " + items[-1][1] + " " + prose(k, 3)) for k in range(12)]
    for some in (items[8:], items[2:5] + items[-1:]):
        got = dc.contamination(docs_of(rows), bench(spark, some)).collect()
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
        assert sorted(got, key=key) == sorted(brute(rows, some), key=key)


def test_passages_that_many_texts_and_many_items_share(spark, docs_of, monkeypatch):
    """Rows after the join follow texts plus items: each text has one set, each set its items once."""
    passage = prose(50, 14)
    items = [(k, f"{passage} {prose(k, 3)}") for k in range(200)] + [(500, prose(51, 12)), (501, prose(51, 12)), (None, prose(52, 11))]
    rows = [(1000 + i, f"{prose(i, 20)} {passage} {prose(i + 7, 5)}") for i in range(300)] + [(1, prose(51, 12)), (2, prose(53, 30)), (3, None)] + [(4, prose(52, 11))] * 50
    want = sorted(brute(rows, items), key=key)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, dc.contamination(docs_of(rows), bench(spark, items)).select(*columns).collect()), key=key) == want
    _, hits, sets = dc._scan(docs_of(rows), bench(spark, items), 10, "doc_id", "text")
    assert hits.count() < 20 * len(rows) and sets.count() < 3 * len(items) and hits.select("set").distinct().count() < 2 * len(items)
    monkeypatch.setattr(dc, "MAX_WINDOWS", -1)
    monkeypatch.setattr(dc, "MAX_KEYS", -1)
    assert sorted(map(tuple, dc.contamination(docs_of(rows), bench(spark, items)).select(*columns).collect()), key=key) == want
    left = dc.decontaminate(docs_of(rows), bench(spark, items))
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]
