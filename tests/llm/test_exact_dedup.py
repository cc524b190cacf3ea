import hashlib
import re
from collections import defaultdict

from llm_helpers import corpus

from quern.llm.exact_dedup import drop_copies, exact_groups


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    g = defaultdict(list)
    for i, t in rows:
        g[norm(t)].append(i)
    return {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in g.items()}


def check(rows, got):
    want = brute(rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert len(by) == len(want)
    for t, (least, n) in want.items():
        rs = by[hashlib.sha256(t.encode()).hexdigest()]
        assert len(rs) == n and {(r.keep_id, r.group_size) for r in rs} == {(least, n)}
        kept = [r for r in rs if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == least


def test_all_cases(docs_of):
    rows = corpus()
    check(rows, exact_groups(docs_of(rows)).collect())


def test_hot_group_is_salted(docs_of):
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(6000)] + [(None, "hot text"), (5, "hot text")]
    check(rows, exact_groups(docs_of(rows, 5)).collect())


def test_empty_table(docs_of):
    assert exact_groups(docs_of([])).collect() == []


def test_drop_keeps_columns_and_one_row(docs_of):
    rows = corpus()
    d = docs_of(rows)
    out = drop_copies(d)
    assert out.columns == d.columns and out.schema == d.schema
    left = [r.text for r in out.collect()]
    assert sorted(map(norm, left)) == sorted(brute(rows))


def test_hot_groups_of_null_or_equal_ids_are_spread(docs_of):
    rows = [(None, "no ids at all")] * 3000 + [(7, "one  id")] * 3000 + [(None, "one id")] * 20 + [(i, f"text {i}") for i in range(500)]
    d = docs_of(rows, 5)
    check(rows, exact_groups(d).collect())
    assert drop_copies(d).count() == 502
