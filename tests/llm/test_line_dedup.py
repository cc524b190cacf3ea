import hashlib
import random
import re
from collections import defaultdict

from llm_helpers import corpus, prose

from quern.llm.line_dedup import CONSTANT, MIN_DOCS, drop_recurring_lines


def brute(rows):
    """{(id, text): (lines, places that go)} and the number of recurring templates; leaves have three leading tokens."""

    def parse(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in re.split("[\x20\x09-\x0d]+", line.strip("\x20\x09\x0a\x0b\x0c\x0d")) if t]

    docs = {(i, t): [parse(x) for x in t.split("\n")] for i, t in rows if t is not None}
    leaf, token = defaultdict(int), defaultdict(int)
    for lines in docs.values():
        for ts in lines:
            if ts:
                leaf[(len(ts), *ts[:3])] += 1
                for p, x in enumerate(ts):
                    token[((len(ts), *ts[:3]), p, x)] += 1
    places = defaultdict(lambda: defaultdict(list))
    for k, lines in docs.items():
        for at, ts in enumerate(lines):
            lf = (len(ts), *ts[:3])
            if not ts or leaf[lf] < MIN_DOCS:
                continue
            fixed = [token[(lf, p, x)] >= MIN_DOCS and x != "<*>" for p, x in enumerate(ts)]
            if sum(fixed) / len(ts) >= CONSTANT:
                places[(lf, tuple(x if f else "<*>" for x, f in zip(ts, fixed)))][k].append(at)
    recurring = {t: ks for t, ks in places.items() if len(ks) >= MIN_DOCS}
    gone = defaultdict(set)
    for ks in recurring.values():
        ids = [k[0] or 0 for k in ks]
        assert ids.count(min(ids)) == 1, "the fixture must have one first document, so that its answer is exact"
        for k, at in ks.items():
            gone[k].update(at[1:] if (k[0] or 0) == min(ids) else at)
    return docs, gone, len(recurring)


def check(rows, df):
    docs, gone, n = brute(rows)
    want = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        cut = gone[(i, t)]
        kept = "\n".join(x for at, x in enumerate(lines) if at not in cut)
        want.append((i, len(lines), len(cut), hashlib.sha256(kept.encode()).hexdigest(), None if t is None else kept))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, r.text) for r in drop_recurring_lines(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return n


def boilerplate():
    rows = []
    for i in range(1, 41):
        body = [prose(i, 12), prose(100 + i, 9)]
        if i % 2:
            body.insert(1, f"page {i} of the printed manual number {i * 7}, all rights kept")
        if i % 3 == 0:
            body.append("Read   more at the end of this very page")
        rows.append((i, "\n".join(body)))
    return rows


def test_boilerplate_goes_and_prose_stays(docs_of):
    rows = boilerplate()
    assert check(rows, docs_of(rows)) == 2
    got = {r.doc_id: r for r in drop_recurring_lines(docs_of(rows)).collect()}
    assert got[1].n_dropped == 0 and got[3].n_dropped == 1 and got[9].n_dropped == 2 and got[2].n_dropped == 0
    assert "page 1 of" in got[1].text and "page 5 of" not in got[5].text and got[2].text == rows[1][1]


def test_repeated_rows_are_one_document(docs_of):
    rows = boilerplate()
    rows += [rows[0]] * 3 + [rows[2]] * 4 + [rows[8]] * 2 + [(None, rows[4][1])] * 2
    r = random.Random(2)
    r.shuffle(rows)
    assert check(rows, docs_of(rows)) == 2


def test_a_row_repeated_so_often_that_its_key_is_hot(docs_of):
    rows = boilerplate()
    rows += [rows[8]] * 3000
    assert check(rows, docs_of(rows, 6)) == 2


def test_six_documents_with_one_shared_line_and_a_repeated_first(docs_of):
    rows = [(i, f"{prose(i, 9)}\nthis line is shared by all of these documents") for i in range(1, 7)]
    rows += [rows[0], rows[2]]
    assert check(rows, docs_of(rows)) == 1
    got = sorted((r.doc_id, r.n_dropped) for r in drop_recurring_lines(docs_of(rows)).collect())
    assert got == [(1, 0), (1, 0), (2, 1), (3, 1), (3, 1), (4, 1), (5, 1), (6, 1)]


def test_all_cases_and_copies(docs_of):
    rows = corpus() + [(60 + i, "first line of a copied text here\n" + prose(77, 30)) for i in range(7)]
    rows.append((90, "\n".join(["same long line of this text again"] * 2000)))
    assert check(rows, docs_of(rows)) == 1  # the prose line is all variable fields


def test_empty_table(docs_of):
    assert drop_recurring_lines(docs_of([])).collect() == []


def test_a_field_at_the_fourth_token_is_variable(docs_of):
    names = "sports politics science travel culture weather".split()
    rows = [(i, f"Posted in section {name} of this evening paper\n{prose(i, 12)}") for i, name in enumerate(names)]
    assert check(rows, docs_of(rows)) == 1
    got = {r.doc_id: r for r in drop_recurring_lines(docs_of(rows)).collect()}
    assert [got[i].n_dropped for i in range(6)] == [0, 1, 1, 1, 1, 1] and got[0].text == rows[0][1]


def test_sql_gives_the_same_rows(spark, docs_of):
    import duckdb
    import pyarrow as pa

    from quern.llm.line_dedup import SQL

    rows = boilerplate()
    rows += [rows[0], rows[2], rows[2], (70, None), (71, "")]
    documents = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})  # noqa: F841
    want = sorted(duckdb.sql(SQL).fetchall(), key=str)
    assert sorted(map(tuple, drop_recurring_lines(docs_of(rows)).drop("text").collect()), key=str) == want


def test_the_shuffle_of_many_leaves_gives_the_same(docs_of, monkeypatch):
    from quern.llm import line_dedup

    monkeypatch.setattr(line_dedup, "MAX_LEAVES", -1)
    rows = boilerplate() + corpus()
    assert check(rows, docs_of(rows)) >= 2


def test_a_text_of_very_many_lines_takes_linear_time(docs_of):
    """One text repeats its line 400,000 times; removing lines by a search for each would take hours."""
    import time

    line = "the same long line of this one text again"
    rows = [(i, f"{prose(i, 9)}\n{line}") for i in range(5)] + [(50, "\n".join([line] * 400_000))]
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in drop_recurring_lines(docs_of(rows)).collect()}
    assert got[50] == (400_000, 400_000, 0) and got[3][1] == 1 and got[0][1] == 0
    assert time.time() - began < 120
