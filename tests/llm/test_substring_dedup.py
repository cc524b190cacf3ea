import hashlib
import random
from collections import Counter

import pyarrow as pa

from llm_helpers import corpus, prose

from quern.llm.substring_dedup import remove_repeats


def brute(rows, n):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    c = Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1))
    out = []
    for i, w in words:
        cut = [False] * len(w)
        for k in range(len(w) - n + 1):
            if c[tuple(w[k : k + n])] > 1:
                cut[k : k + n] = [True] * n
        kept = b" ".join(x for x, f in zip(w, cut) if not f)
        out.append((i, len(w), sum(cut), hashlib.sha256(kept).hexdigest()))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, *x[1:])


def run(df, n=35):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df, n).collect()), key=key)


def test_all_cases(docs_of):
    rows = corpus() + [(20, prose(9) + " " + prose(1) + " " + prose(7)), (21, prose(7) + "\n\n" + prose(8)), (22, " ".join(prose(8).split()[:35]))]
    assert run(docs_of(rows)) == sorted(brute(rows, 35), key=key)


def test_short_windows_and_one_partition(docs_of):
    rows = [(i, prose(i % 4, 30 + i)) for i in range(20)]
    for parts in (1, 6):
        assert run(docs_of(rows, parts), 8) == sorted(brute(rows, 8), key=key)


def test_segments_and_folds_are_cut_anywhere(docs_of, monkeypatch):
    from quern.llm import substring_dedup as m

    monkeypatch.setattr(m, "SEGMENT", 50)
    monkeypatch.setattr(m, "FOLD_BYTES", 3000)
    import numpy as np

    from quern.llm.common import Words, text_buffer

    rows = [(i, prose(i % 5, 200)) for i in range(30)]
    f = m._Folder(35, 4, 4)
    out = []
    for i, t in rows:
        out += list(f.add(Words(*text_buffer(pa.array([t]))), np.array([i]), np.array([i])))
    out += list(f.flush())
    held, local = {}, []
    for b in out:
        for bk, body in zip(b.column(1).to_pylist(), b.column(2)):
            parts = m._unpack(body.as_buffer())
            if bk < 0:
                local.append([np.frombuffer(x, np.int64) for x in parts])
            else:
                held.setdefault(bk, []).append(parts)
    cut = {i: set() for i, _ in rows}
    for k1, _, s, e in local + [m._count(h, 35) for h in held.values()]:
        for i, a, b in zip(k1.tolist(), s.tolist(), e.tolist()):
            cut[i].update(range(a, b))
    assert {i: len(c) for i, c in cut.items()} == {i: r for i, _, r, _ in brute(rows, 35)}


def test_a_common_word_group_draws_few_windows_and_changes_no_result(docs_of):
    import numpy as np

    from quern.llm import substring_dedup as m

    r = random.Random(3)
    phrase = "by the terms of"
    rows = []
    for i in range(150):
        w = prose(i, 120).split()
        for _ in range(4):
            w[r.randrange(len(w)) : 0] = phrase.split()
        rows.append((i, " ".join(w)))
    rows += [(200, rows[7][1]), (201, " ".join(rows[9][1].split()[20:70]))]
    d = docs_of(rows)
    found = m.frequent_slots(d.select("text"), 4, 2000)
    g = m.ngram_hashes(m.Words(*m.text_buffer(pa.array([phrase]))).hashes(), 4)
    assert 0 < found.size < 2000 and int(m._slots(g)[0]) in found.tolist()
    other = np.array([1, 2**63 + 5], np.uint64)
    order = m.ranks(np.concatenate([other, g]), found)
    assert order.argmax() == 2 and m.ranks(other, found[:0]) is other
    assert run(d) == sorted(brute(rows, 35), key=key)


def test_a_row_repeated_so_often_that_its_key_is_hot(docs_of):
    rows = [(i, prose(i, 60)) for i in range(20)] + [(3, prose(3, 60))] * 2500 + [(30, prose(4, 60))]
    want = [(i, n, r, h) for i, n, r, h in brute(rows[:21] + rows[-1:], 35)]
    by = {i: x for i, *x in want}
    assert run(docs_of(rows, 5)) == sorted(((i, *by[i]) for i, _ in rows), key=key)


def test_empty_table(docs_of):
    assert run(docs_of([])) == []


def test_places_of_a_repeated_text_stay_bounded(monkeypatch):
    """A task full of copies holds few strings but many places: it flushes by either."""
    import numpy as np

    from quern.llm import substring_dedup as m
    from quern.llm.common import Words

    monkeypatch.setattr(m, "FOLD_BYTES", 200_000)
    data = " ".join(f"w{i}" for i in range(1000)).encode()
    folder = m._Folder(35, 12, 4)
    most = flushes = 0
    for i in range(300):
        w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        flushes += len(list(folder.add(w, np.array([i]), np.array([i]))))
        most = max(most, sum(sum(x.nbytes for x in part) for part in folder.where))
    assert flushes > 5 and most <= 400_000
