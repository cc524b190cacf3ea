import zlib

import numpy as np
import pytest
from llm_helpers import corpus, prose

from quern.llm import packing
from quern.llm.common import load_tokenizer_path

PATH, RANKS = load_tokenizer_path("byte_bpe_50k.json"), load_tokenizer_path("byte_bpe_50k.tiktoken")


def check(rows, df, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows]
    raw = packing.pack(df, window)
    got = raw.collect()
    dig = {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.digest(raw).collect()}
    by_doc, seqs = {}, {}
    for r in got:
        a = np.frombuffer(r.ids, "<u4")
        assert a.size == r.length and dig[(r.sequence_id, r.offset)] == zlib.crc32(r.ids)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, a.tolist()))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    # Every row's ids come back whole, repeated rows as often as they are there.
    want, have = sorted((str(i), x) for (i, _), x in zip(rows, ids)), []
    for (i, n), pieces in by_doc.items():
        pieces.sort(key=lambda p: p[0])
        copies = sum(s == 0 for s, _ in pieces)
        if copies == 1:
            assert [s for s, _ in pieces] == np.cumsum([0] + [len(a) for _, a in pieces])[:-1].tolist()
            have.append((str(i), [y for _, a in pieces for y in a]))
        else:
            assert sum(len(a) for _, a in pieces) == copies * n
            have += [(str(i), x) for (j, _), x in zip(rows, ids) if j == i and len(x) == n]
    assert sorted(have) == want
    fill = []
    for pieces in seqs.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [m for _, m in pieces])[:-1].tolist()
        fill.append(sum(m for _, m in pieces))
    assert max(fill) <= window and sum(f < window for f in fill) <= 1
    return fill


def test_all_cases(docs_of):
    rows = corpus() + [(80, "a <|endoftext|> b"), (81, "<|endoftext|>" * 3), (82, "<|endoftext|"), (83, "漢 <|endoftext|>")]
    check(rows, docs_of(rows))


def test_added_tokens_are_those_of_the_file_or_plain_text():
    texts = ["a <|endoftext|> b"]
    assert packing.encode(texts, PATH, RANKS)[0].tolist() == [64, 220, 50256, 275, 1]
    assert 50256 not in packing.encode(texts, PATH, RANKS, plain_specials=True)[0].tolist()


def test_small_window_uses_combinations(docs_of):
    rows = [(i, prose(i, 2 + i % 9)) for i in range(300)]
    check(rows, docs_of(rows, 4), 64)


def test_empty_table(docs_of):
    assert packing.pack(docs_of([])).collect() == []


def test_both_encoders_agree():
    import random

    r = random.Random(3)
    texts = ["".join(chr(r.choice([32, 10, 9, 0xA0, 0x85, *range(33, 0x250)])) for _ in range(60)) for _ in range(400)] + ["<|endoftext|> it's we'll", "漢字 ١٢   🙂 á", None, ""]
    for plain in (False, True):
        a, b = packing.encode(texts, PATH, plain_specials=plain), packing.encode(texts, PATH, RANKS, plain_specials=plain)
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_nnls_solves_and_plan_places_every_rest_once():
    rng = np.random.default_rng(1)
    hist = np.zeros(65, np.int64)
    hist[1:64] = rng.integers(0, 400, 63)
    cols = packing.combinations(64, np.flatnonzero(hist))
    assert (cols.sum(axis=1) == 64).all() and len({tuple(c) for c in cols.tolist()}) == len(cols)
    truth = np.zeros(len(cols))
    truth[::97] = 10
    made = sum(np.bincount(cols[:, k], weights=truth, minlength=65) for k in range(3))
    for grow in (20, 5000):  # from a small working set too, every column is reached
        x = packing.nnls(cols, made, 3000, grow, 1e-4)
        back = sum(np.bincount(cols[:, k], weights=x, minlength=65) for k in range(3))
        assert (x >= 0).all() and np.abs(back - made)[1:].max() < 0.5
    plan = packing.Plan(hist, 64)
    assert plan.used.sum() > 0.7 * hist.sum()
    used = np.zeros((plan.n_combined + plan.n_rest, 64), int)
    for n in range(1, 64):
        for k in range(hist[n]):
            for s, o, m in plan.place(n, k):
                used[s, o : o + m] += 1
    assert used.max() == 1 and (used[: plan.n_combined] == 1).all() and (used.sum(axis=1) == 64)[:-1].all()


@pytest.mark.parametrize("h", [np.zeros(9, np.int64), np.eye(1, 9, 8, dtype=np.int64)[0]])
def test_plan_of_nothing_to_combine(h):
    assert packing.Plan(h, 8).n_combined == 0
