import math
from collections import defaultdict

import numpy as np
from llm_helpers import corpus, prose

from quern.llm import minhash_dedup as mh


def sets(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    s = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            inter = len(s[a] & s[b])
            if s[a] and s[b] and 100 * inter >= 75 * (len(s[a]) + len(s[b]) - inter):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)].append(d)
    return sorted(((d, len(s[i]), min(least[top(i)], default=None)) if s[i] else (d, 0, d) for i, (d, _) in enumerate(rows)), key=str)


def run(df):
    out = mh.near_groups(df).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def variants(seed, n, base=100, edits=12):
    import random

    r = random.Random(seed)
    words = prose(seed, base).split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randrange(edits)):
            w[r.randrange(base)] = f"edit{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_all_cases(docs_of):
    rows = corpus()
    assert run(docs_of(rows)) == brute(rows)


def test_chains_of_edits_split_and_meet(docs_of, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 8)
    rows = [(i, t) for i, t in enumerate(variants(1, 60) + variants(2, 40, 60, 6) + variants(3, 30, 200, 20))]
    assert run(docs_of(rows)) == brute(rows)


def test_wide_buckets_meet_by_rare_shingles(docs_of, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 4)
    monkeypatch.setattr(mh, "WIDE", 6)
    met = []
    rare = mh._rare_keys
    monkeypatch.setattr(mh, "_rare_keys", lambda texts: met.append(1) or rare(texts))
    page = prose(7, 120)  # pages of one template, below the threshold to each other, some with a near copy
    rows = [(i, f"{page} {prose(500 + i, 50)}") for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ", 3) + " and more") for i in range(0, 40, 4)]
    rows += [(200 + i, t) for i, t in enumerate(variants(1, 60) + variants(3, 30, 200, 20))]
    assert run(docs_of(rows)) == brute(rows) and met


def test_rows_repeated_so_often_that_their_key_is_hot(docs_of):
    rows = [(i, t) for i, t in enumerate(variants(5, 20, 80, 5))]
    rows += [rows[3]] * 1500 + [(None, None)] * 1500 + [(30, "only once here")] + [(40 + i, "many ids of one text") for i in range(1500)]
    d = docs_of(rows)
    assert run(d) == brute_of_distinct(rows)
    kept = mh.drop_near_copies(d).collect()
    least = {c for _, n, c in brute_of_distinct(rows) if n}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least) and sum(r.doc_id is None for r in kept) == 1500


def brute_of_distinct(rows):
    """brute over distinct texts, for inputs with many equal rows."""
    first, texts = {}, {}
    for i, t in rows:
        texts.setdefault(t, []).append(i)
    rep = [(min((i for i in ids if i is not None), default=None), t) for t, ids in texts.items()]
    for (_, n, c), (_, t) in zip(*(sorted(x, key=str) for x in (brute(rep), rep))):
        first[t] = (n, c)
    return sorted(((i, first[t][0], first[t][1] if first[t][0] else i) for i, t in rows), key=str)


def test_empty_table_and_no_words(docs_of):
    assert run(docs_of([])) == []
    assert run(docs_of([(1, None), (2, ""), (3, " ")])) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_drop_keeps_one_of_each_component(docs_of):
    rows = [(i, t) for i, t in enumerate(variants(5, 20, 80, 5))] + [(50, None), (51, "a b"), (52, "A  B")]
    d = docs_of(rows)
    out = mh.drop_near_copies(d)
    assert out.columns == d.columns
    want = {c for _, n, c in brute(rows) if n} | {i for i, n, _ in brute(rows) if not n}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_signatures_estimate_similarity_and_bounds_hold():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    s = mh.signatures([np.concatenate([both, a]), np.concatenate([both, b])], 400)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.08
    steps = mh.least_matches(200)
    assert all(m1 < m2 for (_, m1), (_, m2) in zip(steps, steps[1:])) and all(m < 0.75 * n for n, m in steps)


def test_pairs_at_the_threshold_are_not_pruned(docs_of):
    # 60 of 80 shingles are common and a band agrees, but few of the first minima do: bounds at posterior 1e-4 prune all four.
    rows = []
    for seed in (6252, 8321, 8678, 9767):
        w = [f"w{seed}x{i}" for i in range(84)]
        rows += [(2 * seed, " ".join(w[:74])), (2 * seed + 1, " ".join(w[:64] + w[74:]))]
    assert run(docs_of(rows)) == brute(rows)


def test_a_pair_at_the_threshold_is_missed_as_rarely_as_stated():
    t = mh.PERCENT / 100
    now, done = {(0, False): 1.0}, 0  # (matches, whether a band agrees): probability, over independent hashes
    for n, least in mh.least_matches(mh.BANDS * mh.ROWS):
        for _ in range((n - done) // mh.ROWS):
            then = {}
            for (m, band), q in now.items():
                for k in range(mh.ROWS + 1):
                    key = (m + k, band or k == mh.ROWS)
                    then[key] = then.get(key, 0) + q * math.comb(mh.ROWS, k) * t**k * (1 - t) ** (mh.ROWS - k)
            now = then
        now, done = {k: q for k, q in now.items() if k[0] >= least}, n
    assert 1 - sum(q for (_, band), q in now.items() if band) < 2.5e-5
