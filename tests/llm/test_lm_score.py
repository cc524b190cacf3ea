import math
import zlib
from collections import Counter, defaultdict

import pytest
from llm_helpers import corpus, prose

from quern.llm.lm_score import discounts, lm_scores


def brute(rows):
    docs = [(i, (t or "").encode().lower().split(), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in rows]
    big, uni = Counter(), Counter()
    for _, w, held in docs:
        if not held:
            q = ["<s>", *w, "</s>"]
            big.update(zip(q, q[1:]))
            uni.update(q[1:])
    n, v = sum(uni.values()), len(uni)
    cont, total, kinds = Counter(b for _, b in big), Counter(), defaultdict(lambda: [0] * 4)
    for (a, _), c in big.items():
        total[a] += c
        kinds[a][min(c, 3)] += 1

    def d(counts):
        c = Counter(counts)
        return discounts(c[1], c[2], c[3], c[4])

    d2, d1 = d(big.values()), d(cont.values())
    gamma = sum(d1[min(c, 3)] for c in cont.values()) / len(big) if big else 1.0
    out = []
    for i, w, held in docs:
        q = ["<s>", *w, "</s>"]
        score = base = known = 0
        for a, b in zip(q, q[1:]):
            p = (max(cont[b] - d1[min(cont[b], 3)], 0) / len(big) if big else 0) + gamma / (v + 1)
            if a in total:
                c = big[(a, b)]
                p = max(c - d2[min(c, 3)], 0) / total[a] + sum(d2[k] * kinds[a][k] for k in (1, 2, 3)) / total[a] * p
            score += math.log10(p)
            base += math.log10((uni[b] + 1) / (n + v + 1))
            known += b in uni
        out.append((i, held, len(q) - 1, known, n, base, score))
    return out


def check(rows, df):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scores(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_all_cases(docs_of):
    rows = corpus() + [(100 + i, prose(i % 9, 60)) for i in range(40)]
    check(rows, docs_of(rows))


def test_nothing_to_learn_from(docs_of):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = [(i, "a b a") for i in held]
    check(rows, docs_of(rows))


def test_empty_table(docs_of):
    assert lm_scores(docs_of([])).collect() == []


def test_probabilities_of_a_context_add_up(docs_of, spark):
    import numpy as np

    from quern.llm.common import Words, hash_words, text_buffer
    from quern.llm.lm_score import END, train
    import pyarrow as pa

    texts = [prose(i, 40) for i in range(12)]
    m = train(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = sorted({w for t in texts for w in t.split()}) + ["never-seen"]
    w = Words(*text_buffer(pa.array([" ".join(words)])))
    h = np.append(hash_words(w.a, w.starts, w.ends), END)
    _, p1 = m.unigrams(h)
    assert p1.sum() == pytest.approx(1.0)
    for context in h[:5]:
        assert m.bigrams(np.full(h.size, context), h, p1).sum() == pytest.approx(1.0)
