import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.common import Words, hash_words, ngram_hashes, sliding_min, text_buffer

TEXT = st.text(alphabet=st.sampled_from("abAB \t\n\r\x0b\x0cé漢\x00"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.booleans())
def test_words_are_those_of_the_rule(texts, lower):
    w = Words(*text_buffer(pa.array(texts, pa.string())), lower=lower)
    want = [(t or "").encode() for t in texts]
    want = [(t.lower() if lower else t).split() for t in want]
    got = [[w.buf[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == want and w.counts.tolist() == [len(x) for x in want]
    h, flat = w.hashes(), [x for ws in want for x in ws]
    seen = {}
    for x, k in zip(flat, h.tolist()):
        assert seen.setdefault(x, k) == k
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 40))
def test_ngrams_and_sliding_minima(xs, n):
    h = np.array(xs, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = ngram_hashes(h, n)
    assert g.size == max(0, len(xs) - n + 1)
    seen = {}
    for i, k in enumerate(g.tolist()):
        assert seen.setdefault(tuple(xs[i : i + n]), k) == k
    assert len(set(seen.values())) == len(seen)
    if len(xs) >= n:
        assert sliding_min(h, n).tolist() == [min(h[i : i + n].tolist()) for i in range(len(xs) - n + 1)]


def test_hashes_do_not_depend_on_place():
    a = np.frombuffer(b"word " * 300_000 + b"x" * 3_000_000 + b" word", np.uint8)
    w = Words(a, np.array([0, a.size]))
    h = w.hashes()
    assert len(set(h.tolist())) == 2 and h[0] == h[-1]
    assert hash_words(w.a, w.starts[5:9], w.ends[5:9]).tolist() == h[5:9].tolist()
