"""Count-only Viterbi tokenisation with a unigram vocabulary (operator 2).

An Aho-Corasick automaton over the vocabulary enumerates every piece that ends at each character; dynamic
programming carries the best score and its number of pieces, never the pieces, and only as far back as the longest
piece reaches. Ties follow the public unigram tokenizers: candidates come by ascending start and replace the best
only if strictly better, so of equal paths the one with the longest last piece stays. A character that is no piece
by itself costs the least score of the vocabulary minus 10; with byte fallback it counts as its UTF-8 bytes, else
consecutive ones count as one.

A space starts a new segment (as the mark U+2581), and no piece crosses a segment's start, so a text's count is the
sum over its segments; equal short segments are computed once for each worker, in a cache of bounded size.

No public unigram vocabulary is installed where this was built. The default file, piece_bpe_32k.model, is a BPE
vocabulary whose scores (minus the merge rank) are read as unigram scores: the counts are those of a unigram
tokenizer with that table, not those of the BPE tokenizer that the file belongs to. Pass path or vocabulary for
another one.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import load_tokenizer_path, small_batches, trim

MARK, UNK_PENALTY = "▁", 10.0
#: Segments kept by each worker, and the longest kept, so the cache is bounded in bytes too.
CACHE, CACHE_CHARS = 500_000, 48


class UnigramCounter:
    """Counts pieces of a vocabulary given as (piece, score) pairs."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, least: float | None = None) -> None:
        self.byte_fallback = byte_fallback
        self.unk = (min(s for _, s in vocabulary) if least is None else least) - UNK_PENALTY
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.single = {p: s for p, s in vocabulary if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in vocabulary:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[int, float]] = {}

    def segment(self, x: str) -> tuple[int, float]:
        """(pieces, best score) of one segment. Rings of the longest piece's length hold the state."""
        ring = self.longest + 1
        best, count, unknown = [0.0] * ring, [0] * ring, [False] * ring
        single, byte_fallback = self.single, self.byte_fallback
        hits: list[tuple[int, float]] = []
        matches = self.automaton.iter(x)
        at_end, hit = next(matches, (-1, None))
        for e, ch in enumerate(x, 1):
            hits.clear()
            while at_end == e - 1:
                hits.append(hit)
                at_end, hit = next(matches, (-1, None))
            if len(hits) > 1:
                hits.sort(reverse=True)  # by ascending start
            score, at = None, 0
            for size, s in hits:
                s += best[(e - size) % ring]
                if score is None or s > score:
                    score, at = s, (e - size) % ring
            fresh = False
            if ch not in single:
                s = self.unk + best[(e - 1) % ring]
                if score is None or s > score:
                    score, at, fresh = s, (e - 1) % ring, True
            if not fresh:
                n = count[at] + 1
            elif byte_fallback:
                n = count[at] + len(ch.encode("utf-8", "surrogatepass"))
            else:
                n = count[at] + (0 if unknown[at] else 1)
            i = e % ring
            best[i], count[i], unknown[i] = score, n, fresh
        return count[len(x) % ring], best[len(x) % ring]

    def text(self, text: str | None) -> tuple[int, float, int]:
        """(pieces, best score, segments) of a text; null and empty texts have none."""
        if not text:
            return 0, 0.0, 0
        t = text.replace(" ", MARK)
        parts = (t[1:] if t[0] == MARK else t).split(MARK)
        cache = self.cache
        n, total = 0, 0.0
        for p in parts:
            got = cache.get(p)
            if got is None:
                got = self.segment(MARK + p)
                if len(p) <= CACHE_CHARS:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[p] = got
            n += got[0]
            total += got[1]
        return n, total, len(parts)


@lru_cache
def sentencepiece_counter(path: str) -> UnigramCounter:
    """A counter over the ordinary pieces of a sentencepiece file, read as a unigram vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return UnigramCounter(plain, byte_fallback=any(sp.is_byte(i) for i in ids), least=min(sp.get_score(i) for i in ids))


def token_counts(docs: DataFrame, path: str | None = None, vocabulary: list[tuple[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, score (of the best path), n_segments, n_bytes.

    vocabulary, as (piece, log probability) pairs with byte fallback, goes before path, a sentencepiece file; see the
    note on the default file above. Null and empty texts have zero tokens. Null ids and repeated rows are counted like any other; other columns are
    ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    path = path or (None if vocabulary else load_tokenizer_path("piece_bpe_32k.model"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def work(batches):
        counter = UnigramCounter(vocabulary) if vocabulary else sentencepiece_counter(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [counter.text(t) for t in texts]
            size = np.array([len(t.encode()) if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), pa.array(size)],
                names=["doc_id", "n_tokens", "score", "n_segments", "n_bytes"],
            )
        trim()

    return rows.mapInArrow(work, "doc_id long, n_tokens long, score double, n_segments long, n_bytes long")
