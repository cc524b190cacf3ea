"""Substring dedup by super-k-mers (operator 1).

A window is WINDOW consecutive words. Each window has a minimiser, the least hash of the m-word grams inside it;
consecutive windows that share one travel as a single packed string to the minimiser's bucket, so a word is sent
about three times instead of WINDOW times. Inside a bucket, sorting counts the windows: equal strings fold first,
then windows are sorted by hash and neighbours are compared word for word.

Shuffled rows are whole buckets of one map batch, compressed; they are addressed to partitions directly. Strings
that repeat inside a map batch are folded before the shuffle: their windows are known to repeat, so they go once,
marked, without their places. A passage that a third of all documents share therefore costs its bucket one string
for each map batch. Minimisers are taken from frequent grams last: a first pass over all texts counts grams by
slots of their hash, and grams of slots that hold more than one in 16 * buckets of all of them rank behind all
others. A common word group therefore draws windows only where nothing rarer is near, and its bucket is spread over
those of its neighbours. The order decides only where windows meet, never what is counted. What comes back is one row for each repeated stretch, joined to the texts by (id, text hash).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Words, hash_words, heavy, keyed, mix64, ngram_hashes, reducers, sliding_min, small_batches, staged, text_buffer, trim
from quern.operators.skew import hot_join

WINDOW, GRAM = 35, 4
#: Bytes of distinct strings that a map task folds before it sends them; words looked at together.
FOLD_BYTES, SEGMENT = 32 << 20, 1 << 18
#: Buckets for each shuffle partition; a reducer holds one bucket at a time. Bits of a gram's slot.
BUCKETS, SLOT_BITS = 4, 22

_PACKED = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
_STRETCH = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _pack(**arrays: np.ndarray | bytes) -> bytes:
    out = []
    for v in arrays.values():
        raw = v if isinstance(v, bytes) else v.tobytes()
        out += [len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(body: bytes) -> list[bytes]:
    raw, out, i = zstandard.ZstdDecompressor().decompress(body), [], 0
    while i < len(raw):
        n = int.from_bytes(raw[i : i + 8], "little")
        out.append(raw[i + 8 : i + 8 + n])
        i += 8 + n
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def ranks(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The order of grams as minimisers: by hash, those of frequent slots (sorted) behind all others."""
    if not frequent.size:
        return grams
    slot = _slots(grams)
    at = np.minimum(np.searchsorted(frequent, slot), frequent.size - 1)
    return (grams >> np.uint64(1)) | ((frequent[at] == slot).astype(np.uint64) << np.uint64(63))


def frequent_slots(texts: DataFrame, gram: int, share: int) -> np.ndarray:
    """Slots with more than one in share of all grams of texts (column text): fewer than share, whatever the data.

    Each task counts all its grams and sends the slots that reach half that share of its own.
    """

    def work(batches):
        counts, held, size, total = np.zeros(1 << SLOT_BITS, np.int64), [], 0, 0

        def add():
            slot, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            counts[slot] += n

        for b in batches:
            held.append(_slots(ngram_hashes(Words(*text_buffer(b.column("text"))).hashes(), gram)))
            size += held[-1].size
            total += held[-1].size
            if size > 1 << 20:
                add()
                held, size = [], 0
        add()
        top = np.flatnonzero(counts > max(total / (2 * share), 3))
        n = counts[top].astype(np.int64)
        key = pa.concat_arrays([pa.array(top, pa.int64()), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([key, pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(n.size, np.int64), total))], names=["key", "n", "total"])
        trim()

    found = heavy(staged(texts.select("text").mapInArrow(work, "key long, n long, total long"), "grams"), share)
    return np.sort(found.select("key").toArrow().column("key").to_numpy())


class _Folder:
    """Super-k-mers of a map task: distinct strings, and the places of those seen once or more."""

    def __init__(self, window: int, gram: int, parts: int, frequent: np.ndarray = np.empty(0, np.int64)) -> None:
        self.window, self.gram, self.parts, self.n_buckets = window, gram, parts, parts * BUCKETS
        self.frequent = frequent
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.bytes, self.places, self.mins, self.where = 0, 0, [], []

    def add(self, w: Words, k1: np.ndarray, k2: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, h = self.window, w.hashes()
        for lo in range(0, max(w.n - n + 1, 0), SEGMENT):
            hi = min(lo + SEGMENT, w.n - n + 1)
            part = h[lo : hi + n - 1]
            least = sliding_min(ranks(ngram_hashes(part, self.gram), self.frequent), n - self.gram + 1)
            doc = w.doc[lo : hi + n - 1]
            valid = doc[: hi - lo] == doc[n - 1 :]
            edge = np.ones(hi - lo + 1, bool)
            edge[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
            cut = np.flatnonzero(edge)
            use = valid[cut[:-1]]
            first, last = cut[:-1][use], cut[1:][use] - 1
            if not first.size:
                continue
            starts, ends = w.starts[lo + first].tolist(), w.ends[lo + last + n - 1].tolist()
            buf, index, strings = w.buf, self.index, self.strings
            at = np.empty(first.size, np.int64)
            fresh = []
            for i, (s, e) in enumerate(zip(starts, ends)):
                x = buf[s:e]
                j = index.get(x)
                if j is None:
                    j = index[x] = len(strings)
                    strings.append(x)
                    self.bytes += e - s
                    fresh.append(i)
                at[i] = j
            self.mins.append(least[first[fresh]])
            d = doc[first]
            word = lo + first - w.first[d]
            self.where.append((at, k1[d], k2[d], word, word + last - first + n))
            self.places += at.size
            # Places grow for strings already held too: 40 bytes each.
            if self.bytes > FOLD_BYTES or self.places * 40 > FOLD_BYTES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.strings:
            return
        at, k1, k2, s, e = (np.concatenate(x) for x in zip(*self.where))
        seen = np.bincount(at, minlength=len(self.strings))
        again = seen[at] > 1
        bucket = (mix64(np.concatenate(self.mins)) % np.uint64(self.n_buckets)).astype(np.int64)
        # The one place of each string that was seen once, by string.
        once = np.full(len(self.strings), -1)
        single = np.flatnonzero(~again)
        once[at[single]] = single
        parts, buckets, bodies = [], [], []
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for group in np.split(order, cuts):
            b = int(bucket[group[0]])
            p = once[group]
            body = b"\n".join([self.strings[i] for i in group.tolist()]) + b"\n"
            bodies.append(_pack(t=body, m=(p < 0), k1=k1[p], k2=k2[p], s=s[p]))
            parts.append(b % self.parts)
            buckets.append(b)
        if again.any():
            order = np.flatnonzero(again)
            # Stretches already known to repeat pass through; they go where the least strings go.
            for i in range(0, order.size, 1 << 18):
                g = order[i : i + (1 << 18)]
                bodies.append(_pack(k1=k1[g], k2=k2[g], s=s[g], e=e[g]))
                parts.append(int(mix64(k2[g[:1]].astype(np.uint64))[0] % np.uint64(self.parts)))
                buckets.append(-1)
        self.clear()
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], schema=_PACKED)


def _count(bodies: list[list[bytes]], n: int) -> tuple[np.ndarray, ...]:
    """(k1, k2, start, end) of the repeated stretches of one bucket; places that need no answer are left out."""
    lines: dict[bytes, int] = {}
    at, multi, k1, k2, s = [], [], [], [], []
    for text, m, a, b, c in bodies:
        at += [lines.setdefault(x, len(lines)) for x in text[:-1].split(b"\n")]
        for out, raw, kind in ((multi, m, bool), (k1, a, np.int64), (k2, b, np.int64), (s, c, np.int64)):
            out.append(np.frombuffer(raw, kind))
    at = np.asarray(at)
    multi, k1, k2, s = (np.concatenate(x) for x in (multi, k1, k2, s))
    weight = np.bincount(at, weights=1 + multi, minlength=len(lines)).astype(np.int64)
    buf = b"\n".join(lines) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    gap = np.flatnonzero((a == 32) | (a == 10))
    ends = gap
    starts = np.concatenate([[0], gap[:-1] + 1])
    line = np.concatenate([[0], np.cumsum(a[gap] == 10)[:-1]])
    h = ngram_hashes(hash_words(a, starts, ends), n)
    win = np.flatnonzero(line[: h.size] == line[n - 1 :])  # windows inside one line
    h, line_of = h[win], line[win]
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    head = np.flatnonzero(new)
    total = np.add.reduceat(weight[line_of[order]], head)
    size = np.diff(np.append(head, order.size))
    repeated = np.zeros(win.size, bool)
    w_start, w_end = starts[win], ends[win + n - 1]
    for g in np.flatnonzero((total > 1) & (size > 1)):
        members = order[head[g] : head[g] + size[g]]
        texts = [buf[w_start[i] : w_end[i]] for i in members]
        if texts.count(texts[0]) == len(texts):
            repeated[members] = True
        else:  # one hash for different windows: count each
            tally: dict[bytes, int] = {}
            for i, x in zip(members, texts):
                tally[x] = tally.get(x, 0) + int(weight[line_of[i]])
            repeated[members] = [tally[x] > 1 for x in texts]
    repeated |= weight[line_of] > 1
    # Stretches of repeated windows in each distinct line, then for each place of that line.
    first_win = np.searchsorted(line_of, np.arange(len(lines)))
    flag = np.concatenate([[False], repeated, [False]])
    border = np.concatenate([[True], line_of[1:] != line_of[:-1], [True]])
    begin = np.flatnonzero(flag[1:-1] & (~flag[:-2] | border[:-1]))
    stop = np.flatnonzero(flag[1:-1] & (~flag[2:] | border[1:]))
    own = line_of[begin]
    lo, hi = begin - first_win[own], stop - first_win[own] + n
    ask = np.flatnonzero(~multi)
    left, right = np.searchsorted(own, at[ask]), np.searchsorted(own, at[ask], side="right")
    reps = right - left
    who = np.repeat(ask, reps)
    which = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(left, reps)
    return k1[who], k2[who], s[who] + lo[which], s[who] + hi[which]


def repeated_stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 (row key), s, e: word ranges covered by windows that start at more than one place of the corpus."""
    spark = docs.sparkSession
    small_batches(spark)
    p = reducers(docs)
    texts = keyed(docs, id_col, text_col).select("k1", "k2", "text")
    frequent = frequent_slots(texts, gram, 16 * p * BUCKETS)

    def fold(batches):
        f = _Folder(window, gram, p, frequent)
        for b in batches:
            w = Words(*text_buffer(b.column("text")))
            yield from f.add(w, b.column("k1").to_numpy(), b.column("k2").to_numpy())
            trim()
        yield from f.flush()
        trim()

    def count(batches):
        held: list[list[bytes]] = []
        bucket = None

        def out(a):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in a], schema=_STRETCH)

        for batch in batches:
            for b, body in zip(batch.column("bucket").to_pylist(), batch.column("body")):
                if b != bucket and held:
                    yield out(_count(held, window))
                    held = []
                    trim()
                bucket = b
                parts = _unpack(body.as_buffer())
                if b < 0:
                    yield out([np.frombuffer(x, np.int64) for x in parts])
                else:
                    held.append(parts)
        if held:
            yield out(_count(held, window))
        held = []
        trim()

    rows = texts.mapInArrow(fold, "part int, bucket int, body binary")
    rows = rows.repartitionById(p, F.col("part")).sortWithinPartitions("bucket")
    return rows.select("bucket", "body").mapInArrow(count, "k1 long, k2 long, s long, e long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, text (the kept words joined by one space).

    Every word covered by a window whose word sequence also starts anywhere else goes; windows are judged on the
    input. Null and empty texts have no words. Rows that repeat id and text are separate rows, so their windows
    repeat. Other columns are ignored.
    """
    found = repeated_stretches(docs, window, gram, id_col, text_col)
    found = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("cut"), F.count(F.lit(1)).alias("_n"))
    # A row that is there k times gives each stretch k times.
    found = staged(found.select("k1", "k2", "cut", F.ceil(F.col("_n") / F.size("cut")).alias("_n")), "stretches")
    rows = hot_join(keyed(docs, id_col, text_col), found, ["k1", "k2"], "_n", "left", merge=True).select("doc_id", "text", "cut.s", "cut.e")

    def keep(batches):
        for b in batches:
            ids, total, removed, digest, texts = b.column("doc_id"), [], [], [], []
            for text, s, e in zip(b.column("text").to_pylist(), b.column("s").to_pylist(), b.column("e").to_pylist()):
                words = (text or "").encode().split()
                n = len(words)
                if s:
                    kept, done = [], 0
                    for i, j in zip(s, e):
                        kept += words[done:i] if i > done else []
                        done = max(done, j)
                    words = kept + words[done:]
                text = b" ".join(words)
                total.append(n)
                removed.append(n - len(words))
                digest.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
            )

    return rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(len(w) - 34)) AS p FROM d WHERE len(w) >= 35),
win AS (SELECT rid, p, array_to_string(w[p + 1 : p + 35], ' ') AS x FROM p),
again AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
hit AS (SELECT rid, list(p) AS ps FROM win JOIN again USING (x) GROUP BY rid),
cov AS (SELECT rid, list_sort(list(DISTINCT q)) AS cut FROM (SELECT rid, unnest(flatten(list_transform(ps, lambda a: range(a, a + 35)))) AS q FROM hit) GROUP BY rid),
keep AS (SELECT rid, list(word ORDER BY i) AS kept FROM (SELECT d.rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT rid, unnest(cut) AS q FROM cov) c WHERE c.rid = x.rid AND c.q = x.i) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(len(cut), 0) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN cov USING (rid) LEFT JOIN keep USING (rid)
"""
