"""Language-model scoring (operator 3): interpolated modified Kneser-Ney, counted in Spark.

The model is a bigram model over all training tokens. Map tasks fold the bigrams of about FOLD tokens and send
them, packed by context bucket, straight to partitions; reducers add counts and write one shard per bucket to the
shared folder: the bigram hashes in order, their counts, the contexts in order and their totals and discount
classes. The distinct bigrams of each reducer feed a second, smaller exchange by successor, which gives the
continuation and token counts of unigrams. Workers memory-map the shards and look up sorted batches of hashes, so
no process holds the model, and its size follows the corpus.

Shards are written under a temporary name and renamed: a task that runs twice leaves the same file. Contexts are
spread by hash. A first pass counts tokens: those that make up more than one in BUCKETS * P of all, and the begin of
a text, are hot contexts, whose pairs are spread by successor as well; the few numbers that their probabilities need
are summed over the reducers and travel with the model (at most BUCKETS * P rows).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Words, heavy, local_path, mix64, new_path, ngram_hashes, reducers, small_batches, staged, text_buffer, trim
from quern.llm.substring_dedup import _pack, _unpack

#: Tokens that a map task folds at once; shards for each shuffle partition; bytes of text that are scored together.
FOLD, BUCKETS, SCORED = 1_500_000, 4, 6 << 20
BOS, END = np.uint64(0x51ED270B0F1C2D3E), np.uint64(0xA24BAED4963EE407)
_ROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("body", pa.binary())])
_OUT = "kind int, part int, body binary, n1 long, n2 long, n3 long, n4 long, types long, total long"
_OUT_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("body", pa.binary())] + [(k, pa.int64()) for k in ("n1", "n2", "n3", "n4", "types", "total")])


def sequences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with BOS and END around each text, and the index of each text's BOS."""
    size = w.counts + 2
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    out = np.empty(size.sum(), np.uint64)
    out[first] = BOS
    out[first + size - 1] = END
    out[np.arange(w.n) + 2 * w.doc + 1] = w.hashes()
    return out, first


def _fold_pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order of their hash: hash, first, second, added counts."""
    key = ngram_hashes_pair(a, b)
    order = np.argsort(key)
    key = key[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], a[order[head]], b[order[head]], np.add.reduceat(c[order], head)


def ngram_hashes_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0xD6E8FEB86659FD93) + mix64(b ^ np.uint64(0x2545F4914F6CDD1D)))


def bucket_of(a: np.ndarray, b: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each pair: by its context, pairs of hot contexts (sorted) by the successor too."""
    key = np.where(find(hot, a)[1], ngram_hashes_pair(a, b), a)
    return (mix64(key) % np.uint64(n)).astype(np.int64)


def _write(path: str, **arrays: np.ndarray) -> None:
    """One file: name, type and length of each array, then the arrays, 8-byte aligned; complete or absent."""
    head = ";".join(f"{k},{v.dtype.str},{v.size}" for k, v in arrays.items()).encode()
    head += b" " * (-(len(head) + 8) % 8)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            f.write(v.tobytes())
            f.write(b"\0" * (-v.nbytes % 8))
    os.replace(tmp, path)


class Shard:
    """A memory-mapped file of _write."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:8].tobytes(), "little")
        at = 8 + n
        for part in raw[8:at].tobytes().decode().strip().split(";"):
            name, kind, size = part.split(",")
            nbytes = int(size) * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + nbytes].view(kind))
            at += nbytes + -nbytes % 8


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted (in any order) in the sorted keys, and which are there."""
    if not keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.searchsorted(keys, wanted)
    at[at == keys.size] = 0
    return at, keys[at] == wanted


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts; 0.5, 1, 1.5 where they are undefined."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2 * n2)
        d = [k - (k + 1) * y * after / here for k, (here, after) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        if all(0 <= x <= k for k, x in enumerate(d, 1)):
            out[1:] = d
    return out


class KneserNey:
    """A trained model: where its shards are, and the few numbers that all lookups need."""

    def __init__(self, path: str, n_buckets: int, n_words: int, d2, d1, types: int, uni: tuple[int, int, int], vocabulary: int, tokens: int, hot: dict[str, np.ndarray]) -> None:
        self.hot = hot  # key (sorted contexts), total, c1, c2, c3
        self.path, self.n_buckets, self.n_words, self.d2, self.d1, self.types = path, n_buckets, n_words, d2, d1, types
        self.vocabulary, self.tokens = vocabulary, tokens
        self.gamma1 = float(d1[1] * uni[0] + d1[2] * uni[1] + d1[3] * uni[2]) / types if types else 1.0

    def _shard(self, kind: str, b: int) -> Shard | None:
        path = f"{self.path}/{kind}{b}"
        return Shard(path) if os.path.exists(path) else None

    def _by_bucket(self, bucket: np.ndarray, kind: str):
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for g in np.split(order, cuts):
            if g.size and (shard := self._shard(kind, int(bucket[g[0]]))) is not None:
                yield g, shard

    def unigrams(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token count and continuation probability of distinct token hashes."""
        raw, cont = np.zeros(tokens.size, np.int64), np.zeros(tokens.size, np.int64)
        for g, s in self._by_bucket((tokens % np.uint64(self.n_words)).astype(np.int64), "u"):
            at, there = find(s.key, tokens[g])
            raw[g], cont[g] = np.where(there, s.raw[at], 0), np.where(there, s.cont[at], 0)
        p = np.full(tokens.size, self.gamma1 / (self.vocabulary + 1))
        return raw, p + (np.maximum(cont - self.d1[np.minimum(cont, 3)], 0) / self.types if self.types else 0)

    def bigrams(self, a: np.ndarray, b: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of b after a, given the lower-order probability of b."""
        key = ngram_hashes_pair(a, b)
        c, total, gamma = np.zeros(a.size, np.int64), np.ones(a.size), np.ones(a.size)
        for g, s in self._by_bucket(bucket_of(a, b, self.hot["key"], self.n_buckets), "b"):
            at, there = find(s.key, key[g])
            got = np.where(there, s.count[at], 0).astype(np.int64)
            big = np.flatnonzero(there & (got == 255))
            if big.size:
                got[big] = s.big_count[np.searchsorted(s.big_at, at[big])]
            c[g] = got
            at, there = find(s.context, a[g])
            total[g] = np.where(there, s.total[at], 1)
            mass = self.d2[1] * s.c1[at] + self.d2[2] * s.c2[at] + self.d2[3] * s.c3[at]
            gamma[g] = np.where(there, mass / total[g], 1.0)
        at, there = find(self.hot["key"], a)
        if there.any():
            g, at = np.flatnonzero(there), at[there]
            total[g] = np.maximum(self.hot["total"][at], 1)
            mass = sum(self.d2[k] * self.hot[f"c{k}"][at] for k in (1, 2, 3))
            gamma[g] = np.where(self.hot["total"][at] > 0, mass / total[g], 1.0)
        return np.maximum(c - self.d2[np.minimum(c, 3)], 0) / total + gamma * lower

    def score(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base score and model score of each text."""
        seq, first = sequences(w)
        is_bos = np.zeros(seq.size, bool)
        is_bos[first] = True
        at = np.flatnonzero(~is_bos)
        distinct, inv = np.unique(seq, return_inverse=True)
        raw, p1 = self.unigrams(distinct)
        pair = inv[at - 1].astype(np.int64) * distinct.size + inv[at]
        pairs, back = np.unique(pair, return_inverse=True)
        left, right = pairs // distinct.size, pairs % distinct.size
        logp = np.log10(self.bigrams(distinct[left], distinct[right], p1[right]))[back]
        count = raw[inv[at]]
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        cut = first - np.arange(first.size)
        return w.counts + 1, np.add.reduceat((count > 0).astype(np.int64), cut), np.add.reduceat(base, cut), np.add.reduceat(logp, cut)


def hot_contexts(texts: DataFrame, share: int) -> np.ndarray:
    """BOS and the tokens that make up more than one in share of all tokens of texts (column t), sorted.

    Each task counts all its tokens, keeping those above a quarter of that share of what it has seen, which loses
    no token that is hot in the task; a token that is hot only in sum may be missed, which costs balance alone.
    """

    def work(batches):
        keys, n, total, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), 0, [], 0

        def fold(keys, n, keep):
            key, inv = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([n, np.ones(sum(map(len, held)))]), minlength=key.size).astype(np.int64)
            top = n > keep
            return key[top], n[top]

        for b in batches:
            held.append(Words(*text_buffer(b.column(0)), lower=True).hashes())
            size += held[-1].size
            total += held[-1].size
            if size > FOLD:
                keys, n = fold(keys, n, total // (4 * share))
                held, size = [], 0
        keys, n = fold(keys, n, total // (2 * share))
        key = pa.concat_arrays([pa.array(keys.view(np.int64)), pa.nulls(1, pa.int64())])
        yield pa.RecordBatch.from_arrays([key, pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(n.size, np.int64), total))], names=["key", "n", "total"])
        trim()

    found = heavy(staged(texts.mapInArrow(work, "key long, n long, total long"), "kn-tokens"), share)
    return np.sort(np.append(found.select("key").toArrow().column("key").to_numpy().view(np.uint64), BOS))


def train(rows: DataFrame, text_col: str = "text") -> KneserNey:
    """Count the texts of rows and write the model to the shared folder. Null texts count as empty."""
    spark = rows.sparkSession
    small_batches(spark)
    p = reducers(rows)
    nb = p * BUCKETS
    texts = rows.select(F.col(text_col).cast("string").alias("t"))
    hot = hot_contexts(texts, nb)
    where = new_path(spark, "kn")
    path = local_path(where)
    os.makedirs(path, exist_ok=True)

    def rows_of(bucket: np.ndarray, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        parts, buckets, bodies = [], [], []
        for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            b = int(bucket[g[0]])
            parts.append(b % p)
            buckets.append(b)
            bodies.append(_pack(**{k: v[g] for k, v in arrays.items()}))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], schema=_ROW)

    def fold(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            a, b = (np.concatenate(x) for x in zip(*held))
            _, a, b, c = _fold_pairs(a, b, np.ones(a.size, np.int64))
            order = np.argsort(a)  # equal contexts side by side compress away
            a, b, c = a[order], b[order], c[order].astype(np.uint32)
            return rows_of(bucket_of(a, b, hot, nb), {"a": a, "b": b, "c": c})

        for batch in batches:
            w = Words(*text_buffer(batch.column(0)), lower=True)
            seq, first = sequences(w)
            keep = np.ones(seq.size, bool)
            keep[first] = False
            at = np.flatnonzero(keep)
            for i in range(0, at.size, FOLD):
                part = at[i : i + FOLD]
                held.append((seq[part - 1], seq[part]))
                size += part.size
                if size >= FOLD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def groups(batches):
        held, now = [], None
        for batch in batches:
            for b, body in zip(batch.column("bucket").to_pylist(), batch.column("body")):
                if b != now and held:
                    yield now, held
                    held = []
                now = b
                held.append(_unpack(body.as_buffer()))
        if held:
            yield now, held

    def gather(held, kinds):
        return [np.concatenate([np.frombuffer(x[i], k) for x in held]) for i, k in enumerate(kinds)]

    def out(rows_):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], f.type) for i, f in enumerate(_OUT_SCHEMA)], schema=_OUT_SCHEMA)

    def of_counts(c: np.ndarray) -> list[int]:
        return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()

    def fold_words(held):
        word, cont, raw = (np.concatenate(x) for x in zip(*held))
        key, inv = np.unique(word, return_inverse=True)
        return key, np.bincount(inv, weights=cont).astype(np.uint32), np.bincount(inv, weights=raw).astype(np.uint64)

    def bigrams(batches):
        words = []  # of all buckets of this task, so that a task sends one row to each partition
        for b, held in groups(batches):
            a, nxt, c = gather(held, (np.uint64, np.uint64, np.uint32))
            key, a, nxt, c = _fold_pairs(a, nxt, c.astype(np.int64))
            context, inv = np.unique(a, return_inverse=True)
            small = np.minimum(c, 255).astype(np.uint8)
            big = np.flatnonzero(c >= 255)
            k = [np.bincount(inv[m], minlength=context.size).astype(np.uint32) for m in (c == 1, c == 2, c > 2)]
            total = np.bincount(inv, weights=c, minlength=context.size).astype(np.uint64)
            _write(f"{path}/b{b}", key=key, context=context, total=total, big_at=big, big_count=c[big], c1=k[0], c2=k[1], c3=k[2], count=small)
            word, w_inv = np.unique(nxt, return_inverse=True)
            words.append((word, np.bincount(w_inv), np.bincount(w_inv, weights=c)))
            if len(words) > 4:
                words = [fold_words(words)]
            shares = np.flatnonzero(find(hot, context)[1])
            yield out([(0, -1, None, *of_counts(c), c.size, int(c.sum()))] + [(3, -1, context[i].tobytes(), int(k[0][i]), int(k[1][i]), int(k[2][i]), 0, 0, int(total[i])) for i in shares])
        if words:
            word, cont, raw = fold_words(words)
            sent = rows_of((word % np.uint64(p)).astype(np.int64), {"word": word, "cont": cont, "raw": raw})
            yield out([(1, bk, body, 0, 0, 0, 0, 0, 0) for bk, body in zip(sent.column(1).to_pylist(), sent.column(2).to_pylist())])
        trim()

    def unigrams(batches):
        for b, held in groups(batches):
            key, cont, raw = fold_words([gather(held, (np.uint64, np.uint32, np.uint64))])
            cont = cont.astype(np.int64)
            _write(f"{path}/u{b}", key=key, cont=cont.astype(np.uint32), raw=raw.astype(np.int64))
            yield out([(2, -1, None, *of_counts(cont), key.size, int((cont > 2).sum()))])

    counted = texts.mapInArrow(fold, "part int, bucket int, body binary")
    counted = counted.repartitionById(p, F.col("part")).sortWithinPartitions("bucket").select("bucket", "body").mapInArrow(bigrams, _OUT)
    counted = staged(counted, "kn-unigrams")
    words = counted.filter("kind = 1").select(F.col("part").alias("bucket"), "body")
    words = words.repartitionById(p, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(unigrams, _OUT)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "types", "total")]
    one = words.agg(*sums).first()  # writes the shards
    two = counted.filter("kind = 0").agg(*sums).first()
    sums = [F.sum(c).alias(c) for c in ("n1", "n2", "n3", "total")]
    shares = {int.from_bytes(r.body, "little"): r for r in counted.filter("kind = 3").groupBy("body").agg(*sums).collect()}  # one row per hot context
    hot_rows = {"key": hot} | {name: np.array([getattr(shares.get(k), column, 0) for k in hot.tolist()], np.float64) for name, column in (("total", "total"), ("c1", "n1"), ("c2", "n2"), ("c3", "n3"))}
    return KneserNey(path, nb, p, discounts(two.n1, two.n2, two.n3, two.n4), discounts(one.n1, one.n2, one.n3, one.n4), two.types, (one.n1, one.n2, one.total), one.types, two.total, hot_rows)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7) -> DataFrame:
    """Score every text of docs by a model of those outside the held-out fold (crc32 of the id as text, mod folds).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), perplexity.
    Null texts are empty and have one token, the end. A null id counts as the empty string for the fold. Repeated
    rows are scored, and counted, once each. Where nothing is left to learn from, every token is unknown. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    rest = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))) % folds
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), (rest == fold).alias("held_out"))
    model = train(rows.filter(~F.col("held_out")))

    def score(batches):
        def answer(held):
            b = pa.concat_batches(held)
            n, known, base, s = model.score(Words(*text_buffer(b.column("text")), lower=True))
            columns = [b.column("doc_id"), b.column("held_out"), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(n.size, model.tokens, np.int64)), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

        held, size = [], 0  # texts scored together open each shard once
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.column("text").nbytes
            if size > SCORED:
                yield answer(held)
                held, size = [], 0
        if held:
            yield answer(held)

    return rows.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
