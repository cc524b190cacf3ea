"""Target-distribution importance resampling (operator 13).

Every run of 1 to n words falls into a bucket by CRC-32. Two arrays count the buckets of the documents and of the
target texts; their log ratio is a bucket's gain, and a document's weight is the mean gain of its features. Gumbel
noise from a hash of seed and id makes a draw without replacement a choice of the highest scores.

The draw is an external merge. A histogram of the scores (whole numbers in a range that counts of 64 bits and the
noise bound to some 140,000 values) gives the score below which nothing is drawn; only rows from there on move. Each
task sorts its share into runs and cuts them at sampled splitters; a merge task gets the pieces of all runs of one
range and merges them by a tournament tree, whose ranks start at the number of rows before the range, and stops at
the draw count. Rows that repeat id and text are one entry with a count, so copies are no hot range.
"""

from __future__ import annotations

import hashlib
import math
import string
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import CRC_TABLE, crc_sql, keyed, partitions, small_batches, staged, trim
from quern.operators.skew import hot_join

#: Rows of a sorted run, of a merge range on average, of one repeated entry's piece; words a task remembers.
RUN_ROWS, MERGE_ROWS, PIECE, CACHE = 1 << 18, 1 << 17, 4096, 1 << 20
#: Sampled keys for each merge range.
SAMPLES = 16
#: Digits, a-z and bytes from 0x80 on make words; A-Z are lower-cased first, everything else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_KEY = ["neg", "no_id", "id", "k2"]
_ENTRY = "neg long, no_id long, id long, k2 long, n_words long, n_features long, weight long, copies long"
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]


class _Buckets(dict):
    """Bucket of each feature, remembered up to CACHE of them."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.size
        return found

    def of(self, text: bytes | None, n: int) -> tuple[int, np.ndarray]:
        """Number of words and the buckets of all features of a text (null: none)."""
        words = (text or b"").translate(_TABLE).split()
        found = [self[w] for w in words]
        for m in range(2, n + 1):
            found += [self[b" ".join(words[i : i + m])] for i in range(len(words) - m + 1)]
        return len(words), np.array(found, np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features in each bucket over all texts: one array per task, summed by bucket in Spark."""

    def count(batches):
        seen, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                total += np.bincount(seen.of(text, n)[1], minlength=buckets) if text else 0
        at = np.flatnonzero(total)
        trim()
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(texts[text_col].cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's share, with one added to each count, floored."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    ratio = [float((b + 1) * (s + size)) / float((a + 1) * (t + size)) for a, b in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Floored Gumbel noise in thousandths; a null id counts as the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k2, n_words, n_features, weight, score of every row."""

    def score(batches):
        seen = _Buckets(len(gain))
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, text in zip(ids, b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words, at = seen.of(text, n)
                weight = int(gain[at].sum()) // at.size if at.size else 0
                out.append((words, at.size, weight, weight + noise(seed, i)))
            cols = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)]
            yield pa.record_batch([b.column(0), b.column(2), *cols], names=["doc_id", "k2", "n_words", "n_features", "weight", "score"])
        trim()

    rows = keyed(docs, id_col, text_col).select("doc_id", "text", "k2")
    return rows.mapInArrow(score, "doc_id long, k2 long, n_words long, n_features long, weight long, score long")


class Tournament:
    """Loser tree over sorted sequences: pop() gives the least head, ties by sequence, at one match per level."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _head(self, r: int) -> tuple | None:
        return self.runs[r][self.at[r]] if r < len(self.runs) and self.at[r] < len(self.runs[r]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def pop(self) -> tuple | None:
        found, r = self._head(self.winner), self.winner
        if found is None:
            return None
        self.at[r] += 1
        node = (r + self.size) // 2
        while node:
            if self._beats(self.losers[node], r):
                self.losers[node], r = r, self.losers[node]
            node //= 2
        self.winner = r
        return found


def _runs(entries: DataFrame, splits: list[tuple]) -> DataFrame:
    """range, run, entries as arrays: each task's sorted runs of at most RUN_ROWS entries, cut at the splitters."""

    def cut(held: list[pa.RecordBatch], run: int):
        t = pa.Table.from_batches(held).sort_by([(k, "ascending") for k in _KEY])
        key = [t.column(k).to_numpy() for k in _KEY]
        ends = [0, *(bisect_left(range(len(t)), s, key=lambda i: tuple(int(k[i]) for k in key)) for s in splits), len(t)]
        full = [r for r in range(len(ends) - 1) if ends[r] < ends[r + 1]]
        for i in range(0, len(full), 256):
            some = full[i : i + 256]
            off = np.cumsum([0, *(ends[r + 1] - ends[r] for r in some)])
            part = t.slice(ends[some[0]], int(off[-1])).combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), part.column(c).combine_chunks()) for c in _NAMES]
            yield pa.record_batch([pa.array(some, pa.int64()), pa.array([run] * len(some), pa.int64()), *lists], names=["range", "run", *_NAMES])

    def runs(batches):
        held, rows, run = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= RUN_ROWS:
                yield from cut(held, run)
                held, rows, run = [], 0, run + 1
        if rows:
            yield from cut(held, run)
        trim()

    schema = "range long, run long, " + ", ".join(f"{c} array<long>" for c in _NAMES)
    return entries.select(*_NAMES).mapInArrow(runs, schema)


def _merged(runs: DataFrame, before: dict[int, int], want: int) -> DataFrame:
    """doc_id, k2, n_words, n_features, weight, score, first, copies: entries in pieces of at most PIECE copies.

    first is the rank of a piece's first copy, null from the draw count on.
    """
    names = ["doc_id", "k2", "n_words", "n_features", "weight", "score", "first", "copies"]

    def emit(tree, rank):
        out = []
        while (x := tree.pop()) is not None:
            neg, no_id, i, k2, words, features, weight, copies = x
            while copies:
                drawn = rank <= want
                take = min(copies, PIECE, want - rank + 1 if drawn else PIECE)
                out.append((None if no_id else i, k2, words, features, weight, -neg, rank if drawn else None, take))
                rank, copies = rank + take, copies - take
            if len(out) >= 8192:
                yield out
                out = []
        if out:
            yield out

    def merge(batches):
        def flush(at, held):
            for out in emit(Tournament([held[r] for r in sorted(held)]), before[at] + 1):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        at, held = None, {}
        for b in batches:
            for row in b.to_pylist():
                if row["range"] != at:
                    if held:
                        yield from flush(at, held)
                    at, held = row["range"], {}
                held[row["run"]] = list(zip(*(row[c] for c in _NAMES), strict=True))
        if held:
            yield from flush(at, held)
        trim()

    return runs.repartition("range").sortWithinPartitions("range", "run").mapInArrow(merge, ", ".join(f"{c} long" for c in names))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank, n_words, k2 (the row's key by id and text).

    Of the N documents with at least min_words words, floor(percent * N / 100) are drawn: the highest scores, ties to
    smaller ids, null ids last, then the lesser k2; rank counts from 1 and is null where undrawn. Rows that repeat id
    and text get ranks of their own, one after the other. Null and empty texts have no features, weight 0 and are
    not eligible; with an empty target every gain follows the documents alone. An empty table gives an empty
    result. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    rows = staged(scored(docs, gain, n, seed, id_col, text_col), "scored")
    able = F.col("n_words") >= min_words
    histogram = sorted(rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.score)
    want, least, seen = sum(r.n for r in histogram) * percent // 100, None, 0
    for r in histogram:
        if seen >= want:
            break
        least, seen = r.score, seen + r.n
    names = ["doc_id", "n_features", "weight", "score", "rank", "n_words", "k2"]
    if not want:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*names)
    near = able & (F.col("score") >= least)
    rest = rows.filter(~near).withColumn("rank", F.lit(None).cast("long")).select(*names)
    keys = [(-F.col("score")).alias("neg"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    entries = rows.filter(near).groupBy("doc_id", "k2", "n_words", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    entries = staged(entries.select(*keys, "k2", "n_words", "n_features", "weight", "copies"), "entries")
    ranges = max(partitions(spark), -(-seen // MERGE_ROWS))
    every = max(1, seen // (SAMPLES * ranges))
    sample = sorted(tuple(r) for r in entries.filter(F.pmod(F.xxhash64("id", "k2"), F.lit(every)) == 0).select(*_KEY).collect())  # some SAMPLES * ranges rows
    splits = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    runs = staged(_runs(entries, splits), "runs")
    sums = runs.select("range", F.aggregate("copies", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.array_max("copies").alias("most"))
    before, total, most = {}, 0, 0
    for r in sorted(sums.groupBy("range").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect(), key=lambda r: r.range):  # one row per range
        before[r.range], total, most = total, total + r.n, max(most, r.most)
    drawn = _merged(runs, before, want)
    if most > PIECE:  # pieces of one entry go to several tasks before they become rows
        drawn = drawn.repartition(partitions(spark))
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_i")
    drawn = drawn.select("*", one).withColumn("rank", F.col("first") + F.col("_i"))
    return drawn.select(*names).unionByName(rest)


def draw_documents(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, n: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """docs' rows that are drawn, columns unchanged. Rows that repeat id and text all stay where one of them is drawn."""
    d = resample(docs, target, percent, min_words, seed, n, buckets, id_col, text_col, target_col)
    d = d.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_k1"), F.col("k2").alias("_k2")).agg(F.count(F.lit(1)).alias("_n"), F.max("rank").alias("_rank"))
    d = staged(d.filter("_rank is not null"), "drawn")
    key = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("_k1"), key.alias("_k2"))
    return hot_join(rows, d, ["_k1", "_k2"], "_n", merge=True).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT rid, unnest(ws) AS w FROM d), bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
b AS (SELECT w, {crc_sql("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), tab),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM bw JOIN b USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000))::DOUBLE
  / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bw) + 10000))::DOUBLE)) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
m AS (SELECT rid, count(*) AS n_features, sum(gain) AS gs FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY rid),
x AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(floor(gs / n_features), 0) AS BIGINT) AS weight,
  ('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM y WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank
FROM y LEFT JOIN r USING (rid)
"""
