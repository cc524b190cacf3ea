"""Helpers shared by the corpus operators: vectorised word splitting and hashing, staged tables, row keys."""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.shared import local_path, new_path, partitions, staged  # noqa: F401

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and turns every white-space byte into one space.
_LOWER_SPACE = np.arange(256, dtype=np.uint8)
_LOWER_SPACE[65:91] += 32
_PLAIN_SPACE = np.arange(256, dtype=np.uint8)
for _t in (_LOWER_SPACE, _PLAIN_SPACE):
    _t[SPACE] = 32

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    start = np.uint64((seed * 0x632BE59BD9B4E019 + 1) % (1 << 64))
    return mix64(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_MUL))


_BYTE = seeds64(256, 7)
_BYTE[SPACE] = 0


class _Powers:
    """p^i and p^-i modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.up.size:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, base in (("up", _MUL), ("down", _INV)):
                    out = np.ones(1, np.uint64)
                    while out.size < size:
                        out = np.concatenate([out, out * np.uint64(pow(base, out.size, 1 << 64))])
                    setattr(self, name, out[:size])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()
_CHUNK = 1 << 20


class Words:
    """The words of a batch of texts, as offsets into one normalised byte buffer.

    ``buf`` holds the texts back to back with each white-space run as one space; word k is
    ``buf[starts[k]:ends[k]]``, ``doc[k]`` its text's index and ``first[d]:first[d + 1]`` the words of text d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> None:
        a = (_LOWER_SPACE if lower else _PLAIN_SPACE)[data]
        space = a == 32
        twice = space[1:] & space[:-1]
        if twice.any():
            keep = np.concatenate([[True], ~twice])
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            a, space = a[keep], space[keep]
        n = a.size
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        edge[0] = edge[n] = True
        before = np.concatenate([[True], space]) | edge
        after = np.concatenate([space, [True]]) | edge
        self.starts = np.flatnonzero(~space & before[:-1])
        self.ends = np.flatnonzero(~space & after[1:]) + 1
        self.a, self.offsets, self.n_docs = a, offsets, offsets.size - 1
        self.buf = a.tobytes()
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self.n = self.starts.size

    def hashes(self) -> np.ndarray:
        return hash_words(self.a, self.starts, self.ends)


def hash_words(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given as offsets in order; bytes between words must be white space."""
    out = np.empty(starts.size, np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < starts.size:
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(starts, base + _CHUNK)))
            seg = a[base : ends[j - 1]]
            up, down = _POWERS.get(seg.size)
            at = starts[i:j] - base
            total = np.add.reduceat(_BYTE[seg] * up, at)
            out[i:j] = mix64(total * down[at] + (ends[i:j] - starts[i:j]).astype(np.uint64))
            i = j
    return out


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive items that start at each place of h (len(h) - n + 1 of them)."""
    if h.size < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if n <= 8:
            m = seeds64(n, 1000 + n) | np.uint64(1)
            out = h[: h.size - n + 1] * m[0]
            for k in range(1, n):
                out += h[k : h.size - n + 1 + k] * m[k]
            return mix64(out)
        out = np.empty(h.size - n + 1, np.uint64)
        for i in range(0, out.size, _CHUNK):
            part = h[i : i + _CHUNK + n - 1]
            up, down = _POWERS.get(part.size)
            c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up, dtype=np.uint64)])
            out[i : i + _CHUNK] = (c[n:] - c[:-n]) * down[: c.size - n]
        return mix64(out)


def sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """min(x[i:i + span]) for every i with a whole span."""
    width = 1
    while width * 2 <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = span - width
    return np.minimum(x[: x.size - rest], x[rest:]) if rest else x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; nulls have length zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or not offsets.size:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_rule(col):
    """White-space runs become one space, as a column expression."""
    return F.regexp_replace(col, r"[\x20\x09-\x0D]+", " ")


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the row key (k1, k2): equal for rows with equal id and text, else different.

    Here as in all operators of this package ids are whole numbers; text that is no number in an id column fails.
    """
    out = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return out.withColumns({"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))})


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lower the session's rows per Arrow batch to rows (it stays lowered: plans run after this returns).

    Spark also ends a batch at spark.sql.execution.arrow.maxBytesPerBatch, so long texts make smaller ones.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def reducers(df: DataFrame, each: int = 32 << 20) -> int:
    """Shuffle partitions for whole texts of df: the session's, or more where df's files are larger than each times that."""
    p = partitions(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return p if size >= 1 << 60 else max(p, -(-size // each))  # unknown sizes are given as huge


def heavy(hashes: DataFrame, share: int) -> DataFrame:
    """key, n of the 64-bit keys with more than one in share of all rows of hashes (key, n, total), summed by task."""
    total = hashes.agg(F.sum("total")).first()[0] or 0
    return hashes.groupBy("key").agg(F.sum("n").alias("n")).filter((F.col("n") > total / share) & F.col("key").isNotNull())


def trim() -> None:
    """Give freed memory back: Python workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: under $QUERN_TOKENIZERS where set, else the installed package."""
    own = os.environ.get("QUERN_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: CRC-32 (polynomial 0xEDB88320) of a word in SQL: the byte table by its rule, then one step a byte.
CRC_TABLE = """tab AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string; a row of tab (column t) must be in scope."""
    byte = f"instr('123456789ABCDEF', hex({text})[2 * i - 1]) * 16 + instr('123456789ABCDEF', hex({text})[2 * i])"
    steps = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ({byte})::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
