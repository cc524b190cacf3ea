"""Packing token sequences into windows by non-negative least squares (operator 5).

Each text is encoded once; its ids go to the shared folder with the task that made them and running counts. Whole
windows of a text are sequences of their own. The rest of each text is a length below the window; shallow
combinations (two or three lengths) that fill a window exactly are the columns of a non-negative least-squares
problem against the histogram of rests, whose solution, rounded, says how often each is repeated. What the rounded
plan leaves over is packed greedily, longest first, each window being filled to the end before the next opens, so
only the last sequence of all can need padding.

Plan and histogram have at most one entry for each length: they are bounded by the window, not by the data. Rows
find their place from counts alone: a row's rank in its length's bin is the number of such rows in earlier tasks,
a sum over (task, length), plus its running count. Rows meet these sums by a shuffle on (task, length), so a length
that a third of all rows have is split by task and nothing that grows with the data is broadcast.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import load_tokenizer_path, small_batches, staged, trim
from quern.operators.skew import sums_before

WINDOW, END_ID = 2048, 1
#: Characters that both libraries split alike whatever their Unicode tables; other texts go to tokenizers itself.
_COMMON = regex.compile(r"[\x00-ɏ‐-‧]*")
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache
def _encoders(path: str, ranks_path: str | None, plain_specials: bool):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = plain_specials
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    if not ranks_path:
        return slow, None, added
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return slow, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def encode(texts: list[str | None], path: str, ranks_path: str | None = None, end_id: int = END_ID, plain_specials: bool = False) -> list[np.ndarray]:
    """Ids of each text (null: empty) by the tokenizer file at path, then end_id.

    With ranks_path, the same vocabulary as ranks, texts of common characters without the string of an added token
    are encoded by the faster library; the ids are the same. An added token's string in a text becomes its id, as
    the tokenizer file says; with plain_specials it is ordinary text, so that no text can forge such an id.
    """
    slow, fast, added = _encoders(path, ranks_path, plain_specials)
    out = []
    for t in texts:
        t = t or ""
        quick = fast is not None and _COMMON.fullmatch(t) and not any(a in t for a in added)
        ids = fast.encode_ordinary(t) if quick else slow.encode(t, add_special_tokens=False).ids
        out.append(np.array(ids + [end_id], np.uint32))
    return out


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of the given lengths (c may be 0) that add up to window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = True
    a, b = np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & (b > 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[c]
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def nnls(columns: np.ndarray, hist: np.ndarray, steps: int = 300, grow: int = 2000, tolerance: float = 1e-3) -> np.ndarray:
    """Least squares of sum_j x_j * column_j against hist with x >= 0, over all columns.

    A column is the multiset of its lengths; length 0 is nothing. A working set of columns is solved by accelerated
    projected gradients; then the grow columns outside it that would lower the residual most join, until none would
    by more than tolerance of the largest count: the optimality condition over every column. What has weight zero
    in the solution stays out of the plan, so counts gather on few columns and survive rounding.
    """
    m = hist.size
    target = hist.astype(float)
    target[0] = 0

    def forward(cols, x):
        y = np.zeros(m)
        for k in range(cols.shape[1]):
            y += np.bincount(cols[:, k], weights=x, minlength=m)
        y[0] = 0
        return y

    def solve(cols, x):
        v, norm = np.ones(len(cols)), 1.0
        for _ in range(20):
            v = forward(cols, v)[cols].sum(axis=1)
            norm = float(np.linalg.norm(v)) or 1.0
            v /= norm
        z, t, floor = x, 1.0, tolerance * max(float(target.max()), 1.0)
        for _ in range(steps):
            gradient = (forward(cols, z) - target)[cols].sum(axis=1)
            new = np.maximum(0, z - gradient / (1.05 * norm))
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            z, moved = new + (t - 1) / t2 * (new - x), float(np.abs(new - x).max())
            x, t = new, t2
            if moved < floor / 1000:
                break
        return x

    out = np.zeros(len(columns))
    # First the columns whose scarcest length is most common.
    worth = np.where(columns > 0, hist[columns], np.iinfo(np.int64).max).min(axis=1)
    active = np.argsort(-worth, kind="stable")[:grow]
    inside = np.zeros(len(columns), bool)
    floor = tolerance * max(float(target.max()), 1.0)
    while True:
        inside[active] = True
        out[active] = solve(columns[active], out[active])
        residual = target - forward(columns[active], out[active])
        gain = residual[columns].sum(axis=1)
        gain[inside] = 0
        fresh = np.flatnonzero(gain > floor)
        if not fresh.size:
            return out
        fresh = fresh[np.argsort(-gain[fresh], kind="stable")[:grow]]
        active = np.concatenate([active, fresh])


class Plan:
    """Where each (length, rank) goes: repeated combinations first, then the greedy rest."""

    def __init__(self, hist: np.ndarray, window: int) -> None:
        self.window = window
        left = hist.astype(np.int64).copy()
        left[0] = 0
        cols = combinations(window, np.flatnonzero(left))
        if len(cols):
            x = nnls(cols, left)
            order = np.argsort(-x, kind="stable")
            cols, want = cols[order], np.rint(x[order]).astype(np.int64)
        uses: dict[int, list[tuple[int, int, int, int, tuple[int, ...]]]] = {}
        used = np.zeros_like(left)
        self.n_combined = 0
        for col, n in zip(cols.tolist(), want.tolist() if len(cols) else []):
            need = {r: col.count(r) for r in col if r}
            n = min([n, *(int(left[r] - used[r]) // k for r, k in need.items())])
            if n <= 0:
                continue
            at, places = 0, {}
            for r in col:
                if r:
                    places.setdefault(r, []).append(at)
                    at += r
            for r, k in need.items():
                uses.setdefault(r, []).append((int(used[r]), n, k, self.n_combined, tuple(places[r])))
                used[r] += n * k
            self.n_combined += n
        self.uses = {r: (np.array([u[0] for u in v]), v) for r, v in uses.items()}
        self.used = used
        rest = left - used
        sizes = rest * np.arange(rest.size)
        self.rest_at = sizes[::-1].cumsum()[::-1] - sizes  # longest first
        self.n_rest = -(-int(sizes.sum()) // window)

    def place(self, r: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of the rank-th rest of length r; sequences count from 0."""
        if rank < self.used[r]:
            first, uses = self.uses[r]
            base, _, k, seq, places = uses[int(np.searchsorted(first, rank, side="right")) - 1]
            copy, slot = divmod(rank - base, k)
            return [(seq + copy, places[slot], r)]
        at = int(self.rest_at[r]) + (rank - int(self.used[r])) * r
        seq, offset = divmod(at, self.window)
        head = min(r, self.window - offset)
        out = [(self.n_combined + seq, offset, head)]
        return out + [(self.n_combined + seq + 1, 0, r - head)] if head < r else out


def tokens(docs: DataFrame, window: int, path: str, ranks_path: str | None, end_id: int, plain_specials: bool, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, r (rest), part (task), k (earlier rows of the task with this r), f (whole windows before), ids."""

    def work(batches):
        part = TaskContext.get().partitionId()
        seen, whole = np.zeros(window, np.int64), 0
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for ids in encode(b.column("text").to_pylist(), path, ranks_path, end_id, plain_specials):
                n = ids.size
                r = n % window
                small = ids.astype(np.uint16) if ids.max() < 1 << 16 else ids
                for c, v in zip(cols, (n, r, int(seen[r]), whole, bytes([small.itemsize]) + zip_.compress(small.tobytes()))):
                    c.append(v)
                seen[r] += 1
                whole += n // window
            n, r, k, f, ids = cols
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int32()), pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(k, pa.int64()), pa.array(f, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "n", "r", "part", "k", "f", "ids"],
            )
        trim()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, r int, part int, k long, f long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None, ranks_path: str | None = None, plain_specials: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Sequences hold at most window ids and are gapless from offset 0; each id of each row of docs lies in exactly
    one piece. Null and empty texts are the end id alone. Null ids and repeated rows are packed like any other. An
    empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    if path is None:
        path, ranks_path = load_tokenizer_path("byte_bpe_50k.json"), load_tokenizer_path("byte_bpe_50k.tiktoken")
    table = staged(tokens(docs, window, path, ranks_path, end_id, plain_specials, id_col, text_col), "tokens")
    counts = table.groupBy("part", "r").agg(F.count(F.lit(1)).alias("c"), F.sum(F.expr(f"n div {window}")).alias("w"))
    counts = staged(counts, "rests")
    hist = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("r").agg(F.sum("c").alias("c")).collect():  # at most window rows
        hist[row.r] = row.c
    plan = Plan(hist, window)
    whole = counts.groupBy("part").agg(F.sum("w").alias("w"))
    n_whole = whole.agg(F.sum("w")).first()[0] or 0
    whole = sums_before(whole, "part", "w", "w0").select("part", "w0")
    ranks = counts.select("part", "r", F.coalesce(F.sum("c").over(Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("k0"))
    # One row for each task and length: it grows with the input, so it is never broadcast.
    at = ranks.join(whole, "part")
    rows = table.join(at.hint("merge"), ["part", "r"]).select("doc_id", "n", "r", (F.col("k") + F.col("k0")).alias("rank"), (F.col("f") + F.col("w0")).alias("first"), "ids")

    def place(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, n, r, rank, first, body in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "r", "rank", "first", "ids"))):
                ids = np.frombuffer(unzip.decompress(body[1:]), f"<u{body[0]}").astype("<u4")
                pieces = [(first + i, 0, window) for i in range(n // window)]
                if r:
                    pieces += [(n_whole + s, o, m) for s, o, m in plan.place(r, rank)]
                start = 0
                for seq, offset, m in pieces:
                    for c, v in zip(out, (doc, start, m, ids[start : start + m].tobytes(), n, seq, offset)):
                        c.append(v)
                    start += m
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        trim()

    return rows.mapInArrow(place, _PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32 in place of ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
