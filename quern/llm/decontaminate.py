"""Benchmark decontamination (operator 6): DataFrame functions only.

The normalised n-grams of the test items form a hash set. Training texts are first sifted: every window of m words
holds a whole block of b = ceil(m / 2) words that starts at a multiple of b, so each text's aligned blocks (one for
each b words) are looked up, as 64-bit hashes, in the broadcast set of all blocks of the items' windows. Only texts
with such a block are split into windows, which are looked up as whole strings: a hit is verified by the join
itself and no hash can mislead. Both sets are broadcast behind checks of their rows and bytes; beyond them hot_join
shuffles, with hot and null keys spread. What is shuffled of texts without hits is one narrow row.

Items that share a window are folded to one set per window before texts meet them, and texts that hit the same sets
share one answer, so a passage that many texts and many items hold makes rows for texts plus items, not their product.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import keyed, staged
from quern.operators.skew import hot_join

#: Everything but digits, letters and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: A larger set of windows, blocks or keys is joined by a shuffle instead of a broadcast.
MAX_WINDOWS, MAX_BYTES, MAX_KEYS = 1_000_000, 100 << 20, 2_000_000
#: Bytes counted for a row of hashes or keys.
NARROW = 32


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS + "+"), "")


def _windows(words: Column, n: int) -> Column:
    """Every n consecutive words, joined by one space."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def _block(m: int) -> int:
    """Words of a block of which every window of m words holds an aligned one."""
    return (m + 1) // 2


def _hashes(words: Column, size: int, step: int) -> Column:
    """64-bit hashes of the size words that start at every step-th place."""
    n = F.floor((F.size(words) - size) / step).cast("int")
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), F.slice(words, i * step + 1, size)))


def _placed(windows: Column, n: int) -> Column:
    return F.transform(windows, lambda x, i: F.struct(i.alias("pos"), F.lit(n).alias("len"), x.alias("window")))


def item_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """window, len, item: each item's windows, items as strings.

    Items of fewer than n words, but not none, are one window. A null id counts as the empty string.
    """
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item"), words_of(benchmark[text_col]).alias("w"))
    short = F.when(F.size("w") > 0, F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>"))
    cut = F.when(F.size("w") >= n, _windows(F.col("w"), n)).otherwise(short)
    return items.select("item", F.least(F.size("w"), F.lit(n)).alias("len"), F.explode(cut).alias("window")).distinct()


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int, size: Column | None = None) -> DataFrame:
    """left joined (inner or left) with right, one row per key: broadcast if right has at most rows rows and MAX_BYTES
    bytes, else by hot_join, for which left's rows of each key of right are counted."""
    got = right.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size if size is not None else F.lit(NARROW)), F.lit(0)).alias("b")).first()
    if got.n <= rows and got.b <= MAX_BYTES:
        return left.join(F.broadcast(right), on, how)
    count = left.select(*on).groupBy(*on).agg(F.count(F.lit(1)).alias("_weight"))
    return hot_join(left, staged(right.join(count, on), "weighted"), on, "_weight", how)


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs (doc_id, k1, k2, n_words), hits (k1, k2, pos from 0, len, set) and the sets of items (set, item)."""
    items = staged(item_windows(benchmark, n), "windows")
    found = items.groupBy("window", "len").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    of = F.struct(F.xxhash64("_items").alias("a"), F.xxhash64(F.lit(6), "_items").alias("b"), F.size("_items").alias("n"))
    found = staged(found.withColumn("set", of), "window-sets")
    sets = found.groupBy("set").agg(F.first("_items").alias("_items")).select("set", F.explode("_items").alias("item"))
    found = found.select("window", "len", "set")
    lens = sorted(r["len"] for r in found.select("len").distinct().collect())  # at most n
    blocks = sorted({_block(m) for m in lens})
    set_of = F.concat(*[F.when(F.col("len") == m, _hashes(F.split("window", " "), _block(m), 1)).otherwise(F.array().cast("array<long>")) for m in lens] or [F.array().cast("array<long>")])
    known = found.select(F.explode(set_of).alias("_h")).distinct().withColumn("_hit", F.lit(True))
    rows = keyed(docs, id_col, text_col).select("doc_id", "k1", "k2", words_of(F.col("text")).alias("_w"))
    rows = rows.withColumns({"_rid": F.monotonically_increasing_id(), "n_words": F.size("_w")})
    cut = F.concat(*[_hashes(F.col("_w"), b, b) for b in blocks] or [F.array().cast("array<long>")])
    rows = rows.select("_rid", "doc_id", "k1", "k2", "n_words", F.posexplode_outer(cut).alias("_at", "_h"))
    rows = _meet(rows, known, ["_h"], "left", MAX_KEYS).filter("_hit or _at is null or _at = 0")
    base = rows.groupBy("_rid").agg(*[F.first(c).alias(c) for c in ("doc_id", "k1", "k2", "n_words")], F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_hit"))
    base = staged(base.drop("_rid"), "sifted")
    some = base.filter("_hit").select("k1", "k2").distinct()
    texts = _meet(keyed(docs, id_col, text_col).select("k1", "k2", "text"), some, ["k1", "k2"], "inner", MAX_KEYS)
    texts = texts.select("k1", "k2", words_of(F.col("text")).alias("_w"))
    win = F.concat(*[_placed(_windows(F.col("_w"), m), m) for m in lens] or [F.array().cast("array<struct<pos:int,len:int,window:string>>")])
    hits = texts.select("k1", "k2", F.explode(win).alias("_x")).select("k1", "k2", "_x.*")
    hits = _meet(hits, found, ["window", "len"], "inner", MAX_WINDOWS, NARROW + F.octet_length("window"))
    return base.select("doc_id", "k1", "k2", "n_words"), staged(hits.select("k1", "k2", "pos", "len", "set").distinct(), "hits"), sets


def _spans(hits: DataFrame) -> DataFrame:
    """k1, k2, hits: each document's hits in order, an array of (pos, len)."""
    return hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A document word inside any occurrence of a window is hit. Null and empty texts have no words and are clean, as
    is everything where the benchmark is empty. Repeated rows are reported once each. An empty table gives an empty
    result. Other columns are ignored.
    """
    rows, hits, sets = _scan(docs, benchmark, n, id_col, text_col)
    walk = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, h: F.struct(
            F.greatest(a["end"], h["pos"] + h["len"]).alias("end"),
            (a["hit"] + h["pos"] + h["len"] - F.least(F.greatest(a["end"], h["pos"]), h["pos"] + h["len"])).alias("hit"),
        ),
    )
    of = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("set")).alias("sets"))
    found = staged(_spans(hits).select("k1", "k2", walk["hit"].cast("long").alias("_n")).join(of, ["k1", "k2"]), "contaminated")
    # One answer for all texts with the same sets; their items are listed once.
    answers = found.groupBy("sets").agg(F.count(F.lit(1)).alias("_texts"))
    listed = answers.select("sets", F.explode("sets").alias("set")).join(sets, "set").groupBy("sets").agg(F.array_sort(F.collect_set("item")).alias("items"))
    answers = staged(answers.join(listed, "sets"), "answers")
    found = hot_join(found, answers, ["sets"], "_texts").drop("sets")
    rows = _meet(rows, found, ["k1", "k2"], "left", MAX_KEYS, NARROW + 16 * F.size("items"))
    rows = rows.withColumns({"_n": F.coalesce("_n", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("_n").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("_n") > 0).alias("contaminated"), "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with the hit words and what precedes them cut out.

    The columns of docs are unchanged. Documents without hits stay byte for byte. The contaminated documents' keys
    are broadcast behind a check of their number, so whole texts move only beyond it.
    """
    hits = _spans(_scan(docs, benchmark, n, id_col, text_col)[1])
    hits = hits.select(F.col("k1").alias("_h1"), F.col("k2").alias("_h2"), *([F.col("hits").alias("_hits")] if mode == "spans" else []))
    hits = staged(hits, "hit-documents")
    key = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("_k1"), key.alias("_k2"))
    hits = hits.withColumnsRenamed({"_h1": "_k1", "_h2": "_k2"})
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    if mode == "documents":
        hits = hits.withColumn("_hits", F.lit(True))
    kept = _meet(kept, hits, ["_k1", "_k2"], "left", MAX_KEYS, NARROW + 16 * F.size("_hits") if mode == "spans" else None)
    if mode == "documents":
        return kept.filter(F.col("_hits").isNull()).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
    text = F.col(f"_row.`{text_col}`")
    word = SEPARATORS.replace("[", "[^", 1) + "+"
    pieces = F.regexp_extract_all(text, F.lit(f"{SEPARATORS}*{word}"), F.lit(0))
    left = F.filter(pieces, lambda _, i: ~F.exists("_hits", lambda h: (i >= h["pos"]) & (i < h["pos"] + h["len"])))
    cut = F.concat(F.array_join(left, ""), F.regexp_extract(text, f"{SEPARATORS}*$", 0))
    new = F.when(F.col("_hits").isNotNull(), cut).otherwise(text)
    return kept.select(*[(new if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SQL = f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n,
  unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 9), lambda k: array_to_string(w[k + 1 : k + 10], ' ')) END) AS win FROM i),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
lens AS (SELECT DISTINCT n FROM iw),
pos AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS win FROM pos),
h AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
