"""Line dedup by a log-template tree (operator 7): DataFrame functions only.

Each line is parsed to a fixed depth: its token count and its leading tokens, after tokens with a digit became
``<*>``, name a leaf. Inside leaves that several documents reach, a token stays constant at its place if it recurs
there in several lines, and else becomes ``<*>`` too: that is the line's template. A template that enough documents
share, and that is constant enough, is boilerplate: every line of it but the first goes.

Leaves are counted on 8-byte hashes with map-side partial aggregation; only lines of recurring leaves are masked
whole and staged, and everything after reads those. Equal masked lines travel as one row with a count, so a line
that a third of the corpus repeats costs one row per task. Whole texts are shuffled once, to meet their line numbers.
Keys that many rows have (a token at its place, a line, a template, a repeated document) are joined by hot_join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import keyed, staged
from quern.operators.skew import hot_join

#: Leaves that recur are broadcast up to this many rows (16 bytes each), else joined by a shuffle.
MAX_LEAVES = 500_000
WILD = "<*>"
#: Leading tokens of a leaf; documents that make a template recurring; least share of constant tokens.
DEPTH, MIN_DOCS, CONSTANT = 3, 5, 0.5


def plain(line: Column) -> Column:
    """White-space runs as one space, ends trimmed; byte scans find the few lines that need it."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in "\t\v\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def masked(line: Column) -> Column:
    """Tokens with an ASCII digit as <*>."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ ]*[0-9][^ ]*", WILD)).otherwise(line)


def _leaf(line: Column, depth: int) -> Column:
    n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.xxhash64(n, masked(F.substring_index(line, " ", depth)))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, drop, n_rows: per document key with such lines, the sorted places (from 0) of the lines that go.

    n_rows is how many rows the document has. Rows that repeat id and text are one document: their lines count once.
    """
    rows = keyed(docs, id_col, text_col).filter(F.col("text").isNotNull())
    lines = rows.select("k1", "k2", F.posexplode(F.split("text", "\n")).alias("at", "_l")).select("k1", "k2", "at", plain(F.col("_l")).alias("l"))
    lines = lines.filter("l <> ''").withColumn("leaf", _leaf(F.col("l"), depth))
    # Rows here, not documents: leaves that fewer documents reach hold no recurring template, so none is lost or gained.
    leaves = staged(lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_docs).select("leaf"), "leaves")
    few = leaves.count() <= MAX_LEAVES
    lines = lines.join(F.broadcast(leaves) if few else leaves, "leaf", "left_semi")
    m = masked(F.col("l"))
    lines = staged(lines.select("k1", "k2", "at", "leaf", F.xxhash64(m).alias("mh"), m.alias("m")), "lines")
    # From here a masked line is known by (leaf, mh), 128 bits; its text moves once.
    once = staged(lines.groupBy("leaf", "mh", "k1", "k2", "at").agg(F.count(F.lit(1)).alias("n_rows")), "places")
    distinct = lines.groupBy("leaf", "mh").agg(F.min("m").alias("m"))
    distinct = staged(distinct.join(once.groupBy("leaf", "mh").agg(F.count(F.lit(1)).alias("n")), ["leaf", "mh"]), "masked")
    tokens = distinct.select("leaf", "mh", "n", F.posexplode(F.split("m", " ")).alias("p", "t"))
    common = tokens.filter(F.col("t") != WILD).groupBy("leaf", "p", "t").agg(F.sum("n").alias("_c"), F.count(F.lit(1)).alias("_rows")).filter(F.col("_c") >= min_docs)
    common = staged(common.select("leaf", "p", "t", F.lit(1).alias("_k"), "_rows"), "constants")
    tokens = hot_join(tokens.select("leaf", "mh", "n", "p", "t"), common, ["leaf", "p", "t"], "_rows", "left", merge=True)
    # Places and constant tokens name the template; sums of fixed size, so equal lines fold before the shuffle.
    seen = F.bit_xor(F.when(F.col("_k").isNotNull(), F.xxhash64("p", "t")).otherwise(F.xxhash64("p")))
    parsed = tokens.groupBy("leaf", "mh").agg(seen.alias("_t"), (F.count("_k") / F.count(F.lit(1))).alias("_share"), F.max("n").alias("n"))
    parsed = staged(parsed.filter(F.col("_share") >= constant).select("leaf", "mh", "_t", "n"), "parsed")
    per_doc = hot_join(once, parsed, ["leaf", "mh"], "n", merge=True).groupBy("leaf", "_t", "k1", "k2").agg(F.array_sort(F.collect_list("at")).alias("ats"), F.max("n_rows").alias("n_rows"))
    per_doc = staged(per_doc, "templates")
    # A template is (leaf, hash of its places and constants): 128 bits.
    count = per_doc.groupBy("leaf", "_t").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("k1", "k2")).alias("_first")).filter(F.col("_n") >= min_docs)
    out = hot_join(per_doc, staged(count, "recurring"), ["leaf", "_t"], "_n", merge=True)
    first = (F.col("k1") == F.col("_first.k1")) & (F.col("k2") == F.col("_first.k2"))
    ats = F.when(first, F.slice("ats", 2, F.greatest(F.size("ats") - 1, F.lit(0)))).otherwise(F.col("ats"))
    out = out.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list(ats))).alias("drop"), F.max("n_rows").alias("n_rows"))
    return out.filter(F.size("drop") > 0)


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_dropped, kept_sha256, text (the lines that stay).

    Lines are cut at ``\\n``; blank lines always stay; of a recurring template the first line (smallest doc_id,
    then place) stays. A null text has no lines and stays null (its hash is that of the empty text). Rows that
    repeat id and text are one document, however many they are, and get the same answer. Null ids count as 0 for
    the order; of rows with one id and different texts the lesser text hash is first. An empty table gives an empty
    result. Other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col)
    drop = staged(recurring_lines(docs, depth, min_docs, constant, id_col, text_col), "drop")
    rows = hot_join(rows, drop, ["k1", "k2"], "n_rows", "left", merge=True)
    # Which lines stay, in time linear in the lines: a run of them before each dropped place and after the last.
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    cuts = F.zip_with(F.concat(F.array(F.lit(-1)), "drop"), F.concat("drop", F.array(n_lines)), lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False))))
    kept = F.array_join(F.zip_with(F.split("text", "\n"), F.flatten(cuts), lambda line, stays: F.when(stays, line)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept)
    rows = rows.select("doc_id", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"), text.alias("text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT DISTINCT doc_id, text FROM documents)),
l AS (SELECT rid, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS ln FROM d),
m AS (SELECT rid, ln, list_transform(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS ts FROM l),
k AS (SELECT rid, ln, ts, len(ts) || ':' || array_to_string(ts[1:3], ' ') AS leaf FROM m WHERE len(ts) > 0),
f AS (SELECT leaf FROM k GROUP BY leaf HAVING count(*) >= 5), c AS (SELECT * FROM k SEMI JOIN f USING (leaf)),
t AS (SELECT rid, ln, leaf, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM c),
o AS (SELECT leaf, p, t FROM t WHERE t <> '<*>' GROUP BY ALL HAVING count(*) >= 5),
x AS (SELECT rid, ln, t.leaf, string_agg(CASE WHEN o.t IS NULL THEN '<*>' ELSE t.t END, ' ' ORDER BY t.p) AS tpl, avg(CASE WHEN o.t IS NULL THEN 0.0 ELSE 1.0 END) AS share
  FROM t LEFT JOIN o ON o.leaf = t.leaf AND o.p = t.p AND o.t = t.t GROUP BY rid, ln, t.leaf),
y AS (SELECT leaf, tpl, rid, list(ln ORDER BY ln) AS lns FROM x WHERE share >= 0.5 GROUP BY leaf, tpl, rid),
z AS (SELECT leaf, tpl, arg_min(rid, (coalesce(doc_id, 0), rid)) AS first FROM y JOIN d USING (rid) GROUP BY leaf, tpl HAVING count(*) >= 5),
g AS (SELECT rid, flatten(list(CASE WHEN rid = first THEN lns[2:] ELSE lns END)) AS cut FROM y JOIN z USING (leaf, tpl) GROUP BY rid),
h AS (SELECT doc_id, text, ls, coalesce(cut, []) AS cut FROM d LEFT JOIN g USING (rid))
SELECT a.doc_id, coalesce(len(ls), 0) AS n_lines, len(cut) AS n_dropped, sha256(coalesce(CASE WHEN len(cut) = 0 THEN a.text
  ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda q: NOT list_contains(cut, q)), lambda q: ls[q + 1]), chr(10)) END, '')) AS kept_sha256
FROM documents a JOIN h ON a.doc_id IS NOT DISTINCT FROM h.doc_id AND a.text IS NOT DISTINCT FROM h.text
"""
