"""MinHash near-dedup with sequential Bayesian verification (operator 10).

Texts with equal shingle sets are one class, so copies are never paired. Classes that share a band of their
signature are candidates. First each bucket's members are paired with one pivot only, chosen among PIVOTS orders;
pairs are compared signature batch by signature batch and pruned once the posterior probability of reaching the
threshold falls under MISS; survivors are verified on their whole shingle sets. Members that those links join need
no further comparison. Buckets that still hold several components then compare members across components, block
against block inside tasks, with the same pruning and verification; a block hands on at most one link for each
component it joins, never its pairs.

Where more than WIDE members of a bucket are outside its largest component, its members are dealt anew: texts at similarity t share one of their rarest n - ceil(t n) + 1 shingles (the prefix
filter, rarity being counted among these members), so each goes to the buckets of those of its shingles that another
member has, and bucket mates without a rare shingle in common, such as pages of one template, never meet. That is
exact: every pair at the threshold meets, and is compared and verified as above.

Nothing gathers a group in one task: pivots are dealt out with at most one partner share in SHARES, blocks hold
about BLOCK members, and hot band keys, components and copies are split by hot_join. Links, components and
fingerprints stay in tables. Texts are read once for signatures and shuffled once, for candidates only.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Words, keyed, mix64, ngram_hashes, partitions, seeds64, small_batches, staged, text_buffer
from quern.operators.graph import components
from quern.operators.skew import hot_join

SHINGLE, PERCENT = 5, 75
#: 40 bands of 5: a pair at similarity 0.75 shares no band with probability 2.0e-5; with pruning it is missed with 2.4e-5.
BANDS, ROWS = 40, 5
#: Posterior probability of similarity >= 0.75 under which a pair is pruned; hashes compared at a time.
MISS, BATCH = 1e-6, 40
#: Shares of a pivot's partners; members of a block; members outside a bucket's largest component that are met block by
#: block; pivots that a group's buckets choose among.
SHARES, BLOCK, WIDE, PIVOTS = 1024, 256, 1024, 4


def shingle_sets(w: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; fewer words than size are one shingle."""
    h = w.hashes()
    g = ngram_hashes(h, size)
    out = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        n = hi - lo
        if n >= size:
            out.append(np.unique(g[lo : hi - size + 1]))
        elif n:
            out.append(mix64(ngram_hashes(h[lo:hi], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


@lru_cache
def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    s = seeds64(2 * k, 10)
    return (s[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[k:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Least value of each of k hash functions over each (non-empty) set."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([s.size for s in sets])[:-1]])
    mul, add = _functions(k)
    out = np.empty((len(sets), k), np.uint32)
    for j in range(k):
        out[:, j] = np.minimum.reduceat(x * mul[j] + add[j], first)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    out = np.broadcast_to(seeds64(bands, 11), (len(sig), bands)).copy()
    for r in range(rows):
        out = mix64(out ^ s[:, :, r])
    return out.view(np.int64)


@lru_cache
def least_matches(k: int, percent: int = PERCENT, miss: float = MISS, batch: int = BATCH) -> tuple[tuple[int, int], ...]:
    """(hashes compared, fewest matches to go on): under a uniform prior, P(s >= t | m of n) = P(Bin(n + 1, t) <= m).

    Minima are compared by 16 bits, which agree by chance once in 65,536: t is raised accordingly.
    """
    t, out = percent / 100, []
    t += (1 - t) / 65536
    for n in range(batch, k + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, k1, k2, n (set size), digest (of the set), bands, sig (low 16 bits of each minimum)."""

    def work(batches):
        for b in batches:
            sets = shingle_sets(Words(*text_buffer(b.column("text")), lower=True))
            full = [i for i, s in enumerate(sets) if s.size]
            keys, sigs = [None] * len(sets), [None] * len(sets)
            if full:
                m = signatures([sets[i] for i in full], bands * rows)
                low = m.astype(np.uint16)
                for i, key, s in zip(full, band_keys(m, bands, rows), low):
                    keys[i], sigs[i] = key, s.tobytes()
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("k1"), b.column("k2"), pa.array([s.size for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "k1", "k2", "n", "digest", "bands", "sig"],
            )

    return keyed(docs, id_col, text_col).mapInArrow(work, "doc_id long, k1 long, k2 long, n long, digest binary, bands array<long>, sig binary")


def _meet(pairs: DataFrame, store: DataFrame, payload: str, read, test) -> DataFrame:
    """The pairs (a, b) whose payloads pass test(read(a's), read(b's)).

    Each a is sent with a share of its partners, so a pivot of any degree is met by bounded shares; a task holds
    one a at a time. read turns a list of payloads into a list of values.
    """
    p = partitions(pairs.sparkSession)
    pairs = pairs.withColumn("c", F.pmod(F.xxhash64("b"), F.lit(SHARES)))
    left = pairs.select(F.col("a").alias("cid"), "a", "c", F.lit(-1).cast("long").alias("b")).distinct()
    need = left.union(pairs.select(F.col("b").alias("cid"), "a", "c", "b"))
    rows = need.join(store.select("cid", payload), "cid").select("a", "c", "b", payload)
    rows = rows.repartition(p, "a", "c").sortWithinPartitions("a", "c", "b")

    def work(batches):
        held = None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = ([], [])
            for i, value in enumerate(read(batch.column(payload))):
                if b[i] < 0:
                    held = value
                elif test(held, value):
                    out[0].append(a[i])
                    out[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def _blocks(members: DataFrame, steps: tuple[tuple[int, int], ...]) -> DataFrame:
    """Links (a, b) between components that share a bucket; members: key, cid, root, major, others, size, sig, text.

    Most members of a bucket often have one root already, its major one; they need not meet each other. The others
    are cut into blocks of about BLOCK, and so are the major ones; every block of others meets every block, so a
    major member is sent once for each block of others, and a task holds two blocks. Pairs of different components
    are compared by signature, pruned as above, and the rest verified whole in order of likelihood, unless links
    found before already join them: a group returns fewer links than it has components, and no link that could join
    two is left out.
    """
    p = partitions(members.sparkSession)
    blocks, rest = F.ceil(F.col("others") / BLOCK).cast("int"), F.ceil((F.col("size") - F.col("others")) / BLOCK).cast("int")
    h, is_major = F.xxhash64("cid"), F.col("root") == F.col("major")
    rows = members.withColumn("i", F.when(is_major, blocks + F.pmod(h, rest)).otherwise(F.pmod(h, blocks)).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(is_major, blocks - 1).otherwise(blocks + rest - 1))))
    rows = rows.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "root", "sig", "text")
    rows = rows.repartition(p, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def links(group, held):
        block, root = np.array([r[0] for r in held]), np.array([r[1] for r in held])
        sig = np.frombuffer(b"".join(r[2] for r in held), np.uint16).reshape(len(held), -1)
        if group[1] == group[2]:
            x, y = np.nonzero(np.triu(root[:, None] != root[None, :]))
        else:
            a, b = np.flatnonzero(block == group[1]), np.flatnonzero(block == group[2])
            x, y = np.nonzero(root[a][:, None] != root[b][None, :])
            x, y = a[x], b[y]
        score, done = np.zeros(x.size, np.int64), 0
        for n, least in steps:
            for k in range(0, x.size, 1 << 15):
                s = slice(k, k + (1 << 15))
                score[s] += np.count_nonzero(sig[x[s], done:n] == sig[y[s], done:n], axis=1)
            keep = score >= least
            x, y, score, done = x[keep], y[keep], score[keep], n
        out: tuple[list[int], list[int]] = ([], [])
        if not x.size:
            return out
        need = np.unique(np.concatenate([x, y]))
        sets = dict(zip(need.tolist(), shingle_sets(Words(*text_buffer(pa.array([held[i][3] for i in need])), lower=True))))
        up = {r: r for r in root.tolist()}

        def top(r):
            while up[r] != r:
                up[r] = up[up[r]]
                r = up[r]
            return r

        for k in np.argsort(-score, kind="stable").tolist():
            a, b = int(x[k]), int(y[k])
            ra, rb = top(int(root[a])), top(int(root[b]))
            if ra != rb and _near(sets[a], sets[b]):
                up[max(ra, rb)] = min(ra, rb)
                out[0].append(int(root[a]))
                out[1].append(int(root[b]))
        return out

    def work(batches):
        group, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "lo", "hi", "i", "root", "sig", "text")]
            out: tuple[list[int], list[int]] = ([], [])
            for key, lo, hi, *row in zip(*cols):
                if (key, lo, hi) != group:
                    if len(held) > 1:
                        for o, v in zip(out, links(group, held)):
                            o.extend(v)
                    group, held = (key, lo, hi), []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(group, held)], names=["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def _rare_keys(texts: DataFrame) -> DataFrame:
    """key, cid: of each text (cid, text) the shingles of its prefix, rarest first, that another of texts has too."""

    def work(batches):
        for b in batches:
            sets = shingle_sets(Words(*text_buffer(b.column("text")), lower=True))
            size = np.array([x.size for x in sets], np.int64)
            cid = np.repeat(b.column("cid").to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.repeat(size, size)), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["cid", "n", "key"])

    rows = staged(texts.select("cid", "text").mapInArrow(work, "cid long, n long, key long"), "shingles")
    shared = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").withColumn("rarity", F.col("k")), "shared")
    rows = hot_join(rows, shared, ["key"], "k")
    # Shingles that no other member has come first and need no bucket.
    by = Window.partitionBy("cid")
    rows = rows.withColumns({"_own": F.col("n") - F.count(F.lit(1)).over(by), "_at": F.row_number().over(by.orderBy("rarity", "key"))})
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    return rows.filter(F.col("_own") + F.col("_at") <= prefix).select("key", "cid")


def _near(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(x.size, y.size) < PERCENT * max(x.size, y.size):
        return False
    common = np.intersect1d(x, y, assume_unique=True).size
    return 100 * common >= PERCENT * (x.size + y.size - common)


def near_groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept; also k1, k2.

    Texts are linked when 100 * intersection >= 75 * union of their sets of 5-word shingles (A-Z lower-cased;
    fewer words are one shingle). A text without words is linked with nothing and keeps its own id. Null ids lose
    against any id; a component without ids has a null component_id. Repeated rows are linked as equal texts are.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    steps = least_matches(bands * rows)
    table = staged(sketch(docs, bands, rows, id_col, text_col), "sketch")
    head = F.struct("k1", "k2", "n", "bands", "sig")
    classes = table.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first(head).alias("_f"), F.count(F.lit(1)).alias("n_rows"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "digest", "least", "n_rows", "_f.*")
    classes = staged(classes, "classes")

    keys = classes.select(F.posexplode("bands").alias("band", "key"), "cid")
    pivot = F.min_by("cid", F.xxhash64("cid", F.col("band") % PIVOTS)).alias("pivot")
    pivots = keys.groupBy("key").agg(pivot, F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("_w", F.col("size"))
    members = staged(hot_join(keys.select("key", "cid"), staged(pivots, "pivots"), ["key"], "_w"), "members")
    # Texts of candidates only; one plan at every size. Rows that repeat id and text share a key: one stands for its class.
    candidates = staged(members.select("cid").distinct().join(classes.select("cid", "k1", "k2", "sig", "n_rows"), "cid"), "candidates")
    texts = hot_join(keyed(docs, id_col, text_col).select("k1", "k2", "text"), candidates, ["k1", "k2"], "n_rows", merge=True)
    texts = staged(texts.dropDuplicates(["k1", "k2"]).select("cid", "sig", "text"), "texts")

    def read_sig(col):
        return [np.frombuffer(x, np.uint16) for x in col.to_pylist()]

    def likely(x, y):
        done = score = 0
        for n, least in steps:
            score += int(np.count_nonzero(x[done:n] == y[done:n]))
            if score < least:
                return False
            done = n
        return True

    def read_text(col):
        return shingle_sets(Words(*text_buffer(col), lower=True))

    star = members.filter("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b")).distinct()
    star = staged(_meet(star, texts, "sig", read_sig, likely), "likely")
    roots = components(staged(_meet(star, texts, "text", read_text, _near), "links"))
    # Buckets that still hold members of several components.
    left = members.drop("pivot").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    left = staged(left, "bucket-members")

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows (key, cid, root) of keys with several roots, with the most frequent root and how many have others."""
        groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("_m"), F.sum("n").alias("size"))
        groups = groups.filter("_m.n < size").select("key", F.col("_m.root").alias("major"), (F.col("size") - F.col("_m.n")).alias("others"), "size", F.col("size").alias("_w"))
        return staged(hot_join(rows.select("key", "cid", "root"), staged(groups, "mixed"), ["key"], "_w"), "mixed-members")

    left = mixed(left)
    wide = left.filter(F.col("others") > WIDE).select("cid", "root").distinct()
    left = left.filter(F.col("others") <= WIDE)
    if not wide.isEmpty():
        left = left.unionByName(mixed(staged(_rare_keys(wide.join(texts, "cid")), "rare-keys").join(wide, "cid")))
    tops = components(staged(_blocks(left.join(texts, "cid"), steps), "bridges")).select(F.col("node").alias("root"), F.col("root").alias("top"))

    found = classes.select("cid", "digest", "least", "n_rows").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    found = staged(found, "found")
    tops = staged(tops.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("_w")), "root"), "tops")
    found = hot_join(found, tops, ["root"], "_w", "left").withColumn("root", F.coalesce("top", "root"))
    found = staged(found, "found-tops")
    least = staged(found.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_w")), "least")
    found = staged(hot_join(found, least, ["root"], "_w").select("digest", "component_id", "n_rows"), "components")
    # Texts without words have no class: without a digest the join spreads them.
    out = table.select("doc_id", "k1", "k2", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    out = hot_join(out, found, ["digest"], "n_rows", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "k1", "k2")


def drop_near_copies(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component (that of the smallest id) and every row without words; docs' columns unchanged.

    Of rows that repeat an id inside their component, one stays.
    """
    groups = near_groups(docs, bands, rows, id_col, text_col).filter("kept and n_shingles > 0")
    # A component's row has the least id; equal ids there are told apart by their text hash.
    one = groups.groupBy("component_id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).groupBy("component_id", "k1").agg(F.min(F.struct("k2", "n")).alias("_o"))
    one = staged(one.select("k1", "_o.k2", "_o.n"), "kept")
    text = docs[text_col].cast("string")
    key = F.xxhash64(docs[id_col].cast("long"), F.coalesce(text, F.lit("")))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows_ = docs.select(row, F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("k1"), key.alias("k2"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"))
    kept = hot_join(rows_.filter("_words").drop("_words"), one, ["k1", "k2"], "n", merge=True).dropDuplicates(["k1", "k2"]).select("_row")
    kept = kept.union(rows_.filter("not _words").select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - 4), lambda k: array_to_string(w[k + 1 : k + 5], ' '))) END AS g FROM d),
s AS (SELECT doc_id, unnest(g) AS x FROM g), n AS (SELECT doc_id, len(g) AS n FROM g),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, n AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""
