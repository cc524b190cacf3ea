"""Connected components and the label-sharing graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import hot_join
from quern.sources.shared import staged


#: Labels of one content that a task pairs with all others.
SHARE = 256


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    return staged(df, "cut")


def _to_least(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (u, v) with m, the least of u and its neighbours in edges: hubs of any degree are split by hot_join."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("_deg"))
    return hot_join(rows, least, ["u"], "_deg", least=64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node that each node with an edge can reach. Self-loops are ignored.

    Alternating star contraction: every round hooks each node's larger neighbours, then its smaller ones, to the
    least, and writes the edges out. The number of rounds grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, both.filter("v > u")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        down = _to_least(large, large).select(F.col("v").alias("x"), F.col("m").alias("y"))
        down = down.union(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.col("m").alias("y"))).filter("x <> y")
        now = cut(down.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(out.select(F.col("root").alias("node"), "root").distinct())


def split_groups(samples: DataFrame) -> DataFrame:
    """samples (sample_id, filename, word, sha256) with aug_source, split_group, split_group_size, aug_linked.

    Files with equal content, and files made from the same source or from each other, share a group named by its
    smallest sample_id; links are transitive. Each kind of link is a hub node, so edges grow with the files.
    """
    from quern.functions.text import augmentation_source

    s = samples.withColumn("aug_source", augmentation_source(F.col("filename"), F.col("word")))
    me = F.concat(F.lit("sample:"), F.col("sample_id")).alias("a")
    content = s.filter("sha256 is not null").select(me, F.concat(F.lit("sha:"), F.col("sha256")).alias("b"))
    hub = F.concat(F.lit("augsrc:"), F.col("aug_source"))
    copies = s.filter("aug_source is not null").select(me, hub.alias("b"))
    sources = s.select("sample_id", F.col("filename").alias("_f")).join(s.filter("aug_source is not null").select("aug_source").distinct(), F.col("_f") == F.col("aug_source"))
    roots = components(content.union(copies).union(sources.select(me, hub.alias("b"))))
    s = s.join(roots.withColumnRenamed("node", "_n"), F.concat(F.lit("sample:"), F.col("sample_id")) == F.col("_n"), "left")
    s = s.withColumn("_root", F.coalesce("root", "sample_id"))
    named = s.groupBy("_root").agg(F.min("sample_id").alias("split_group"), F.count(F.lit(1)).cast("int").alias("split_group_size"), F.bool_or(F.col("aug_source").isNotNull()).alias("aug_linked"))
    return hot_join(s, named.withColumn("_files", F.col("split_group_size")), ["_root"], "_files").drop("_root", "_n", "root")


def label_pairs(samples: DataFrame, word: str = "word", sha: str = "sha256") -> DataFrame:
    """label_a < label_b that share a content, shared_clips, and its share of either label's samples."""
    d = samples.select(F.col(word).alias("w"), F.col(sha).alias("h")).filter("h is not null")
    labels = staged(d.distinct(), "labels")
    # A content of many labels is dealt out: each label is one share's own and meets the shares of all.
    many = staged(labels.groupBy("h").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").withColumn("n", F.ceil(F.col("_k") / SHARE).cast("int")), "contents")
    labels = hot_join(labels, many, ["h"], "_k")
    x = labels.select("h", "w", F.pmod(F.xxhash64("w"), F.col("n")).cast("int").alias("s"))
    y = labels.select("h", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.w") < F.col("y.w")))
    pairs = pairs.groupBy(F.col("x.w").alias("label_a"), F.col("y.w").alias("label_b")).agg(F.count(F.lit(1)).alias("shared_clips"))
    size = samples.groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(size.select(F.col(word).alias("label_a"), F.col("n").alias("na")), "label_a").join(size.select(F.col(word).alias("label_b"), F.col("n").alias("nb")), "label_b")
    fa, fb = F.col("shared_clips") / F.col("na"), F.col("shared_clips") / F.col("nb")
    return pairs.select("label_a", "label_b", "shared_clips", fa.alias("fraction_of_a"), fb.alias("fraction_of_b"), F.greatest(fa, fb).alias("max_fraction"), F.least(fa, fb).alias("min_fraction"))


def pair_treatment(pairs: DataFrame) -> DataFrame:
    """pairs with evidence: what the shared share says about two labels."""
    e = F.when(F.col("min_fraction") >= 0.95, "near_identical").when(F.col("max_fraction") >= 0.5, "mostly_copies")
    return pairs.withColumn("evidence", e.when(F.col("shared_clips") <= 2, "sporadic").otherwise("partial_overlap"))


def label_components(pairs: DataFrame) -> DataFrame:
    """labels (sorted), size of each component of the label-sharing graph; largest first, then the least label."""
    roots = components(pairs, "label_a", "label_b")
    return roots.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("labels"), F.count(F.lit(1)).alias("size")).drop("root").orderBy(F.desc("size"), F.col("labels")[0])


def label_partners(pairs: DataFrame) -> DataFrame:
    """word, partners: how many labels each label shares content with."""
    both = pairs.select(F.col("label_a").alias("word"), F.col("label_b").alias("o")).union(pairs.select(F.col("label_b"), F.col("label_a")))
    return both.groupBy("word").agg(F.count_distinct("o").alias("partners"))
