"""Exact dedup by content sort (operator 8): DataFrame functions only.

Texts are range-partitioned by sampled splitters over (prefix, content hash, salt) of their normalised bytes and
sorted externally by the whole content, so equal texts become neighbours; a window over the sorted run compares
neighbouring texts whole and keeps the smallest id. The range keys are bounded, so the splitter sample never
carries whole texts, and texts cross the network once.

Skew: a first pass counts digests with map-side partial aggregation. At most ``4 * P`` digests can hold more than
rows / (4 * P) rows each, for P shuffle partitions; only those are salted by row, so a group of any size is sorted
in bounded pieces, whatever its ids: null, equal or distinct. The smallest id of such a group, known from the first
pass, joins its pieces. What is broadcast has fewer than ``4 * P`` rows whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions, staged, word_rule
from quern.operators.skew import hot_limit

#: Characters of the content that take part in the range key.
PREFIX = 48


def normalised(text: Column) -> Column:
    """Null is empty; every white-space run becomes one space. Byte scans find the texts that need a regex."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    odd = F.contains(plain, F.lit("  "))
    for c in "\t\v\f\r":
        odd = odd | F.contains(plain, F.lit(c))
    return F.when(odd, word_rule(text)).otherwise(plain)


def _sorted_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df's columns in a struct _row, with keep_id, group_size, kept and text_sha256 of each row."""
    p = partitions(df.sparkSession)
    row = F.struct(*[df[c] for c in df.columns]).alias("_row")
    rows = df.select(row, df[id_col].alias("_id"), normalised(df[text_col]).alias("_t"))
    rows = rows.withColumns({"_sha": F.sha2("_t", 256), "_h": F.xxhash64("_t")})
    digests = df.select(df[id_col].alias("_id"), F.unhex(F.sha2(normalised(df[text_col]), 256)).alias("_hot"))
    digests = staged(digests.groupBy("_hot").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")), "digests")
    limit = hot_limit(digests.agg(F.sum("_n")).first()[0] or 0, p)
    # Fewer than 4 * p rows by the choice of the limit: its size is bounded whatever the input.
    hot = digests.filter(F.col("_n") > limit)
    if not hot.isEmpty():
        # How many rows of each hot group have its smallest id: few groups, so one partial aggregate.
        least = df.select(df[id_col].alias("_id"), F.unhex(F.sha2(normalised(df[text_col]), 256)).alias("_hot")).join(F.broadcast(hot), "_hot")
        hot = staged(least.groupBy("_hot", "_n", "_first").agg(F.count_if(F.col("_id").eqNullSafe(F.col("_first"))).alias("_k")), "hot")
    else:
        hot = hot.withColumn("_k", F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(hot), F.unhex("_sha") == hot["_hot"], "left")
    salts = F.ceil(F.col("_n") / F.lit(limit)).cast("long")
    any_salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), salts)
    # Rows with the smallest id go to salt 0. Where they alone are too many they are spread like the others: with
    # more than limit >= 1000 of them, salt 0 gets some but for a chance below exp(-1000).
    salt = F.when((F.col("_k") <= limit) & F.col("_id").eqNullSafe(F.col("_first")), F.lit(0)).otherwise(any_salt)
    rows = rows.withColumns({"_p": F.substring("_t", 1, PREFIX), "_s": F.when(F.col("_n").isNotNull(), salt).otherwise(F.lit(0)).cast("long")}).drop("_t")
    rows = rows.repartitionByRange(p, "_p", "_h", "_s").withColumn("_t", normalised(F.col(f"_row.`{text_col}`")))
    same = Window.partitionBy("_p", "_h", "_s", "_t")
    rows = rows.select(
        "_row", "_id", "_sha", "_n", "_first", "_s",
        F.row_number().over(same.orderBy(F.col("_id").asc_nulls_last())).alias("_rn"),
        F.min("_id").over(same).alias("_least"),
        F.count(F.lit(1)).over(same).alias("_size"),
    )
    hot_row = F.col("_n").isNotNull()
    return rows.select(
        "_row",
        F.col("_id").alias("doc_id"),
        F.when(hot_row, F.col("_first")).otherwise(F.col("_least")).alias("keep_id"),
        F.coalesce("_n", "_size").alias("group_size"),
        ((F.col("_rn") == 1) & (F.col("_s") == 0) & (~hot_row | F.col("_id").eqNullSafe(F.col("_first")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group, group size and decision of every row of df.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. Null texts count as empty.
    Null ids: they lose against any id, and keep_id is null only where a group has no id at all. Rows that repeat
    both id and text are copies of each other: exactly one row of every group is kept. An empty table gives an
    empty result; other columns of df are ignored, whatever their names.
    """
    only = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return _sorted_runs(only, "id", "text").drop("_row")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_groups keeps, with df's columns unchanged."""
    return _sorted_runs(df, id_col, text_col).filter("kept").select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns])


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
