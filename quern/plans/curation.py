"""Queries: manifest, duplicates, labels, splits, samples, vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import graph, quality, reconcile, sampling, vocabulary
from quern.operators.skew import with_group
from quern.plans.registry import AUG, PROXY, SAMPLES, query, r6, samples, table

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


@query("""SELECT sha256(text) AS sha256, count(*) AS n_files, count(DISTINCT source) AS n_labels, string_agg(DISTINCT source, '|' ORDER BY source) AS labels, 0 AS part,
  string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR)) AS paths FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_content_groups(spark, sf):
    return reconcile.content_groups(samples(spark, sf), path="sample_id")


@query(f"""WITH {SAMPLES} SELECT doc_id, n_chars > 300 AS eligible, CASE WHEN n_chars > 300 THEN count(*) OVER w ELSE 0 END AS dup_group_size,
  n_chars > 300 AND count(*) OVER w > 1 AND (min(word) OVER w <> max(word) OVER w) AS dup_cross_label FROM samples WINDOW w AS (PARTITION BY n_chars > 300, sha256)""")
def annotate_duplicates(spark, sf):
    s = samples(spark, sf).withColumn("eligible", F.col("n_chars") > 300)
    return reconcile.annotate_duplicates(s, F.col("eligible")).select("doc_id", "eligible", "dup_group_size", "dup_cross_label")


def _rows_and_files(spark, sf):
    """Metadata rows and a file index whose names partly miss, repeat or conflict."""
    s = samples(spark, sf)
    gone = F.when(F.col("lang") == "es", F.concat(F.lit("gone-"), "filename")).otherwise(F.col("filename"))
    rows = s.select(F.col("doc_id").alias("csv_row"), F.when(F.col("n_chars") > 9000, " ").otherwise(F.col("word")).alias("word"), gone.alias("filename"))
    new = F.when(F.col("n_chars") <= 400, F.concat(F.lit("new-"), "filename")).otherwise(F.col("filename"))
    files = s.withColumn("filename", new).select(F.concat("repo_path", F.lit("#"), "sample_id").alias("repo_path"), F.col("lang").alias("folder"), "filename", F.col("n_chars").alias("size_bytes"), F.when(F.col("word") != "src3", F.col("sha256")).alias("sha256"))
    return rows, files


_MANIFEST = f"""{SAMPLES}, rws AS (SELECT doc_id AS csv_row, CASE WHEN n_chars > 9000 THEN ' ' ELSE word END AS word, CASE WHEN lang = 'es' THEN 'gone-' ELSE '' END || filename AS filename FROM samples),
files AS (SELECT repo_path || '#' || sample_id AS repo_path, lang AS folder, CASE WHEN n_chars <= 400 THEN 'new-' ELSE '' END || filename AS filename, n_chars AS size_bytes, CASE WHEN word <> 'src3' THEN sha256 END AS sha256 FROM samples),
idx AS (SELECT filename, count(*) AS k, min(repo_path) AS repo_path, arg_min(folder, repo_path) AS folder, arg_min(size_bytes, repo_path) AS size_bytes,
  (SELECT f2.sha256 FROM files f2 WHERE f2.filename = f.filename ORDER BY f2.repo_path LIMIT 1) AS sha256 FROM files f GROUP BY filename),
lab AS (SELECT filename, count(DISTINCT word) AS labels FROM rws GROUP BY filename),
j AS (SELECT r.*, labels, row_number() OVER (PARTITION BY r.filename, r.word ORDER BY csv_row) AS nth, coalesce(k, 0) AS k, i.repo_path, folder, size_bytes, sha256
  FROM rws r JOIN lab USING (filename) LEFT JOIN idx i USING (filename)),
man AS (SELECT csv_row, word, filename, CASE WHEN trim(word) = '' THEN 'empty_word_or_filename' WHEN labels > 1 THEN 'conflicting_label_for_file' WHEN nth > 1 THEN 'duplicate_csv_row'
  WHEN k = 0 THEN 'file_missing_in_repo' WHEN k > 1 THEN 'ambiguous_filename' WHEN sha256 IS NULL THEN 'missing_sha256' ELSE '' END AS issue,
  CASE WHEN k = 1 THEN repo_path END AS repo_path, CASE WHEN k = 1 THEN folder END AS folder, CASE WHEN k = 1 THEN size_bytes END AS size_bytes, CASE WHEN k = 1 THEN sha256 END AS sha256 FROM j
  UNION ALL SELECT -1, NULL, filename, 'repo_file_not_in_csv', repo_path, folder, size_bytes, sha256 FROM files WHERE filename NOT IN (SELECT filename FROM rws))"""


@query(f"WITH {_MANIFEST} SELECT *, {PROXY.format(f='filename')} AS source_proxy, issue = '' AS eligible_pre_probe, CASE WHEN issue = '' THEN repo_path END AS sample_id FROM man")
def manifest_reconcile(spark, sf):
    return reconcile.manifest(*_rows_and_files(spark, sf))


@query(f"WITH {_MANIFEST} SELECT issue, folder, lower(regexp_extract(filename, '[^.]*$')) AS extension, count(*) AS n, coalesce(sum(size_bytes), 0) AS bytes FROM man GROUP BY ALL")
def manifest_summary(spark, sf):
    m = reconcile.manifest(*_rows_and_files(spark, sf)).withColumn("extension", tx.extension(F.col("filename")))
    return m.groupBy("issue", "folder", "extension").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query("""WITH p AS (SELECT l_orderkey, count(*) AS decoded_frames, max(l_linenumber) = count(*) AS sha_ok, min(l_quantity) > 2 AS dl_ok, CASE WHEN sum(l_tax) > 0.02 THEN true END AS dec_ok FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE '' END AS issue, p.* FROM orders LEFT JOIN p ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN issue <> '' THEN issue WHEN dl_ok IS NULL THEN 'not_probed' WHEN NOT dl_ok THEN 'download_failed' WHEN NOT coalesce(sha_ok, false) THEN 'sha256_mismatch'
  WHEN NOT coalesce(dec_ok, false) THEN 'undecodable' WHEN decoded_frames < 3 THEN 'fewer_than_min_decoded_frames' ELSE '' END AS exclusion_reason FROM j""")
def validate_ladder(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("repo_path")).agg(
        F.count(F.lit(1)).alias("decoded_frames"), (F.max("l_linenumber") == F.count(F.lit(1))).alias("sha256_match"), (F.min("l_quantity") > 2).alias("download_ok"), F.when(F.sum("l_tax") > 0.02, True).alias("decode_ok"))
    m = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("repo_path"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("").alias("issue"))
    return reconcile.validate(m, p, 3).select("o_orderkey", "exclusion_reason")


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(url, '\.html$') THEN 'html' WHEN regexp_matches(url, '[?]') THEN 'query' WHEN regexp_matches(url, '#') THEN 'anchor' WHEN regexp_matches(url, '/$') THEN 'folder' ELSE 'other' END AS url_class,
  {PROXY.format(f="replace(regexp_extract(url, '[^/]*$'), '.html', '.mp4')")} AS source_proxy FROM pages""")
def source_proxy(spark, sf):
    p = table(spark, sf, "pages")
    kinds = (("html", r"\.html$"), ("query", "[?]"), ("anchor", "#"), ("folder", "/$"))
    name = F.replace(F.substring_index("url", "/", -1), F.lit(".html"), F.lit(".mp4"))
    return p.select("page_id", tx.first_match(F.col("url"), kinds).alias("url_class"), tx.source_proxy(name).alias("source_proxy"))


def _words(spark, sf):
    """Labels out of part names and order priorities: words, pairs of words, dashed and doubled forms."""
    p = table(spark, sf, "part").select("p_partkey", F.split(F.lower(F.trim("p_name")), " ").alias("w"))
    k = F.col("p_partkey") % 9
    a, b = F.col("w")[0], F.coalesce(F.try_element_at("w", F.lit(2)), F.lit("x"))
    return p.select(F.when(k == 0, F.concat(a, b)).when(k == 1, F.concat(a, F.lit(" "), b)).when(k == 2, F.concat(a, F.lit("-cl"))).when(k == 3, F.concat(a, a)).when(k == 4, F.initcap(a)).when(k == 5, b).otherwise(a).alias("word"))


_WORDS = """pw AS (SELECT p_partkey % 9 AS k, string_split(lower(trim(p_name)), ' ') AS w FROM part),
ab AS (SELECT k, w[1] AS a, coalesce(w[2], 'x') AS b FROM pw),
words AS (SELECT CASE k WHEN 0 THEN a || b WHEN 1 THEN a || ' ' || b WHEN 2 THEN a || '-cl' WHEN 3 THEN a || a WHEN 4 THEN upper(a[1]) || a[2:] WHEN 5 THEN b ELSE a END AS word FROM ab)"""


@query(rf"""WITH {_WORDS}, x AS (SELECT word AS label, count(*) AS n_samples, regexp_replace(lower(trim(word)), '[\s_\-]+', '', 'g') AS k FROM words GROUP BY word),
ks AS (SELECT k, max(label) AS l FROM x GROUP BY k), nd AS (SELECT k, string_agg(label, ' | ' ORDER BY label) AS detail FROM x GROUP BY k HAVING count(*) > 1),
cu AS (SELECT label, n_samples, k, unnest(range(2, length(k) - 1)) AS i FROM x WHERE length(k) > 3),
cc AS (SELECT label, n_samples, 'concatenation_of_labels' AS anomaly, arg_min(a.l || ' + ' || b.l, i) AS detail FROM cu JOIN ks a ON a.k = left(cu.k, i) JOIN ks b ON b.k = substr(cu.k, i + 1) WHERE a.l <> label AND b.l <> label GROUP BY label, n_samples)
SELECT label, n_samples, 'whitespace' AS anomaly, 'leading/trailing/double whitespace' AS detail FROM x WHERE label <> trim(label) OR contains(label, '  ')
UNION ALL SELECT label, n_samples, 'uppercase', 'contains uppercase characters' FROM x WHERE label <> lower(label)
UNION ALL SELECT label, n_samples, 'unusual_characters', array_to_string(regexp_extract_all(lower(label), '[^a-z0-9 \-_'']'), '') FROM x WHERE regexp_matches(lower(label), '[^a-z0-9 \-_'']')
UNION ALL SELECT label, n_samples, 'contains_digit', '' FROM x WHERE regexp_matches(label, '\d')
UNION ALL SELECT label, n_samples, 'classifier_suffix', 'ends with -cl' FROM x WHERE regexp_matches(lower(label), '-cl$|\bcl\b')
UNION ALL SELECT label, n_samples, 'repeated_word', left(k, length(k) // 2) FROM x WHERE length(k) >= 4 AND length(k) % 2 = 0 AND left(k, length(k) // 2) = right(k, length(k) // 2)
UNION ALL SELECT label, n_samples, 'long_unseparated', CAST(length(k) AS VARCHAR) FROM x WHERE length(k) >= 14 AND NOT regexp_matches(label, '[ \-_]')
UNION ALL SELECT label, n_samples, 'near_duplicate_label', detail FROM x JOIN nd USING (k) UNION ALL SELECT * FROM cc""")
def label_audit(spark, sf):
    return reconcile.audit_labels(_words(spark, sf))


_PAIRS = f"""{SAMPLES}, lab AS (SELECT DISTINCT sha256, word FROM samples), sz AS (SELECT word, count(*) AS n FROM samples GROUP BY word),
pr AS (SELECT a.word AS label_a, b.word AS label_b, count(*) AS shared_clips FROM lab a JOIN lab b ON a.sha256 = b.sha256 AND a.word < b.word GROUP BY ALL),
pairs AS (SELECT label_a, label_b, shared_clips, shared_clips / x.n AS fa, shared_clips / y.n AS fb FROM pr JOIN sz x ON x.word = label_a JOIN sz y ON y.word = label_b)"""


@query(f"WITH {_PAIRS} SELECT label_a, label_b, shared_clips, round(fa, 6) AS fraction_of_a, round(fb, 6) AS fraction_of_b, round(greatest(fa, fb), 6) AS max_fraction, round(least(fa, fb), 6) AS min_fraction FROM pairs")
def label_pairs(spark, sf):
    p = graph.label_pairs(samples(spark, sf))
    return p.select("label_a", "label_b", "shared_clips", *[r6(c).alias(c) for c in ("fraction_of_a", "fraction_of_b", "max_fraction", "min_fraction")])


@query(f"""WITH {_PAIRS} SELECT label_a, label_b, CASE WHEN least(fa, fb) >= 0.95 THEN 'near_identical' WHEN greatest(fa, fb) >= 0.5 THEN 'mostly_copies' WHEN shared_clips <= 2 THEN 'sporadic' ELSE 'partial_overlap' END AS evidence FROM pairs""")
def pair_treatment(spark, sf):
    return graph.pair_treatment(graph.label_pairs(samples(spark, sf))).select("label_a", "label_b", "evidence")


@query(f"WITH {_PAIRS}, b AS (SELECT label_a AS word, label_b AS o FROM pairs UNION ALL SELECT label_b, label_a FROM pairs) SELECT word, count(DISTINCT o) AS partners FROM b GROUP BY word")
def label_partners(spark, sf):
    return graph.label_partners(graph.label_pairs(samples(spark, sf)))


_LANGPAIRS = f"""RECURSIVE {SAMPLES}, lab AS (SELECT DISTINCT sha256, lang || ':' || word AS w FROM samples), e AS (SELECT DISTINCT a.w AS x, b.w AS y FROM lab a JOIN lab b ON a.sha256 = b.sha256 AND a.w <> b.w),
reach AS (SELECT DISTINCT x AS node, x AS r FROM e UNION SELECT reach.node, e.y FROM reach JOIN e ON e.x = reach.r), root AS (SELECT node, min(r) AS root FROM reach GROUP BY node)"""


@query(f"WITH {_LANGPAIRS} SELECT string_agg(node, '|' ORDER BY node) AS labels, count(*) AS size FROM root GROUP BY root")
def sharing_components(spark, sf):
    s = samples(spark, sf).withColumn("word", F.concat_ws(":", "lang", "word"))
    return graph.label_components(graph.label_pairs(s)).select(F.array_join("labels", "|").alias("labels"), "size")


@query(f"""WITH RECURSIVE {SAMPLES}, a AS (SELECT *, {AUG.format(f="filename", w="word")} AS aug_source FROM samples),
hub AS (SELECT sample_id, 'h' || sha256 AS h FROM a UNION SELECT sample_id, 'a' || aug_source FROM a WHERE aug_source IS NOT NULL
  UNION SELECT sample_id, 'a' || filename FROM a WHERE filename IN (SELECT aug_source FROM a WHERE aug_source IS NOT NULL)),
reach AS (SELECT sample_id, sample_id AS r FROM a UNION SELECT reach.sample_id, y.sample_id FROM reach JOIN hub x ON x.sample_id = reach.r JOIN hub y ON y.h = x.h),
g AS (SELECT sample_id, min(r) AS split_group FROM reach GROUP BY sample_id)
SELECT a.sample_id, aug_source, split_group, count(*) OVER (PARTITION BY split_group) AS split_group_size, bool_or(aug_source IS NOT NULL) OVER (PARTITION BY split_group) AS aug_linked FROM a JOIN g USING (sample_id)""")
def split_groups(spark, sf):
    return graph.split_groups(samples(spark, sf)).select("sample_id", "aug_source", "split_group", F.col("split_group_size").cast("long").alias("split_group_size"), "aug_linked")


_EVIDENCE = rf"""{SAMPLES}, p AS (SELECT *, {PROXY.format(f="filename")} AS source_proxy, {AUG.format(f="filename", w="word")} AS aug_source, min(sample_id) OVER (PARTITION BY sha256) AS split_group FROM samples),
ev AS (SELECT *, CASE WHEN source_proxy = 'word_timestamp_n' AND regexp_matches(filename, '^.*_\d{{8}}_\d{{6}}_\d+\.mp4$') THEN regexp_extract(filename, '^(.*_\d{{8}}_\d{{6}})_\d+\.mp4$', 1) END AS batch,
  min(word) OVER (PARTITION BY sha256) <> max(word) OVER (PARTITION BY sha256) AS cross_label, count(*) OVER (PARTITION BY sha256, word) > 1 AS within_dup, aug_source IS NOT NULL AS augmented FROM p)"""


def _evidence(spark, sf):
    s = samples(spark, sf)
    s = s.withColumns({"source_proxy": tx.source_proxy(F.col("filename")), "aug_source": tx.augmentation_source(F.col("filename"), F.col("word")), })
    return vocabulary.file_evidence(with_group(s, ["sha256"], F.min("sample_id").alias("split_group")))


@query(f"WITH {_EVIDENCE} SELECT sample_id, source_proxy, aug_source, batch, cross_label, within_dup, augmented, a.sample_id IS NOT NULL AS source_present FROM ev LEFT JOIN (SELECT DISTINCT filename AS fn, 1 AS sample_id FROM samples) a ON a.fn = aug_source".replace("SELECT sample_id, source_proxy", "SELECT ev.sample_id, source_proxy"))
def file_evidence(spark, sf):
    e = _evidence(spark, sf)
    names = samples(spark, sf).select(F.col("filename").alias("aug_source"), F.lit(True).alias("_p")).distinct()
    return e.join(names, "aug_source", "left").select("sample_id", "source_proxy", "aug_source", "batch", "cross_label", "within_dup", "augmented", F.col("_p").isNotNull().alias("source_present"))


_FEATURES = _EVIDENCE + """, bt AS (SELECT word, max(n) AS mb FROM (SELECT word, batch, count(*) AS n FROM ev WHERE batch IS NOT NULL GROUP BY ALL) GROUP BY word),
f0 AS (SELECT word, count(*) AS clips, count(DISTINCT sha256) AS unique_clips, count(DISTINCT split_group) AS units, count_if(cross_label) AS cross_label_clips, count_if(within_dup) AS within_dup_clips,
  count_if(augmented) AS augmented_clips, count(DISTINCT source_proxy) AS source_patterns, count_if(source_proxy = 'numericid-WORD') AS numericid_clips,
  count_if(split = 'train') AS train_clips, count(DISTINCT CASE WHEN split = 'train' THEN split_group END) AS train_units, count_if(split = 'val') AS val_clips, count(DISTINCT CASE WHEN split = 'val' THEN split_group END) AS val_units,
  count_if(split = 'test') AS test_clips, count(DISTINCT CASE WHEN split = 'test' THEN split_group END) AS test_units FROM ev GROUP BY word),
feat AS (SELECT f0.*, coalesce(mb, 0) AS max_batch_clips, cross_label_clips / clips AS cross_label_fraction, augmented_clips / clips AS augmented_fraction, 1 - unique_clips / clips AS within_dup_fraction,
  coalesce(mb, 0) / clips AS max_batch_share, train_units / units AS train_unit_fraction, least(val_units, test_units) AS min_eval_units FROM f0 LEFT JOIN bt USING (word)),
reas AS (SELECT *, concat_ws('|', CASE WHEN augmented_fraction >= 0.5 THEN 'augmentation_dominated' END, CASE WHEN augmented_clips > 9 AND augmented_fraction < 0.5 THEN 'augmented_copies' END,
  CASE WHEN cross_label_fraction >= 1 THEN 'fully_shared_with_other_labels' END, CASE WHEN cross_label_fraction >= 0.5 AND cross_label_fraction < 1 THEN 'heavily_shared_with_other_labels' END,
  CASE WHEN cross_label_clips > 2 AND cross_label_fraction < 0.5 THEN 'shares_clips_with_other_labels' END, CASE WHEN val_units < 3 THEN 'too_few_val_units' END, CASE WHEN test_units < 3 THEN 'too_few_test_units' END,
  CASE WHEN NOT train_unit_fraction BETWEEN 0.6 AND 0.8 THEN 'imbalanced_split' END, CASE WHEN within_dup_fraction > 0.1 THEN 'within_class_duplicates' END, CASE WHEN max_batch_share > 0.5 THEN 'single_batch_dominated' END,
  CASE WHEN source_patterns < 2 THEN 'single_source_collection' END) AS reasons FROM feat)"""
_RULES = vocabulary.RULES | {"max_augmented_clips": 9, "max_cross_label_shared_clips": 2, "min_val_units": 3, "min_test_units": 3}


def _features(spark, sf):
    return vocabulary.class_features(_evidence(spark, sf))


@query(f"WITH {_FEATURES} SELECT word, clips, unique_clips, units, cross_label_clips, within_dup_clips, augmented_clips, source_patterns, numericid_clips, max_batch_clips, train_clips, train_units, val_clips, val_units, test_clips, test_units, round(cross_label_fraction, 6) AS cross_label_fraction, round(within_dup_fraction, 6) AS within_dup_fraction, round(max_batch_share, 6) AS max_batch_share, round(train_unit_fraction, 6) AS train_unit_fraction, min_eval_units FROM feat")
def class_features(spark, sf):
    f = _features(spark, sf)
    return f.select("word", "clips", "unique_clips", "units", "cross_label_clips", "within_dup_clips", "augmented_clips", "source_patterns", "numericid_clips", "max_batch_clips", "train_clips", "train_units", "val_clips", "val_units", "test_clips", "test_units", *[r6(c).alias(c) for c in ("cross_label_fraction", "within_dup_fraction", "max_batch_share", "train_unit_fraction")], "min_eval_units")


def _reasons(spark, sf):
    return _features(spark, sf).withColumn("reasons", vocabulary.exclusion_reasons(_RULES))


@query(f"WITH {_FEATURES} SELECT word, reasons FROM reas")
def exclusion_reasons(spark, sf):
    return _reasons(spark, sf).select("word", "reasons")


@query(f"WITH {_FEATURES} SELECT reason, count(*) AS n, count_if(i = 1) AS n_primary FROM (SELECT unnest(string_split(reasons, '|')) AS reason, generate_subscripts(string_split(reasons, '|'), 1) AS i FROM reas) WHERE reason <> '' GROUP BY reason")
def reason_histogram(spark, sf):
    return vocabulary.reason_counts(_reasons(spark, sf))


@query(f"WITH {_FEATURES} SELECT word, string_split(reasons, '|')[1] AS primary_reason, reasons = '' AS in_pool FROM reas")
def primary_reason(spark, sf):
    return _reasons(spark, sf).select("word", vocabulary.primary_reason(F.col("reasons")).alias("primary_reason"), (F.col("reasons") == "").alias("in_pool"))


@query(f"WITH {_FEATURES} SELECT word, CASE WHEN word IN ('src3', 'src7') THEN concat_ws('|', nullif(reasons, ''), 'deferred_pending_inspection') ELSE reasons END AS reasons FROM reas")
def deferred_override(spark, sf):
    f = _reasons(spark, sf)
    return vocabulary.defer(f, spark.createDataFrame([("src3",), ("src7",)], "word string")).select("word", "reasons")


@query(f"WITH {_FEATURES} SELECT word, row_number() OVER (ORDER BY min_eval_units DESC, source_patterns DESC, units DESC, sha256('42:' || word)) AS rank FROM feat")
def rank_candidates(spark, sf):
    return vocabulary.rank_candidates(_features(spark, sf), ["min_eval_units", "source_patterns", "units"], 42).select("word", "rank")


@query(f"WITH {_FEATURES} SELECT count(*) AS classes, sum(clips) AS clips, sum(unique_clips) AS unique_clips, sum(units) AS units, sum(train_units) AS train_units, sum(val_units) AS val_units, min(clips) AS min_clips, median(clips) AS median_clips, max(clips) AS max_clips, round(max(clips) / min(clips), 6) AS class_imbalance_ratio, min(val_units) AS min_val_units, min(test_units) AS min_test_units FROM feat")
def summary_counts(spark, sf):
    s = vocabulary.summary_counts(_features(spark, sf))
    return s.select("classes", "clips", "unique_clips", "units", "train_units", "val_units", "min_clips", "median_clips", "max_clips", r6("class_imbalance_ratio").alias("class_imbalance_ratio"), "min_val_units", "min_test_units")


@query(f"""WITH {_FEATURES}, c AS (SELECT word, clips, units, row_number() OVER (ORDER BY word) - 1 AS i FROM feat) SELECT 'all' AS name, i AS index, word AS class, clips, units FROM c""")
def vocabulary_doc(spark, sf):
    doc = vocabulary.vocabulary_doc(_features(spark, sf), "all")
    schema = "struct<name string, num_classes int, vocabulary_sha256 string, classes array<struct<index long, class string, clips long, units long>>>"
    return doc.select("name", F.explode(F.from_json("document", schema).classes).alias("c")).select("name", "c.*")


@query(f"WITH {_EVIDENCE} SELECT count(DISTINCT batch) AS batches, (SELECT count(*) FROM (SELECT batch FROM ev WHERE batch IS NOT NULL GROUP BY batch HAVING count(DISTINCT split) > 1)) AS spanning FROM ev")
def batch_stats(spark, sf):
    b = _evidence(spark, sf).filter("batch is not null").groupBy("batch").agg(F.count_distinct("split").alias("k"))
    return b.agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("k") > 1).alias("spanning"))


_TARGETS = f"""{SAMPLES}, z AS (SELECT word, count(*) AS n FROM samples GROUP BY word), r(split, i, r) AS (VALUES ('train', 0, 0.7), ('val', 1, 0.15), ('test', 2, 0.15)),
a AS (SELECT word, n, split, i, floor(round(n * CAST(r AS DOUBLE), 9)) AS base, round(n * CAST(r AS DOUBLE), 9) - floor(round(n * CAST(r AS DOUBLE), 9)) AS frac, sha256('42:' || word || ':' || split) AS h FROM z, r),
b AS (SELECT *, n - sum(base) OVER (PARTITION BY word) AS lft, row_number() OVER (PARTITION BY word ORDER BY frac DESC, h) AS rk FROM a),
c AS (SELECT *, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS t FROM b), d AS (SELECT *, CASE WHEN n >= 3 AND i > 0 AND t = 0 THEN 1 ELSE 0 END AS lift FROM c),
tg AS (SELECT word, split, CAST(t + lift - CASE WHEN i = 0 THEN sum(lift) OVER (PARTITION BY word) ELSE 0 END AS BIGINT) AS target FROM d)"""


@query(f"WITH {_TARGETS} SELECT * FROM tg")
def class_targets(spark, sf):
    return sampling.class_targets(samples(spark, sf).groupBy("word").agg(F.count(F.lit(1)).alias("n")), RATIOS, 42)


# Every class meets its targets here, so the shares are those of the targets.
@query(f"""WITH {_TARGETS}, q AS (SELECT split, sum(target) AS k, sum(target) / (SELECT count(*) FROM samples) AS f, count_if(target = 0) AS empty FROM tg GROUP BY split)
SELECT 'unique sample_id' AS check, true AS passed, '0 duplicated ids' AS detail UNION ALL SELECT 'each file in exactly one split', k = 0, k || ' paths repeated' FROM (SELECT count(*) - count(DISTINCT repo_path) AS k FROM samples)
UNION ALL SELECT 'split values valid', true, '0 invalid values' UNION ALL SELECT 'no identical content across splits', true, '0 hashes span >1 split' UNION ALL SELECT 'no split group across splits', true, '0 groups span >1 split'
UNION ALL SELECT 'only eligible samples in split', true, '0 ineligible samples present' UNION ALL SELECT 'all eligible samples assigned', true, '0 eligible samples missing'
UNION ALL SELECT 'every expected class present in ' || split, empty = 0, empty || ' expected classes missing' FROM q
UNION ALL SELECT split || ' ratio ~ ' || CASE split WHEN 'train' THEN '0.70' ELSE '0.15' END, abs(f - CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END) <= 0.02, printf('%.4f', f) FROM q""")
def assign_splits(spark, sf):
    s = with_group(samples(spark, sf).drop("split"), ["sha256"], F.min("sample_id").alias("split_group"))
    out = sampling.assign_splits(s, RATIOS, 42)
    return quality.split_checks(out, s.select("sample_id"), RATIOS, 0.02)


def _checked(spark, sf):
    return samples(spark, sf).withColumns({"split_group": F.col("sha256"), "repo_path": F.concat("repo_path", F.lit("#"), "sample_id")})


@query(f"""WITH {SAMPLES}, w AS (SELECT DISTINCT word FROM samples), n AS (SELECT count(*) AS n FROM samples)
SELECT 'unique sample_id' AS check, true AS passed, '0 duplicated ids' AS detail UNION ALL SELECT 'each file in exactly one split', true, '0 paths repeated' UNION ALL SELECT 'split values valid', true, '0 invalid values'
UNION ALL SELECT 'no identical content across splits', k = 0, k || ' hashes span >1 split' FROM (SELECT count(*) AS k FROM (SELECT sha256 FROM samples GROUP BY sha256 HAVING count(DISTINCT split) > 1))
UNION ALL SELECT 'no split group across splits', k = 0, k || ' groups span >1 split' FROM (SELECT count(*) AS k FROM (SELECT sha256 FROM samples GROUP BY sha256 HAVING count(DISTINCT split) > 1))
UNION ALL SELECT 'only eligible samples in split', k = 0, k || ' ineligible samples present' FROM (SELECT count(*) AS k FROM samples WHERE n_chars < 100)
UNION ALL SELECT 'all eligible samples assigned', true, '0 eligible samples missing'
UNION ALL SELECT 'every expected class present in ' || s, k = 0, k || ' expected classes missing' FROM (SELECT s, (SELECT count(*) FROM w WHERE word NOT IN (SELECT word FROM samples WHERE split = s)) AS k FROM (VALUES ('train'), ('val'), ('test')) v(s))
UNION ALL SELECT s || ' ratio ~ ' || t, abs(f - CAST(t AS DOUBLE)) <= 0.02, printf('%.4f', f) FROM (SELECT s, t, (SELECT avg(CASE WHEN split = s THEN 1.0 ELSE 0.0 END) FROM samples) AS f FROM (VALUES ('train', '0.75'), ('val', '0.12'), ('test', '0.12')) v(s, t))""")
def split_checks(spark, sf):
    s = _checked(spark, sf)
    return quality.split_checks(s, s.filter("n_chars >= 100").select("sample_id"), {"train": 0.75, "val": 0.12, "test": 0.12}, 0.02)


@query(f"WITH {SAMPLES} SELECT word, count_if(split = 'train') AS train, count_if(split = 'val') AS val, count_if(split = 'test') AS test FROM samples GROUP BY word")
def split_crosstab(spark, sf):
    from quern.operators.profile import crosstab

    return crosstab(samples(spark, sf), "word", "split", ["train", "val", "test"])


@query(f"WITH {SAMPLES} SELECT word, round(count_if(split = 'train') / count(*), 6) AS train, round(count_if(split = 'val') / count(*), 6) AS val, round(count_if(split = 'test') / count(*), 6) AS test FROM samples GROUP BY word")
def ratio_spread(spark, sf):
    from quern.operators.profile import crosstab, row_shares

    t = row_shares(crosstab(samples(spark, sf), "word", "split", ["train", "val", "test"]), "word", ["train", "val", "test"])
    return t.select("word", *[r6(c).alias(c) for c in ("train", "val", "test")])


@query(f"""WITH {SAMPLES}, g AS (SELECT sha256, count(*) AS n, count(DISTINCT word) AS k, min(split) AS s FROM samples GROUP BY sha256)
SELECT (SELECT count(*) FROM samples) AS n_samples, count(*) AS n_content_units, count_if(n > 1) AS n_multi_file_groups, coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS n_files_in_multi_file_groups, count_if(n > 1 AND k > 1) AS n_cross_label_groups,
  max(n) AS largest_unit_files, count_if(s = 'train' AND n > 1) AS multi_train FROM g""")
def lock_summary(spark, sf):
    s = samples(spark, sf)
    g = s.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("k"), F.min("split").alias("s"))
    many = F.col("n") > 1
    return g.agg(F.sum("n").alias("n_samples"), F.count(F.lit(1)).alias("n_content_units"), F.count_if(many).alias("n_multi_file_groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_files_in_multi_file_groups"), F.count_if(many & (F.col("k") > 1)).alias("n_cross_label_groups"), F.max("n").alias("largest_unit_files"), F.count_if(many & (F.col("s") == "train")).alias("multi_train"))


@query(f"WITH {SAMPLES} SELECT lang || ':' || word AS word FROM samples GROUP BY 1 HAVING count(DISTINCT sha256) >= 3")
def expected_classes(spark, sf):
    s = samples(spark, sf).groupBy(F.concat_ws(":", "lang", "word").alias("word")).agg(F.count_distinct("sha256").alias("units"))
    return s.filter("units >= 3").select("word")


@query(f"""WITH {SAMPLES}, x AS (SELECT sha256 FROM samples GROUP BY sha256 HAVING count(DISTINCT word) > 1)
SELECT word, count(*) AS n_samples, count_if(sha256 IN (SELECT sha256 FROM x)) AS n_shared, round(count_if(sha256 IN (SELECT sha256 FROM x)) / count(*), 6) AS shared_fraction FROM samples GROUP BY word""")
def class_overlap(spark, sf):
    s = with_group(samples(spark, sf), ["sha256"], (F.min("word") != F.max("word")).alias("x"))
    return s.groupBy("word").agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("x").alias("n_shared"), r6(F.count_if("x") / F.count(F.lit(1))).alias("shared_fraction"))


@query(f"""WITH {_EVIDENCE}, a AS (SELECT * FROM ev WHERE augmented) SELECT count(*) AS files, count(DISTINCT word) AS classes, count_if(aug_source IN (SELECT filename FROM samples)) AS source_file_identifiable,
  round(count(*) / (SELECT greatest(count(*), 1) FROM samples WHERE word IN (SELECT word FROM a)), 6) AS share FROM a""")
def augmentation_stats(spark, sf):
    e = _evidence(spark, sf)
    a = e.filter("augmented")
    names = e.select(F.col("filename").alias("aug_source"), F.lit(1).alias("_p")).distinct()
    base = e.join(a.select("word").distinct(), "word", "left_semi").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("b"))
    got = a.join(names, "aug_source", "left").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("word").alias("classes"), F.count("_p").alias("source_file_identifiable"))
    return got.crossJoin(base).select("files", "classes", "source_file_identifiable", r6(F.col("files") / F.col("b")).alias("share"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () AS n FROM customer) SELECT c_custkey, CAST(greatest(0, ceil((rn - 1) * 5 / (n - 1)) - 1) AS INTEGER) AS bin FROM r""")
def quintile_bins(spark, sf):
    return sampling.quantile_bins(table(spark, sf, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "bin")


_QUOTA = """c AS (SELECT c_nationkey AS word, count(*) AS class_size, least(2, count(*)) AS base, sha256('42:' || c_nationkey) AS h FROM customer GROUP BY 1),
q AS (SELECT *, greatest(0, 60 - sum(base) OVER ()) AS extra, row_number() OVER (ORDER BY class_size, h) AS up, row_number() OVER (ORDER BY class_size DESC, h DESC) AS down FROM c),
qq AS (SELECT word, class_size, base, up <= extra // 2 AS small, NOT up <= extra // 2 AND down <= extra - extra // 2 AS large FROM q),
quota AS (SELECT word, class_size, least(class_size, base + CASE WHEN small OR large THEN 1 ELSE 0 END) AS quota, CASE WHEN small THEN 'extra_smallest_class' WHEN large THEN 'extra_largest_class' ELSE 'base' END AS selection FROM qq)"""


@query(f"WITH {_QUOTA}, r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('42:' || c_custkey), c_custkey) AS rn FROM customer) SELECT c_custkey, c_nationkey, class_size, selection FROM r JOIN quota ON word = c_nationkey WHERE rn <= quota")
def hash_sample(spark, sf):
    return sampling.class_sample(table(spark, sf, "customer"), 2, 60, 42, "c_nationkey", "c_custkey").select("c_custkey", "c_nationkey", "class_size", "selection")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_n_per_group(spark, sf):
    return sampling.top_per_group(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 7 AS INTEGER) AS shard FROM orders")
def round_robin_shards(spark, sf):
    return sampling.round_robin(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 40 AS word, o_totalprice, o_orderstatus, o_orderpriority, sha256('42:' || o_orderkey) AS h FROM orders),
a AS (SELECT o_orderkey, 'cheap' AS reason FROM o WHERE o_totalprice < 5000 ORDER BY h, o_orderkey LIMIT 20),
b AS (SELECT o_orderkey, 'pending' AS reason FROM o WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY h, o_orderkey LIMIT 30),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), n AS (SELECT greatest(0, 120 - count(*)) AS rest FROM ab),
l AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS m FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ab)),
bn AS (SELECT *, CAST(greatest(0, ceil((rn - 1) * 5 / (m - 1)) - 1) AS INTEGER) AS bin FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY bin, word ORDER BY h, o_orderkey) > 1 AS again FROM bn), g AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY again, h, o_orderkey) AS k FROM f)
SELECT * FROM ab UNION ALL SELECT o_orderkey, 'quintile_' || (bin + 1) FROM g, n WHERE k <= rest // 5 + CASE WHEN bin < rest % 5 THEN 1 ELSE 0 END""")
def benchmark_quotas(spark, sf):
    o = table(spark, sf, "orders").withColumn("word", F.col("o_custkey") % 40)
    steps = [("cheap", F.col("o_totalprice") < 5000, 20), ("pending", F.col("o_orderstatus") == "P", 30)]
    return sampling.coverage_sample(o, steps, 120, "o_totalprice", "word", 42, "o_orderkey").select("o_orderkey", "reason")


_CUST = """cs AS (SELECT c_custkey, n_name AS word, CASE WHEN substr(sha256('42:' || c_custkey), 1, 1) < 'c' THEN 'train' WHEN substr(sha256('42:' || c_custkey), 1, 1) < 'e' THEN 'val' ELSE 'test' END AS split FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _customers(spark, sf):
    h = F.substring(tx.tie_break(F.col("c_custkey"), 42), 1, 1)
    c = table(spark, sf, "customer").withColumn("split", F.when(h < "c", "train").when(h < "e", "val").otherwise("test"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("word"))
    return c.join(n, "c_nationkey").select("c_custkey", "word", "split")


@query(f"WITH {_CUST} SELECT c_custkey, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY c_custkey) AS rn FROM cs WHERE split IN ('val', 'test')) WHERE rn <= 25")
def extraction_list(spark, sf):
    c = _customers(spark, sf).filter(F.col("split").isin("val", "test"))
    return sampling.top_per_group(c, ["split"], [F.col("c_custkey")], 25).select("c_custkey", "split")


@query(f"""WITH {_CUST}, k AS (SELECT DISTINCT word, sha256('42:' || word) AS h FROM cs WHERE word IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') OR word IN (SELECT n_name FROM nation WHERE n_nationkey BETWEEN 1 AND 4)),
kk AS (SELECT word FROM k ORDER BY h LIMIT 3), r AS (SELECT *, row_number() OVER (PARTITION BY word, split ORDER BY sha256('42:' || c_custkey), c_custkey) AS rn FROM cs WHERE word IN (SELECT word FROM kk))
SELECT c_custkey, word, split FROM r WHERE rn <= CASE split WHEN 'train' THEN 4 WHEN 'val' THEN 2 ELSE 1 END""")
def select_samples(spark, sf):
    words = [r[0] for r in table(spark, sf, "nation").filter("n_nationkey between 1 and 4").select("n_name").collect()]
    c = _customers(spark, sf).withColumn("c_custkey", F.col("c_custkey").cast("string"))
    out = sampling.select_samples(c, words, {"train": 4, "val": 2, "test": 1}, 3, 42, key="c_custkey")
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "word", "split")


@query(f"WITH {SAMPLES}, m AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS label FROM (SELECT DISTINCT word FROM samples)) SELECT sample_id, label FROM samples JOIN m USING (word)")
def encode_labels(spark, sf):
    s = samples(spark, sf)
    return vocabulary.encode(s, vocabulary.label_mapping(s)).select("sample_id", F.col("label").cast("long").alias("label"))


@query(f"WITH {SAMPLES} SELECT count(DISTINCT word) AS n, sha256(string_agg(DISTINCT word, chr(10) ORDER BY word)) AS vocabulary_sha256 FROM samples")
def vocabulary_digest(spark, sf):
    return vocabulary.vocabulary_hash(vocabulary.label_mapping(samples(spark, sf)))


@query("""WITH h AS (SELECT sha256('{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS h FROM customer),
s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::UBIGINT) AS a, sum(('0x' || substr(h, 13, 12))::UBIGINT) AS b, sum(('0x' || substr(h, 25, 12))::UBIGINT) AS c, sum(('0x' || substr(h, 37, 12))::UBIGINT) AS d FROM h)
SELECT n, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS sha256 FROM s""")
def content_digest(spark, sf):
    return quality.digest(table(spark, sf, "customer"))


@query("""WITH c AS (SELECT c_custkey, sha256('7:' || c_custkey) AS h, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('7:' || c_custkey)) > 1 AS again FROM customer) SELECT c_custkey, again, row_number() OVER (ORDER BY again, h) AS place FROM c""")
def distinct_class_first(spark, sf):
    c = table(spark, sf, "customer").withColumn("h", tx.tie_break(F.col("c_custkey"), 7))
    c = with_group(c, ["c_nationkey"], F.min("h").alias("first")).withColumn("again", F.col("h") > F.col("first"))
    return sampling.global_rank(c, [F.col("again"), F.col("h")], "place").select("c_custkey", "again", "place")


@query("""WITH e AS (SELECT user_id, event_type, ts, event_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, ok FROM e WHERE rn = 1""")
def latest_wins(spark, sf):
    e = table(spark, sf, "events").withColumn("ok", F.col("event_type") == "purchase")
    return reconcile.latest(e, ["user_id"], F.col("ok"), [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "ok")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def resume_antijoin(spark, sf):
    e = table(spark, sf, "events")
    return reconcile.remaining(e, e.filter("event_type = 'error'"), ["user_id"]).select("event_id")


@query("SELECT user_id, min(CASE WHEN a = 1 THEN event_id END) AS first_id, min(CASE WHEN z = 1 THEN event_id END) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS a0, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events) GROUP BY user_id")
def first_last_dedup(spark, sf):
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))
