"""Queries on time series: events as clips (clip = user, frame = place in time)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import arrays as ar
from quern.functions import text as tx
from quern.operators import quality, sequences, timeseries
from quern.plans.registry import query, r6, table

_CLIPS = """fr AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type, value, ts, event_id, event_type = 'click' AS lh, event_type = 'view' AS rh,
  event_type IN ('click', 'view', 'purchase', 'signup') AS hand, epoch_us(ts) / 1000000.0 AS t FROM events)"""
_RUNS = """{name} AS (SELECT clip, min(frame) AS start, count(*) AS len FROM (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS g FROM fr WHERE {mask}) GROUP BY clip, g)"""


def clips(spark, sf):
    e = table(spark, sf, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("frame"), "event_type", "value", "ts", "event_id",
        (F.col("event_type") == "click").alias("lh"), (F.col("event_type") == "view").alias("rh"), F.col("event_type").isin("click", "view", "purchase", "signup").alias("hand"),
        (F.unix_micros("ts") / 1000000.0).alias("t"))


@query(f"WITH {_CLIPS}, {_RUNS.format(name='r', mask='hand')} SELECT * FROM r")
def runs_rle(spark, sf):
    return timeseries.runs(clips(spark, sf), F.col("hand"))


@query(f"WITH {_CLIPS}, {_RUNS.format(name='r', mask='NOT hand')} SELECT clip, coalesce(max(len), 0) AS longest FROM (SELECT DISTINCT clip FROM fr) LEFT JOIN r USING (clip) GROUP BY clip")
def longest_run(spark, sf):
    return timeseries.longest_runs(clips(spark, sf), ~F.col("hand"))


_IV = f"{_CLIPS}, {_RUNS.format(name='r', mask='hand')}, iv AS (SELECT clip, min(start) AS start, max(start + len - 1) AS e FROM r WHERE len >= 3 GROUP BY clip)"


@query(f"WITH {_IV} SELECT clip, start, e AS end, e - start + 1 AS frames FROM iv")
def active_interval(spark, sf):
    return timeseries.active_intervals(clips(spark, sf), F.col("hand"))


@query(f"WITH {_CLIPS}, {_RUNS.format(name='r', mask='NOT (lh OR rh)')}, l AS (SELECT clip, max(len) AS k FROM r GROUP BY clip) SELECT clip, count(*) AS n_frames, count_if(NOT (lh OR rh)) AS missing_frames, round(count_if(NOT (lh OR rh)) / count(*), 6) AS missing_frac, coalesce(max(k), 0) AS longest_missing_run FROM fr LEFT JOIN l USING (clip) GROUP BY clip")
def hand_quality(spark, sf):
    return timeseries.quality(clips(spark, sf), ~(F.col("lh") | F.col("rh"))).withColumn("missing_frac", r6("missing_frac"))


@query(f"""WITH {_IV}, {_RUNS.format(name='m', mask='NOT hand')}, ml AS (SELECT clip, max(len) AS k FROM m GROUP BY clip), fu AS (SELECT clip, count(*) AS n, count_if(NOT hand) / count(*) AS f FROM fr GROUP BY clip),
ins AS (SELECT fr.clip, count_if(NOT hand) / count(*) AS af FROM fr JOIN iv ON iv.clip = fr.clip AND frame BETWEEN start AND e GROUP BY fr.clip), am AS (SELECT m.clip, max(least(m.start + len - 1, e) - greatest(m.start, iv.start) + 1) AS ar FROM m JOIN iv ON iv.clip = m.clip AND m.start <= e AND m.start + len - 1 >= iv.start GROUP BY m.clip)
SELECT fu.clip, n AS n_frames, iv.start, e AS end, CASE WHEN n < 55 THEN 'too_few_decoded_frames' WHEN iv.start IS NULL THEN 'no_active_signing_interval' WHEN af > 0.2 THEN 'active_both_hands_missing_fraction' WHEN coalesce(ar, 0) > 2 THEN 'active_both_hands_missing_run' END AS reason,
  CASE WHEN n < 55 THEN 'too_few_decoded_frames' WHEN f > 0.2 THEN 'both_hands_missing_fraction' WHEN coalesce(k, 0) > 2 THEN 'both_hands_missing_run' END AS full_reason FROM fu LEFT JOIN iv USING (clip) LEFT JOIN ins USING (clip) LEFT JOIN am USING (clip) LEFT JOIN ml USING (clip)""")
def rejection_ladder(spark, sf):
    return timeseries.rejections(clips(spark, sf), F.col("hand"), min_frames=55, max_frac=0.2, max_run=2)


_PRESENT = "event_type NOT IN ('error', 'signup')"
_GAP = f"""{_CLIPS}, p AS (SELECT *, {_PRESENT} AS pr FROM fr), q AS (SELECT *, last_value(CASE WHEN pr THEN frame END IGNORE NULLS) OVER b AS lf, last_value(CASE WHEN pr THEN value END IGNORE NULLS) OVER b AS lv,
  first_value(CASE WHEN pr THEN frame END IGNORE NULLS) OVER a AS nf, first_value(CASE WHEN pr THEN value END IGNORE NULLS) OVER a AS nv FROM p
  WINDOW b AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fg AS (SELECT *, coalesce(NOT pr AND nf - lf - 1 <= 2, false) AS fill FROM q)"""


def _present(spark, sf):
    return clips(spark, sf).withColumn("pr", ~F.col("event_type").isin("error", "signup"))


@query(f"WITH {_GAP} SELECT clip, frame, round(CASE WHEN pr THEN value WHEN fill THEN lv * (1 - (frame - lf) / (nf - lf)) + nv * ((frame - lf) / (nf - lf)) ELSE 0 END, 6) AS filled, pr OR fill AS is_present, fill AS interpolated FROM fg")
def fill_gaps(spark, sf):
    g = timeseries.gap_fill(_present(spark, sf), "value", "pr", 2)
    return g.select("clip", "frame", r6("filled").alias("filled"), "is_present", "interpolated")


@query(f"""WITH {_GAP} SELECT clip, frame, round(coalesce(lv, nv), 6) AS value_carried, pr AS measured, coalesce(lv, nv) IS NOT NULL AS clip_ok FROM q""")
def carry_reference(spark, sf):
    c = timeseries.carry(_present(spark, sf), ["value"], F.col("pr"))
    return c.select("clip", "frame", r6("value_carried").alias("value_carried"), "measured", "clip_ok")


@query(f"""WITH {_CLIPS}, s AS (SELECT clip, frame, round(t / 43200.0, 6) AS t, value AS v, {_PRESENT} AS p, row_number() OVER (PARTITION BY clip ORDER BY round(t / 43200.0, 6), value, {_PRESENT}) - 1 AS i FROM fr),
c AS (SELECT clip, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM s GROUP BY clip), m AS (SELECT *, CAST(greatest(1, round_even(n / CASE WHEN t1 > t0 THEN (n - 1) / (t1 - t0) ELSE 2.0 END * 2.0, 0)) AS INTEGER) AS m FROM c),
g AS (SELECT clip, n, k, least(t0 + k / 2.0, t1) AS tt FROM (SELECT *, unnest(range(m)) AS k FROM m)),
h AS (SELECT g.clip, k, tt, greatest(1, least(max(g.n) - 1, count_if(s.t < tt))) AS hi FROM g JOIN s ON s.clip = g.clip GROUP BY g.clip, k, tt),
x AS (SELECT h.clip, k, tt, a.v AS av, a.p AS ap, b.v AS bv, b.p AS bp, greatest(0, least(1, (tt - a.t) / CASE WHEN b.t > a.t THEN b.t - a.t ELSE 1 END)) AS w FROM h JOIN s a ON a.clip = h.clip AND a.i = hi - 1 JOIN s b ON b.clip = h.clip AND b.i = hi)
SELECT clip, k, round(tt, 6) AS t, round(CASE WHEN ap AND bp THEN av * (1 - w) + bv * w WHEN w >= 0.5 THEN bv ELSE av END, 4) AS value, (ap AND bp) OR CASE WHEN w >= 0.5 THEN bp ELSE ap END AS present FROM x""")
def resample_grid(spark, sf):
    c = _present(spark, sf).withColumn("t", r6(F.col("t") / 43200.0))
    r = timeseries.resample_uniform(c, "value", "pr", 2.0)
    return r.select("clip", F.col("k").cast("long").alias("k"), F.round("t", 6).alias("t"), F.round("value", 4).alias("value"), "present")


@query(f"""WITH {_IV}, p AS (SELECT clip, k, start + k * ((e - start) / 29) AS p, e FROM (SELECT *, unnest(range(30)) AS k FROM iv)), q AS (SELECT clip, k, CAST(floor(p) AS BIGINT) AS i, least(CAST(floor(p) AS BIGINT) + 1, e) AS j, CAST(CAST(p - floor(p) AS FLOAT) AS DOUBLE) AS a FROM p),
x AS (SELECT q.clip, k, a, l.value AS av, l.event_type NOT IN ('error', 'signup') AS ap, r.value AS bv, r.event_type NOT IN ('error', 'signup') AS bp FROM q JOIN fr l ON l.clip = q.clip AND l.frame = i JOIN fr r ON r.clip = q.clip AND r.frame = j)
SELECT clip, k, round(CASE WHEN ap AND bp THEN av * (1 - a) + bv * a WHEN a >= 0.5 THEN bv ELSE av END, 5) AS value, (ap AND bp) OR CASE WHEN a >= 0.5 THEN bp ELSE ap END AS present FROM x""")
def resample_window(spark, sf):
    c = _present(spark, sf)
    r = timeseries.resample_window(c, timeseries.active_intervals(c, F.col("hand")), "value", "pr", 30)
    return r.select("clip", F.col("k").cast("long").alias("k"), F.round("value", 5).alias("value"), "present")


@query(f"WITH {_CLIPS} SELECT clip, arg_min(event_id, abs(t - (SELECT min(t) FROM fr) - 864000.0) * 1000000 + t / 10000000000) AS event_id FROM fr GROUP BY clip")
def nearest_event(spark, sf):
    c = clips(spark, sf)
    start = c.agg(F.min("t")).first()[0]
    return timeseries.nearest_in_time(c, F.lit(start + 864000.0), ["event_id"])


@query("""WITH f AS (SELECT vec_id, (i - 1) // 8 AS w, (i - 1) % 8 AS j, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))
SELECT vec_id, j, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high FROM f GROUP BY vec_id, j""")
def temporal_statistics(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.transform(F.slice("embedding", w * 8 + 1, 8), lambda v: v.cast("double")))
    s = e.select("vec_id", sequences.temporal_statistics(x, 8).alias("s"))
    s = s.select("vec_id", "s", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    cols = [r6(F.element_at("s", F.col("j") + 1 + 8 * k)).alias(n) for k, n in enumerate(("mean", "std", "low", "high"))]
    return s.select("vec_id", F.col("j").cast("long").alias("j"), *cols)


@query("""SELECT vec_id, len(embedding) + 2 AS n_features, round(list_sum(list_concat(embedding[1:24], [CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END]::FLOAT[], embedding[25:48], [1]::FLOAT[], list_transform(embedding[49:], lambda v: v * 1))::DOUBLE[]), 4) AS total FROM embeddings""")
def assemble_features(spark, sf):
    e = table(spark, sf, "embeddings")
    parts = {"left_hand": F.slice("embedding", 1, 24), "pose": F.slice("embedding", 25, 24)}
    f = ar.assemble(parts, {"left_hand": F.col("label") % 2 == 0, "pose": F.lit(True)}, F.slice("embedding", 49, 1 << 20), ["left_hand", "pose"])
    e = e.select("vec_id", F.transform(f, lambda v: v.cast("double")).alias("f"))
    return e.select("vec_id", F.size("f").cast("long").alias("n_features"), F.round(F.aggregate("f", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("""WITH f AS (SELECT vec_id // 8 AS clip, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS frame, label % 3 <> 0 AS p, embedding FROM embeddings), s AS (SELECT clip, max(frame) AS e FROM f GROUP BY clip HAVING count(*) > 1),
q AS (SELECT clip, k, e, k * (e / 4.0) AS at_ FROM (SELECT *, unnest(range(5)) AS k FROM s)), w AS (SELECT clip, k, CAST(floor(at_) AS BIGINT) AS i, least(CAST(floor(at_) AS BIGINT) + 1, e) AS j, CAST(CAST(at_ - floor(at_) AS FLOAT) AS DOUBLE) AS a FROM q),
x AS (SELECT w.clip, k, a, l.p AS lp, r.p AS rp, unnest(l.embedding[1:63]) AS lv, unnest(r.embedding[1:63]) AS rv FROM w JOIN f l ON l.clip = w.clip AND l.frame = i JOIN f r ON r.clip = w.clip AND r.frame = j)
SELECT clip, k, 64 AS n_features, round(sum(CASE WHEN lp AND rp THEN lv * (1 - a) + rv * a WHEN a >= 0.5 THEN rv ELSE lv END) + max(CASE WHEN (lp AND rp) OR CASE WHEN a >= 0.5 THEN rp ELSE lp END THEN 1 ELSE 0 END), 3) AS total FROM x GROUP BY clip, k""")
def window_features(spark, sf):
    """Eight vectors a clip as frames of one hand (21 landmarks), assembled on five rows over the whole clip."""
    e = table(spark, sf, "embeddings").withColumn("clip", F.floor(F.col("vec_id") / 8))
    at = (F.row_number().over(Window.partitionBy("clip").orderBy("vec_id")) - 1).cast("long")
    flags = ar.pack_flags(F.col("label") % 3 != 0, F.col("label") % 3 != 0, F.lit(False))
    f = e.select("clip", at.alias("frame"), F.transform(F.slice("embedding", 1, 63), lambda v: v.cast("double")).alias("left_hand"), flags.alias("left_hand_flags"))
    spans = f.groupBy("clip").agg(F.lit(0).cast("long").alias("start"), F.max("frame").alias("end")).filter("end > 0")
    x = sequences.window_features(f, spans, ["left_hand"], 5)
    total = F.aggregate("features", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return x.select("clip", F.col("k").cast("long").alias("k"), F.size("features").cast("long").alias("n_features"), F.round(total, 3).alias("total"))


@query(f"WITH {_CLIPS}, n AS (SELECT clip, count(*) AS active_frames FROM fr WHERE hand GROUP BY clip) SELECT clip, active_frames, CASE WHEN active_frames < 30 THEN '<30' WHEN active_frames < 45 THEN '30-44' WHEN active_frames < 60 THEN '45-59' ELSE '>=60' END AS active_bin, active_frames < 30 AS short_active_interval FROM n")
def interval_bins(spark, sf):
    n = clips(spark, sf).filter("hand").groupBy("clip").agg(F.count(F.lit(1)).alias("active_frames"))
    return n.withColumns({"active_bin": sequences.interval_bin(F.col("active_frames")), "short_active_interval": F.col("active_frames") < 30})


@query(f"""WITH {_IV}, n AS (SELECT clip, count(*) AS n, max(t) - min(t) AS span FROM fr GROUP BY clip)
SELECT clip, coalesce(start, n) AS before, coalesce(n - 1 - e, n) AS after, CAST(greatest(1, round_even(n / CASE WHEN span > 0 THEN (n - 1) / span ELSE 30 END * 0.0001, 0)) AS INTEGER) AS std_frames FROM n LEFT JOIN iv USING (clip)""")
def rest_bookkeeping(spark, sf):
    c = clips(spark, sf)
    n = c.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"))
    j = n.join(timeseries.active_intervals(c, F.col("hand")), "clip", "left")
    before, after = timeseries.rest_frames(F.col("n"), F.col("start"), F.col("end"))
    fps = F.when(F.col("span") > 0, (F.col("n") - 1) / F.col("span")).otherwise(30.0)
    return j.select("clip", before.alias("before"), after.alias("after"), ar.standard_length(F.col("n"), fps, 0.0001).alias("std_frames"))


@query(f"""WITH {_CLIPS}, g AS (SELECT clip, frame, unnest([1, 2]) AS k, lh, rh FROM fr), m AS (SELECT clip, frame, CASE k WHEN 1 THEN 'left' ELSE 'right' END AS grp, NOT CASE k WHEN 1 THEN lh ELSE rh END AS miss FROM g),
r AS (SELECT clip, grp, count(*) AS len FROM (SELECT *, frame - row_number() OVER (PARTITION BY clip, grp ORDER BY frame) AS x FROM m WHERE miss) GROUP BY clip, grp, x), l AS (SELECT clip, grp, max(len) AS k FROM r GROUP BY ALL)
SELECT clip, grp, count_if(miss) AS missing_frames, round(100.0 * count_if(miss) / count(*), 6) AS missing_pct, coalesce(max(k), 0) AS longest FROM m LEFT JOIN l USING (clip, grp) GROUP BY clip, grp""")
def clip_missing_stats(spark, sf):
    c = clips(spark, sf)
    out = []
    for name, col in (("left", "lh"), ("right", "rh")):
        q = timeseries.quality(c, ~F.col(col))
        out.append(q.select("clip", F.lit(name).alias("grp"), "missing_frames", r6(F.col("missing_frac") * 100).alias("missing_pct"), F.col("longest_missing_run").alias("longest")))
    return out[0].union(out[1])


@query(f"WITH {_CLIPS}, {_RUNS.format(name='r', mask='NOT hand')} SELECT count(*) AS intervals, count_if(len <= 1) AS short, count_if(len BETWEEN 2 AND 3) AS mid, count_if(len > 3) AS long, (SELECT count(*) FROM (SELECT clip FROM r GROUP BY clip HAVING max(len) > 3)) AS clips_with_long FROM r")
def run_histogram(spark, sf):
    """Run lists as JSON text, as a store keeps them, read back and counted."""
    runs = timeseries.runs(clips(spark, sf), ~F.col("hand"))
    stored = runs.groupBy("clip").agg(F.to_json(F.collect_list(F.struct("start", "len"))).alias("doc"))
    back = stored.select("clip", F.explode(F.from_json("doc", "array<struct<start long, len long>>")).alias("r")).select("clip", "r.len")
    long = F.count_distinct(F.when(F.col("len") > 3, F.col("clip")))
    return back.agg(F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("len") <= 1).alias("short"), F.count_if(F.col("len").between(2, 3)).alias("mid"), F.count_if(F.col("len") > 3).alias("long"), long.alias("clips_with_long"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, round(100.0 * count_if(event_type = 'purchase') / count(*), 6) AS purchase_pct, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1")
def split_stats(spark, sf):
    e = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.count(F.lit(1)).alias("events"), r6(F.count_if(F.col("event_type") == "purchase") * 100.0 / F.count(F.lit(1))).alias("purchase_pct"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, count(*) AS videos, round(60 * count(*) / date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))), 6) AS per_min, round(sum(value) / date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))), 6) AS value_per_s FROM events GROUP BY 1 HAVING count(*) > 1")
def throughput(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("videos"), F.sum("value").alias("v"), (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("s"))
    return e.filter("videos > 1").select("user_id", "videos", r6(60 * F.col("videos") / F.col("s")).alias("per_min"), r6(F.col("v") / F.col("s")).alias("value_per_s"))


_SPLITCLIP = "CASE WHEN substr(sha256('42:' || clip), 1, 1) < 'c' THEN 'train' WHEN substr(sha256('42:' || clip), 1, 1) < 'e' THEN 'val' ELSE 'test' END"


def _frozen(spark, sf):
    h = F.substring(tx.tie_break(F.col("clip"), 42), 1, 1)
    return clips(spark, sf).select("clip").distinct().select(F.col("clip").alias("sample_id"), F.concat(F.lit("w"), (F.col("clip") % 12).cast("string")).alias("word"), F.when(h < "c", "train").when(h < "e", "val").otherwise("test").alias("split"))


@query(f"""WITH {_IV}, z AS (SELECT DISTINCT 'w' || clip % 12 AS word FROM fr), m AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS label FROM z)
SELECT clip AS sample_id, iv.start, e AS end, m.word, {_SPLITCLIP} AS split, e - iv.start + 1 AS active_frames, label, CASE WHEN e - iv.start + 1 < 30 THEN '<30' WHEN e - iv.start + 1 < 45 THEN '30-44' WHEN e - iv.start + 1 < 60 THEN '45-59' ELSE '>=60' END AS active_bin, e - iv.start + 1 < 30 AS short_active_interval,
  round(30 / (e - iv.start + 1), 6) AS stretch_30, round(45 / (e - iv.start + 1), 6) AS stretch_45, round(60 / (e - iv.start + 1), 6) AS stretch_60 FROM iv JOIN m ON m.word = 'w' || clip % 12""")
def sequence_index(spark, sf):
    from quern.operators.vocabulary import label_mapping

    frozen = _frozen(spark, sf)
    meta = timeseries.active_intervals(clips(spark, sf), F.col("hand")).select(F.col("clip").alias("sample_id"), "start", "end", F.lit(None).cast("string").alias("reason"))
    i = sequences.index(meta, frozen, label_mapping(frozen))
    return i.select("sample_id", "start", "end", "word", "split", "active_frames", "label", "active_bin", "short_active_interval", *[r6(f"stretch_{w}").alias(f"stretch_{w}") for w in (30, 45, 60)])


@query(f"WITH {_CLIPS} SELECT {_SPLITCLIP} AS split, count(DISTINCT clip) AS clips, count(*) AS frames, round(sum(value), 4) AS total FROM fr GROUP BY 1")
def sequence_view(spark, sf):
    c = clips(spark, sf).join(_frozen(spark, sf).withColumnRenamed("sample_id", "clip"), "clip")
    return c.groupBy("split").agg(F.count_distinct("clip").alias("clips"), F.count(F.lit(1)).alias("frames"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT vec_id, (row_number() OVER (ORDER BY sha256('42:' || vec_id), vec_id) - 1) // 64 AS batch, (row_number() OVER (ORDER BY sha256('42:' || vec_id), vec_id) - 1) % 64 AS place FROM embeddings")
def batches(spark, sf):
    return sequences.batches(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 64, 42)


@query(f"""WITH {_CLIPS}, x AS (SELECT DISTINCT clip AS sample_id, {_SPLITCLIP} AS split FROM fr), y AS (SELECT sample_id, CASE WHEN sample_id % 40 = 7 THEN 'train' ELSE split END AS split, 'p' || sample_id // 2 AS g FROM x),
cross_ AS (SELECT count(*) AS k FROM (SELECT g FROM y GROUP BY g HAVING count(DISTINCT split) > 1))
SELECT 'source appears once' AS check, true AS passed, '0 repeated' AS detail UNION ALL SELECT 'valid split', true, '0 invalid' UNION ALL SELECT c || ' in one split', k = 0, k || ' in more than one split' FROM cross_, (VALUES ('repo_path'), ('sha256'), ('split_group')) v(c)
UNION ALL SELECT 'copy with its source', k = 0, k || ' copies apart from their source' FROM (SELECT count(*) AS k FROM y a JOIN y b ON 'p' || (a.sample_id // 2 - 1) = b.g WHERE a.sample_id % 9 = 0 AND a.split <> b.split)""")
def index_leakage(spark, sf):
    y = _frozen(spark, sf).withColumn("split", F.when(F.col("sample_id") % 40 == 7, "train").otherwise(F.col("split")))
    g = F.concat(F.lit("p"), F.floor(F.col("sample_id") / 2).cast("string"))
    source = F.when(F.col("sample_id") % 9 == 0, F.concat(F.lit("p"), (F.floor(F.col("sample_id") / 2) - 1).cast("string")))
    return quality.index_leaks(y.select("sample_id", "split", g.alias("repo_path"), g.alias("sha256"), g.alias("split_group"), source.alias("aug_source")))


@query("""WITH e AS (SELECT vec_id, len(embedding) AS n, list_bool_and(list_transform(embedding, lambda v: isfinite(v))) AS fin, label FROM embeddings)
SELECT 'shape' AS check, count_if(n <> 64) = 0 AS passed, count_if(n <> 64) || ' arrays of another length' AS detail FROM e UNION ALL SELECT 'finite', count_if(NOT fin) = 0, count_if(NOT fin) || ' not finite' FROM e
UNION ALL SELECT 'label range', count_if(NOT label BETWEEN 0 AND 8) = 0, count_if(NOT label BETWEEN 0 AND 8) || ' out of range' FROM e UNION ALL SELECT 'unreferenced', count(*) = 0, count(*) || ' without metadata' FROM e WHERE vec_id NOT IN (SELECT doc_id FROM documents)""".replace("list_bool_and(", "list_aggregate(").replace("lambda v: isfinite(v)))", "lambda v: isfinite(v)), 'bool_and')"))
def array_checks(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("fin", F.forall("embedding", lambda v: ar.finite(v)))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    return quality.all_of([
        quality.check(e, "shape", F.count_if(F.size("embedding") != 64), "arrays of another length"),
        quality.check(e, "finite", F.count_if(~F.col("fin")), "not finite"),
        quality.check(e, "label range", F.count_if(~F.col("label").between(0, 8)), "out of range"),
        quality.check(e.join(d, "vec_id", "left_anti"), "unreferenced", F.count(F.lit(1)), "without metadata"),
    ])


@query(f"""WITH {_IV}, j AS (SELECT fr.*, frame BETWEEN start AND e AS inside FROM fr LEFT JOIN iv USING (clip)) SELECT coalesce(inside, false) AS inside, count(*) AS frames, count_if(NOT (lh OR rh)) AS both_missing, count_if(lh AND rh) AS both_present,
  round(max(abs(value)), 6) AS max_abs, count_if(((CASE WHEN lh THEN 1 ELSE 0 END) | (CASE WHEN rh THEN 2 ELSE 0 END)) & 2 <> 0) AS bit_present FROM j GROUP BY 1""")
def store_verification(spark, sf):
    c = clips(spark, sf)
    j = c.join(timeseries.active_intervals(c, F.col("hand")), "clip", "left").withColumn("inside", F.coalesce(F.col("frame").between(F.col("start"), F.col("end")), F.lit(False)))
    flags = ar.pack_flags(F.col("lh"), F.col("rh"), F.lit(False))
    return j.groupBy("inside").agg(F.count(F.lit(1)).alias("frames"), F.count_if(~(F.col("lh") | F.col("rh"))).alias("both_missing"), F.count_if(F.col("lh") & F.col("rh")).alias("both_present"), r6(F.max(F.abs("value"))).alias("max_abs"), F.count_if(ar.has_flag(flags, ar.PRESENT)).alias("bit_present"))


@query(f"""WITH {_IV}, x AS (SELECT clip, e - start + 1 AS a, {_SPLITCLIP} AS split FROM iv) SELECT split, CASE WHEN a < 45 THEN 'up' WHEN a = 45 THEN 'identity' ELSE 'down' END AS kind, count(*) AS n, min(a) AS least, max(a) AS most FROM x GROUP BY ALL""")
def sequence_counts(spark, sf):
    i = timeseries.active_intervals(clips(spark, sf), F.col("hand")).join(_frozen(spark, sf).withColumnRenamed("sample_id", "clip"), "clip")
    kind = F.when(F.col("frames") < 45, "up").when(F.col("frames") == 45, "identity").otherwise("down")
    return i.groupBy("split", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("frames").alias("least"), F.max("frames").alias("most"))
