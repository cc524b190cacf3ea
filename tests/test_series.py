import math

import pytest
from pyspark.sql import functions as F

from quern.functions import arrays as ar
from quern.functions import text as tx
from quern.operators import evalmetrics, kernel, profile, quality, sequences, timeseries


def mask(spark, bits, clip=0):
    return spark.createDataFrame([(clip, i, bool(b)) for i, b in enumerate(bits)], "clip int, frame long, m boolean")


def test_runs_and_longest(spark):
    df = mask(spark, [0, 1, 1, 0, 1])
    assert sorted((r.start, r.len) for r in timeseries.runs(df, F.col("m")).collect()) == [(1, 2), (4, 1)]
    assert timeseries.longest_runs(mask(spark, [0, 0]), F.col("m")).first().longest == 0


@pytest.mark.parametrize(
    "bits,want",
    [([0] * 16 + [1] * 24 + [0] * 40, (16, 39, 24)), ([0, 1, 0] + [0] * 17 + [1] * 10 + [0] * 10 + [1] * 10 + [0] * 10 + [1, 1], (20, 49, 30)), ([1, 1, 0, 1], None)],
)
def test_active_interval(spark, bits, want):
    got = timeseries.active_intervals(mask(spark, bits), F.col("m")).collect()
    assert [(r.start, r.end, r.frames) for r in got] == ([want] if want else [])


@pytest.mark.parametrize(
    "n,hole,want",
    [(80, 0, None), (80, 15, None), (80, 16, "active_both_hands_missing_run"), (40, 14, "active_both_hands_missing_fraction"), (29, 0, "too_few_decoded_frames"), (0, 60, "no_active_signing_interval")],
)
def test_rejection_ladder_and_boundaries(spark, n, hole, want):
    on = max(n - hole, 0)
    bits = [1] * (on // 2) + [0] * hole + [1] * (on - on // 2)
    assert timeseries.rejections(mask(spark, bits), F.col("m")).first().reason == want


def test_gap_of_five_is_filled_six_and_edges_are_not(spark):
    def run(bits, v):
        df = spark.createDataFrame([(0, i, float(x), bool(b)) for i, (b, x) in enumerate(zip(bits, v))], "clip int, frame long, v double, p boolean")
        return [(round(r.filled, 6), r.is_present, r.interpolated) for r in timeseries.gap_fill(df, "v", "p").orderBy("frame").collect()]

    five = run([1] + [0] * 5 + [1], [0, 9, 9, 9, 9, 9, 6])
    assert [x[0] for x in five] == [0, 1, 2, 3, 4, 5, 6] and all(x[1] for x in five) and [x[2] for x in five] == [False] + [True] * 5 + [False]
    six = run([1] + [0] * 6 + [1], range(8))
    assert [x[:2] for x in six[1:7]] == [(0.0, False)] * 6
    assert [x[1] for x in run([0, 0, 1, 1, 0], range(5))] == [False, False, True, True, False]


def test_carried_reference(spark):
    df = spark.createDataFrame([(0, i, float(i), i in (1, 2)) for i in range(5)] + [(1, 0, 5.0, False)], "clip int, frame long, v double, ok boolean")
    got = {(r.clip, r.frame): r for r in timeseries.carry(df, ["v"], F.col("ok")).collect()}
    assert [got[(0, i)].v_carried for i in range(5)] == [1, 1, 2, 2, 2] and [got[(0, i)].measured for i in range(5)] == [False, True, True, False, False]
    assert got[(1, 0)].v_carried is None and not got[(1, 0)].clip_ok


@pytest.mark.parametrize("fps,n,m", [(30, 45, 45), (15, 40, 80), (60, 120, 60)])
def test_resample_rates(spark, fps, n, m):
    df = spark.createDataFrame([(0, i / fps, i / fps, True) for i in range(n)], "clip int, t double, v double, p boolean")
    got = timeseries.resample_uniform(df, "v", "p").orderBy("k").collect()
    assert len(got) == m and all(r.present for r in got)
    assert all(abs(r.value - r.t) < 1e-9 for r in got)  # value is time, so interpolation is checkable


def test_resample_presence_at_a_missing_neighbour(spark):
    df = spark.createDataFrame([(0, i / 15, 1.0, i != 5) for i in range(20)], "clip int, t double, v double, p boolean")
    p = [r.present for r in timeseries.resample_uniform(df, "v", "p").orderBy("k").collect()]
    assert not p[10] and p[8] and p[12]


def test_window_resample_and_positions(spark):
    df = spark.createDataFrame([(0, i, float(i), True) for i in range(20)], "clip int, frame long, v double, p boolean")
    span = spark.createDataFrame([(0, 10, 14)], "clip int, start int, end int")
    v = [r.value for r in timeseries.resample_window(df, span, "v", "p", 60).orderBy("k").collect()]
    assert len(v) == 60 and len(set(v)) == 60 and v[0] == 10 and v[-1] == 14
    assert [r.value for r in timeseries.resample_window(df, span, "v", "p", 5).orderBy("k").collect()] == [10, 11, 12, 13, 14]
    with pytest.raises(ValueError):
        timeseries.resample_window(df, span, "v", "p", 1)
    with pytest.raises(Exception, match="empty active interval"):
        spark.range(1).select(ar.positions(F.lit(5), F.lit(4), 3)).collect()


def test_bins_stretch_layout_and_flags(spark):
    df = spark.createDataFrame([(x,) for x in (29, 30, 44, 45, 59, 60)], "n int")
    assert [r[0] for r in df.select(sequences.interval_bin(F.col("n"))).collect()] == ["<30", "30-44", "30-44", "45-59", "45-59", ">=60"]
    assert [ar.feature_dim(g) for g in (["left_hand", "right_hand"], ["left_hand", "right_hand", "pose"], ["left_hand", "right_hand", "pose", "face"])] == [128, 261, 1666]
    names = ar.feature_names(["left_hand", "pose"])
    assert len(names) == ar.feature_dim(["left_hand", "pose"]) and names[63] == "left_hand_present" and ar.layout(["left_hand", "pose"])[1] == ("pose", 64, 163)
    f = spark.range(1).select(ar.pack_flags(F.lit(True), F.lit(True), F.lit(False)).alias("f"))
    assert f.select("f", ar.has_flag(F.col("f"), ar.PRESENT), ar.has_flag(F.col("f"), ar.INTERPOLATED)).first()[:] == (3, True, False)
    assert spark.range(1).select(F.size(ar.per_landmark([F.lit(True)] * 4))).first()[0] == 543
    assert [r[0] for r in spark.createDataFrame([(75, 30.0), (1, 60.0), (5, 60.0)], "n int, f double").select(ar.standard_length(F.col("n"), F.col("f"))).collect()] == [75, 1, 2]


def test_metrics_golden(spark):
    p = spark.createDataFrame(list(zip([0, 0, 1, 1, 2], [0, 1, 1, 1, 0])), "y_true int, y_pred int")
    cm = evalmetrics.confusion(p)
    m = evalmetrics.metrics(cm, 3).first()
    assert m.accuracy == 0.6 and m.macro_precision == pytest.approx((0.5 + 2 / 3) / 3) and m.macro_recall == pytest.approx(0.5) and m.weighted_f1 == pytest.approx(0.52)
    assert {r.label: round(r.f1, 6) for r in evalmetrics.per_class(cm).collect()} == {0: 0.5, 1: 0.8, 2: 0.0}
    assert [(r.y_true, r.y_pred) for r in evalmetrics.top_confusions(cm).collect()] == [(0, 1), (2, 0)]
    assert math.isnan(evalmetrics.metrics(cm.filter("n < 0"), 3).first().accuracy)


def test_best_so_far(spark):
    df = spark.createDataFrame(list(enumerate([0.1, 0.3, 0.3, 0.2, 0.4])), "epoch int, metric double")
    got = evalmetrics.best_so_far(df, patience=2).orderBy("epoch").collect()
    assert [r.improved for r in got] == [True, True, False, False, True] and [r.best_epoch for r in got] == [0, 1, 1, 1, 4]
    assert [r.bad_epochs for r in got] == [0, 0, 1, 2, 0] and [r.stop for r in got] == [False, False, False, True, False]


def test_temporal_statistics_golden(spark):
    x = [[1.0, 2.0, 3.0], [3.0, 2.0, 1.0], [5.0, 2.0, -1.0], [7.0, 2.0, -3.0]]
    df = spark.createDataFrame([(x,)], "x array<array<double>>")
    s = df.select(sequences.temporal_statistics(F.col("x"), 3)).first()[0]
    assert s == pytest.approx([4, 2, 0, math.sqrt(5), 0, math.sqrt(5), 1, 2, -3, 7, 2, 3])


def test_yates_and_plain_chi_square(spark):
    two = spark.createDataFrame([("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 9, "a string, b string")
    n, e = 29, [17 * 15 / 29, 17 * 14 / 29, 12 * 15 / 29, 12 * 14 / 29]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip([12, 5, 3, 9], e))
    got = profile.chi_square(two, "a", "b").first()
    assert got.chi2 == pytest.approx(want) and got.dof == 1 and got.min_expected == pytest.approx(min(e)) and n == 29
    assert profile.chi_square(two.filter("a = 'a'"), "a", "b").first().chi2 is None


def test_leaks_are_caught(spark):
    good = [("s1", "v/a.mp4", "h1", "g1", None, "train"), ("s2", "v/b.mp4", "h2", "g2", "a.mp4", "train"), ("s3", "v/c.mp4", "h3", "g3", None, "val")]
    schema = "sample_id string, repo_path string, sha256 string, split_group string, aug_source string, split string"
    assert all(r.passed for r in quality.index_leaks(spark.createDataFrame(good, schema)).collect())
    for extra, name in [(("s1", "v/z.mp4", "h9", "g9", None, "train"), "source appears once"), (("s4", "v/y.mp4", "h3", "g8", None, "train"), "sha256 in one split"), (("s5", "v/x.mp4", "h8", "g3", None, "test"), "split_group in one split"), (("s6", "v/w.mp4", "h7", "g7", "a.mp4", "val"), "copy with its source"), (("s7", "v/v.mp4", "h6", "g6", None, "dev"), "valid split")]:
        bad = {r.check for r in quality.index_leaks(spark.createDataFrame([*good, extra], schema)).collect() if not r.passed}
        assert name in bad


def test_text_helpers(spark):
    one = spark.range(1)
    assert one.select(tx.clock(F.lit(3725)), tx.clock(F.lit(61)), tx.url_path(F.lit("a b/c+d")), tx.room_from_link(F.lit("https://h/channel/r_1?x")), tx.room_from_link(F.lit("no room!"))).first()[:] == ("62:05", "01:01", "a%20b/c%2Bd", "r_1", None)
    import hashlib

    assert one.select(tx.tie_break(F.lit("w"), 42)).first()[0] == hashlib.sha256(b"42:w").hexdigest()
    assert one.select(tx.array_name(F.lit("v/a.mp4"))).first()[0] == hashlib.sha1(b"v/a.mp4").hexdigest()[:20] + ".npz"
    c = "a" * 36
    assert one.select(tx.signal_error(F.lit("r"), F.lit(c), F.lit("b" * 36), F.lit("offer"), F.lit("{}")), tx.signal_error(F.lit("r"), F.lit(c), F.lit(c), F.lit("offer"), F.lit("{}")), tx.signal_error(F.lit("r"), F.lit(c), F.lit("b" * 36), F.lit("hi"), F.lit("{}")), tx.signal_error(F.lit("r"), F.lit(c), F.lit("b" * 36), F.lit("ice"), F.lit("x" * 64001))).first()[:] == (None, "invalid_id", "invalid_type", "too_large")


def test_kernel_on_a_25_fps_clip(spark):
    n = 100

    def frame(clip, i, hands):
        pose = [0.0] * 99
        for k, x in ((ar.LEFT_SHOULDER, 0.6), (ar.RIGHT_SHOULDER, 0.4)):
            pose[3 * k : 3 * k + 3] = [x, 0.4, 0.0]
        hand = [0.5, 0.4, 0.0] * 21
        return (clip, i / 25, 640, 480, pose, True, hand, hands, hand, False, [0.9] * 33)

    rows = [frame("ok", i, 20 <= i < 60) for i in range(n)] + [frame("few", i, True) for i in range(29)] + [frame("idle", i, False) for i in range(40)]
    schema = "clip string, t double, width int, height int, pose array<double>, pose_seen boolean, left_hand array<double>, left_hand_seen boolean, right_hand array<double>, right_hand_seen boolean, pose_vis array<double>"
    frames, clips = kernel.preprocess(spark.createDataFrame(rows, schema), ["pose", "left_hand", "right_hand"])
    c = {r.clip: r for r in clips.collect()}
    assert c["ok"].n_frames == 120 and (c["ok"].start, c["ok"].end, c["ok"].active_frames) == (24, 71, 48)
    assert (c["ok"].rest_before, c["ok"].rest_after) == (24, 48) and c["ok"].reason is None
    assert c["few"].reason == "too_few_decoded_frames" and c["idle"].reason == "no_active_signing_interval" and (c["idle"].rest_before, c["idle"].rest_after) == (48, 48)
    got = frames.orderBy("frame").collect()
    assert len(got) == 120 and got[0].center == pytest.approx([320, 192, 0]) and got[0].scale == pytest.approx(128)
    assert got[30].left_hand[:3] == pytest.approx([0, 0, 0], abs=1e-9) and got[30].pose[3 * ar.LEFT_SHOULDER] == pytest.approx(0.5)
    assert got[30].left_hand_flags == 3 and got[0].left_hand_flags == 0 and set(got[0].left_hand) == {0.0}
