"""Small literal fixtures with exact expected values (FIXTURES.md part A)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightframe.functions import numeric as num
from nightframe.functions import stages as st
from nightframe.operators import calibration as cal
from nightframe.operators import dataset as ds
from nightframe.operators import drift
from nightframe.operators import evaluation as ev
from nightframe.operators import relations as rel
from nightframe.operators import sequences as sq
from nightframe.operators import statistics as stat
from nightframe.operators import windows as win
from nightframe.sources import stage_text

START = dt.datetime(2024, 1, 1)


def epochs(spark, indexes, width=2):
    rows = [("t", "r", i, START + dt.timedelta(seconds=30 * i), [float(i)] * width) for i in indexes]
    return spark.createDataFrame(rows, "tenant string, rec string, epoch_index int, epoch_start_ts timestamp, features array<float>")


@pytest.mark.parametrize(
    "indexes, size, padding, statuses, padded",
    [
        (range(21), 21, "reject", ["ok"], [False]),
        ([0, 2], 3, "zero_fill", ["ok", "ok"], [True, True]),
        ([0, 1], 3, "zero_fill", ["ok", "ok"], [True, True]),
        ([0, 2], 3, "reject", ["gap"], [False]),
        ([0], 3, "reject", [], []),
    ],
)
def test_windows(spark, indexes, size, padding, statuses, padded):
    out = win.build_windows(epochs(spark, indexes), ["tenant", "rec"], window_size=size, padding=padding).orderBy("end_index").collect()
    assert [r.status for r in out] == statuses
    assert [r.padded for r in out] == padded
    assert all(len(r.window) == size for r in out if r.status == "ok")


def test_gap_window_ends_at_ninety_seconds_and_holds_zero_row(spark):
    out = win.build_windows(epochs(spark, [0, 2]), ["rec"], window_size=3, padding="zero_fill").filter("end_index = 2").collect()[0]
    assert out.window_end_ts == START + dt.timedelta(seconds=90)
    assert out.window == [[0.0, 0.0], [0.0, 0.0], [2.0, 2.0]]


def test_strict_windows_raise_on_a_gap(spark):
    with pytest.raises(Exception, match="Missing epoch index"):
        win.build_windows(epochs(spark, [0, 2]), ["rec"], window_size=3, strict=True).collect()


def test_confusion_accuracy(spark):
    df = spark.createDataFrame([("W", "W"), ("N1", "N2"), ("N1", "N1"), ("N2", "N2")], "ground_truth_stage string, predicted_stage string")
    report = ev.classification_report(df.withColumn("s", F.lit(1)), ["s"], "ground_truth_stage", "predicted_stage").collect()[0]
    assert report.accuracy == 0.75


@pytest.mark.parametrize(
    "values, bins, counts",
    [([0.1, 0.2, 0.95], 5, [1, 1, 0, 0, 1]), ([0.0, 1.0], 4, [1, 0, 0, 1]), ([0.5, float("inf")], 2, [0, 1])],
)
def test_confidence_histogram(spark, values, bins, counts):
    df = spark.createDataFrame([(1, v) for v in values], "s int, confidence double")
    assert [r["count"] for r in ev.confidence_histogram(df, ["s"], bins=bins).orderBy("bin").collect()] == counts


def test_transitions_skip_unknown_labels(spark):
    rows = [(1, i, s) for i, s in enumerate(["W", "N1", "N2", "N2", "W", "?", "W"])]
    df = spark.createDataFrame(rows, "r int, epoch_index int, predicted_stage string")
    got = {(r.src, r.dst): r.n for r in sq.transition_counts(df, ["r"], labels=["W", "N1", "N2"]).collect()}
    assert got == {("W", "N1"): 1, ("N1", "N2"): 1, ("N2", "N2"): 1, ("N2", "W"): 1}


def test_label_merge(spark):
    df = spark.createDataFrame([(["W", "N1"], ["N2", "W", "REM"])], "a array<string>, b array<string>")
    assert df.select(rel.merge_labels(F.col("a"), F.col("b"))).first()[0] == ["W", "N1", "N2", "REM"]


def test_daily_stats_and_merge(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0)], "day int, value double")
    got = {r.day: r for r in stat.daily_feature_stats(df, ["day"]).collect()}
    assert (got[1]["count"], got[1].mean, got[1].p50) == (2, 2.0, 2.0)
    parts = spark.createDataFrame(
        [("x", 2, 4.0, 10.0, 1.0, 3.0, 2.0, 2.0, 2.0), ("x", 1, 3.0, 9.0, 3.0, 3.0, 3.0, 3.0, 3.0)],
        "f string, count long, sum double, sum_squares double, min double, max double, p10 double, p50 double, p90 double",
    )
    assert stat.merge_feature_stats(parts, ["f"]).first().p50 == pytest.approx(7 / 3)


def test_drift_numbers(spark):
    rows = [("current", "W", 5.0), ("baseline", "W", 1.0), ("baseline", "W", 3.0), ("baseline", "W", 5.0)]
    df = spark.createDataFrame(rows, "window string, s string, v double").withColumn("k", F.lit(1))
    dist = drift.distribution_drift(df, ["k"], "s").first()
    assert (dist.psi, dist.kl_divergence) == (0.0, 0.0)
    z = drift.mean_drift(df, ["k"], "v").first()
    assert z.baseline_std == 2.0 and z.z_score == 1.0


@pytest.mark.parametrize(
    "row, status, severity",
    [((0.5, 0.0, None), "alert", "HIGH"), ((None, None, 6.1), "alert", "HIGH"), ((None, None, -3.5), "alert", "MEDIUM"), ((0.1, 0.05, None), "ok", "LOW")],
)
def test_drift_classes(spark, row, status, severity):
    df = spark.createDataFrame([("m", *row)], "name string, psi double, kl double, z double")
    got = drift.classify(df).first()
    assert (got.status, got.severity) == (status, severity)


def test_overall_severity_is_at_least_medium_with_an_alert(spark):
    df = spark.createDataFrame([("m", "alert", "LOW", 0.1)], "name string, status string, severity string, drift_score double")
    assert drift.overall(df.withColumn("k", F.lit(1)), ["k"]).first().overall_severity == "MEDIUM"


def test_time_overlap_groups(spark):
    df = spark.createDataFrame([("a", 0, 100), ("b", 50, 120), ("c", 500, 600), ("d", None, None)], "r string, s long, e long")
    got = {r.r: r.time_group for r in rel.overlap_groups(df, "r", "s", "e").collect()}
    assert got["a"] == got["b"] != got["c"] and got["d"] is None


def test_purge_gap_drops_both_sides(spark):
    rows = [("r", i, "train" if i < 3 else "test") for i in range(4)]
    df = spark.createDataFrame(rows, "r string, epoch_index int, split string")
    assert sorted(r.epoch_index for r in ds.purge_gap(df, ["r"], 1).collect()) == [0, 1]


@pytest.mark.parametrize(
    "text, dataset",
    [("subject_dodh_001", "DODH"), ("CAP-night-2", "CAP"), ("isruc_patient", "ISRUC"), ("sleepedf-subject", "SLEEP-EDF"), ("other", "UNKNOWN"), (None, "UNKNOWN")],
)
def test_dataset_id(spark, text, dataset):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(st.dataset_id(F.col("t"))).first()[0] == dataset


@pytest.mark.parametrize("codes, want", [([1, 2, 3, 4, 5], [0, 1, 2, 3, 4]), ([0, -1, 9, 2], [0, -1, -1, 2])])
def test_numeric_stage_schemes(spark, codes, want):
    df = spark.createDataFrame([("r", i, c) for i, c in enumerate(codes)], "r string, i int, c int")
    got = st.numeric_stage_codes(df, ["r"], "c", "code").orderBy("i").collect()
    assert [r.code for r in got] == want


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-1.0,), (300.0,)], "x double")
    assert [r[0] for r in df.select(num.clamp_uint8(F.col("x"))).collect()] == [2, 4, 0, 255]


def lines(spark, text):
    rows = [("f", i, line) for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line_no int, line string")


def test_cap_text_to_hypnogram(spark):
    text = "Event\tTime\tDur\nSLEEP-S0\t23:59:30\t30\nSLEEP-S1\t00:00:00\t30\nSLEEP-REM\t00:00:30\t30"
    events = stage_text.parse_stage_events(lines(spark, text), ["file"])
    hyp = win.hypnogram_from_events(events, ["file"]).orderBy("epoch_index").collect()
    assert [r.stage for r in hyp] == [0, 1, 4]


def test_remlogic_text(spark):
    text = "Sleep Stage\tPosition\tTime\tEvent\tDuration\nW\tx\t22.30.28\tSLEEP-S0\t30\nS1\tx\t22.30.58\tSLEEP-S1\t30"
    got = stage_text.parse_stage_events(lines(spark, text), ["file"]).orderBy("line_no").collect()
    assert [(r.clock, r.stage) for r in got] == [("22.30.28", 0), ("22.30.58", 1)]


def test_isruc_text(spark):
    got = stage_text.parse_isruc(lines(spark, "0\n1\n2\n3\n5\n7"), ["file"]).orderBy("line_no").collect()
    assert [r.stage for r in got] == [0, 1, 2, 3, 4, -1]
    assert [r.unknown_code for r in got] == [False] * 5 + [True]
    assert stage_text.parse_isruc(lines(spark, "0\nhello"), ["file"]).count() == 0


def test_stage_files_keep_line_order(spark, tmp_path):
    (tmp_path / "n1.txt").write_text("SLEEP-S0;22:00:00;30\r\nSLEEP-S2;22:00:30;60\r\n")
    got = stage_text.read_stage_events(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.stage, r.duration_sec) for r in got] == [(0, 30.0), (2, 60.0)]


def test_annotations_fill_unknown_and_report_conflicts(spark):
    hyp = spark.createDataFrame([("r", i, s) for i, s in enumerate([0, 1, -1, 2])], "r string, epoch_index int, stage int")
    notes = spark.createDataFrame([("r", 60, 30, "REM", 4), ("r", 90, 30, "N1", 1)], "r string, onset_sec int, duration_sec int, label string, stage int")
    got = win.merge_annotations(hyp, notes, ["r"]).orderBy("epoch_index").collect()
    assert [r.stage for r in got] == [0, 1, 4, 2]
    assert [r.conflict for r in got] == [False, False, False, True]


def test_calibration_bins_have_gaps(spark):
    rows = [("W", [0.9, 0.1]), ("Light", [0.2, 0.8]), ("W", [0.4, 0.6]), ("Light", [0.3, 0.7])]
    df = spark.createDataFrame(rows, "t string, probabilities array<double>").withColumn("s", F.lit(1))
    top = cal.top_label(df, labels=["W", "Light"]).withColumn("ok", F.col("argmax") == F.col("t"))
    bins = cal.reliability(top, ["s"], "conf", "ok", bins=4).collect()
    assert len(bins) == 4 and sum(r["count"] for r in bins) == 4
    assert all(r.gap == pytest.approx(abs(r.avg_acc - r.avg_conf)) for r in bins)
