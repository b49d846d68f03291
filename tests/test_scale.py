"""Shared steps run once, and steps that a planner misjudges are planned as they should be."""

import datetime as dt
import pathlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightframe.catalog import QUERIES, streams, views
from nightframe.functions import probability as prob
from nightframe.operators import dataset, ordered, scoring, signal, windows
from nightframe.sources import artifacts
from nightframe.schema import FEATURES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three users' events and two suppliers' lines."""
    top = tmp_path_factory.mktemp("tables")
    start = dt.datetime(2024, 1, 1)
    kinds = ["click", "view", "error", "signup", "purchase"]
    events = [
        (i, start + dt.timedelta(minutes=17 * i), i % 3, kinds[i * 7 % 5], float(i % 40), f'{{"k": {i % 83}}}') for i in range(240)
    ]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{top}/events.parquet")
    lines = [(i // 4, i % 9, i % 2, i % 4 + 1, float(i * 13 % 50), float(i)) for i in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{top}/lineitem.parquet")
    return str(top)


@pytest.mark.parametrize(
    "name, table",
    [
        ("sig_07_local_maxima", "lineitem"), ("sig_25_burst_delta", "lineitem"), ("sig_29_vibration_features", "lineitem"),
        ("agg_17_daily_feature_stats", "events"), ("mod_08_scorecard", "events"), ("mod_09_gates", "events"), ("mod_06_grouped_folds", "events"),
    ],
)
def test_a_table_read_in_many_steps_is_prepared_once(spark, tables, name, table):
    out = QUERIES[name](spark, tables)
    assert not [f for f in out.inputFiles() if f"/{table}.parquet" in f]
    assert out.count() > 0


@pytest.mark.parametrize("name, reads", [("sig_25_burst_delta", 2), ("sig_24_movement", 2), ("sig_06_robust_threshold", 1)])
def test_passes_of_a_quantile_do_not_multiply_the_plan(spark, tables, name, reads):
    out = QUERIES[name](spark, tables)
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() <= reads
    assert out.count() > 0


def test_scale_of_channels(spark):
    """Odd and even numbers of values, a channel that hardly moves, one of nulls; a null key has no limits."""
    values = {"a": [1.0, 9.0, 3.0, 4.0], "b": [5.0, 5.0, 5.0, 8.0], "c": [None, None], None: [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: (r.median, r.mad, r.scale) for r in signal.robust_scale(df, ["k"], "v").collect()}
    assert got == {"a": (3.5, 1.5, 1.5), "b": (5.0, 0.0, pytest.approx(1.299038105676658)), "c": (None, None, None)}


def test_a_feed_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i)) for i in range(30)], "i long, ts timestamp").mapInArrow(mark, "i long, ts timestamp")
    runs = []
    streams.feed(spark, df, "fed", lambda stream: runs.append(stream.isStreaming))
    assert made.value == 30 and runs == [True] * (len(streams.CUTS) + 1)


def test_epochs_of_a_hypnogram_are_not_joined(spark):
    events = spark.createDataFrame(
        [("a", 0, 100, 60.0, 1), ("a", 1, 130, 60.0, 2), ("a", 2, 400, 45.0, 3), ("b", 0, 0, 90000.0, 4)],
        "rec string, line_no int, clock_sec long, duration_sec double, stage int",
    )
    out = windows.hypnogram_from_events(events, ["rec"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bJoin (Inner|LeftOuter)", plan[: plan.index("Generate")])) == 0
    got = {(r.rec, r.epoch_index): (r.stage, r.odd_duration) for r in out.collect()}
    assert [got["a", i] for i in range(12)] == [(1, True), (2, True), (2, True), *[(-1, True)] * 7, (3, True), (3, True)]
    assert [got["b", i] for i in range(3000)] == [(4, False)] * 3000 and len(got) == 3012


def test_draws_are_not_sent_to_every_task(spark):
    df = spark.createDataFrame([("x" if i % 4 else "y", i, i % 3 == 0) for i in range(200)], "label string, id long, hard boolean")
    for out in (dataset.balance_classes(df, "label", ["id"], "oversample"), dataset.weighted_resample(df, "hard", ["id"], 2.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan.split("Generate")[0]
    drawn = dataset.balance_classes(df, "label", ["id"], "oversample")
    assert {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()} == {"x": 150, "y": 150}


def test_losses_of_a_batch(spark):
    rows = [([0.5, 2.0, -1.0], 2), ([3.0, 1.0, 1.0], 1), (None, 1), ([1.0, None, 2.0], 3), ([1.0, 2.0], None), ([700.0, -700.0], 2)]
    df = spark.createDataFrame(rows, "z array<double>, y int")
    temperatures = [0.25, 1.0, 10.0]
    want = df.agg(*[F.sum(prob.log_loss(F.col("z"), F.col("y"), F.lit(t))) for t in temperatures]).first()
    got = scoring.loss_sums(pa.array([z for z, _ in rows], pa.list_(pa.float64())), pa.array([y for _, y in rows], pa.int32()), temperatures)
    assert got == pytest.approx(list(want), rel=1e-12)
    best = scoring.fit_temperature(df, "z", "y", [0.01, *temperatures]).first()
    assert best["rows"] == len(rows) and best["temperature"] == 10.0 and best["nll"] == pytest.approx(want[2] / len(rows))
    with pytest.raises(ValueError):
        scoring.loss_sums(pa.array([[1.0]]), pa.array([0], pa.int32()), [1.0])


def test_nights_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(40).select(
        F.col("id").alias("night_id"), F.lit(0).alias("epoch_index"), F.lit(0).cast("bigint").alias("start_sec"),
        *[F.lit(1).alias(f) for f in FEATURES], F.lit(1).alias("stage"), F.lit(True).alias("valid"),
    )
    artifacts.write_night_artifacts(df, str(tmp_path / "nights"))
    files = list(pathlib.Path(tmp_path / "nights").glob("night_id=*/part-*.parquet"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1


def nights_of(spark, ids, kind, hr, epochs=3):
    df = spark.createDataFrame([(i, e) for i in ids for e in range(epochs)], f"night_id {kind}, epoch_index int")
    return df.select(
        "night_id", "epoch_index", (F.col("epoch_index") * 30).cast("bigint").alias("start_sec"),
        *[F.lit(hr).alias(f) for f in FEATURES], F.when(F.col("epoch_index") > 0, 2).alias("stage"), (F.col("epoch_index") < 2).alias("valid"),
    )


@pytest.mark.parametrize("kind, ids, again", [("long", [None, -3, *range(30)], [5, None, 40]), ("string", ["a/b", "é=1 %", "10", "007", "", None], ["a/b", "x", ""])])
@pytest.mark.parametrize("shared", [True, False])
def test_only_nights_that_come_are_replaced(spark, tmp_path, monkeypatch, request, kind, ids, again, shared):
    """Written and read by the tasks, or by Spark where the store is not a shared folder."""
    path = str(tmp_path / "nights")
    monkeypatch.setattr(artifacts, "shared_folder", artifacts.shared_folder if shared else lambda spark, path: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # a night comes in several batches
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch"))
    artifacts.write_night_artifacts(nights_of(spark, ids, kind, 1), path)
    artifacts.write_night_artifacts(nights_of(spark, again, kind, 255, 2), path)
    df = nights_of(spark, ids, kind, 1)
    schema = artifacts.night_rows(df).schema
    got = artifacts.read_night_artifacts(spark, path, schema, schema.names)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in schema]
    named = lambda i: None if i == "" else i
    want = [(named(i), e, 1.0, None if e == 0 else 2, e < 2, 30 * e) for i in ids if named(i) not in map(named, again) for e in range(3)]
    want += [(named(i), e, None, None if e == 0 else 2, True, 30 * e) for i in again for e in range(2)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.night_id, r.epoch_index, r.hr_mean, r.label, r.valid_mask, r.start_sec) for r in got.collect()), key=key) == sorted(want, key=key)
    by_spark = spark.read.schema(schema).parquet(path).select(*schema.names)
    assert got.exceptAll(by_spark).isEmpty() and by_spark.exceptAll(got).isEmpty()
    left = [f for f in pathlib.Path(path).rglob("*") if not f.name.startswith(("night_id=", "part-", ".part-", "_SUCCESS", "._SUCCESS"))]
    assert not left


def test_no_process_and_no_reading_task_for_each_night(spark, tables, tmp_path):
    """Spark's local writer leaves a checksum beside each file it starts a process for; its reader keeps a list of all files."""
    artifacts.write_night_artifacts(nights_of(spark, range(40), "long", 1), str(tmp_path / "nights"))
    assert not list((tmp_path / "nights").rglob("*.crc"))
    out = QUERIES["src_13_night_artifacts"](spark, tables)
    assert not out.inputFiles()
    assert {r.night_id: r.n_epochs for r in out.collect()} == {0: 80, 1: 80, 2: 80}


def test_no_nights(spark, tmp_path):
    df = nights_of(spark, [], "long", 1)
    artifacts.write_night_artifacts(df, str(tmp_path / "nights"))
    schema = artifacts.night_rows(df).schema
    assert artifacts.read_night_artifacts(spark, str(tmp_path / "nights"), schema, ["night_id", "label"]).count() == 0


def test_only_long_keys_keep_fine_blocks(spark):
    df = spark.createDataFrame([("long", i) for i in range(20)] + [("short", i) for i in range(3)] + [(None, i) for i in range(8)], "k string, i long")
    marked = ordered.wide_blocks(df, ["k"], F.floor(F.col("i") / 4), limit=5)
    blocks = {r["k"]: r["b"] for r in marked.groupBy("k").agg(F.count_distinct("_block").alias("b")).collect()}
    assert blocks == {"long": 5, "short": 1, None: 2} and marked.count() == 31
    placed = ordered.with_position(marked.filter("k is not null"), ["k"], ["i"], "_block").collect()
    assert len(placed) == 23 and all(r["pos"] == r["i"] for r in placed)


def test_an_event_without_a_time_counts_but_has_no_epoch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, 7, "click", 1.0, "k1"), (2, None, 7, "view", 1.0, "k2"), (3, at + dt.timedelta(hours=5), 7, "view", 1.0, "k3"), (4, at, None, "view", 1.0, "k4")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.event_id, r.epoch_index) for r in views.epochs(spark, str(tmp_path)).collect()) == [(1, 1), (3, 2)]
