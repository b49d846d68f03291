"""Cases outside the range of the driver's tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightframe.operators import dataset, evaluation, signal, statistics, windows
from nightframe.sources import stage_text
from nightframe.streaming import jobs


def epochs(spark, indexes, schemas=None, widths=None):
    start = dt.datetime(2024, 1, 1, 22)
    rows = [
        ("r", i, start + dt.timedelta(seconds=30 * i), [float(k)] * (widths[k] if widths else 2), schemas[k] if schemas else "v1")
        for k, i in enumerate(indexes)
    ]
    return spark.createDataFrame(rows, "rec string, epoch_index int, epoch_start_ts timestamp, features array<double>, schema string")


def statuses(df):
    return {r["end_index"]: r["status"] for r in df.collect()}


def test_repeated_index_hides_no_gap(spark):
    got = windows.build_windows(epochs(spark, [0, 0, 2]), ["rec"], window_size=3)
    assert statuses(got) == {2: "gap"}
    got = windows.build_windows(epochs(spark, [0, 1, 1, 2]), ["rec"], window_size=3).collect()
    assert [(r["end_index"], r["status"], len(r["window"])) for r in got] == [(2, "ok", 3)]
    filled = windows.build_windows(epochs(spark, [0, 1, 1, 2]), ["rec"], window_size=3, padding="zero_fill")
    assert statuses(filled) == {0: "ok", 1: "ok", 2: "ok"}


def test_mixed_windows_are_marked_or_refused(spark):
    mixed = epochs(spark, [0, 1], schemas=["v1", "v2"])
    assert statuses(windows.build_windows(mixed, ["rec"], window_size=2, schema_id="schema")) == {1: "mixed_schema"}
    uneven = epochs(spark, [0, 1], widths=[2, 3])
    assert statuses(windows.build_windows(uneven, ["rec"], window_size=2)) == {1: "width"}
    with pytest.raises(Exception, match="mixed_schema"):
        windows.build_windows(mixed, ["rec"], window_size=2, schema_id="schema", strict=True).collect()


def test_slew_limit_far_from_zero(spark):
    values = [5e9] + [0.0] * 6143
    got = signal.slew_limit(
        spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, epoch_index int, v double"),
        ["k"], "v", "capped", limit=1e4,
    ).orderBy("epoch_index").toPandas()["capped"].to_numpy()
    want, state = [], np.nan
    for x in values:
        state = x if np.isnan(state) else min(max(x, state - 1e4), state + 1e4)
        want.append(state)
    assert np.array_equal(got, want)


def test_histogram_clips_before_the_cast(spark):
    df = spark.createDataFrame([("a", 1e12), ("a", -1e12), ("a", 0.05)], "k string, confidence double")
    got = {r["bin"]: r["count"] for r in evaluation.confidence_histogram(df, ["k"]).collect()}
    assert got[0] == 2 and got[9] == 1


def test_snapshot_digest_takes_text_ids(spark):
    rows = spark.createDataFrame(
        [("night-a", 0, dt.datetime(2024, 1, 1), "W"), ("night-b", 0, dt.datetime(2024, 1, 1), "N1")],
        "recording_id string, epoch_index int, window_end_ts timestamp, label string",
    )
    one = dataset.snapshot_digest(dataset.snapshot_rows(rows)).first()
    assert one == dataset.snapshot_digest(dataset.snapshot_rows(rows.orderBy(F.desc("recording_id")).repartition(2))).first()
    assert one["row_count"] == 2


def test_fingerprint_tells_columns_apart(spark):
    one = spark.createDataFrame([("a|b", "c"), (None, "null")], "x string, y string")
    two = spark.createDataFrame([("a", "b|c"), ("null", None)], "x string, y string")
    prints = [statistics.table_fingerprint(df, [], "t").select("sum0", "sum1").first() for df in (one, two)]
    assert prints[0] != prints[1]


def test_stage_file_is_judged_by_all_its_lines(spark):
    numbers = [("long", i, str(i % 3)) for i in range(30)]
    lines = spark.createDataFrame(
        [*numbers, ("long", 30, "remark"), ("good", 0, "2"), ("good", 1, " "), ("text", 0, "a b")], "file string, line_no int, line string"
    )
    kinds = {r["file"]: r["format"] for r in stage_text.isruc_files(lines, ["file"]).collect()}
    assert kinds == {"long": "mixed", "good": "stages", "text": "other"}
    assert [r["file"] for r in stage_text.parse_isruc(lines, ["file"]).collect()] == ["good"]


class MapInMemory(dict):
    exists = property(lambda self: lambda: bool(self))
    iterator = property(lambda self: lambda: iter(list(self.items())))
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__


def fed(batches, size):
    """Window ends emitted per batch, and how many values wait at the end."""
    job = jobs.LastEpochs(["rec"], size)
    job.waiting, job.seen = MapInMemory(), MapInMemory()
    found = []
    for indexes in batches:
        frame = pd.DataFrame({"epoch_index": indexes, "value": [float(i) for i in indexes]})
        found.append([w for out in job.handleInputRows(("r",), iter([frame]), None) for w in zip(out["window_end_index"], out["mean_value"])])
    return found, len(job.waiting)


def test_windows_come_whatever_the_lateness():
    size = 21
    first, second, again = fed([[i for i in range(200) if i != 50], [50], [50, 60]], size)[0]
    assert sorted(e for e, _ in first + second) == list(range(20, 200)) and not again
    assert all(abs(m - (e - 10)) < 1e-9 for e, m in first + second)


@pytest.mark.parametrize("seed", range(8))
def test_windows_in_any_order_come_once(seed):
    rng = np.random.default_rng(seed)
    stream = rng.permutation(np.repeat(np.flatnonzero(rng.random(90) > 0.1), 2))
    found, waiting = fed(np.array_split(stream, 12), 4)
    present = set(stream.tolist())
    want = [e for e in range(90) if all(e - k in present for k in range(4))]
    assert sorted(e for part in found for e, _ in part) == want
    gaps = sum(i + 1 not in present for i in present)
    assert waiting <= 6 * gaps


class StateInMemory(dict):
    """State of recordings by key; counts how often it is asked."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value


@pytest.mark.parametrize("seed", range(6))
def test_windows_of_a_group_of_recordings(seed):
    """Each recording's windows come once with their mean, and its state is read and written once a batch."""
    rng = np.random.default_rng(seed)
    size, names = 4, [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (3, None)][: 5 - seed % 2]
    rows = [(k, int(i) - 7, float(rng.integers(100))) for k in names for i in rng.permutation(np.repeat(np.flatnonzero(rng.random(60) > 0.1), 2))]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    job = jobs.LastEpochsOfMany([T.StructField("rec", T.LongType()), T.StructField("_part", T.StringType())], size)
    job.recordings = StateInMemory()
    values, found, visits = {}, [], 0
    for part in np.array_split(np.arange(len(rows)), 9):
        batch = [rows[i] for i in part]
        values = {at: min(v for *b, v in batch if tuple(b) == at) for at in {(k, i) for k, i, _ in batch}} | values
        frame = pd.DataFrame({"key_0": pd.array([k[0] for k, *_ in batch], "Int64"), "key_1": [k[1] for k, *_ in batch], "epoch_index": [i for _, i, _ in batch], "value": [v for *_, v in batch]}, dtype=object)
        visits += len({k for k, *_ in batch})
        for out in job.handleInputRows((0,), iter([frame[:50], frame[50:]]), None):
            found += [(job.plain((a, b)), e, m) for a, b, e, m in zip(out["rec"], out["_part"], out["window_end_index"], out["mean_value"])]
    want = {(k, i): np.mean([values[k, i - j] for j in range(size)]) for k, i in values if all((k, i - j) in values for j in range(size))}
    assert len(found) == len(want) and {(k, i): m for k, i, m in found} == pytest.approx(want)
    assert job.recordings.asked <= 2 * visits and set(job.recordings) == set(names)
    for k in names:
        mine = {i for key, i in values if key == k}
        assert len(job.recordings[k][1]) // 16 <= 6 * sum(i + 1 not in mine for i in mine)


def test_a_stream_of_many_recordings_is_handled_in_groups(spark, tmp_path):
    rows = spark.range(300 * 30).selectExpr("id div 30 AS `class`", "CAST(id % 30 AS int) AS epoch_index", "CAST(id AS double) AS value")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for late in (False, True):
        rows.filter((F.col("epoch_index") == 5) == F.lit(late)).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.windows_when_complete(jobs.file_stream(spark, path, rows.schema), ["class"])
        jobs.run_to_table(stream, out, str(tmp_path / "checkpoint"))
    assert "recording_group" in stream._jdf.queryExecution().analyzed().toString()
    got = {(r["class"], r.window_end_index): r.mean_value for r in spark.read.parquet(out).collect()}
    assert got == {(k, e): 30.0 * k + e - 10 for k in range(300) for e in range(20, 30)} and spark.read.parquet(out).count() == 3000


def test_scratch_of_other_threads_is_left_alone(spark):
    """A scope collects what its own thread makes, also while another thread has one open."""
    import threading

    from nightframe.session import scratch_path, scratch_scope

    inside, done = threading.Event(), threading.Event()
    theirs = []

    def other():
        inside.wait(10)
        with scratch_scope() as made:
            theirs.append(scratch_path(spark, "other"))
            assert made == theirs
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch_scope() as mine:
        own = scratch_path(spark, "own")
        inside.set()
        done.wait(10)
        later = scratch_path(spark, "own")
    thread.join()
    assert mine == [own, later] and theirs


def test_dataset_refuses_other_feature_schemas(spark):
    """The plan raises on an epoch of another schema, or leaves windows over two schemas out if none is asked for."""
    from nightframe.plans.dataset_build import DatasetConfig, build_dataset

    start = dt.datetime(2024, 1, 1, 22)
    rows = [("t", r, i, start + dt.timedelta(seconds=30 * i), [1.0, 2.0], "v2" if i >= 4 and r == "b" else "v1") for r in "abc" for i in range(6)]
    eps = spark.createDataFrame(rows, "tenant_id string, recording_id string, epoch_index int, epoch_start_ts timestamp, features array<double>, feature_schema_version string")
    marks = [("t", r, i, 30 * i, "DODH", "W", None) for r in "abc" for i in range(6)]
    labels = spark.createDataFrame(marks, "tenant_id string, recording_id string, epoch_index int, end_sec long, dataset_id string, ground_truth_stage string, predicted_stage string")
    config = DatasetConfig(window_size=2, padding="reject")
    left = {(r.recording_id, r.epoch_index) for r in build_dataset(eps, labels, config).collect()}
    assert left == {(r, i) for r in "abc" for i in range(1, 6)} - {("b", 4)}
    with pytest.raises(Exception, match="Feature schema mismatch"):
        build_dataset(eps, labels, DatasetConfig(window_size=2, padding="reject", schema_version="v1")).collect()
    only = eps.filter("recording_id <> 'b'")
    assert build_dataset(only, labels, DatasetConfig(window_size=2, padding="reject", schema_version="v1")).count() == 10


def test_payloads_of_every_form(spark):
    """Lists, maps in any order, wrapped and bare base64 text; short, odd, missing and unusual values."""
    import base64
    import struct

    from nightframe.functions import payload

    def text(*xs):
        return base64.b64encode(struct.pack(f"<{len(xs)}f", *xs)).decode()

    rows = [
        (0, "[1, 2.5]"), (1, '{"b": 2.5, "a": 1}'), (2, '{"features": [1, 2.5]}'), (3, text(1, 2.5)), (4, f'{{"features":"{text(1, 2.5)}"}}'),
        (5, text(1)), (6, text(1, float("nan"))), (7, text(float("-inf"), 1)), (8, '{"a": 1}'), (9, None), (10, text(1e-40, -0.0)),
        (11, base64.b64encode(struct.pack("<2f", 1, 2.5) + b"xy").decode()), (12, ""), (13, "[1, null]"),
    ]
    df = payload.decode_features(spark.createDataFrame(rows, "id int, p string"), "p", ["a", "b"])
    got = {r["id"]: (r["decoded"]["features"], r["decoded"]["error"]) for r in df.collect()}
    for k in (0, 1, 2, 3, 4, 11):
        assert got[k] == ([1.0, 2.5], None), k
    assert got[10][1] is None and got[10][0][0] == pytest.approx(1e-40, rel=1e-3) and df.columns == ["id", "p", "decoded"]
    assert [got[k][1] for k in (5, 6, 7, 8, 9, 12, 13)] == [
        "wrong length", "not finite", "not finite", "missing features", "unsupported payload", "wrong length", "missing features"]


def test_dumps_cut_short(spark):
    import struct

    from nightframe.sources import artifacts

    epoch = bytes([1, 2, 3, 255, 5, 6, 128, 8, 9, 10, 11, 12, 13, 14, 15])
    head = struct.pack("<IHH", 4_000_000_000, 2, 0)
    rows = [("full", head + epoch * 2), ("short", head + epoch + epoch[:7]), ("head", head[:5]), ("none", None), ("empty", struct.pack("<IHH", 7, 0, 0))]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in rows], "k string, chunk binary")
    got = artifacts.unpack_flash_chunks(df, ["k"]).orderBy("k", "start_sec").collect()
    assert [(r["k"], r["start_sec"]) for r in got] == [("full", 4_000_000_000), ("full", 4_000_000_030), ("short", 4_000_000_000)]
    values = list(got[0])[2:]
    assert sorted(values) == sorted([-1 if x == 255 else -128 if x == 128 else x for x in epoch])


def test_snapshot_trees_name_what_differs(spark):
    """Trees of several levels; changed, missing and added blocks; equal and empty snapshots."""
    rows = spark.range(0, 3000).select(
        (F.col("id") / 3).cast("long").alias("recording_id"), (F.col("id") % 3 * 2048).cast("long").alias("epoch_index"),
        F.sha2(F.col("id").cast("string"), 256).alias("row_digest"),
    )
    first = dataset.snapshot_tree(rows)
    levels = {r["level"]: (r["count"], r["n"]) for r in first.groupBy("level").agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()}
    assert dataset.tree_depth(3000) == 2 and levels[-1] == (3000, 3000) and levels[0] == (1, 3000) and set(levels) == {-1, 0, 1, 2}
    assert dataset.tree_differences(first, dataset.snapshot_tree(rows.repartition(7), depth=2)).isEmpty()
    other = rows.filter("recording_id <> 5").withColumn(
        "row_digest", F.when((F.col("recording_id") == 900) & (F.col("epoch_index") == 2048), F.lit("x")).otherwise(F.col("row_digest"))
    ).unionByName(spark.createDataFrame([(7777, 0, "y")], "recording_id long, epoch_index long, row_digest string"))
    got = dataset.tree_differences(first, dataset.snapshot_tree(other, depth=2)).collect()
    assert {tuple(r) for r in got} == {(5, 0, "missing"), (5, 1, "missing"), (5, 2, "missing"), (900, 1, "changed"), (7777, 0, "added")}
    nothing = dataset.snapshot_tree(rows.limit(0))
    assert nothing.isEmpty() and dataset.tree_differences(nothing, dataset.snapshot_tree(rows.limit(0))).isEmpty()
    assert dataset.tree_differences(dataset.snapshot_tree(rows.limit(0), depth=2), first).count() == 3000
