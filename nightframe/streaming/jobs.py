"""Structured Streaming forms of the always-on behaviours (STR-01 .. STR-08).

Every function returns a streaming DataFrame or a ``foreachBatch`` body; the
caller picks the sink and trigger. State lives in checkpoints on shared
storage, so a lost executor only replays its last batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nightframe.operators.evaluation import ratio
from nightframe.operators.ingest import insert_ignore
from nightframe.operators.statistics import with_moments
from nightframe.schema import RECORDING_TIMEOUT_HOURS, WINDOW_SIZE
from nightframe.session import ROCKSDB_PROVIDER, path_exists

#: Recordings are called into Python by so many groups; a task holds a group's rows of one batch.
RECORDING_GROUPS = 1024


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_event_time(stream: DataFrame, col: str, lateness: str) -> DataFrame:
    """Event time as TIMESTAMP with a watermark."""
    return stream.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, lateness)


def tumbling_epochs(stream: DataFrame, keys: Sequence[str], ts: str, seconds: int = 30) -> DataFrame:
    """30-second means, spreads and presence from device samples (STR-01).

    Input ``hr, rr, in_bed, moved``; the stream carries a watermark on ``ts``.
    """
    return stream.groupBy(*keys, F.window(ts, f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("hr").alias("hr_mean"), F.stddev_pop("hr").alias("hr_std"),
        F.avg("rr").alias("rr_mean"),
        (100 * F.avg(F.col("in_bed").cast("double"))).alias("in_bed_pct"),
        (100 * F.avg(F.col("moved").cast("double"))).alias("move_pct"),
    ).select(*keys, F.col("w.start").alias("epoch_start_ts"), "samples", "hr_mean", "hr_std", "rr_mean", "in_bed_pct", "move_pct")


def deduplicated(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeated uploads of a key within the watermark (STR-02)."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def append_new(target_path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: insert-ignore into a Parquet table (STR-02).

    Each batch owns one folder, replaced when the batch is retried, and keys
    written by *other* batches are skipped: replays and late copies are harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.createDataFrame([], batch.select(*keys).schema)
        if batch_id > 0:
            stored = spark.read.option("basePath", target_path).schema(
                T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
            )
            if path_exists(spark, target_path):  # else all earlier batches were empty
                known = stored.parquet(target_path).filter(F.col("batch") < batch_id).select(*keys)
        insert_ignore(batch, known, keys, order).write.mode("overwrite").parquet(f"{target_path}/batch={batch_id}")

    return write


class Ready(NamedTuple):
    """What new epochs bring: complete windows, and the runs and values with which it goes on."""

    ends: np.ndarray  # index of a complete window's last epoch
    means: np.ndarray
    first: np.ndarray  # of each run of indexes seen
    last: np.ndarray
    index: np.ndarray  # the epochs at hand, those that waited and the new ones, in order
    value: np.ndarray
    is_new: np.ndarray
    waits: np.ndarray  # whether an epoch at hand still belongs to a window with an absent one


def fresh_epochs(first: np.ndarray, last: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Which indexes lie in no run seen so far; runs are in order and apart."""
    if not len(first):
        return np.ones(len(index), bool)
    at = np.searchsorted(first, index, "right") - 1
    return (at < 0) | (index > last[np.maximum(at, 0)])


def complete(size: int, first: np.ndarray, last: np.ndarray, held: np.ndarray, held_value: np.ndarray, index: np.ndarray, value: np.ndarray) -> Ready:
    """Windows of ``size`` epochs that the fresh epochs ``index`` complete, given the runs seen and the values that wait."""
    all_index = np.concatenate([held, index])
    order = np.argsort(all_index)
    is_new = order >= len(held)
    all_value = np.concatenate([held_value, value])[order]
    all_index = all_index[order]
    ready = np.empty(0, np.int64)
    means = np.empty(0)
    if len(all_index) >= size:
        new_before = np.concatenate([[0], np.cumsum(is_new)])
        whole = all_index[size - 1 :] - all_index[: len(all_index) - size + 1] == size - 1
        ready = np.flatnonzero(whole & (new_before[size:] > new_before[:-size]))
        means = np.lib.stride_tricks.sliding_window_view(all_value, size)[ready].mean(1)
    # Runs grow and meet; an epoch all of whose windows are out need not wait.
    low, high = np.concatenate([first, index]), np.concatenate([last, index])
    order_of = np.argsort(low)
    low, high = low[order_of], high[order_of]
    opens = np.append(True, low[1:] > high[:-1] + 1)
    first, last = low[opens], high[np.append(opens[1:], True)]
    run = np.searchsorted(first, all_index, "right") - 1
    done = (all_index - size + 1 >= first[run]) & (all_index + size - 1 <= last[run])
    return Ready(all_index[ready + size - 1], means, first, last, all_index, all_value, is_new, ~done)


class LastEpochs(StatefulProcessor):
    """Emits every complete window of a recording once, however late its epochs come.

    State: the runs of indexes seen so far, and the values of those epochs that
    still belong to a window with an absent epoch. Inside a run only its first
    and last ``size - 1`` values wait, so state grows with the gaps and not with
    the length of the recording.
    """

    def __init__(self, key_fields: list[str], size: int):
        self.key_fields = key_fields
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "epoch_index int", "value double")
        self.seen = handle.getMapState("seen", "first int", "last int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = {k[0]: v[0] for k, v in self.seen.iterator()} if self.seen.exists() else {}
        held = {k[0]: v[0] for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        firsts = np.array(sorted(runs), np.int64)
        lasts = np.array([runs[i] for i in firsts.tolist()], np.int64)
        batch = pd.concat(list(rows))[["epoch_index", "value"]].sort_values(["epoch_index", "value"])
        batch = batch.drop_duplicates("epoch_index")
        index, value = batch["epoch_index"].to_numpy(np.int64), batch["value"].to_numpy(float)
        fresh = fresh_epochs(firsts, lasts, index)
        if not fresh.any():
            return
        got = complete(self.size, firsts, lasts, np.array(list(held), np.int64), np.array(list(held.values()), float), index[fresh], value[fresh])
        if len(got.ends):
            out = {name: [part] * len(got.ends) for name, part in zip(self.key_fields, key)}
            yield pd.DataFrame(out | {"window_end_index": got.ends, "mean_value": got.means})
        for i in got.index[~got.waits & ~got.is_new].tolist():
            self.waiting.removeKey((i,))
        put = got.waits & got.is_new
        for i, v in zip(got.index[put].tolist(), got.value[put].tolist()):
            self.waiting.updateValue((i,), (v,))
        after = dict(zip(got.first.tolist(), got.last.tolist()))
        for i in runs.keys() - after.keys():
            self.seen.removeKey((i,))
        for i, end in after.items():
            if runs.get(i) != end:
                self.seen.updateValue((i,), (end,))

    def close(self) -> None:
        pass


class LastEpochsOfMany(LastEpochs):
    """:class:`LastEpochs` of a group of recordings, whose rows come with their keys.

    A call into Python and each access to state cost more than the few epochs
    that a recording has in a batch. So all recordings of a group are settled in
    one pass over arrays, where each has a range of indexes of its own, and the
    state of a recording is read and written as a whole.
    """

    def __init__(self, key_fields: list[T.StructField], size: int):
        super().__init__([f.name for f in key_fields], size)
        self.columns = [f"key_{i}" for i in range(len(key_fields))]
        self.whole = [isinstance(f.dataType, T.IntegralType) for f in key_fields]
        self.key_schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(self.columns, key_fields)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        # runs: first and last of each; waiting: indexes, then their values
        self.recordings = handle.getMapState("recordings", self.key_schema, "runs binary, waiting binary")

    def plain(self, key: tuple) -> tuple:
        """Key as state has it; pandas makes floats of whole numbers beside a null."""
        return tuple(None if pd.isna(x) else int(x) if whole else x for x, whole in zip(key, self.whole))

    def stored(self, keys: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        runs, held, values = [], [], []
        for key in keys:
            found = self.recordings.getValue(key)
            span = np.frombuffer(found[0] if found else b"", np.int64)
            waiting = found[1] if found else b""
            runs.append(span.reshape(-1, 2))
            held.append(np.frombuffer(waiting[: len(waiting) // 2], np.int64))
            values.append(np.frombuffer(waiting[len(waiting) // 2 :], np.float64))
        return runs, held, values

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        rec = batch.groupby(self.columns, sort=False, dropna=False).ngroup().to_numpy(np.int64)
        named = batch.loc[np.unique(rec, return_index=True)[1], self.columns].set_axis(self.key_fields, axis=1).reset_index(drop=True)
        keys = [self.plain(k) for k in named.itertuples(index=False, name=None)]
        runs, held, held_value = self.stored(keys)
        index, value = batch["epoch_index"].to_numpy(np.int64), batch["value"].to_numpy(float)
        order = np.lexsort((value, index, rec))
        rec, index, value = rec[order], index[order], value[order]
        one = np.append(True, (rec[1:] != rec[:-1]) | (index[1:] != index[:-1]))
        rec, index, value = rec[one], index[one], value[one]
        # Recording r has the indexes from r * stride on; ranges are a step apart, so runs don't meet.
        span = np.concatenate(runs)
        known = np.concatenate([index, span.ravel()])
        low, stride = known.min(), known.max() - known.min() + 2
        begins = np.arange(len(keys) + 1) * stride
        span = span + np.repeat(begins[:-1] - low, [len(x) for x in runs])[:, None]
        waiting = np.concatenate(held) + np.repeat(begins[:-1] - low, [len(x) for x in held])
        index = index + begins[rec] - low
        fresh = fresh_epochs(span[:, 0], span[:, 1], index)
        if not fresh.any():
            return
        got = complete(self.size, span[:, 0], span[:, 1], waiting, np.concatenate(held_value), index[fresh], value[fresh])
        if len(got.ends):
            of = got.ends // stride
            out = named.loc[of].reset_index(drop=True)
            yield out.assign(window_end_index=got.ends - begins[of] + low, mean_value=got.means)
        kept, kept_value = got.index[got.waits], got.value[got.waits]
        spans = np.stack([got.first, got.last], 1)
        run_at, kept_at = np.searchsorted(got.first, begins), np.searchsorted(kept, begins)
        for r in np.unique(rec[fresh]).tolist():
            a, b, c, d = run_at[r], run_at[r + 1], kept_at[r], kept_at[r + 1]
            shift = low - begins[r]
            waits = (kept[c:d] + shift).tobytes() + kept_value[c:d].tobytes()
            self.recordings.updateValue(keys[r], ((spans[a:b] + shift).tobytes(), waits))


def windows_when_complete(stream: DataFrame, keys: Sequence[str], size: int = WINDOW_SIZE) -> DataFrame:
    """Emit a window as soon as ``size`` contiguous epochs exist (STR-03).

    Input ``epoch_index, value``. An epoch may come at any time: nothing is
    dropped by age, and one that fills a gap completes its windows then. Of
    repeated uploads the first batch's value counts, inside a batch the smallest.
    Recordings are dealt over ``RECORDING_GROUPS`` by a hash of their key.
    """
    use_rocksdb(stream.sparkSession)
    fields = [stream.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("window_end_index", T.LongType()), T.StructField("mean_value", T.DoubleType())])
    group = F.pmod(F.xxhash64(*keys), F.lit(RECORDING_GROUPS)).cast("int").alias("recording_group")
    named = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    return stream.select(group, *named, "epoch_index", "value").groupBy("recording_group").transformWithStateInPandas(
        LastEpochsOfMany(fields, size), outputStructType=schema, outputMode="append", timeMode="none"
    )


class OpenRecording(StatefulProcessor):
    """The open recording of a device, closed 12 hours after its start."""

    def __init__(self, key_fields: list[str], cap_seconds: int):
        self.key_fields = key_fields
        self.cap = cap_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = self.start.get()[0] if self.start.exists() else None
        frames = pd.concat(list(rows)).sort_values(["sec", "event_id"])
        times, starts, at = frames["sec"].to_numpy(), np.empty(len(frames), np.int64), 0
        while at < len(times):  # one step per recording
            if start is None or times[at] - start > self.cap:
                start = int(times[at])
            after = int(np.searchsorted(times, start + self.cap, side="right"))
            starts[at:after], at = start, after
        self.start.update((start,))
        out = frames[["event_id", "sec"]].copy()
        for name, part in zip(self.key_fields, key):
            out[name] = part
        out["recording_start"] = starts
        yield out[[*self.key_fields, "event_id", "sec", "recording_start"]]

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, keys: Sequence[str], cap_hours: int = RECORDING_TIMEOUT_HOURS) -> DataFrame:
    """Recording of each upload with the cap counted from its start (STR-04).

    Input ``event_id, sec`` in upload order per batch. The cap is applied when
    the next upload of the device arrives, which is when the service closes an
    overdue recording, so no timer is needed.
    """
    use_rocksdb(stream.sparkSession)
    long = T.LongType()
    schema = T.StructType(
        [*[stream.schema[k] for k in keys], T.StructField("event_id", long), T.StructField("sec", long), T.StructField("recording_start", long)]
    )
    return stream.groupBy(*keys).transformWithStateInPandas(
        OpenRecording(list(keys), cap_hours * 3600), outputStructType=schema, outputMode="append", timeMode="none"
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def daily_rollup(stream: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """Mergeable daily statistics in update mode (STR-05)."""
    return stream.groupBy(*by, F.window(ts, "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"),
        F.sum(F.col(value) * F.col(value)).alias("sum_squares"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ).select(*by, F.to_date("w.start").alias("day"), "count", "sum", "sum_squares", "min", "max")


def within_lookback(rollup: DataFrame, as_of: Column, days: int = 30, day: str = "day") -> DataFrame:
    """Refresh window of the rollups: the last ``days`` without the current day (STR-05)."""
    today = F.to_date(as_of)
    return with_moments(rollup.filter((F.col(day) >= F.date_sub(today, days)) & (F.col(day) < today)))


def sync_status(stream: DataFrame, by: Sequence[str], ts: str) -> DataFrame:
    """Latest ingest time and event count per scope, emitted on change (STR-06)."""
    return stream.groupBy(*by).agg(F.max(ts).alias("last_ingest"), F.count(F.lit(1)).alias("uploads"))


def ingest_failure_rate(stream: DataFrame, ts: str, window: str = "1 hour") -> DataFrame:
    """Failure share and uploads per second by period (STR-07). Input ``ok``."""
    agg = stream.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("uploads"), F.count_if(~F.col("ok")).alias("failed")
    )
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return agg.select(
        F.col("w.start").alias("period_start"), "uploads", "failed",
        ratio(F.col("failed"), F.col("uploads")).alias("failure_rate"),
        (F.col("uploads") / seconds).alias("uploads_per_second"),
    )


def batch_report(path: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that writes what ``build`` makes of each batch's rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stored_report(
    table: str, path: str, keys: Sequence[str], build: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body that stores each batch and audits the table (STR-08).

    A report covers the keys that the batch touched, over all their rows stored
    so far, so a night that spans batches is judged whole. Batch and report own
    one folder each, replaced when the batch is retried.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        shape = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        stored = batch.sparkSession.read.option("basePath", table).schema(shape).parquet(table)
        stored = stored.filter(F.col("batch") <= batch_id)
        touched = stored.filter(F.col("batch") == batch_id).select(*keys).distinct()
        build(stored.drop("batch").join(touched, list(keys), "left_semi")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return write


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into Parquet files, then stop."""
    (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    )


def run_batches(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available through a ``foreachBatch`` body, then stop."""
    (
        stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    )
