"""Streaming queries: the stored stream result equals the batch result (STR-01 .. STR-08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.catalog.base import query, r6, ts_text
from nightframe.catalog.views import read
from nightframe.operators import statistics as stat
from nightframe.operators.ingest import first_per_key
from nightframe.operators.ordered import BLOCK, wide_blocks, with_position
from nightframe.session import cut_lineage, scratch_path
from nightframe.streaming import jobs

_EV = "ev AS (SELECT *, CAST(user_id % 5 AS BIGINT) AS device_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events)"
# the tables cover January 2024; uploads arrive in the periods between these days, the first and last are open
CUTS = ["2024-01-09", "2024-01-17", "2024-01-25", "2024-02-15"]


def feed(spark, df, label: str, run) -> None:
    """Let ``df`` arrive period by period and run the stream after each arrival.

    Each run takes all new files as one batch and continues from the checkpoint,
    as a scheduled ``availableNow`` job does. Rows without a time arrive first.
    """
    path = scratch_path(spark, label)
    df = cut_lineage(df, f"{label}-rows")  # made once, not for every period
    period = F.coalesce(sum((F.col("ts") >= F.lit(day).cast("timestamp")).cast("int") for day in CUTS), F.lit(0))
    for k in range(len(CUTS) + 1):
        df.filter(period == k).write.mode("append").parquet(path)
        run(jobs.file_stream(spark, path, df.schema))


def events(spark, sf):
    return read(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("device_id"), "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"),
        "event_type",
    )


def to_table(spark, df, label: str, transform, mode: str = "append"):
    """Stored output of a stream over ``df``."""
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    feed(spark, df, f"{label}-source", lambda stream: jobs.run_to_table(transform(stream), path, checkpoint, mode))
    return spark.read.parquet(path)


def latest_batches(spark, df, label: str, transform, keys):
    """Rows of an update-mode stream; the latest batch of a key wins."""
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    body = jobs.batch_report(path, lambda batch: batch)
    feed(spark, df, f"{label}-source", lambda stream: jobs.run_batches(transform(stream), body, checkpoint, "update"))
    stored = spark.read.option("basePath", path).parquet(path)
    return first_per_key(stored.withColumn("age", -F.col("batch")), keys, ["age"])


@query(
    "str_01_tumbling_epochs",
    f"""WITH {_EV}, e AS (SELECT device_id, sec // 3600 * 3600 AS w, count(*) AS samples, avg(value) AS hr_mean, 100 * avg(CASE WHEN k > 50 THEN 1.0 ELSE 0 END) AS in_bed_pct FROM ev GROUP BY 1, 2)
SELECT device_id, strftime(make_timestamp(w * 1000000), '%Y-%m-%d %H:%M:%S') AS epoch_start_ts, samples, round(hr_mean, 6) AS hr_mean, round(in_bed_pct, 6) AS in_bed_pct FROM e""",
)
def tumbling(spark, sf):
    """Append mode emits a window once the watermark has passed it, so a late row
    far ahead closes the last real windows."""
    df = events(spark, sf)
    flush = df.groupBy().agg(F.max("ts").alias("m")).select(F.lit(-1).cast("bigint").alias("device_id"), (F.col("m") + F.expr("INTERVAL 9000 DAYS")).alias("ts"))
    rows = df.select("device_id", "ts", "value", "k").unionByName(flush, allowMissingColumns=True)

    def transform(stream):
        timed = jobs.with_event_time(stream, "ts", "10 minutes")
        shaped = timed.select("device_id", "ts", F.col("value").alias("hr"), F.col("k").alias("rr"), (F.col("k") > 50).alias("in_bed"), (F.col("k") > 90).alias("moved"))
        return jobs.tumbling_epochs(shaped, ["device_id"], "ts", 3600)

    out = to_table(spark, rows, "epochs", transform)
    return out.filter(F.col("device_id") >= 0).select("device_id", ts_text("epoch_start_ts"), "samples", r6("hr_mean"), r6("in_bed_pct"))


@query(
    "str_02_deduplicated_ingest",
    f"WITH {_EV} SELECT device_id, event_id, sec FROM ev",
)
def ingest(spark, sf):
    """Every event is uploaded twice, the copy a day later; one row per key remains."""
    df = events(spark, sf).select("device_id", "event_id", "sec", "ts")
    again = df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    path, checkpoint = scratch_path(spark, "epoch-table"), scratch_path(spark, "epoch-table-checkpoint")
    keys = ["device_id", "event_id"]

    def run(stream):
        unique = jobs.deduplicated(jobs.with_event_time(stream, "ts", "1 hour"), keys)
        jobs.run_batches(unique, jobs.append_new(path, keys, ["ts"]), checkpoint)

    feed(spark, df.unionByName(again), "uploads", run)
    return spark.read.option("basePath", path).parquet(path).select("device_id", "event_id", "sec")


def user_rows(spark, sf):
    marked = wide_blocks(events(spark, sf), ["user_id"], F.floor(F.col("sec") / 3600))
    df = with_position(marked, ["user_id"], ["sec", "event_id"], BLOCK, "n")
    return df.select("user_id", "ts", (F.col("n") + F.floor(F.col("n") / 25)).cast("int").alias("epoch_index"), F.col("value"))


@query(
    "str_03_windows_when_complete",
    f"""WITH {_EV}, p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS n FROM ev), i AS (SELECT user_id, value, n + n // 25 AS i FROM p),
w AS (SELECT a.user_id, a.i AS window_end_index, count(*) AS c, avg(b.value) AS m FROM i a JOIN i b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 20 AND a.i GROUP BY 1, 2)
SELECT user_id, window_end_index, round(m, 6) AS mean_value FROM w WHERE c = 21""",
)
def complete_windows(spark, sf):
    """Every 97th epoch arrives two months late and fills its gap then."""
    late = F.when(F.col("epoch_index") % 97 == 5, F.col("ts") + F.expr("INTERVAL 60 DAYS")).otherwise(F.col("ts"))
    out = to_table(spark, user_rows(spark, sf).withColumn("ts", late), "windows", lambda s: jobs.windows_when_complete(s, ["user_id"]))
    return out.select("user_id", "window_end_index", r6("mean_value"))


@query(
    "str_04_recording_sessions",
    f"""WITH RECURSIVE {_EV}, e AS (SELECT device_id, event_id, sec, row_number() OVER (PARTITION BY device_id ORDER BY sec, event_id) AS rn FROM ev),
w AS (SELECT device_id, event_id, rn, sec AS st FROM e WHERE rn = 1 UNION ALL SELECT e.device_id, e.event_id, e.rn, CASE WHEN e.sec - w.st > 43200 THEN e.sec ELSE w.st END FROM w JOIN e ON e.device_id = w.device_id AND e.rn = w.rn + 1)
SELECT device_id, event_id, st AS recording_start FROM w""",
)
def session_stream(spark, sf):
    rows = events(spark, sf).select("device_id", "event_id", "sec", "ts")
    out = to_table(spark, rows, "sessions", lambda s: jobs.sessions(s.drop("ts"), ["device_id"]))
    return out.select("device_id", "event_id", "recording_start")


@query(
    "str_05_daily_rollup",
    f"""WITH {_EV} SELECT device_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS count, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean
FROM ev WHERE ts < TIMESTAMP '2024-01-30 00:00:00' AND ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2""",
)
def rollup(spark, sf):
    def transform(stream):
        return jobs.daily_rollup(jobs.with_event_time(stream, "ts", "1 hour"), ["device_id"], "ts", "value")

    latest = latest_batches(spark, events(spark, sf), "daily", transform, ["device_id", "day"])
    out = jobs.within_lookback(latest, F.lit("2024-01-30 12:00:00").cast("timestamp"), days=20)
    return out.select("device_id", F.col("day").cast("string").alias("day"), "count", F.round("sum", 4).alias("sum"), "min", "max", r6("mean"))


@query(
    "str_06_sync_status",
    f"WITH {_EV} SELECT device_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ingest, count(*) AS uploads FROM ev GROUP BY 1",
)
def sync(spark, sf):
    latest = latest_batches(spark, events(spark, sf), "status", lambda s: jobs.sync_status(s, ["device_id"], "ts"), ["device_id"])
    return latest.select("device_id", ts_text("last_ingest"), "uploads")


@query(
    "str_07_ingest_failure_rate",
    f"""WITH {_EV}, a AS (SELECT sec // 86400 * 86400 AS w, count(*) AS uploads, count(*) FILTER (WHERE event_type = 'error') AS failed FROM ev GROUP BY 1)
SELECT strftime(make_timestamp(w * 1000000), '%Y-%m-%d %H:%M:%S') AS period_start, uploads, failed, round(failed / uploads, 6) AS failure_rate, round(uploads / 86400, 6) AS uploads_per_second FROM a""",
)
def failures(spark, sf):
    def transform(stream):
        timed = jobs.with_event_time(stream, "ts", "1 hour").withColumn("ok", F.col("event_type") != "error")
        return jobs.ingest_failure_rate(timed, "ts", "1 day")

    latest = latest_batches(spark, events(spark, sf), "failures", transform, ["period_start"])
    return latest.select(ts_text("period_start"), "uploads", "failed", r6("failure_rate"), r6("uploads_per_second"))


@query(
    "str_08_periodic_audit",
    f"""WITH {_EV}, p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS n FROM ev), i AS (SELECT user_id, n + n // 25 AS i FROM p),
a AS (SELECT user_id, CAST(max(i) - min(i) + 1 - count(*) AS BIGINT) AS missing FROM i GROUP BY 1)
SELECT user_id, missing, CASE WHEN missing >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM a WHERE missing > 0""",
)
def audit(spark, sf):
    """Nights arrive over several batches; the latest report of a user counts."""
    rows, table, path = user_rows(spark, sf), scratch_path(spark, "audited-epochs"), scratch_path(spark, "audit")
    body = jobs.stored_report(table, path, ["user_id"], lambda stored: stat.missing_epochs(stored, ["user_id"], complete=True))
    checkpoint = scratch_path(spark, "audit-checkpoint")
    feed(spark, rows, "audit-source", lambda stream: jobs.run_batches(stream, body, checkpoint))
    out = spark.read.option("basePath", path).parquet(path).withColumn("age", -F.col("batch"))
    return first_per_key(out, ["user_id"], ["age"]).filter("missing > 0").select("user_id", "missing", "severity")
