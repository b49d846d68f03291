"""The engine's input tables derived from the driver tables (see FIXTURES.md).

``epochs``, ``predictions``, ``recordings`` and ``samples`` are built with
DataFrame operators; ``EPOCHS``, ``PREDS`` and ``SAMPLES`` are the same views as
common table expressions for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.operators.ordered import BLOCK, running_totals, wide_blocks, with_position
from nightframe.schema import CLASSES, DATASETS, FEATURES

BASE_SECONDS = 1704146400  # 2024-01-01 22:00:00 UTC, start of the first night

# Feature values as functions of the event's number k and value v; the same
# text is valid in both SQL dialects.
FEATURE_SQL = {
    "in_bed_pct": "(k * 7) % 101",
    "hr_mean": "40 + CAST(floor(value) AS INT) % 100",
    "hr_std": "k % 12",
    "dhr": "k % 21 - 10",
    "rr_mean": "8 + k % 22",
    "rr_std": "k % 5",
    "drr": "k % 7 - 3",
    "large_move_pct": "k % 13",
    "minor_move_pct": "k % 29",
    "turnovers_delta": "k % 3",
    "apnea_delta": "k % 4",
    "flags": "k % 64",
    "vib_move_pct": "k % 50",
    "vib_resp_q": "CAST(floor(value) AS INT) % 100",
    "agree_flags": "k % 8",
}
_FEATURE_SELECT = ",\n       ".join(
    f"CAST({sql} AS INT) AS {name}" for name, sql in FEATURE_SQL.items()
)

_TYPE_STAGE = (
    "CASE event_type WHEN 'click' THEN 'W' WHEN 'view' THEN 'N1' WHEN 'error' THEN 'N2' "
    "WHEN 'signup' THEN 'N3' ELSE 'REM' END"
)
_TRUTH = (
    "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 5 = 0 THEN 'W' WHEN k % 5 = 1 THEN 'N1' "
    "WHEN k % 5 = 2 THEN 'N2' WHEN k % 5 = 3 THEN 'N3' ELSE 'REM' END"
)
_FOUR = "CASE {c} WHEN 'W' THEN 'W' WHEN 'N1' THEN 'Light' WHEN 'N2' THEN 'Light' WHEN 'N3' THEN 'Deep' WHEN 'REM' THEN 'REM' END"

EPOCHS = f"""
n_v AS (
  SELECT user_id, event_id, event_type, value, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1
              + sum(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS epoch_index
  FROM events),
s_v AS (SELECT *, {_TYPE_STAGE} AS type_stage, {_TRUTH} AS ground_truth_stage FROM n_v),
epochs_v AS (
  SELECT CAST(user_id % 3 AS INT) AS tenant_id, user_id AS recording_id,
         CAST(user_id % 5 AS INT) AS device_id, epoch_index,
         CAST({BASE_SECONDS} + user_id * 86400 + epoch_index * 30 AS BIGINT) AS start_sec,
         TIMESTAMP '2024-01-01 22:00:00' + (user_id * 86400 + epoch_index * 30) * INTERVAL '1' SECOND AS epoch_start_ts,
         event_id, ts AS ingest_ts, k, value, type_stage,
         CASE WHEN event_id % 3 = 0 AND ground_truth_stage IS NOT NULL
              THEN ground_truth_stage ELSE type_stage END AS predicted_stage,
         ground_truth_stage,
         0.25 + 0.75 * CAST((event_id * 37 + k) % 100 AS DOUBLE) / 100 AS confidence,
         {_FEATURE_SELECT}
  FROM s_v)"""

_PROBS = ",\n         ".join(
    f"CASE WHEN pred4 = '{c}' THEN confidence ELSE (1 - confidence) / 3 END AS p_{c.lower()}"
    for c in CLASSES
)
PREDS = (
    EPOCHS
    + f""",
p4_v AS (
  SELECT *, start_sec + 30 AS end_sec, epoch_start_ts + INTERVAL '30' SECOND AS window_end_ts,
         {_FOUR.format(c="predicted_stage")} AS pred4, {_FOUR.format(c="ground_truth_stage")} AS true4,
         CASE device_id WHEN 0 THEN 'DODH' WHEN 1 THEN 'CAP' WHEN 2 THEN 'ISRUC' WHEN 3 THEN 'SLEEP-EDF' ELSE 'UNKNOWN' END AS dataset_id,
         'm' || CAST(device_id % 2 AS VARCHAR) AS model_version
  FROM epochs_v),
preds_v AS (SELECT *,
         {_PROBS}
  FROM p4_v)"""
)

RECS = (
    PREDS
    + """,
recs_v AS (
  SELECT tenant_id, recording_id, device_id, dataset_id, min(start_sec) AS start_sec, max(start_sec) + 30 AS end_sec,
         count(*) AS n_epochs
  FROM preds_v GROUP BY tenant_id, recording_id, device_id, dataset_id)"""
)

SAMPLES = """
samples_v AS (
  SELECT l_suppkey AS recording_id,
         CASE WHEN l_linenumber % 2 = 0 THEN 'resp' ELSE 'ecg' END AS channel,
         CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 2
                                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS sample_idx,
         CAST(1.0 AS DOUBLE) AS fs,
         l_quantity - 25 AS value
  FROM lineitem)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One night per user; event order gives the epoch index, with gaps."""
    events = read(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "event_type",
        "value",
        "ts",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"),
    )
    known = events.filter(F.col("user_id").isNotNull())
    numbered = running_totals(
        wide_blocks(known, ["user_id"], F.floor(F.col("_us") / 3_600_000_000)),
        ["user_id"],
        ["_us", "event_id"],
        BLOCK,
        {
            "_n": F.lit(1),
            "_skips": F.when(F.col("event_id") % 17 == 0, 1).otherwise(0),
        },
    ).filter(F.col("_us").isNotNull()).withColumn("epoch_index", (F.col("_n") - 1 + F.col("_skips")).cast("int"))
    staged = numbered.withColumns(
        {"type_stage": F.expr(_TYPE_STAGE), "ground_truth_stage": F.expr(_TRUTH)}
    )
    start = (
        F.lit(BASE_SECONDS) + F.col("user_id") * 86400 + F.col("epoch_index") * 30
    ).cast("bigint")
    return staged.select(
        (F.col("user_id") % 3).cast("int").alias("tenant_id"),
        F.col("user_id").alias("recording_id"),
        (F.col("user_id") % 5).cast("int").alias("device_id"),
        "epoch_index",
        start.alias("start_sec"),
        F.timestamp_seconds(start).alias("epoch_start_ts"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ingest_ts"),
        "k",
        "value",
        "type_stage",
        F.when(
            (F.col("event_id") % 3 == 0) & F.col("ground_truth_stage").isNotNull(),
            F.col("ground_truth_stage"),
        )
        .otherwise(F.col("type_stage"))
        .alias("predicted_stage"),
        "ground_truth_stage",
        (
            F.lit(0.25)
            + F.lit(0.75) * ((F.col("event_id") * 37 + F.col("k")) % 100).cast("double") / 100
        ).alias("confidence"),
        *[F.expr(f"CAST({sql} AS INT)").alias(name) for name, sql in FEATURE_SQL.items()],
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per epoch with four-class labels and probabilities."""
    base = epochs(spark, sf_dir).withColumns(
        {
            "end_sec": F.col("start_sec") + 30,
            "window_end_ts": F.col("epoch_start_ts") + F.expr("INTERVAL 30 SECONDS"),
            "pred4": F.expr(_FOUR.format(c="predicted_stage")),
            "true4": F.expr(_FOUR.format(c="ground_truth_stage")),
            "dataset_id": F.element_at(
                F.array(*[F.lit(d) for d in DATASETS]), F.col("device_id") + 1
            ),
            "model_version": F.concat(F.lit("m"), (F.col("device_id") % 2).cast("string")),
        }
    )
    return base.withColumns(
        {
            f"p_{c.lower()}": F.when(F.col("pred4") == c, F.col("confidence")).otherwise(
                (1 - F.col("confidence")) / 3
            )
            for c in CLASSES
        }
    ).withColumn("probabilities", F.array(*[F.col(f"p_{c.lower()}") for c in CLASSES]))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        predictions(spark, sf_dir)
        .groupBy("tenant_id", "recording_id", "device_id", "dataset_id")
        .agg(
            F.min("start_sec").alias("start_sec"),
            (F.max("start_sec") + 30).alias("end_sec"),
            F.count(F.lit(1)).alias("n_epochs"),
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-format 1 Hz signal, one channel per parity of line number."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("recording_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "resp").otherwise("ecg").alias("channel"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        (F.col("l_quantity") - 25).alias("value"),
    )
    known = lines.filter(F.col("recording_id").isNotNull())
    numbered = with_position(
        wide_blocks(known, ["recording_id", "channel"], F.floor(F.col("l_orderkey") / 8192)),
        ["recording_id", "channel"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        BLOCK,
        "sample_idx",
    )
    return numbered.select(
        "recording_id",
        "channel",
        F.col("sample_idx").cast("bigint").alias("sample_idx"),
        F.lit(1.0).alias("fs"),
        "value",
    )


def feature_array(dtype: str = "float"):
    return F.array(*[F.col(f).cast(dtype) for f in FEATURES])
