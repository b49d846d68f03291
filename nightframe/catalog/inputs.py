"""Source and sink queries (SRC-01, 02, 07 .. 15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.catalog.base import query, r6
from nightframe.catalog.signals import KEY
from nightframe.catalog.views import EPOCHS, PREDS, RECS, SAMPLES, epochs, predictions, recordings, samples
from nightframe.catalog.windows import window_rows
from nightframe.operators.nights import positions
from nightframe.schema import FEATURES
from nightframe.session import scratch_path
from nightframe.sources import artifacts as art
from nightframe.sources import scans
from nightframe.sources import stage_text as text

_POS = "pos_v AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY epoch_index) - 1 AS INT) AS pos FROM preds_v)"
_CODE = "CASE ground_truth_stage WHEN 'W' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'REM' THEN 4 ELSE -1 END"


def round_trip(spark, sf, drop_unknown: bool):
    path = scratch_path(spark, "epochs-jsonl")
    scans.write_epochs_jsonl(epochs(spark, sf).withColumn("stage", F.expr(_CODE)), path, drop_unknown)
    return scans.read_epochs_jsonl(spark, path).select(
        "recording_id", "epoch_index", "stage", *[F.col(f"features.{f}").alias(f) for f in ("hr_mean", "dhr", "agree_flags")]
    )


_JSONL = f"SELECT CAST(recording_id AS VARCHAR) AS recording_id, epoch_index, {_CODE} AS stage, CAST(hr_mean AS DOUBLE) AS hr_mean, CAST(dhr AS DOUBLE) AS dhr, CAST(agree_flags AS DOUBLE) AS agree_flags FROM epochs_v"


@query("src_01_read_epochs_jsonl", f"WITH {EPOCHS} {_JSONL}")
def read_jsonl(spark, sf):
    return round_trip(spark, sf, False)


@query("src_02_write_epochs_jsonl", f"WITH {EPOCHS} {_JSONL} WHERE ground_truth_stage IS NOT NULL")
def write_jsonl(spark, sf):
    return round_trip(spark, sf, True)


_EVENT = "CASE k % 6 WHEN 0 THEN 'SLEEP-S0' WHEN 1 THEN 'SLEEP-S1' WHEN 2 THEN 'sleep-s2' WHEN 3 THEN 'SLEEP-S4' WHEN 4 THEN 'SLEEP-REM' ELSE 'MCAP-A1' END"


def stage_lines(spark, sf):
    """Scored-stage text lines in four delimiters."""
    df = positions(predictions(spark, sf), ["recording_id"])
    clock = F.concat_ws(":", F.lpad((F.col("pos") % 24).cast("string"), 2, "0"), F.lpad((F.col("k") % 60).cast("string"), 2, "0"), F.lpad((F.col("hr_mean") % 60).cast("string"), 2, "0"))
    dotted = F.replace(clock, F.lit(":"), F.lit("."))
    event = F.expr(_EVENT)
    line = (
        F.when(F.col("pos") % 4 == 0, F.concat(F.lit("R\tunknown\t"), clock, F.lit("\t"), event, F.lit("\t"), F.col("rr_mean"), F.lit("\tROC-LOC")))
        .when(F.col("pos") % 4 == 1, F.concat(F.lit('7,"a, b",'), event, F.lit(","), clock, F.lit(","), F.col("rr_mean")))
        .when(F.col("pos") % 4 == 2, F.concat(dotted, F.lit(";"), event, F.lit(";x;"), F.col("rr_mean"), F.lit(".5")))
        .otherwise(F.concat(F.lit("  "), event, F.lit("  "), clock, F.lit("   "), F.col("rr_mean")))
    )
    return df.select("recording_id", F.col("pos").alias("line_no"), line.alias("line"))


@query(
    "src_07_stage_events",
    f"""WITH {PREDS}, {_POS} SELECT recording_id, pos AS line_no, upper({_EVENT}) AS event, (pos % 24) * 3600 + (k % 60) * 60 + hr_mean % 60 AS clock_sec,
  CAST(rr_mean + CASE WHEN pos % 4 = 2 THEN 0.5 ELSE 0 END AS DOUBLE) AS duration_sec, CASE k % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END AS stage FROM pos_v WHERE k % 6 < 5""",
)
def stage_events(spark, sf):
    return text.parse_stage_events(stage_lines(spark, sf), ["recording_id"]).drop("clock")


@query(
    "src_08_isruc_stages",
    f"""WITH {PREDS}, {_POS}, l AS (SELECT recording_id, pos, k % 7 AS c FROM pos_v), bad AS (SELECT DISTINCT recording_id FROM l WHERE recording_id % 4 = 1 AND pos = 3 OR recording_id % 4 = 2 AND pos = 25)
SELECT recording_id, pos AS line_no, CASE c WHEN 5 THEN 4 WHEN 4 THEN -1 WHEN 6 THEN -1 ELSE c END AS stage, c IN (4, 6) AS unknown_code FROM l WHERE recording_id NOT IN (SELECT recording_id FROM bad)""",
)
def isruc(spark, sf):
    df = positions(predictions(spark, sf), ["recording_id"])
    quarter = F.col("recording_id") % 4
    broken = ((quarter == 1) & (F.col("pos") == 3)) | ((quarter == 2) & (F.col("pos") == 25))
    line = F.when(broken, "2 stage").otherwise(F.concat(F.lit(" "), (F.col("k") % 7).cast("string"), F.lit(".0 ")))
    lines = df.select("recording_id", F.col("pos").alias("line_no"), line.alias("line"))
    return text.parse_isruc(lines, ["recording_id"])


@query(
    "src_09_flash_unpack",
    f"""WITH {PREDS}, {_POS}, c AS (SELECT *, min(start_sec) OVER (PARTITION BY recording_id, pos // 20) + 30 * (pos % 20) AS at_sec FROM pos_v)
SELECT recording_id, at_sec AS start_sec, {', '.join(FEATURES)} FROM c""",
)
def flash(spark, sf):
    chunks = art.pack_flash_chunks(positions(predictions(spark, sf), ["recording_id"]), ["recording_id"], "pos")
    return art.unpack_flash_chunks(chunks, ["recording_id"])


@query(
    "src_10_pick_channel",
    f"WITH {SAMPLES} SELECT recording_id, channel, count(*) AS samples, sum(value) AS total FROM samples_v WHERE channel = CASE WHEN recording_id % 2 = 0 THEN 'resp' ELSE 'ecg' END GROUP BY ALL",
)
def pick_channel(spark, sf):
    df = samples(spark, sf)
    path = scratch_path(spark, "samples")
    df.select(F.col("recording_id").cast("string").alias("recording_id"), "channel", "sample_idx", "fs", "value").write.parquet(path)
    stored = scans.read_samples(spark, path)
    wanted = df.select("recording_id").distinct().select(
        F.col("recording_id").cast("string").alias("recording_id"), F.when(F.col("recording_id") % 2 == 0, "resp").otherwise("ecg").alias("channel")
    )
    out = stored.join(wanted, KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("total"))
    return out.withColumn("recording_id", F.col("recording_id").cast("bigint"))


@query(
    "src_11_hypnogram_pairs",
    f"""WITH {RECS} SELECT CAST(tenant_id AS VARCHAR) AS dir, 'n' || recording_id || CASE WHEN recording_id % 2 = 0 THEN '.rec' ELSE '.edf' END AS name,
  CASE WHEN recording_id % 2 = 0 AND recording_id % 3 = 0 THEN 'n' || recording_id || '_1.txt' WHEN recording_id % 2 = 0 AND recording_id % 3 = 1 THEN 'n' || recording_id || '_2.txt'
       WHEN recording_id % 5 <> 4 THEN 'n' || recording_id || '.csv' END AS hypnogram FROM recs_v""",
)
def pairs(spark, sf):
    stem = F.concat(F.lit("n"), F.col("recording_id"))
    names = F.array(
        F.concat(stem, F.when(F.col("recording_id") % 2 == 0, ".rec").otherwise(".edf")),
        F.when(F.col("recording_id") % 3 == 0, F.concat(stem, F.lit("_1.txt"))),
        F.when(F.col("recording_id") % 3 <= 1, F.concat(stem, F.lit("_2.txt"))),
        F.when(F.col("recording_id") % 5 != 4, F.concat(stem, F.lit(".csv"))),
        F.when(F.col("recording_id") % 5 != 4, F.concat(stem, F.lit(".cap"))),
    )
    files = recordings(spark, sf).select(F.col("tenant_id").cast("string").alias("dir"), F.explode(F.filter(names, lambda n: n.isNotNull())).alias("name"))
    return text.pair_hypnograms(files)


@query(
    "src_12_dataset_export",
    f"""WITH {PREDS}, w AS (SELECT a.recording_id, a.epoch_index, count(*) AS n, max(b.hr_mean) FILTER (WHERE b.epoch_index = a.epoch_index - 4) AS t0, max(b.hr_mean) FILTER (WHERE b.epoch_index = a.epoch_index) AS t4, max(b.drr) FILTER (WHERE b.epoch_index = a.epoch_index - 1) AS t3
  FROM preds_v a JOIN preds_v b ON a.recording_id = b.recording_id AND b.epoch_index BETWEEN a.epoch_index - 4 AND a.epoch_index WHERE a.epoch_index >= 4 GROUP BY 1, 2)
SELECT w.recording_id, p.true4 AS label, CASE WHEN w.recording_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CAST(t0 AS DOUBLE) AS t0_hr_mean, CAST(t3 AS DOUBLE) AS t3_drr, CAST(t4 AS DOUBLE) AS t4_hr_mean
FROM w JOIN preds_v p USING (recording_id, epoch_index) WHERE n = 5 AND p.true4 IS NOT NULL""",
)
def export(spark, sf):
    windows = window_rows(spark, sf, "reject", 5).filter(F.col("status") == "ok").select("recording_id", "epoch_index", "window", "window_end_ts")
    labels = predictions(spark, sf).filter(F.col("true4").isNotNull()).select("recording_id", "epoch_index", "dataset_id", F.col("true4").alias("label"))
    rows = windows.join(labels, ["recording_id", "epoch_index"]).withColumn("split", F.when(F.col("recording_id") % 4 == 0, "test").otherwise("train"))
    path = scratch_path(spark, "dataset")
    art.write_dataset(rows, path, 5)
    out = spark.read.parquet(path)
    return out.select("recording_id", "label", "split", *[F.col(c).cast("double").alias(c) for c in ("t0_hr_mean", "t3_drr", "t4_hr_mean")])


@query(
    "src_13_night_artifacts",
    f"""WITH {EPOCHS} SELECT CAST(recording_id AS BIGINT) AS night_id, count(*) AS n_epochs, count(*) FILTER (WHERE hr_mean > 45) AS valid_epochs, count(CASE WHEN k % 9 > 0 THEN 1 END) AS known_hr, CAST(sum({_CODE}) AS BIGINT) AS labels FROM epochs_v GROUP BY 1""",
)
def night_artifacts(spark, sf):
    df = epochs(spark, sf).withColumns(
        {"night_id": F.col("recording_id"), "stage": F.expr(_CODE), "valid": F.col("hr_mean") > 45}
    ).withColumn("hr_mean", F.when(F.col("k") % 9 == 0, 255).otherwise(F.col("hr_mean")))
    path = scratch_path(spark, "nights")
    art.write_night_artifacts(df, path)
    out = art.read_night_artifacts(spark, path, art.night_rows(df).schema, ["night_id", "valid_mask", "hr_mean", "label"])
    return out.groupBy(F.col("night_id").cast("bigint").alias("night_id")).agg(
        F.count(F.lit(1)).alias("n_epochs"), F.count_if("valid_mask").alias("valid_epochs"),
        F.count("hr_mean").alias("known_hr"), F.sum("label").alias("labels"),
    )


@query(
    "src_14_failure_quarantine",
    f"""WITH {RECS}, f AS (SELECT dataset_id, CASE WHEN n_epochs < 60 THEN 'E_ALIGN_MISMATCH' WHEN recording_id % 5 = 0 THEN 'E_QC_FAIL' END AS error_code FROM recs_v)
SELECT dataset_id, error_code, count(*) AS failures FROM f WHERE error_code IS NOT NULL GROUP BY ALL""",
)
def quarantine(spark, sf):
    recs = recordings(spark, sf).withColumn("source", F.col("recording_id").cast("string"))
    rules = {
        "E_ALIGN_MISMATCH": (F.col("n_epochs") < 60, "Signal length does not match"),
        "E_QC_FAIL": (F.col("recording_id") % 5 == 0, "Required channel failed QC"),
    }
    _, bad = art.split_failures(recs, rules)
    return bad.groupBy("dataset_id", "error_code").agg(F.count(F.lit(1)).alias("failures"))


@query(
    "src_15_training_index",
    f"WITH {PREDS} SELECT dataset_id, recording_id, count(*) AS n_epochs, round(avg(CASE WHEN hr_mean > 45 THEN 1.0 ELSE 0 END), 6) AS valid_ratio, 'nights/' || dataset_id || '/' || recording_id AS artifact_dir FROM preds_v GROUP BY ALL",
)
def training_index(spark, sf):
    df = predictions(spark, sf).withColumn("valid", F.col("hr_mean") > 45)
    path = scratch_path(spark, "index")
    art.write_training_index(art.training_index(df), path)
    return spark.read.parquet(f"{path}/parquet").withColumn("valid_ratio", r6("valid_ratio"))
