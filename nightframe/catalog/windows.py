"""Window, filter, join, set, top-k and scan queries (WIN, FLT, JON, SET, TOP, SRC-03..06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.catalog.base import big, i4, query, r6, ts_text
from nightframe.catalog.views import (
    BASE_SECONDS, EPOCHS, PREDS, RECS, epochs, feature_array, predictions, recordings,
)
from nightframe.functions.stages import annotation_code
from nightframe.operators import relations as rel
from nightframe.operators import windows as win
from nightframe.operators.nights import positions
from nightframe.schema import FEATURES, STAGES
from nightframe.sources import scans

REC = ["tenant_id", "recording_id"]
R = "tenant_id, recording_id"
HR = FEATURES.index("hr_mean")


def window_rows(spark, sf, padding: str, size: int):
    df = epochs(spark, sf).withColumn("features", feature_array())
    return win.build_windows(df, REC, window_size=size, padding=padding)


def window_digest(df):
    """Order-sensitive scalar digests of a window, comparable with SQL."""
    rows = F.transform("window", lambda row: F.element_at(row, HR + 1).cast("bigint"))
    weighted = F.aggregate(
        F.transform(rows, lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    total = F.aggregate(
        F.flatten("window"), F.lit(0.0), lambda a, x: a + x.cast("double")
    )
    return df.select(
        *REC, "start_index", "end_index", "padded", i4("present"), weighted.alias("hr_weighted"),
        total.alias("total"), ts_text("window_start_ts"), ts_text("window_end_ts"), "status",
    )


def _window_sql(size: int, padding: str) -> str:
    feats = " + ".join(FEATURES)
    keep = "WHERE e.epoch_index - {n} + 1 >= 0".format(n=size) if padding == "reject" else ""
    padded = "false" if padding == "reject" else f"count(p.epoch_index) < {size}"
    status = f"CASE WHEN count(p.epoch_index) < {size} THEN 'gap' ELSE 'ok' END" if padding == "reject" else "'ok'"
    weight = (
        f"p.hr_mean * (p.epoch_index - e.epoch_index + {size})"
        if padding == "zero_fill"
        else "p.hr_mean * p.rn"
    )
    return f"""WITH {EPOCHS},
j AS (SELECT e.tenant_id, e.recording_id, e.epoch_index AS ei, e.epoch_start_ts AS ts, p.epoch_index, p.hr_mean,
   p.{ " + p.".join(FEATURES) } AS feats,
   row_number() OVER (PARTITION BY e.recording_id, e.epoch_index ORDER BY p.epoch_index) AS rn
   FROM epochs_v e JOIN epochs_v p ON e.recording_id = p.recording_id AND p.epoch_index BETWEEN e.epoch_index - {size} + 1 AND e.epoch_index {keep}),
p AS (SELECT tenant_id, recording_id, ei, ts, count(*) AS present, CAST(sum({weight.replace('p.', '').replace('e.epoch_index', 'ei')}) AS BIGINT) AS hr_weighted, CAST(sum(feats) AS DOUBLE) AS total
   FROM j GROUP BY ALL)
SELECT {R}, ei - {size} + 1 AS start_index, ei AS end_index, {padded.replace('count(p.epoch_index)', 'present')} AS padded, CAST(present AS INT) AS present,
  hr_weighted, total, strftime(ts + INTERVAL '30' SECOND - INTERVAL '{30 * size}' SECOND, '%Y-%m-%d %H:%M:%S') AS window_start_ts,
  strftime(ts + INTERVAL '30' SECOND, '%Y-%m-%d %H:%M:%S') AS window_end_ts, {status.replace('count(p.epoch_index)', 'present')} AS status FROM p"""


@query("win_04_windows_zero_fill", _window_sql(21, "zero_fill"))
def windows_zero_fill(spark, sf):
    return window_digest(window_rows(spark, sf, "zero_fill", 21))


@query("win_04_windows_reject", _window_sql(5, "reject"))
def windows_reject(spark, sf):
    return window_digest(window_rows(spark, sf, "reject", 5))


_POS = f"pos_v AS (SELECT *, CAST(row_number() OVER (PARTITION BY {R} ORDER BY epoch_index) - 1 AS INT) AS pos FROM preds_v)"
_CODE = "CASE ground_truth_stage WHEN 'W' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'REM' THEN 4 END"


@query(
    "win_05_strided_windows",
    f"""WITH {PREDS}, {_POS}, s AS (SELECT *, {_CODE} AS code FROM pos_v),
j AS (SELECT a.recording_id, a.pos, count(*) AS n, sum(b.hr_mean * (b.pos - a.pos + 1)) AS hr_weighted, max(b.code) FILTER (WHERE b.pos = a.pos + 3) AS label
  FROM s a JOIN s b ON a.recording_id = b.recording_id AND b.pos BETWEEN a.pos AND a.pos + 6 WHERE a.pos % 3 = 0 GROUP BY 1, 2)
SELECT recording_id, pos, CAST(hr_weighted AS BIGINT) AS hr_weighted, label FROM j WHERE n = 7 AND label IS NOT NULL""",
)
def strided(spark, sf):
    df = positions(predictions(spark, sf), REC).withColumns(
        {"features": feature_array(), "code": F.expr(_CODE)}
    )
    out = win.strided_windows(df, REC, "features", "code", window_len=7, stride=3)
    rows = F.transform("window", lambda row, i: F.element_at(row, HR + 1).cast("bigint") * (i + 1))
    return out.select(
        "recording_id", "pos",
        F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hr_weighted"),
        F.element_at("labels", 1).alias("label"),
    )


@query(
    "win_06_latest_epochs",
    f"""WITH {EPOCHS}, r AS (SELECT {R}, epoch_index, CAST(row_number() OVER (PARTITION BY {R} ORDER BY epoch_index DESC) AS INT) AS recency FROM epochs_v)
SELECT * FROM r WHERE recency <= 21""",
)
def latest(spark, sf):
    return win.latest_epochs(epochs(spark, sf), REC).select(*REC, "epoch_index", "recency")


@query(
    "win_07_model_input_mean",
    f"""WITH {EPOCHS}, m AS (SELECT a.recording_id, a.epoch_index, count(*) AS n, sum(b.hr_mean) / 5.0 AS hr, sum(b.drr) / 5.0 AS drr
  FROM epochs_v a JOIN epochs_v b ON a.recording_id = b.recording_id AND b.epoch_index BETWEEN a.epoch_index - 4 AND a.epoch_index WHERE a.epoch_index >= 4 GROUP BY 1, 2)
SELECT recording_id, epoch_index, round(hr, 6)::DOUBLE AS hr, round(drr, 6)::DOUBLE + 0.0 AS drr FROM m WHERE n = 5""",
)
def model_input(spark, sf):
    w = window_rows(spark, sf, "reject", 5).filter(win.input_problem(F.col("window"), 5, len(FEATURES)).isNull())
    v = w.withColumn("v", win.model_input(F.col("window")))
    return v.select(
        "recording_id", "epoch_index", r6(F.col("v")[HR], "hr"), r6(F.col("v")[FEATURES.index("drr")], "drr")
    )


@query(
    "win_08_valid_mask",
    f"WITH {EPOCHS} SELECT {R}, epoch_index, ground_truth_stage IS NOT NULL AND hr_mean > 60 AS valid FROM epochs_v",
)
def valid(spark, sf):
    code = F.coalesce(F.expr(_CODE), F.lit(-1))
    return epochs(spark, sf).select(*REC, "epoch_index", win.valid_mask(code, F.col("hr_mean") > 60).alias("valid"))


@query(
    "win_09_daily_bucket",
    f"""WITH {EPOCHS} SELECT tenant_id, strftime(date_trunc('day', ingest_ts), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS epochs FROM epochs_v GROUP BY ALL""",
)
def daily(spark, sf):
    return (
        epochs(spark, sf).groupBy("tenant_id", win.day_bucket(F.col("ingest_ts")).alias("d"))
        .agg(F.count(F.lit(1)).alias("epochs")).select("tenant_id", ts_text("d", "day"), "epochs")
    )


_DEVICE = f"dev_v AS (SELECT recording_id, pos AS sec, hr_mean AS hr, rr_mean AS rr, k % 15 AS movement, (k % 40) / 40 AS vib_score, CAST(floor(pos / 7) AS INT) AS turnovers, CAST(floor(pos / 11) AS INT) AS apnea, k % 2 AS state FROM pos_v)"


@query(
    "win_01_device_epochs",
    f"""WITH {PREDS}, {_POS}, {_DEVICE},
a AS (SELECT recording_id, CAST(sec // 30 AS BIGINT) AS epoch_index, count(*) AS n, sum(hr) // count(*) AS hr_mean, sum(rr) // count(*) AS rr_mean,
  count(*) FILTER (WHERE hr > 40 AND hr < 180 AND rr > 8 AND rr < 30 AND movement < 10) * 100 // count(*) AS in_bed_pct,
  count(*) FILTER (WHERE vib_score > 0.8) * 100 // count(*) AS large_move_pct, count(*) FILTER (WHERE vib_score > 0.15 AND vib_score <= 0.8) * 100 // count(*) AS minor_move_pct,
  avg(vib_score) AS vib, max(turnovers) AS tu, max(apnea) AS ap, arg_max(state, sec) AS flags FROM dev_v GROUP BY 1, 2),
s AS (SELECT d.recording_id, a.epoch_index, floor(sqrt(avg(pow(hr - a.hr_mean, 2)))) AS hr_std FROM dev_v d JOIN a ON d.recording_id = a.recording_id AND d.sec // 30 = a.epoch_index GROUP BY 1, 2),
l AS (SELECT a.*, hr_std, lag(hr_mean, 1, 0) OVER w AS ph, lag(tu, 1, 0) OVER w AS pt FROM a JOIN s USING (recording_id, epoch_index) WINDOW w AS (PARTITION BY recording_id ORDER BY epoch_index))
SELECT recording_id, epoch_index, n, CAST(hr_mean AS BIGINT) AS hr_mean, CAST(rr_mean AS BIGINT) AS rr_mean, CAST(hr_std AS BIGINT) AS hr_std,
  CAST(least(greatest(hr_mean - ph, -128), 127) AS BIGINT) AS dhr, in_bed_pct, large_move_pct, minor_move_pct, CAST(least(large_move_pct + minor_move_pct, 100) AS BIGINT) AS vib_move_pct,
  CAST(least(greatest(100 - floor(vib * 20), 0), 100) AS BIGINT) AS vib_resp_q, CAST(greatest(tu - pt, 0) AS BIGINT) AS turnovers_delta,
  CAST((CASE WHEN flags > 0 AND least(large_move_pct + minor_move_pct, 100) > 20 THEN 1 ELSE 0 END) + (CASE WHEN in_bed_pct < 50 AND least(large_move_pct + minor_move_pct, 100) > 10 THEN 2 ELSE 0 END)
   + (CASE WHEN n < 20 THEN 4 ELSE 0 END) + (CASE WHEN n < 10 THEN 8 ELSE 0 END) AS BIGINT) AS agree_flags FROM l""",
)
def device_epochs(spark, sf):
    rows = positions(predictions(spark, sf), REC).select(
        "recording_id", F.col("pos").alias("sec"), F.col("hr_mean").alias("hr"), F.col("rr_mean").alias("rr"),
        (F.col("k") % 15).alias("movement"), ((F.col("k") % 40) / 40).alias("vib_score"),
        F.floor(F.col("pos") / 7).alias("turnovers"), F.floor(F.col("pos") / 11).alias("apnea"), (F.col("k") % 2).alias("state"),
    )
    out = win.device_epochs(rows, ["recording_id"])
    cols = ["n", "hr_mean", "rr_mean", "hr_std", "dhr", "in_bed_pct", "large_move_pct", "minor_move_pct", "vib_move_pct", "vib_resp_q", "turnovers_delta", "agree_flags"]
    return out.select("recording_id", "epoch_index", *[big(c) for c in cols])


_EVENTS_SQL = f"ev_v AS (SELECT recording_id, pos AS line_no, CAST((79200 + pos * 1500) % 86400 AS BIGINT) AS clock_sec, 30.0 * (k % 70) + CASE WHEN k % 10 = 3 THEN 7 ELSE 0 END AS duration_sec, k % 5 AS stage FROM pos_v)"


def stage_events(spark, sf):
    return positions(predictions(spark, sf), REC).select(
        "recording_id", F.col("pos").alias("line_no"),
        ((F.lit(79200) + F.col("pos") * 1500) % 86400).cast("bigint").alias("clock_sec"),
        (30.0 * (F.col("k") % 70) + F.when(F.col("k") % 10 == 3, 7).otherwise(0)).alias("duration_sec"),
        (F.col("k") % 5).alias("stage"),
    )


@query(
    "win_02_hypnogram",
    f"""WITH {PREDS}, {_POS}, {_EVENTS_SQL},
d AS (SELECT *, CASE WHEN clock_sec < lag(clock_sec) OVER (PARTITION BY recording_id ORDER BY line_no) THEN 1 ELSE 0 END AS back FROM ev_v),
a AS (SELECT *, clock_sec + 86400 * sum(back) OVER (PARTITION BY recording_id ORDER BY line_no) AS t FROM d),
v AS (SELECT * FROM a WHERE duration_sec > 0),
b AS (SELECT *, t - first_value(t) OVER (PARTITION BY recording_id ORDER BY line_no) AS rel FROM v),
p AS (SELECT recording_id, line_no, stage, CAST(round_even(rel / 30, 0) AS BIGINT) AS idx, CAST(greatest(1, round_even(duration_sec / 30, 0)) AS BIGINT) AS n, duration_sec % 30 <> 0 AS odd FROM b),
x AS (SELECT recording_id, line_no, stage, unnest(range(idx, idx + n)) AS epoch_index FROM p),
w AS (SELECT recording_id, epoch_index, arg_max(stage, line_no) AS stage FROM x GROUP BY 1, 2),
g AS (SELECT recording_id, unnest(range(max(idx + n))) AS epoch_index, max(odd) AS odd_duration FROM p GROUP BY recording_id)
SELECT g.recording_id, g.epoch_index, odd_duration, coalesce(stage, -1) AS stage FROM g LEFT JOIN w USING (recording_id, epoch_index)""",
)
def hypnogram(spark, sf):
    return win.hypnogram_from_events(stage_events(spark, sf), ["recording_id"])


_NOTE_STAGE = "CASE k % 6 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN -1 ELSE 3 END"
_NOTE_LABEL = "CASE k % 6 WHEN 0 THEN 'stage REM' WHEN 1 THEN 'wake' WHEN 2 THEN 'N1' WHEN 3 THEN 'N2' WHEN 4 THEN 'unscored' ELSE 'S3' END"


@query(
    "win_03_merge_annotations",
    f"""WITH {PREDS}, {_POS}, h AS (SELECT recording_id, pos AS epoch_index, coalesce({_CODE}, -1) AS stage FROM pos_v),
n AS (SELECT recording_id, pos * 45 AS onset, {_NOTE_LABEL} AS label, {_NOTE_STAGE} AS s, CAST(greatest(0, round_even(pos * 45 / 30, 0)) AS BIGINT) AS idx,
  CAST(greatest(1, round_even(greatest(k, 30) / 30, 0)) AS BIGINT) AS cnt FROM pos_v WHERE hr_mean < 70),
x AS (SELECT recording_id, onset, label, s, unnest(range(idx, idx + cnt)) AS epoch_index FROM n),
f AS (SELECT recording_id, epoch_index, arg_min(s, onset * 1000 + ord) AS first_s, min(onset * 1000 + ord) AS set_at FROM (SELECT *, CASE label WHEN 'N1' THEN 0 WHEN 'N2' THEN 1 WHEN 'S3' THEN 2 WHEN 'stage REM' THEN 3 WHEN 'unscored' THEN 4 ELSE 5 END AS ord FROM x) WHERE s <> -1 GROUP BY 1, 2),
m AS (SELECT h.*, CASE WHEN stage <> -1 THEN stage ELSE coalesce(first_s, -1) END AS fin, set_at FROM h LEFT JOIN f USING (recording_id, epoch_index)),
c AS (SELECT m.recording_id, m.epoch_index, bool_or(x.s <> m.fin AND (m.stage <> -1 OR x.s <> -1 OR (m.set_at IS NOT NULL AND x.onset * 1000 + 4 > m.set_at))) AS conflict
  FROM m JOIN x USING (recording_id, epoch_index) GROUP BY 1, 2)
SELECT m.recording_id, m.epoch_index, fin AS stage, coalesce(conflict, false) AS conflict FROM m LEFT JOIN c USING (recording_id, epoch_index)""",
)
def merge_notes(spark, sf):
    rows = positions(predictions(spark, sf), REC)
    hyp = rows.select("recording_id", F.col("pos").cast("int").alias("epoch_index"), F.coalesce(F.expr(_CODE), F.lit(-1)).alias("stage"))
    notes = rows.filter(F.col("hr_mean") < 70).select(
        "recording_id", (F.col("pos") * 45).alias("onset_sec"), F.col("k").alias("duration_sec"), F.expr(_NOTE_LABEL).alias("label"),
    ).withColumn("stage", annotation_code(F.col("label")))
    return win.merge_annotations(hyp, notes, ["recording_id"])


# --- filters ---------------------------------------------------------------
@query(
    "flt_01_prediction_filters",
    f"""WITH {PREDS} SELECT recording_id, end_sec, predicted_stage FROM preds_v WHERE tenant_id = 1 AND model_version = 'm1'
AND window_end_ts >= TIMESTAMP '2024-01-03 00:00:00' AND window_end_ts <= TIMESTAMP '2024-06-30 22:15:00'""",
)
def filters(spark, sf):
    f = rel.Filters(1, model_version="m1", from_ts="2024-01-03 00:00:00", to_ts="2024-06-30 22:15:00")
    return rel.apply_filters(predictions(spark, sf), f).select("recording_id", "end_sec", "predicted_stage")


@query(
    "flt_02_recordings_in_scope",
    f"WITH {RECS} SELECT recording_id, epoch_index FROM preds_v WHERE recording_id IN (SELECT recording_id FROM recs_v WHERE n_epochs >= 60)",
)
def in_scope(spark, sf):
    scope = recordings(spark, sf).filter(F.col("n_epochs") >= 60)
    return rel.in_scope(predictions(spark, sf), scope, ["recording_id"]).select("recording_id", "epoch_index")


def with_schema(df):
    return df.withColumn(
        "feature_schema_version", F.when(F.col("k") % 19 == 0, "v0").otherwise("v1")
    )


@query(
    "flt_03_schema_violations",
    f"WITH {EPOCHS} SELECT recording_id, epoch_index FROM epochs_v WHERE k % 19 = 0",
)
def schema_violations(spark, sf):
    return rel.schema_violations(with_schema(epochs(spark, sf)), "v1").select("recording_id", "epoch_index")


@query(
    "flt_04_finite_vectors",
    f"WITH {EPOCHS} SELECT recording_id, epoch_index FROM epochs_v WHERE k % 23 <> 0 AND k % 29 <> 0",
)
def finite(spark, sf):
    x = F.when(F.col("k") % 23 == 0, float("nan")).when(F.col("k") % 29 == 0, float("inf")).otherwise(F.col("value"))
    df = epochs(spark, sf).withColumn("v", F.array(F.lit(1.0), x))
    return rel.finite_vectors(df, "v").select("recording_id", "epoch_index")


def rules():
    return {
        "in_bed_pct": F.col("in_bed_pct").between(0, 90),
        "hr_mean": F.col("hr_mean").between(0, 130),
        "dhr": F.col("dhr").between(-9, 9),
        "truth_domain": F.col("ground_truth_stage").isin("W", "N1", "N2", "REM"),
    }


@query(
    "flt_05_constraint_report",
    f"""WITH {EPOCHS}, c AS (SELECT tenant_id, count(*) AS rows, count(*) FILTER (WHERE in_bed_pct > 90) AS a, count(*) FILTER (WHERE hr_mean > 130) AS b,
  count(*) FILTER (WHERE dhr NOT BETWEEN -9 AND 9) AS c, count(*) FILTER (WHERE ground_truth_stage = 'N3') AS d FROM epochs_v GROUP BY 1)
SELECT tenant_id, rows, unnest(['in_bed_pct', 'hr_mean', 'dhr', 'truth_domain']) AS rule, unnest([a, b, c, d]) AS violations FROM c""",
)
def constraints(spark, sf):
    return rel.constraint_report(epochs(spark, sf), rules(), ["tenant_id"])


@query(
    "flt_05_duplicate_keys",
    f"WITH {EPOCHS} SELECT recording_id, hr_mean, count(*) AS copies FROM epochs_v GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicates(spark, sf):
    return rel.duplicate_keys(epochs(spark, sf), ["recording_id", "hr_mean"])


# --- joins -----------------------------------------------------------------
@query(
    "jon_01_epochs_recordings",
    f"WITH {RECS} SELECT e.recording_id, e.epoch_index, e.start_sec - r.start_sec AS offset_sec, r.n_epochs FROM epochs_v e JOIN recs_v r ON e.recording_id = r.recording_id AND e.tenant_id = r.tenant_id",
)
def epochs_recordings(spark, sf):
    recs = recordings(spark, sf).select(*REC, F.col("start_sec").alias("rec_start"), "n_epochs")
    return rel.with_dimension(epochs(spark, sf), recs, REC).select(
        "recording_id", "epoch_index", (F.col("start_sec") - F.col("rec_start")).alias("offset_sec"), "n_epochs"
    )


def devices(spark, sf):
    """Devices 0..3 with their dataset; device 4 is not registered."""
    return recordings(spark, sf).filter(F.col("device_id") < 4).select("device_id", "dataset_id").distinct()


@query(
    "jon_02_devices_left_outer",
    f"WITH {PREDS} SELECT recording_id, epoch_index, CASE WHEN device_id < 4 THEN dataset_id ELSE 'UNKNOWN' END AS dataset_id FROM preds_v",
)
def left_devices(spark, sf):
    out = rel.with_dimension(epochs(spark, sf), devices(spark, sf), ["device_id"], "left")
    return out.select("recording_id", "epoch_index", F.coalesce("dataset_id", F.lit("UNKNOWN")).alias("dataset_id"))


@query(
    "jon_04_ground_truth_lookup",
    f"WITH {PREDS} SELECT recording_id, end_sec, predicted_stage, ground_truth_stage AS truth FROM preds_v",
)
def truth_lookup(spark, sf):
    df = predictions(spark, sf)
    truth = df.filter(F.col("ground_truth_stage").isNotNull()).select(*REC, "end_sec", F.col("ground_truth_stage").alias("truth"))
    return rel.attach_truth(df.select(*REC, "end_sec", "predicted_stage"), truth, [*REC, "end_sec"], "truth").drop("tenant_id")


@query(
    "jon_05_orphan_predictions",
    f"WITH {RECS} SELECT recording_id, epoch_index FROM preds_v p WHERE NOT EXISTS (SELECT 1 FROM recs_v r WHERE r.recording_id = p.recording_id AND r.n_epochs >= 60)",
)
def orphan_predictions(spark, sf):
    known = recordings(spark, sf).filter(F.col("n_epochs") >= 60)
    return rel.orphans(predictions(spark, sf), known, REC).select("recording_id", "epoch_index")


@query(
    "jon_06_device_day_join",
    f"""WITH {RECS} SELECT r.device_id, strftime(date_trunc('day', e.ingest_ts), '%Y-%m-%d') AS day, count(*) AS epochs FROM epochs_v e
JOIN recs_v r ON r.recording_id = e.recording_id AND r.tenant_id = e.tenant_id GROUP BY ALL""",
)
def device_days(spark, sf):
    df = epochs(spark, sf).drop("device_id")
    out = rel.with_dimension(df, recordings(spark, sf).select(*REC, "device_id"), REC)
    return out.groupBy("device_id", F.date_format("ingest_ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("epochs"))


@query(
    "jon_07_overlap_groups",
    f"""WITH {RECS}, t AS (SELECT recording_id, CASE WHEN recording_id % 11 = 0 THEN NULL ELSE recording_id * 2000 + 1 END AS s, recording_id * 2000 + n_epochs * 30 AS e FROM recs_v),
o AS (SELECT *, max(e) OVER (ORDER BY s, recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t WHERE s IS NOT NULL)
SELECT recording_id, CAST(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, recording_id) AS BIGINT) AS time_group FROM o
UNION ALL SELECT recording_id, 0 FROM t WHERE s IS NULL""",
)
def overlap(spark, sf):
    recs = recordings(spark, sf).select(
        "recording_id",
        F.when(F.col("recording_id") % 11 != 0, F.col("recording_id") * 2000 + 1).alias("s"),
        (F.col("recording_id") * 2000 + F.col("n_epochs") * 30).alias("e"),
    )
    return rel.overlap_groups(recs, "recording_id", "s", "e").select(
        "recording_id", F.coalesce("time_group", F.lit(0).cast("bigint")).alias("time_group")
    )


@query(
    "jon_11_latest_ingest_by_user",
    f"WITH {PREDS} SELECT tenant_id, device_id, strftime(max(ingest_ts), '%Y-%m-%d %H:%M:%S') AS last_ingest, max(end_sec) AS last_prediction_sec FROM preds_v GROUP BY ALL",
)
def latest_ingest(spark, sf):
    return predictions(spark, sf).groupBy("tenant_id", "device_id").agg(
        ts_text(F.max("ingest_ts"), "last_ingest"), F.max("end_sec").alias("last_prediction_sec")
    )


# --- sets and top-k --------------------------------------------------------
@query(
    "set_01_label_union",
    f"""WITH {PREDS}, u AS (SELECT dataset_id, pred4 AS l FROM preds_v UNION SELECT dataset_id, true4 FROM preds_v WHERE true4 IS NOT NULL)
SELECT dataset_id, 'REM,N9' || coalesce(',' || string_agg(l, ',' ORDER BY l) FILTER (WHERE l <> 'REM'), '') AS labels FROM u GROUP BY 1""",
)
def label_union(spark, sf):
    df = predictions(spark, sf)
    union = df.select("dataset_id", F.col("pred4").alias("l")).union(df.select("dataset_id", "true4").filter(F.col("true4").isNotNull())).distinct()
    found = union.groupBy("dataset_id").agg(F.collect_set("l").alias("ls"))
    return found.select("dataset_id", F.array_join(rel.merge_labels(F.array(F.lit("REM"), F.lit("N9")), F.col("ls")), ",").alias("labels"))


@query(
    "set_03_feature_differences",
    f"""WITH {EPOCHS} SELECT recording_id, epoch_index, CASE WHEN k % 2 = 0 THEN 'emg' ELSE '' END AS removed, CASE WHEN k % 3 = 0 THEN 'eog,spo2' ELSE 'spo2' END AS added FROM epochs_v""",
)
def feature_differences(spark, sf):
    old = F.when(F.col("k") % 2 == 0, F.array(F.lit("hr"), F.lit("emg"))).otherwise(F.array(F.lit("hr")))
    new = F.when(F.col("k") % 3 == 0, F.array(F.lit("spo2"), F.lit("hr"), F.lit("eog"))).otherwise(F.array(F.lit("hr"), F.lit("spo2")))
    return epochs(spark, sf).select(
        "recording_id", "epoch_index",
        F.array_join(F.array_sort(F.array_except(old, new)), ",").alias("removed"),
        F.array_join(F.array_sort(F.array_except(new, old)), ",").alias("added"),
    )


@query(
    "set_05_union_datasets",
    f"WITH {PREDS} SELECT dataset_id, recording_id, epoch_index FROM preds_v WHERE dataset_id IN ('DODH', 'CAP', 'ISRUC')",
)
def union_datasets(spark, sf):
    df = predictions(spark, sf).select("dataset_id", "recording_id", "epoch_index")
    parts = [df.filter(F.col("dataset_id") == d) for d in ("DODH", "CAP", "ISRUC")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "top_01_latest_recording",
    f"""WITH {RECS}, r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY start_sec DESC, recording_id DESC) AS rn FROM recs_v)
SELECT tenant_id, recording_id, start_sec FROM r WHERE rn = 1""",
)
def latest_recording(spark, sf):
    return rel.latest_by(recordings(spark, sf), ["tenant_id"], ["start_sec", "recording_id"], ["recording_id", "start_sec"])


@query(
    "top_03_bounded_issues",
    f"""WITH {PREDS}, g AS (SELECT tenant_id, recording_id, end_sec, end_sec - lag(end_sec) OVER (PARTITION BY recording_id ORDER BY epoch_index) AS delta FROM preds_v),
r AS (SELECT tenant_id, recording_id, end_sec, row_number() OVER (PARTITION BY tenant_id ORDER BY recording_id, end_sec) AS rn FROM g WHERE delta > 30)
SELECT tenant_id, recording_id, end_sec FROM r WHERE rn <= 500""",
)
def bounded(spark, sf):
    from nightframe.operators.sequences import window_gaps

    gaps = window_gaps(predictions(spark, sf), REC).select(*REC, "end_sec")
    return rel.bounded_issues(gaps, ["tenant_id"], [F.col("recording_id"), F.col("end_sec")], 500)


# --- scans -----------------------------------------------------------------
@query(
    "src_03_scan_epochs",
    f"""WITH {RECS} SELECT e.recording_id, e.epoch_index, e.hr_mean, r.device_id, r.dataset_id FROM epochs_v e JOIN recs_v r ON r.recording_id = e.recording_id
WHERE e.tenant_id = 2 AND e.epoch_start_ts >= TIMESTAMP '2024-01-02 00:00:00' AND e.epoch_start_ts <= TIMESTAMP '2024-12-31 22:10:00'""",
)
def scan_epochs(spark, sf):
    f = rel.Filters(2, from_ts="2024-01-02 00:00:00", to_ts="2024-12-31 22:10:00")
    recs = recordings(spark, sf).select(*REC, "device_id", "dataset_id")
    return scans.scan_epochs(epochs(spark, sf), recs, f, ["epoch_index", "hr_mean"]).drop("tenant_id")


@query(
    "src_04_scan_predictions",
    f"WITH {PREDS} SELECT tenant_id, recording_id, end_sec, predicted_stage, round(confidence, 6) AS confidence FROM preds_v WHERE tenant_id = 0 AND device_id = 3 AND model_version = 'm1'",
)
def scan_predictions(spark, sf):
    f = rel.Filters(0, device_id=3, model_version="m1")
    return scans.scan_predictions(predictions(spark, sf), f, ["end_sec", "predicted_stage", "confidence"]).withColumn("confidence", r6("confidence"))


@query(
    "src_05_epochs_between",
    f"WITH {EPOCHS} SELECT epoch_index, hr_mean FROM epochs_v WHERE recording_id = 7 AND start_sec BETWEEN {BASE_SECONDS + 7 * 86400 + 300} AND {BASE_SECONDS + 7 * 86400 + 1200}",
)
def epochs_between(spark, sf):
    low, high = F.lit(BASE_SECONDS + 7 * 86400 + 300), F.lit(BASE_SECONDS + 7 * 86400 + 1200)
    return scans.between(epochs(spark, sf), 7, low, high, "start_sec", ["epoch_index"]).select("epoch_index", "hr_mean")


@query(
    "src_06_list_recordings",
    f"WITH {RECS} SELECT recording_id, start_sec FROM recs_v WHERE tenant_id = 1 AND device_id = 2",
)
def list_recordings(spark, sf):
    recs = recordings(spark, sf).withColumn("started_at", F.timestamp_seconds("start_sec"))
    return scans.list_recordings(recs, rel.Filters(1, device_id=2)).select("recording_id", "start_sec")
