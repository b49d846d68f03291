"""Statistics, audit, drift, scoring and ingest queries (AGG-17..37, DRF, FST, MOD, UPS, SES, RET)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.catalog.base import big, i4, query, r6, ts_text
from nightframe.catalog.evaluation import CLIN_SQL, R, REC, class_sql, counts_sql, scores_sql
from nightframe.catalog.expressions import BIAS, LOGIT_SQL, WEIGHTS, logits
from nightframe.catalog.views import BASE_SECONDS, EPOCHS, PREDS, RECS, epochs, feature_array, predictions, read, recordings
from nightframe.catalog.windows import window_rows, with_schema
from nightframe.functions.numeric import unpivot_features
from nightframe.operators import decoding
from nightframe.operators import drift as dr
from nightframe.operators import ingest as ing
from nightframe.operators import relations as rel
from nightframe.operators import scoring as sc
from nightframe.operators import sequences as sq
from nightframe.operators import statistics as stat
from nightframe.plans import scorecard as card
from nightframe.schema import CLASSES, FEATURES
from nightframe.session import cut_lineage

_UNP = f"u_v AS (SELECT tenant_id, recording_id, strftime(ingest_ts, '%Y-%m-%d') AS day, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, CAST(unnest([{', '.join(FEATURES)}]) AS DOUBLE) AS value, k FROM epochs_v)"


def feature_rows(spark, sf):
    df = epochs(spark, sf).withColumn("day", F.date_format("ingest_ts", "yyyy-MM-dd"))
    df = cut_lineage(df.select("tenant_id", "recording_id", "day", "k", *FEATURES), "features")  # read by several aggregates
    return unpivot_features(df, ["tenant_id", "recording_id", "day", "k"], FEATURES)


_STATS = """count(*) AS count, CAST(sum(value) AS DOUBLE) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90"""
_STAT_COLS = ["mean", "std", "p10", "p50", "p90"]


@query("agg_17_daily_feature_stats", f"WITH {EPOCHS}, {_UNP} SELECT tenant_id, day, feature, {_STATS} FROM u_v GROUP BY tenant_id, day, feature")
def daily_stats(spark, sf):
    out = stat.daily_feature_stats(feature_rows(spark, sf), ["tenant_id", "day", "feature"])
    return out.select("tenant_id", "day", "feature", "count", "sum", "min", "max", *[r6(c) for c in _STAT_COLS])


@query(
    "agg_18_merged_feature_stats",
    f"""WITH {EPOCHS}, {_UNP}, p AS (SELECT tenant_id, feature, k % 2 AS part, count(*) AS n, sum(value) AS s, sum(value * value) AS q, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS p50 FROM u_v GROUP BY 1, 2, 3)
SELECT tenant_id, feature, CAST(sum(n) AS BIGINT) AS count, sum(s) AS sum, min(lo) AS min, max(hi) AS max, round(sum(s) / sum(n), 6) AS mean,
  round(sqrt(sum(q) / sum(n) - pow(sum(s) / sum(n), 2)), 6) AS std, round(sum(p50 * n) / sum(n), 6) AS p50 FROM p GROUP BY 1, 2""",
)
def merged_stats(spark, sf):
    rows = feature_rows(spark, sf).withColumn("part", F.col("k") % 2)
    partial = stat.daily_feature_stats(rows, ["tenant_id", "feature", "part"])
    out = stat.merge_feature_stats(partial, ["tenant_id", "feature"])
    return out.select("tenant_id", "feature", "count", "sum", "min", "max", r6("mean"), r6("std"), r6("p50"))


@query(
    "agg_19_recording_days",
    f"WITH {PREDS} SELECT tenant_id, recording_id, strftime(window_end_ts, '%Y-%m-%d') AS day, count(*) AS predictions, round(avg(confidence), 6) AS avg_confidence FROM preds_v GROUP BY ALL",
)
def recording_days(spark, sf):
    return stat.recording_days(predictions(spark, sf), "window_end_ts").select(*REC, F.col("day").cast("string").alias("day"), "predictions", r6("avg_confidence"))


@query(
    "agg_20_device_days",
    f"WITH {EPOCHS} SELECT tenant_id, device_id, strftime(epoch_start_ts, '%Y-%m-%d') AS day, count(*) AS epochs FROM epochs_v GROUP BY ALL",
)
def device_days(spark, sf):
    out = stat.device_days(epochs(spark, sf).drop("device_id"), recordings(spark, sf), "epoch_start_ts")
    return out.withColumn("day", F.col("day").cast("string"))


USAGE = """use_v AS (SELECT o_orderkey AS batch_id, o_orderpriority AS model_version, CAST(epoch(o_orderdate) AS BIGINT) AS window_start_sec, CAST(epoch(o_orderdate) AS BIGINT) + 60 AS window_end_sec,
  CAST(o_custkey % 97 AS BIGINT) AS prediction_count, CAST(o_totalprice AS DOUBLE) / 1000 AS average_latency_ms FROM orders)"""


def usage(spark, sf):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_orderpriority").alias("model_version"),
        start.alias("window_start_sec"), (start + 60).alias("window_end_sec"),
        (F.col("o_custkey") % 97).alias("prediction_count"), (F.col("o_totalprice") / 1000).alias("average_latency_ms"),
    )


@query(
    "agg_21_model_usage",
    f"""WITH {USAGE} SELECT model_version, CAST(sum(prediction_count) AS BIGINT) AS prediction_count, min(window_start_sec) AS window_start_sec, max(window_end_sec) AS window_end_sec,
  round(sum(prediction_count * average_latency_ms) / sum(prediction_count), 6) AS average_latency_ms FROM use_v GROUP BY 1""",
)
def model_usage(spark, sf):
    return stat.usage_by_model(usage(spark, sf)).withColumn("average_latency_ms", r6("average_latency_ms"))


_LATEST = "l AS (SELECT * FROM use_v ORDER BY window_end_sec DESC, batch_id DESC LIMIT 200)"


def latest_usage(spark, sf):
    return rel.latest_rows(usage(spark, sf), [F.desc("window_end_sec"), F.desc("batch_id")], 200)


_SNAPSHOT = f"""{USAGE}, {_LATEST}, a AS (SELECT count(*) AS sample_size, CAST(sum(prediction_count) AS BIGINT) AS prediction_count, sum(prediction_count * average_latency_ms) / sum(prediction_count) AS lat, list_sort(list(average_latency_ms)) AS ls FROM l),
snap AS (SELECT sample_size, prediction_count, round(lat, 6) AS average_latency_ms, round(ls[1 + CAST(floor(0.95 * (sample_size - 1)) AS INT)], 6) AS p95_latency_ms, round(ls[1 + CAST(floor(0.99 * (sample_size - 1)) AS INT)], 6) AS p99_latency_ms FROM a)"""


@query("agg_22_latency_snapshot", f"WITH {_SNAPSHOT} SELECT * FROM snap")
def latency(spark, sf):
    out = stat.latency_snapshot(latest_usage(spark, sf))
    return out.select("sample_size", "prediction_count", *[r6(c) for c in ("average_latency_ms", "p95_latency_ms", "p99_latency_ms")])


@query(
    "agg_23_write_rate",
    f"""WITH {PREDS}, l AS (SELECT CAST(epoch(date_trunc('second', ingest_ts)) AS BIGINT) AS s FROM preds_v ORDER BY ingest_ts DESC, event_id DESC LIMIT 300)
SELECT count(*) AS sample_size, CAST(max(s) - min(s) AS DOUBLE) AS window_seconds, round(count(*) / (max(s) - min(s)), 6) AS writes_per_sec FROM l""",
)
def write_rate(spark, sf):
    latest = rel.latest_rows(predictions(spark, sf).select("ingest_ts", "event_id"), [F.desc("ingest_ts"), F.desc("event_id")], 300)
    out = stat.write_rate(latest.select(F.unix_seconds("ingest_ts").alias("s")), "s")
    return out.select("sample_size", "window_seconds", r6("writes_per_sec"))


@query("top_02_latest_usage", f"WITH {USAGE}, {_LATEST} SELECT batch_id, model_version, window_end_sec FROM l")
def top_usage(spark, sf):
    return latest_usage(spark, sf).select("batch_id", "model_version", "window_end_sec")


@query(
    "agg_29_extraction_qc",
    f"""WITH {EPOCHS}, q AS (SELECT {R}, flags, CASE WHEN k % 9 = 0 THEN 255 ELSE hr_mean END AS hr, rr_mean AS rr FROM epochs_v)
SELECT {R}, count(*) AS epochs, round(count(*) FILTER (WHERE flags & 8 > 0) / count(*), 6) AS hr_valid_pct, round(count(*) FILTER (WHERE flags & 32 > 0) / count(*), 6) AS rr_valid_pct,
  min(hr) FILTER (WHERE hr <> 255) AS hr_min, max(hr) FILTER (WHERE hr <> 255) AS hr_max, quantile_cont(CASE WHEN hr <> 255 THEN hr END, 0.5) AS hr_median, quantile_cont(rr, 0.5) AS rr_median,
  concat_ws(',', CASE WHEN max(flags & 4) = 0 THEN 'ecg' END, CASE WHEN max(flags & 16) = 0 THEN 'resp' END) AS missing_channels,
  CASE WHEN max(flags & 64) > 0 THEN 'edr' WHEN max(flags & 16) > 0 THEN 'resp' ELSE 'none' END AS rr_source FROM q GROUP BY {R}""",
)
def extraction_qc(spark, sf):
    df = epochs(spark, sf).withColumn("hr_mean", F.when(F.col("k") % 9 == 0, 255).otherwise(F.col("hr_mean")))
    out = stat.extraction_qc(df, REC)
    return out.select(*REC, "epochs", r6("hr_valid_pct"), r6("rr_valid_pct"), "hr_min", "hr_max", "hr_median", "rr_median", "missing_channels", "rr_source")


_CODE = "CASE ground_truth_stage WHEN 'W' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 WHEN 'N3' THEN 3 WHEN 'REM' THEN 4 ELSE -1 END"


def nights(spark, sf):
    df = predictions(spark, sf).withColumn("code", F.expr(_CODE)).withColumn("valid", F.col("hr_mean") > 45)
    return stat.night_classes(df, ["dataset_id", "recording_id"], "code", "valid")


_NIGHTS = f"""c_v AS (SELECT *, {_CODE} AS code FROM preds_v), nt_v AS (SELECT dataset_id, recording_id, count(*) AS n_epochs, count(*) FILTER (WHERE code = -1 AND hr_mean > 45) AS n_unknown,
  {", ".join(f"count(*) FILTER (WHERE code = {i} AND hr_mean > 45) AS n_{i}" for i in range(5))}, avg(CASE WHEN hr_mean > 45 THEN 1.0 ELSE 0.0 END) AS valid_ratio FROM c_v GROUP BY 1, 2)"""


@query("agg_30_night_classes", f"WITH {PREDS}, {_NIGHTS} SELECT * REPLACE (round(valid_ratio, 6) AS valid_ratio) FROM nt_v")
def night_classes(spark, sf):
    return nights(spark, sf).withColumn("valid_ratio", r6("valid_ratio"))


@query(
    "agg_31_extraction_summary",
    f"WITH {PREDS}, {_NIGHTS} SELECT dataset_id, count(*) AS records, CAST(sum(n_epochs) AS BIGINT) AS epochs, round(avg(valid_ratio), 6) AS avg_valid_ratio FROM nt_v GROUP BY 1",
)
def extraction_summary(spark, sf):
    return stat.extraction_summary(nights(spark, sf)).withColumn("avg_valid_ratio", r6("avg_valid_ratio"))


@query(
    "agg_35_dump_summary",
    f"""WITH {EPOCHS}, h AS (SELECT {R}, CASE WHEN k % 9 = 0 THEN 0 ELSE hr_mean END AS hr, rr_mean, in_bed_pct, turnovers_delta, apnea_delta FROM epochs_v)
SELECT {R}, round(count(*) * 30 / 3600, 6) AS hours, round(avg(hr) FILTER (WHERE hr > 0), 6) AS avg_hr, round(avg(rr_mean), 6) AS avg_rr, round(avg(in_bed_pct), 6) AS avg_in_bed,
  CAST(sum(turnovers_delta) AS BIGINT) AS turnovers, CAST(sum(apnea_delta) AS BIGINT) AS apnea_events FROM h GROUP BY {R}""",
)
def dump_summary(spark, sf):
    df = epochs(spark, sf).withColumn("hr_mean", F.when(F.col("k") % 9 == 0, 0).otherwise(F.col("hr_mean")))
    out = stat.dump_summary(df, REC)
    return out.select(*REC, *[r6(c) for c in ("hours", "avg_hr", "avg_rr", "avg_in_bed")], "turnovers", "apnea_events")


_WORDS = ", ".join(f"CAST(sum(CAST(('0x' || substr(d, {1 + 8 * i}, 8)) AS BIGINT)) AS BIGINT) AS sum{i}" for i in range(4))


#: All columns of the tables compared.
_PARITY = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


def _led(col: str) -> str:
    """A value led by its length, as in ``table_fingerprint``."""
    return f"coalesce(length(CAST({col} AS VARCHAR)) || ':' || {col}, '-')"


@query(
    "agg_36_table_parity",
    f"""WITH f AS (SELECT 'orders' AS table_name, md5({' || '.join(map(_led, _PARITY['orders']))}) AS d FROM orders
 UNION ALL SELECT 'customer', md5({' || '.join(map(_led, _PARITY['customer']))}) FROM customer)
SELECT table_name, count(*) AS rows, {_WORDS}, true AS equal FROM f GROUP BY 1""",
)
def table_parity(spark, sf):
    prints = None
    copies = None
    for name, cols in _PARITY.items():
        table = read(spark, sf, name)
        one = stat.table_fingerprint(table.select(cols), [], name)
        two = stat.table_fingerprint(table.select(cols).repartition(3), [], name)
        prints = one if prints is None else prints.unionByName(one)
        copies = two if copies is None else copies.unionByName(two)
    verdict = stat.parity(prints, copies).select("table_name", "equal")
    return prints.join(verdict, "table_name").select(
        "table_name", "rows", *[big(f"sum{i}") for i in range(4)], "equal"
    )


_MISSING = f"""miss AS (SELECT {R}, CAST(max(epoch_index) - min(epoch_index) + 1 - count(*) AS BIGINT) AS missing FROM epochs_v GROUP BY {R})"""


@query("agg_37_missing_epochs", f"WITH {EPOCHS}, {_MISSING} SELECT *, CASE WHEN missing >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM miss WHERE missing > 0")
def missing_epochs(spark, sf):
    return stat.missing_epochs(epochs(spark, sf), REC)


@query(
    "set_06_audit_issues",
    f"""WITH {RECS}, {_MISSING},
g AS (SELECT {R}, end_sec - lag(end_sec) OVER (PARTITION BY {R} ORDER BY epoch_index) AS delta FROM preds_v),
i AS (SELECT 'missing_epochs' AS issue_type, CASE WHEN missing >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {R} FROM miss WHERE missing > 0
 UNION ALL SELECT 'window_gap', CASE WHEN delta >= 120 THEN 'HIGH' ELSE 'MEDIUM' END, {R} FROM g WHERE delta > 30
 UNION ALL SELECT 'orphan_prediction', 'HIGH', {R} FROM preds_v WHERE recording_id % 10 = 3
 UNION ALL SELECT 'invalid_epoch_schema', 'MEDIUM', {R} FROM epochs_v WHERE k % 19 = 0)
SELECT issue_type, severity, {R}, count(*) AS issues FROM i GROUP BY ALL""",
)
def audit(spark, sf):
    eps, preds = epochs(spark, sf), predictions(spark, sf)
    known = recordings(spark, sf).filter(F.col("recording_id") % 10 != 3)
    issues = stat.audit_issues(
        {
            "missing_epochs": stat.missing_epochs(eps, REC),
            "window_gap": sq.window_gaps(preds, REC),
            "orphan_prediction": rel.orphans(preds, known, REC).withColumn("severity", F.lit("HIGH")),
            "invalid_epoch_schema": rel.schema_violations(with_schema(eps), "v1").withColumn("severity", F.lit("MEDIUM")),
        }
    )
    return issues.groupBy("issue_type", "severity", *REC).agg(F.count(F.lit(1)).alias("issues"))


# --- drift -----------------------------------------------------------------
CUT = BASE_SECONDS


def halves(df):
    return df.withColumn("window", F.when(F.col("event_id") % 2 == 0, "current").otherwise("baseline"))


_PSI = f"""dc AS (SELECT tenant_id, predicted_stage AS s, count(*) FILTER (WHERE event_id % 2 = 0) AS c, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM preds_v GROUP BY 1, 2),
dp AS (SELECT tenant_id, c, b, greatest(c / sum(c) OVER (PARTITION BY tenant_id), 1e-8) AS p, greatest(b / sum(b) OVER (PARTITION BY tenant_id), 1e-8) AS q FROM dc),
dd AS (SELECT tenant_id, sum((p - q) * ln(p / q)) AS psi, sum(p * ln(p / q)) AS kl, CAST(sum(c) AS BIGINT) AS current_window, CAST(sum(b) AS BIGINT) AS baseline_window FROM dp GROUP BY 1)"""


@query("drf_01_distribution_drift", f"WITH {PREDS}, {_PSI} SELECT tenant_id, round(psi, 6) AS psi, round(kl, 6) AS kl_divergence, current_window, baseline_window FROM dd")
def distribution_drift(spark, sf):
    out = dr.distribution_drift(halves(predictions(spark, sf)), ["tenant_id"], "predicted_stage")
    return out.select("tenant_id", r6("psi"), r6("kl_divergence"), "current_window", "baseline_window")


_ZCONF = """dz AS (SELECT tenant_id, (avg(confidence) FILTER (WHERE event_id % 2 = 0) - avg(confidence) FILTER (WHERE event_id % 2 = 1)) / stddev_samp(confidence) FILTER (WHERE event_id % 2 = 1) AS z FROM preds_v GROUP BY 1)"""


@query("drf_02_confidence_z", f"WITH {PREDS}, {_ZCONF} SELECT tenant_id, round(z, 6) AS z_score FROM dz")
def confidence_z(spark, sf):
    return dr.mean_drift(halves(predictions(spark, sf)), ["tenant_id"], "confidence").select("tenant_id", r6("z_score"))


_DAILY = f"""{_UNP}, dm AS (SELECT feature, day, avg(value) AS m FROM u_v GROUP BY 1, 2), dd1 AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS r FROM (SELECT DISTINCT day FROM u_v)),
df1 AS (SELECT feature, avg(m) FILTER (WHERE r <= 10) AS cm, avg(m) FILTER (WHERE r > 10) AS bm, stddev_samp(m) FILTER (WHERE r > 10) AS bs, count(*) FILTER (WHERE r <= 10) AS cw, count(*) FILTER (WHERE r > 10) AS bw
  FROM dm JOIN dd1 USING (day) WHERE r <= 20 GROUP BY 1)"""


def feature_drift_rows(spark, sf, k: int = 10):
    """Daily feature means split into the latest ``k`` days and the ``k`` before."""
    rows = feature_rows(spark, sf)
    daily = rows.groupBy("feature", "day").agg(F.avg("value").alias("mean"))
    days = sq.recent_split(daily.select("day").distinct(), [F.desc("day")], k)
    return dr.mean_drift(daily.join(days, "day"), ["feature"], "mean")


@query(
    "drf_03_feature_drift",
    f"""WITH {EPOCHS}, {_DAILY} SELECT feature, round(cm, 6) AS current_mean, round(bm, 6) AS baseline_mean, round(bs, 6) AS baseline_std, round((cm - bm) / bs, 6) AS z_score, cw AS current_window, bw AS baseline_window FROM df1""",
)
def feature_drift(spark, sf):
    out = feature_drift_rows(spark, sf)
    return out.select("feature", *[r6(c) for c in ("current_mean", "baseline_mean", "baseline_std", "z_score")], "current_window", "baseline_window")


def all_metrics(spark, sf):
    preds = halves(predictions(spark, sf))
    means = dr.mean_drift(preds, ["tenant_id"], "confidence").withColumn("name", F.lit("confidence_mean"))
    hr = dr.mean_drift(preds, ["tenant_id"], "hr_mean").withColumn("name", F.lit("feature_1_mean"))
    dist = dr.distribution_drift(preds, ["tenant_id"], "predicted_stage")
    limits = {"psi": 0.001, "kl": 0.0005, "z": 0.02}
    return dr.classify(dr.metric_rows(dist, means.unionByName(hr), ["tenant_id"]), limits)


_METRICS = f"""{_PSI}, {_ZCONF}, hz AS (SELECT tenant_id, (avg(hr_mean) FILTER (WHERE event_id % 2 = 0) - avg(hr_mean) FILTER (WHERE event_id % 2 = 1)) / stddev_samp(hr_mean) FILTER (WHERE event_id % 2 = 1) AS z FROM preds_v GROUP BY 1),
mx AS (SELECT tenant_id, 'stage_distribution' AS name, CASE WHEN psi >= kl THEN psi ELSE kl END AS score, CASE WHEN psi >= kl THEN 0.001 ELSE 0.0005 END AS lim FROM dd
 UNION ALL SELECT tenant_id, 'confidence_mean', abs(z), 0.02 FROM dz UNION ALL SELECT tenant_id, 'feature_1_mean', abs(z), 0.02 FROM hz),
cl AS (SELECT *, CASE WHEN score >= lim THEN 'alert' ELSE 'ok' END AS status, CASE WHEN score >= lim * 2 THEN 2 WHEN score >= lim THEN 1 ELSE 0 END AS sev FROM mx)"""


@query("drf_04_classify_metrics", f"WITH {PREDS}, {_METRICS} SELECT tenant_id, name, round(score, 6) AS drift_score, status, ['LOW', 'MEDIUM', 'HIGH'][sev + 1] AS severity FROM cl")
def classify(spark, sf):
    return all_metrics(spark, sf).select("tenant_id", "name", r6("drift_score"), "status", "severity")


_OVER = """ov AS (SELECT tenant_id, max(score) AS max_score, count(*) FILTER (WHERE status = 'alert') AS alerts, max(sev) AS sev, coalesce(max(name) FILTER (WHERE status = 'alert' AND name LIKE 'feature%'), '') AS flagged_features FROM cl GROUP BY 1)"""


@query("drf_05_overall_severity", f"WITH {PREDS}, {_METRICS}, {_OVER} SELECT tenant_id, round(max_score, 6) AS max_score, alerts, ['LOW', 'MEDIUM', 'HIGH'][sev + 1] AS overall_severity, flagged_features FROM ov")
def overall(spark, sf):
    return dr.overall(all_metrics(spark, sf), ["tenant_id"]).select("tenant_id", r6("max_score"), "alerts", "overall_severity", "flagged_features")


@query(
    "drf_06_retrain_requests",
    f"""WITH {PREDS}, {_METRICS}, {_OVER} SELECT tenant_id, alerts, strftime(TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '30' DAY, '%Y-%m-%d %H:%M:%S') AS suggested_from, '2024-02-01 00:00:00' AS suggested_to FROM ov WHERE max_score * 50 >= 1 AND alerts > 0""",
)
def retrain(spark, sf):
    summary = dr.overall(all_metrics(spark, sf), ["tenant_id"]).withColumn("max_score", F.col("max_score") * 50)
    out = dr.retrain_requests(summary, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("tenant_id", "alerts", ts_text("suggested_from"), ts_text("suggested_to"))


@query(
    "drf_07_promotion_check",
    f"""WITH {PREDS}, {counts_sql('recording_id', 'true4', 'pred4')}, {class_sql('recording_id')}, {scores_sql('recording_id')},
p AS (SELECT recording_id, CASE WHEN recording_id % 7 = 0 THEN 'metrics missing' WHEN accuracy * 2 < 0.8 THEN 'accuracy below threshold' WHEN macro_f1 * 2 < 0.7 THEN 'macro F1 below threshold' WHEN recording_id % 5 = 0 THEN 'schema mismatch' ELSE 'ok' END AS reason FROM sc)
SELECT recording_id, reason, reason = 'ok' AS eligible FROM p""",
)
def promotion(spark, sf):
    from nightframe.operators.evaluation import classification_report

    models = classification_report(predictions(spark, sf), ["recording_id"]).select(
        "recording_id", (F.col("accuracy") * 2).alias("accuracy"), (F.col("macro_f1") * 2).alias("macro_f1"),
        (F.col("recording_id") % 7 != 0).alias("has_metrics"), (F.col("recording_id") % 5 != 0).alias("schema_matches"),
    )
    return dr.promotion_check(models).select("recording_id", "reason", "eligible")


@query(
    "drf_08_slo_report",
    f"""WITH {_SNAPSHOT}, m AS (SELECT p95_latency_ms, p99_latency_ms, (SELECT round(count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) FROM orders) AS failure_rate FROM snap)
SELECT unnest(['p95_latency_ms', 'p99_latency_ms', 'failure_rate']) AS objective, unnest([p95_latency_ms, p99_latency_ms, failure_rate]) AS value, unnest([350.0, 700.0, 0.01])::DOUBLE AS target,
 unnest([p95_latency_ms <= 350, p99_latency_ms <= 700, failure_rate <= 0.01]) AS met FROM m""",
)
def slo(spark, sf):
    snap = stat.latency_snapshot(latest_usage(spark, sf))
    fails = dr.failure_rate(read(spark, sf, "orders").select((F.col("o_orderstatus") != "P").alias("ok")), [])
    return dr.slo_report(card.side_by_side([snap, fails])).withColumn("value", r6("value"))


# --- feature registry ------------------------------------------------------
def observed_schema(spark, sf):
    """A schema version per device from what its epochs hold; device 3 has faults."""
    rows = unpivot_features(epochs(spark, sf), ["device_id"], FEATURES)
    return rows.groupBy(F.col("device_id").alias("version"), "position", F.col("feature").alias("name")).agg(
        F.min("value").cast("int").alias("min"), F.max("value").cast("int").alias("max")
    ).select(
        "version", F.when((F.col("version") == 3) & (F.col("position") == 4), 5).otherwise(F.col("position")).alias("position"), "name",
        F.when((F.col("version") == 3) & (F.col("position") == 7), "").otherwise("int").alias("dtype"), "min",
        F.when((F.col("version") == 3) & (F.col("name") == "hr_mean"), F.col("min") - 1).otherwise(F.col("max")).alias("max"),
        F.when(F.col("version") == 2, F.lit("v9")).alias("deprecated_in"),
    )


@query(
    "fst_01_schema_problems",
    f"WITH {EPOCHS} SELECT device_id AS version, unnest(['feature positions must be unique', 'min must be <= max', 'dtype is required']) AS problem FROM epochs_v WHERE device_id = 3 GROUP BY 1",
)
def schema_problems(spark, sf):
    return dr.schema_problems(observed_schema(spark, sf))


_SCHEMA = f"""sv AS (SELECT device_id AS version, generate_subscripts([{', '.join(repr(f) for f in FEATURES)}], 1) - 1 AS position, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS name,
  unnest([{', '.join(f'min({f})' for f in FEATURES)}]) AS lo, unnest([{', '.join(f'max({f})' for f in FEATURES)}]) AS hi FROM epochs_v WHERE device_id <> 3 GROUP BY device_id)"""


@query(
    "fst_02_schema_hash",
    f"""WITH {EPOCHS}, {_SCHEMA} SELECT version, sha256('[' || string_agg('{{"dtype":"int","max":' || hi || ',"min":' || lo || ',"name":"' || name || '","position":' || position || '}}', ',' ORDER BY position) || ']') AS schema_hash, count(*) AS features FROM sv GROUP BY 1""",
)
def schema_hash(spark, sf):
    return dr.schema_hash(observed_schema(spark, sf).filter(F.col("version") != 3))


@query(
    "fst_03_evolution_check",
    f"WITH {EPOCHS} SELECT device_id AS version, unnest(['apnea_delta', 'drr']) AS name FROM epochs_v WHERE device_id <> 2 GROUP BY device_id",
)
def evolution(spark, sf):
    active = observed_schema(spark, sf)
    new = active.filter(~F.col("name").isin("apnea_delta", "drr"))
    return dr.evolution_problems(active, new, ["version"])


@query(
    "fst_04_consistency",
    f"""WITH {EPOCHS}, v AS (SELECT recording_id, string_agg(DISTINCT CASE WHEN k % 19 = 0 THEN 'v0' ELSE 'v1' END, ',' ORDER BY CASE WHEN k % 19 = 0 THEN 'v0' ELSE 'v1' END) AS e FROM epochs_v GROUP BY 1)
SELECT recording_id, e AS epoch_versions, 'v1' AS prediction_versions, 'v1' AS expected_version, e = 'v1' AS consistent FROM v""",
)
def consistency(spark, sf):
    eps = with_schema(epochs(spark, sf))
    preds = predictions(spark, sf).withColumn("feature_schema_version", F.lit("v1"))
    expected = recordings(spark, sf).select("recording_id", F.lit("v1").alias("expected_version"))
    return dr.consistency(eps, preds, expected, ["recording_id"])


# --- scoring ---------------------------------------------------------------
_MEAN5 = "m5 AS (SELECT a.recording_id, a.epoch_index, count(*) AS n, " + ", ".join(f"avg(b.{f}) AS {f}" for f in FEATURES) + " FROM epochs_v a JOIN epochs_v b ON a.recording_id = b.recording_id AND b.epoch_index BETWEEN a.epoch_index - 4 AND a.epoch_index WHERE a.epoch_index >= 4 GROUP BY 1, 2 HAVING count(*) = 5)"


@query(
    "mod_01_score_windows",
    f"""WITH {EPOCHS}, {_MEAN5}, z AS (SELECT recording_id, epoch_index, {", ".join(f"{s} AS z{c}" for c, s in enumerate(LOGIT_SQL))} FROM m5),
g AS (SELECT *, greatest(z0, z1, z2, z3) AS m FROM z), p AS (SELECT *, 1 / (exp(z0 - m) + exp(z1 - m) + exp(z2 - m) + exp(z3 - m)) AS conf FROM g)
SELECT recording_id, epoch_index, CASE WHEN z0 = m THEN 'W' WHEN z1 = m THEN 'Light' WHEN z2 = m THEN 'Deep' ELSE 'REM' END AS predicted, round(conf, 6)::DOUBLE AS confidence FROM p""",
)
def score_windows(spark, sf):
    version = F.concat(F.lit("m"), (F.col("device_id") % 2).cast("string"))
    windows = window_rows(spark, sf, "reject", 5).filter(F.col("status") == "ok").withColumn("model_version", version)
    model = sc.linear_model(spark, WEIGHTS, BIAS, CLASSES, "m0").unionByName(
        sc.linear_model(spark, WEIGHTS, BIAS, CLASSES, "m1")
    )
    return sc.score_windows(windows, model).select("recording_id", "epoch_index", "predicted", r6("confidence"))


@query(
    "mod_02_ensemble",
    f"""WITH {PREDS} SELECT recording_id, epoch_index, 2::BIGINT AS models, round((p_w + 0.25) / 2, 6) AS q0, round((p_light + 0.25) / 2, 6) AS q1, round((p_deep + 0.25) / 2, 6) AS q2, round((p_rem + 0.25) / 2, 6) AS q3 FROM preds_v""",
)
def ensemble(spark, sf):
    a = predictions(spark, sf).select("recording_id", "epoch_index", "probabilities")
    b = a.withColumn("probabilities", F.array(*[F.lit(0.25)] * 4))
    out = sc.ensemble(a.unionByName(b), ["recording_id", "epoch_index"], "probabilities", 4)
    return out.select("recording_id", "epoch_index", "models", *[r6(F.col("probabilities")[i], f"q{i}") for i in range(4)])


_N2 = ["hr_mean", "rr_std"]


@query(
    "mod_03_normalise_windows",
    f"""WITH {EPOCHS}, c AS (SELECT a.recording_id, a.epoch_index, b.epoch_index - a.epoch_index + 4 AS t, CAST(b.hr_mean AS DOUBLE) AS x, count(*) OVER (PARTITION BY a.recording_id, a.epoch_index) AS n
  FROM epochs_v a JOIN epochs_v b ON a.recording_id = b.recording_id AND b.epoch_index BETWEEN a.epoch_index - 4 AND a.epoch_index WHERE a.epoch_index >= 4),
w AS (SELECT * FROM c WHERE n = 5), s AS (SELECT recording_id, avg(x) AS m, CASE WHEN stddev_pop(x) > 1e-8 THEN stddev_pop(x) ELSE 1 END AS sd FROM w GROUP BY 1),
y AS (SELECT w.recording_id, epoch_index, t, (x - m) / sd AS y FROM w JOIN s USING (recording_id)),
g AS (SELECT avg(y) AS m, CASE WHEN stddev_pop(y) > 1e-8 THEN stddev_pop(y) ELSE 1 END AS sd FROM y WHERE recording_id % 2 = 0)
SELECT recording_id, epoch_index, round((max(y) FILTER (WHERE t = 0) - any_value(m)) / any_value(sd), 4) + 0.0 AS hr_first, round((max(y) FILTER (WHERE t = 4) - any_value(m)) / any_value(sd), 4) + 0.0 AS hr_last FROM y, g GROUP BY 1, 2""",
)
def normalise(spark, sf):
    eps = epochs(spark, sf).withColumn("features", F.array(*[F.col(n).cast("float") for n in _N2]))
    from nightframe.operators.windows import build_windows

    windows = build_windows(eps, REC, window_size=5).filter(F.col("status") == "ok")
    out = sc.normalise_windows(windows, REC, len(_N2), F.col("recording_id") % 2 == 0)
    cell = lambda i: F.round(F.col("window")[i][0], 4) + 0.0
    return out.select("recording_id", "epoch_index", cell(0).alias("hr_first"), cell(4).alias("hr_last"))


@query(
    "mod_04_low_agreement_threshold",
    f"WITH {EPOCHS} SELECT round(quantile_cont(CAST(agree_flags AS DOUBLE), 0.15), 6) AS threshold FROM epochs_v WHERE recording_id % 2 = 0",
)
def low_agreement(spark, sf):
    return sc.low_agreement_threshold(epochs(spark, sf).filter(F.col("recording_id") % 2 == 0)).select(r6("threshold"))


GRID = [0.25 * i for i in range(1, 41)]


@query(
    "mod_05_fit_temperature",
    f"""WITH {PREDS}, z AS (SELECT {", ".join(f"{s} AS z{c}" for c, s in enumerate(LOGIT_SQL))}, CASE true4 WHEN 'W' THEN 0 WHEN 'Light' THEN 1 WHEN 'Deep' THEN 2 ELSE 3 END AS y FROM preds_v WHERE true4 IS NOT NULL),
t AS (SELECT unnest({GRID}) AS t), l AS (SELECT t, avg(ln(exp((z0 - greatest(z0, z1, z2, z3)) / t) + exp((z1 - greatest(z0, z1, z2, z3)) / t) + exp((z2 - greatest(z0, z1, z2, z3)) / t) + exp((z3 - greatest(z0, z1, z2, z3)) / t))
  + (greatest(z0, z1, z2, z3) - CASE y WHEN 0 THEN z0 WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE z3 END) / t) AS nll, count(*) AS rows FROM z, t GROUP BY 1)
SELECT CAST(t AS DOUBLE) AS temperature, round(nll, 6)::DOUBLE AS nll, rows FROM l ORDER BY nll, t LIMIT 1""",
)
def fit_temperature(spark, sf):
    df = logits(predictions(spark, sf).filter(F.col("true4").isNotNull()))
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("true4"))
    out = sc.fit_temperature(df.withColumn("y", index), "logits", "y", GRID)
    return out.select("temperature", r6("nll"), "rows")


@query("mod_06_train_classifier")
def train(spark, sf):
    """Rows only: a fitted model has no SQL twin."""
    df = predictions(spark, sf).filter(F.col("true4").isNotNull()).select(
        *REC, "epoch_index", feature_array("double").alias("features"),
        (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("true4")) - 1).cast("double").alias("label"),
    )
    model = sc.train_classifier(df, "features", "label", max_iter=10)
    return sc.apply_classifier(model, df, "features").select("recording_id", "epoch_index", "label", "prediction")


def separable(spark, sf):
    """Rows whose features tell the class: a wide gap in one of them, noise in the others."""
    df = predictions(spark, sf).filter(F.col("true4").isNotNull())
    label = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("true4")) - 1
    return df.select(
        *REC, "epoch_index", label.cast("double").alias("label"),
        F.array(*[F.when(label == c, 5.0).otherwise(0.0) + F.col("k") % 7 / 10 for c in range(len(CLASSES))], F.col("hr_mean").cast("double")).alias("features"),
    )


_SEPARABLE = f"""WITH {PREDS} SELECT recording_id, epoch_index, CAST(CASE true4 WHEN 'W' THEN 0 WHEN 'Light' THEN 1 WHEN 'Deep' THEN 2 ELSE 3 END AS DOUBLE) AS label,
  CAST(CASE true4 WHEN 'W' THEN 0 WHEN 'Light' THEN 1 WHEN 'Deep' THEN 2 ELSE 3 END AS DOUBLE) AS prediction FROM preds_v WHERE true4 IS NOT NULL"""


@query("mod_06_grouped_folds", _SEPARABLE)
def train_grouped(spark, sf):
    """Regularisation chosen over folds of whole recordings, classes weighed alike; on separable rows the label is the truth."""
    df = cut_lineage(separable(spark, sf), "separable")
    model = sc.train_classifier(df, "features", "label", folds=2, reg_params=(0.0, 0.01), max_iter=15, groups=["recording_id"], balanced=True)
    return sc.apply_classifier(model, df, "features").select("recording_id", "epoch_index", "label", "prediction")


@query("mod_06_boosted_trees", _SEPARABLE)
def train_trees(spark, sf):
    """One-vs-rest boosted trees with class weights on separable rows."""
    df = cut_lineage(separable(spark, sf), "separable")
    model = sc.train_classifier(df, "features", "label", max_iter=2, balanced=True, trees=True)
    return sc.apply_classifier(model, df, "features").select("recording_id", "epoch_index", "label", "prediction")


_REPLAY = f"""rp AS (SELECT *, lead(pred4) OVER w AS na, lead(b4) OVER w AS nb FROM (SELECT *, CASE type_stage WHEN 'W' THEN 'W' WHEN 'N3' THEN 'Deep' WHEN 'REM' THEN 'REM' ELSE 'Light' END AS b4 FROM preds_v) WINDOW w AS (PARTITION BY {R} ORDER BY epoch_index)),
ta AS (SELECT dataset_id, pred4 AS s, na AS d, count(*) AS n FROM rp WHERE na IS NOT NULL GROUP BY ALL), tb AS (SELECT dataset_id, b4 AS s, nb AS d, count(*) AS n FROM rp WHERE nb IS NOT NULL GROUP BY ALL),
tc AS (SELECT coalesce(ta.dataset_id, tb.dataset_id) AS dataset_id, coalesce(ta.n, 0) - coalesce(tb.n, 0) AS df FROM ta FULL JOIN tb ON ta.dataset_id = tb.dataset_id AND ta.s = tb.s AND ta.d = tb.d),
tl AS (SELECT dataset_id, CAST(sum(abs(df)) AS DOUBLE) AS l1, sqrt(sum(df * df)) AS l2 FROM tc GROUP BY 1)"""


def replay_inputs(spark, sf):
    from nightframe.functions.stages import four_class

    df = predictions(spark, sf)
    a = df.select(*REC, "epoch_index", "dataset_id", "true4", F.col("pred4").alias("stage"), "confidence")
    b = df.select(*REC, "epoch_index", four_class(F.col("type_stage")).alias("stage"), (F.col("confidence") * 0.9).alias("confidence"))
    joined = sc.replay_pairs(a, b, [*REC, "epoch_index"], ["stage", "confidence"])
    return joined.join(a.select(*REC, "epoch_index", "dataset_id", "true4"), [*REC, "epoch_index"])


@query(
    "mod_07_replay_summary",
    f"""WITH {PREDS}, {_REPLAY} SELECT dataset_id, count(*) AS windows, count(*) FILTER (WHERE pred4 <> b4) AS disagreements, round(avg(confidence) - avg(confidence * 0.9), 6)::DOUBLE AS confidence_delta,
  round(avg(CASE WHEN true4 IS NOT NULL THEN CASE WHEN pred4 = true4 THEN 1.0 ELSE 0 END END), 6) AS a_accuracy, round(avg(CASE WHEN true4 IS NOT NULL THEN CASE WHEN b4 = true4 THEN 1.0 ELSE 0 END END), 6) AS b_accuracy,
  any_value(l1) AS transition_l1, round(any_value(l2), 6) AS transition_l2 FROM rp JOIN tl USING (dataset_id) GROUP BY 1""",
)
def replay(spark, sf):
    out = sc.replay_summary(replay_inputs(spark, sf), REC, ["dataset_id"], "true4")
    return out.select("dataset_id", "windows", "disagreements", *[r6(c) for c in ("confidence_delta", "a_accuracy", "b_accuracy", "transition_l1", "transition_l2")])


@query(
    "jon_09_replay_join",
    f"WITH {PREDS} SELECT recording_id, epoch_index, pred4 AS a_stage, CASE type_stage WHEN 'W' THEN 'W' WHEN 'N3' THEN 'Deep' WHEN 'REM' THEN 'REM' ELSE 'Light' END AS b_stage FROM preds_v",
)
def replay_join(spark, sf):
    return replay_inputs(spark, sf).select("recording_id", "epoch_index", "a_stage", "b_stage")


_CARD = f"""{counts_sql('recording_id', 'true4', 'pred4')}, {class_sql('recording_id')}, {scores_sql('recording_id')},
confg AS (SELECT 1 AS one, true4 AS truth, pred4 AS pred, count(*) AS n FROM preds_v WHERE true4 IS NOT NULL GROUP BY ALL), {class_sql('one', 'confg', 'pg')}, {scores_sql('one', 'pg', 'sg')},
confd AS (SELECT dataset_id, true4 AS truth, pred4 AS pred, count(*) AS n FROM preds_v WHERE true4 IS NOT NULL GROUP BY ALL), {class_sql('dataset_id', 'confd', 'pd')}, {scores_sql('dataset_id', 'pd', 'sd')},
{CLIN_SQL},
nx AS (SELECT recording_id, pred4, lead(pred4) OVER (PARTITION BY {R} ORDER BY epoch_index) AS np4 FROM preds_v WHERE true4 IS NOT NULL),
rt AS (SELECT recording_id, coalesce(count(*) FILTER (WHERE (pred4 = 'Deep' AND np4 = 'REM') OR (pred4 = 'REM' AND np4 = 'Deep')) / nullif(count(np4), 0), 0) AS fr, coalesce(count(*) FILTER (WHERE pred4 = 'W' AND np4 = 'Deep') / nullif(count(np4), 0), 0) AS pr FROM nx GROUP BY 1),
rk AS (SELECT macro_f1, row_number() OVER (ORDER BY macro_f1, recording_id) AS rn, count(*) OVER () AS cnt FROM sc),
card AS (SELECT (SELECT macro_f1 FROM sg) AS macro_f1, (SELECT mcc FROM sg) AS mcc, (SELECT kappa FROM sg) AS kappa, (SELECT min_class_recall FROM sg) AS min_class_recall,
  (SELECT recall FROM pg WHERE label = 'REM') AS rem_recall, (SELECT recall FROM pg WHERE label = 'Deep') AS deep_recall,
  (SELECT max(macro_f1) - min(macro_f1) FROM sd) AS macro_f1_spread, (SELECT quantile_cont(macro_f1, 0.1) FROM sc) AS p10_macro_f1,
  (SELECT avg(macro_f1) FROM rk WHERE rn <= greatest(ceil(0.1 * cnt), 1)) AS worst_decile_macro_f1, (SELECT avg(rem_latency_min_mae) FROM ce) AS rem_latency_mae,
  (SELECT avg(fr) FROM rt) AS impossible_transition_rate, (SELECT avg(pr) FROM rt) AS wake_deep_direct_rate)"""
_CARD_COLS = ["macro_f1", "mcc", "kappa", "min_class_recall", "rem_recall", "deep_recall", "macro_f1_spread", "p10_macro_f1", "worst_decile_macro_f1", "rem_latency_mae", "impossible_transition_rate", "wake_deep_direct_rate"]


@query("mod_08_scorecard", f"WITH {PREDS}, {_CARD} SELECT {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _CARD_COLS)} FROM card")
def scorecard(spark, sf):
    return card.scorecard(predictions(spark, sf), REC, "recording_id", "dataset_id").select(*[r6(c) for c in _CARD_COLS])


def _gate_sql() -> str:
    parts = []
    for code, metric, op, limit in dr.HARD_GATES:
        parts.append(f"CASE WHEN NOT {metric} {'>=' if op == 'gte' else '<='} {limit} THEN '{code}' END")
    code, metric, _, limit = dr.SOFT_GATES[0]
    soft = f"CASE WHEN NOT {metric} >= {limit} THEN '{code}' ELSE '' END"
    return f"SELECT CASE WHEN concat_ws(',', {', '.join(parts)}) <> '' THEN 'FAIL' WHEN {soft} <> '' THEN 'WARN' ELSE 'PASS' END AS status, concat_ws(',', {', '.join(parts)}) AS hard_failures, {soft} AS soft_warnings FROM card"


@query("mod_09_gates", f"WITH {PREDS}, {_CARD} {_gate_sql()}")
def gates(spark, sf):
    out = card.gated_scorecard(card.scorecard(predictions(spark, sf), REC, "recording_id", "dataset_id"))
    return out.select("status", F.array_join("hard_failures", ",").alias("hard_failures"), F.array_join("soft_warnings", ",").alias("soft_warnings"))


AS_OF = BASE_SECONDS + 12 * 86400


@query(
    "mod_10_rolling_evaluation",
    f"""WITH {PREDS}, w AS (SELECT * FROM preds_v WHERE end_sec BETWEEN {AS_OF} - 7 * 86400 AND {AS_OF}),
{counts_sql('tenant_id', src='w')}, {class_sql('tenant_id')}, {scores_sql('tenant_id')}, t AS (SELECT tenant_id, count(*) AS total_predictions, count(ground_truth_stage) AS labeled_predictions, avg(confidence) AS c FROM w GROUP BY 1)
SELECT tenant_id, total_predictions, labeled_predictions, round(t.c, 6) AS average_confidence, round(accuracy, 6) AS accuracy, round(macro_f1_all, 6) AS macro_f1_all FROM t LEFT JOIN sc USING (tenant_id)""",
)
def rolling(spark, sf):
    out = card.evaluation_query(predictions(spark, sf), ["tenant_id"], F.lit(AS_OF), 7)
    return out.select("tenant_id", "total_predictions", "labeled_predictions", *[r6(c) for c in ("average_confidence", "accuracy", "macro_f1_all")])


@query(
    "mod_10_confidence_drift",
    f"""WITH {PREDS}, w AS (SELECT *, end_sec >= {AS_OF} - 7 * 86400 AS cur FROM preds_v WHERE end_sec >= {AS_OF} - 14 * 86400)
SELECT tenant_id, round((avg(confidence) FILTER (WHERE cur) - avg(confidence) FILTER (WHERE NOT cur)) / stddev_samp(confidence) FILTER (WHERE NOT cur), 6) AS z_score FROM w GROUP BY 1""",
)
def rolling_drift(spark, sf):
    return card.confidence_drift(predictions(spark, sf), ["tenant_id"], F.lit(AS_OF)).select("tenant_id", r6("z_score"))


def _viterbi_sql() -> str:
    pen = sc.transition_penalties(CLASSES)
    steps, paths = [], []
    for j, dst in enumerate(CLASSES):
        cand = [f"(v.s{i} - {pen[src, dst]!r}::DOUBLE)" for i, src in enumerate(CLASSES)]
        best = f"greatest({', '.join(cand)})"
        steps.append(f"{best} + r.l{j}")
        picks = " ".join(f"WHEN {c} = {best} THEN v.p{i}" for i, c in enumerate(cand))
        paths.append(f"CASE {picks} END || '{j}'")
    return f"""WITH RECURSIVE {PREDS},
r AS (SELECT recording_id, epoch_index, row_number() OVER (PARTITION BY recording_id ORDER BY epoch_index) AS t, ln(p_w) AS l0, ln(p_light) AS l1, ln(p_deep) AS l2, ln(p_rem) AS l3 FROM preds_v),
v AS (SELECT recording_id, t, l0 AS s0, l1 AS s1, l2 AS s2, l3 AS s3, '0' AS p0, '1' AS p1, '2' AS p2, '3' AS p3 FROM r WHERE t = 1
 UNION ALL SELECT r.recording_id, r.t, {', '.join(steps)}, {', '.join(paths)} FROM v JOIN r ON r.recording_id = v.recording_id AND r.t = v.t + 1),
f AS (SELECT recording_id, CASE WHEN s0 = m THEN p0 WHEN s1 = m THEN p1 WHEN s2 = m THEN p2 ELSE p3 END AS path FROM (SELECT *, greatest(s0, s1, s2, s3) AS m, row_number() OVER (PARTITION BY recording_id ORDER BY t DESC) AS last FROM v) WHERE last = 1)
SELECT r.recording_id, r.epoch_index, ['W', 'Light', 'Deep', 'REM'][1 + CAST(substr(path, t, 1) AS INT)] AS decoded FROM r JOIN f USING (recording_id)"""


@query("seq_11_viterbi_decode", _viterbi_sql())
def viterbi(spark, sf):
    return decoding.viterbi(predictions(spark, sf), REC).select("recording_id", "epoch_index", "decoded")


# --- ingest ----------------------------------------------------------------
def ingest_batches(spark, sf):
    """A target with a third of the epochs and a batch with every epoch twice."""
    df = epochs(spark, sf).select(*REC, "epoch_start_ts", "event_id", "hr_mean", "k")
    again = df.withColumns({"event_id": F.col("event_id") + 10_000_000, "hr_mean": F.col("hr_mean") + 1})
    return df.unionByName(again), df.filter(F.col("k") % 3 == 0)


@query(
    "ups_01_insert_ignore_epochs",
    f"WITH {EPOCHS} SELECT recording_id, strftime(epoch_start_ts, '%Y-%m-%d %H:%M:%S') AS epoch_start_ts, event_id, hr_mean FROM epochs_v WHERE k % 3 <> 0",
)
def insert_epochs(spark, sf):
    batch, target = ingest_batches(spark, sf)
    out = ing.insert_ignore(batch, target, ["recording_id", "epoch_start_ts"], ["event_id"])
    return out.select("recording_id", ts_text("epoch_start_ts"), "event_id", "hr_mean")


@query(
    "ups_02_insert_report",
    f"WITH {EPOCHS} SELECT tenant_id, count(*) * 2 AS received, count(*) FILTER (WHERE k % 3 <> 0) AS inserted FROM epochs_v GROUP BY 1",
)
def insert_report(spark, sf):
    batch, target = ingest_batches(spark, sf)
    put = ing.insert_ignore(batch, target, [*REC, "epoch_start_ts"], ["event_id"])
    return ing.insert_report(batch, put, ["tenant_id"])


@query(
    "ups_03_insert_ignore_predictions",
    f"WITH {PREDS} SELECT recording_id, end_sec, predicted_stage FROM preds_v WHERE hr_mean >= 80",
)
def insert_predictions(spark, sf):
    df = predictions(spark, sf).select("recording_id", "end_sec", "predicted_stage", "event_id", "hr_mean")
    out = ing.insert_ignore(df, df.filter(F.col("hr_mean") < 80), ["recording_id", "end_sec"], ["event_id"])
    return out.select("recording_id", "end_sec", "predicted_stage")


@query(
    "ups_04_upsert_predictions",
    f"""WITH {PREDS} SELECT recording_id, end_sec, CASE WHEN k % 2 = 0 THEN type_stage ELSE predicted_stage END AS predicted_stage,
  CASE WHEN k % 4 = 2 THEN 'NEW' ELSE ground_truth_stage END AS ground_truth_stage FROM preds_v""",
)
def upsert(spark, sf):
    df = predictions(spark, sf).select("recording_id", "end_sec", "predicted_stage", "type_stage", "ground_truth_stage", "k")
    existing = df.filter(F.col("k") % 4 != 2).drop("type_stage", "k")
    new = df.filter(F.col("k") % 2 == 0).select(
        "recording_id", "end_sec", F.col("type_stage").alias("predicted_stage"), F.lit("NEW").alias("ground_truth_stage")
    )
    return ing.upsert_predictions(existing, new, ["recording_id", "end_sec"])


@query(
    "ups_05_upsert_daily_stats",
    f"""WITH {EPOCHS}, {_UNP} SELECT tenant_id, day, feature, count(*) AS count, CAST(sum(value) AS DOUBLE) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM u_v GROUP BY 1, 2, 3""",
)
def upsert_stats(spark, sf):
    rows = feature_rows(spark, sf)
    by = ["tenant_id", "day", "feature"]
    stored = stat.daily_feature_stats(rows.filter(F.col("k") % 2 == 0), by, approximate=True)
    fresh = stat.daily_feature_stats(rows.filter(F.col("k") % 2 == 1), by, approximate=True)
    out = stat.merge_feature_stats(stored.unionByName(fresh), by)
    return out.select(*by, "count", "sum", "min", "max", r6("mean"), r6("std"))


@query(
    "ses_01_recording_sessions",
    f"""WITH RECURSIVE e AS (SELECT user_id % 5 AS device_id, event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, event_type = 'signup' AND event_id % 40 = 0 AS c, row_number() OVER (PARTITION BY user_id % 5 ORDER BY CAST(epoch(date_trunc('second', ts)) AS BIGINT), event_id) AS rn FROM events),
w AS (SELECT device_id, event_id, rn, s AS st, CASE WHEN c THEN NULL ELSE s END AS open FROM e WHERE rn = 1
 UNION ALL SELECT e.device_id, e.event_id, e.rn, CASE WHEN w.open IS NULL OR e.s - w.open > 43200 THEN e.s ELSE w.open END, CASE WHEN e.c THEN NULL WHEN w.open IS NULL OR e.s - w.open > 43200 THEN e.s ELSE w.open END
 FROM w JOIN e ON e.device_id = w.device_id AND e.rn = w.rn + 1)
SELECT CAST(device_id AS BIGINT) AS device_id, event_id, st AS recording_start FROM w""",
)
def sessions(spark, sf):
    ev = read(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("device_id"), "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"),
        ((F.col("event_type") == "signup") & (F.col("event_id") % 40 == 0)).alias("c"),
    )
    out = ing.recording_sessions(ev, ["device_id"], "s", ["event_id"], closes="c")
    return out.select("device_id", "event_id", "recording_start")


@query(
    "ses_02_latest_night",
    f"""WITH {RECS}, l AS (SELECT tenant_id, arg_max(recording_id, start_sec) AS recording_id FROM recs_v GROUP BY 1),
a AS (SELECT p.recording_id, count(*) AS n, count(*) FILTER (WHERE predicted_stage = 'W') AS w, count(*) FILTER (WHERE predicted_stage IN ('N1', 'N2')) AS lt, count(*) FILTER (WHERE predicted_stage = 'N3') AS d FROM preds_v p JOIN l USING (recording_id) GROUP BY 1)
SELECT recording_id, n // 2 AS total_minutes, CAST(greatest(40, least(95, floor(n * 0.5 / 5))) AS BIGINT) AS score, 'Fair' AS score_label,
 CAST(floor((w // 2) / (n // 2) * 100) AS BIGINT) AS awake_pct, CAST(floor((lt // 2) / (n // 2) * 100) AS BIGINT) AS light_pct, CAST(floor((d // 2) / (n // 2) * 100) AS BIGINT) AS deep_pct,
 CAST(greatest(0, 100 - floor((w // 2) / (n // 2) * 100)) AS BIGINT) AS sleep_efficiency_pct FROM a""",
)
def latest_night(spark, sf):
    out = ing.latest_night(predictions(spark, sf), recordings(spark, sf), ["recording_id"], "tenant_id", "start_sec")
    return out.select("recording_id", *[big(c) for c in ("total_minutes", "score")], "score_label", *[big(c) for c in ("awake_pct", "light_pct", "deep_pct", "sleep_efficiency_pct")])


@query(
    "ret_01_retention",
    f"WITH {PREDS} SELECT recording_id, end_sec FROM preds_v WHERE ingest_ts >= TIMESTAMP '2024-04-20 00:00:00' - INTERVAL '90' DAY",
)
def retention(spark, sf):
    out = ing.retained(predictions(spark, sf), "ingest_ts", F.lit("2024-04-20 00:00:00").cast("timestamp"), ing.EPOCH_RETENTION_DAYS)
    return out.select("recording_id", "end_sec")
