"""Drift metrics, gates, promotion, schema registry (DRF, FST, MOD-09)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.operators.evaluation import ratio

# --- fixed values -----------------------------------------------------------
DRIFT_EPS = 1e-8
DRIFT_THRESHOLDS = {"psi": 0.2, "kl": 0.1, "z": 3.0}
RETRAIN_SCORE = 1.0
RETRAIN_DAYS = 30
PROMOTION_MIN_ACCURACY, PROMOTION_MIN_MACRO_F1 = 0.8, 0.7
SLO_TARGETS = {"p95_latency_ms": 350.0, "p99_latency_ms": 700.0, "failure_rate": 0.01}
HARD_GATES = [
    ("HARD_GLOBAL_MACRO_F1", "macro_f1", "gte", 0.75),
    ("HARD_GLOBAL_MCC", "mcc", "gte", 0.70),
    ("HARD_WORST_DECILE_MACRO_F1", "worst_decile_macro_f1", "gte", 0.50),
    ("HARD_DOMAIN_VARIANCE_MACRO_F1", "macro_f1_spread", "lte", 0.15),
    ("HARD_REM_LATENCY_MAE", "rem_latency_mae", "lte", 20.0),
    ("HARD_MIN_CLASS_RECALL", "min_class_recall", "gte", 0.15),
    ("HARD_REM_RECALL", "rem_recall", "gte", 0.65),
    ("HARD_DEEP_RECALL", "deep_recall", "gte", 0.70),
    ("HARD_WORST_NIGHT_MACRO_F1", "p10_macro_f1", "gte", 0.60),
    ("HARD_IMPOSSIBLE_TRANSITION_RATE", "impossible_transition_rate", "lte", 0.08),
    ("HARD_WAKE_DEEP_DIRECT_RATE", "wake_deep_direct_rate", "lte", 0.05),
]
SOFT_GATES = [("SOFT_WORST_DECILE_MACRO_F1", "worst_decile_macro_f1", "gte", 0.45)]
# --- end of fixed values ----------------------------------------------------


def distribution_drift(
    rows: DataFrame, by: Sequence[str], stage: str, window: str = "window"
) -> DataFrame:
    """PSI and KL of ``current`` against ``baseline`` stage shares (DRF-01).

    A stage absent from one side counts as 1e-8, without renormalising.
    """
    counts = rows.groupBy(*by, F.col(stage).alias("_s")).agg(
        F.count_if(F.col(window) == "current").alias("_c"),
        F.count_if(F.col(window) == "baseline").alias("_b"),
    )
    scope = Window.partitionBy(*(by or [F.lit(0)]))

    def share(col: str) -> Column:
        return F.greatest(F.try_divide(F.col(col), F.sum(col).over(scope)), F.lit(DRIFT_EPS))

    shares = counts.filter((F.col("_c") > 0) | (F.col("_b") > 0)).withColumns(
        {"_p": share("_c"), "_q": share("_b")}
    )
    p, q = F.col("_p"), F.col("_q")
    return shares.groupBy(*by).agg(
        F.sum((p - q) * F.ln(p / q)).alias("psi"),
        F.sum(p * F.ln(p / q)).alias("kl_divergence"),
        F.sum("_c").alias("current_window"),
        F.sum("_b").alias("baseline_window"),
    ).filter((F.col("current_window") > 0) & (F.col("baseline_window") > 0))


def mean_drift(rows: DataFrame, by: Sequence[str], value: str, window: str = "window") -> DataFrame:
    """z-score of the current mean with the baseline's sample std (DRF-02, DRF-03)."""
    cur, base = F.col(window) == "current", F.col(window) == "baseline"
    v = F.col(value).cast("double")
    agg = rows.groupBy(*by).agg(
        F.avg(F.when(cur, v)).alias("current_mean"),
        F.avg(F.when(base, v)).alias("baseline_mean"),
        F.coalesce(F.stddev_samp(F.when(base, v)), F.lit(0.0)).alias("baseline_std"),
        F.count_if(cur).alias("current_window"),
        F.count_if(base).alias("baseline_window"),
    )
    z = F.when(
        F.col("baseline_std") > 0,
        (F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_std"),
    ).otherwise(F.lit(0.0))
    return agg.filter((F.col("current_window") > 0) & (F.col("baseline_window") > 0)).withColumn("z_score", z)


def metric_rows(distribution: DataFrame, means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stage-distribution and mean metrics in one long table ``(name, psi, kl, z)``."""
    null = F.lit(None).cast("double")
    a = distribution.select(*by, F.lit("stage_distribution").alias("name"), "psi", F.col("kl_divergence").alias("kl"), null.alias("z"))
    b = means.select(*by, "name", null.alias("psi"), null.alias("kl"), F.col("z_score").alias("z"))
    return a.unionByName(b)


def classify(metrics: DataFrame, thresholds: Mapping[str, float] = DRIFT_THRESHOLDS) -> DataFrame:
    """Score, status and severity of each metric row (DRF-04)."""
    psi, kl, z = F.col("psi"), F.col("kl"), F.col("z")
    by_psi = psi.isNotNull() & (kl.isNull() | (psi >= kl))
    score = F.when(by_psi, psi).when(kl.isNotNull(), kl).otherwise(F.coalesce(F.abs(z), F.lit(0.0)))
    limit = (
        F.when(by_psi, thresholds["psi"]).when(kl.isNotNull(), thresholds["kl"]).otherwise(thresholds["z"])
    )
    severity = (
        F.when(limit <= 0, "LOW").when(score >= limit * 2, "HIGH").when(score >= limit, "MEDIUM").otherwise("LOW")
    )
    return metrics.withColumns(
        {"drift_score": score, "status": F.when(score >= limit, "alert").otherwise("ok"), "severity": severity}
    )


def overall(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Overall severity, flagged metrics and largest score (DRF-05)."""
    rank = F.when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0)
    agg = classified.groupBy(*by).agg(
        F.max(rank).alias("_r"),
        F.count_if(F.col("status") == "alert").alias("alerts"),
        F.max("drift_score").alias("max_score"),
        F.array_join(
            F.sort_array(F.collect_set(F.when((F.col("status") == "alert") & F.col("name").startswith("feature_"), F.col("name")))), ","
        ).alias("flagged_features"),
    )
    level = F.when((F.col("alerts") > 0) & (F.col("_r") < 1), 1).otherwise(F.col("_r"))
    return agg.withColumn(
        "overall_severity", F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), level + 1)
    ).drop("_r")


def retrain_requests(
    summary: DataFrame, as_of: Column, from_ts: Column | None = None, to_ts: Column | None = None
) -> DataFrame:
    """Request rows where drift is high enough, default window 30 days (DRF-06)."""
    start = from_ts if from_ts is not None else as_of - F.make_interval(days=F.lit(RETRAIN_DAYS))
    return summary.filter((F.col("max_score") >= RETRAIN_SCORE) & (F.col("alerts") > 0)).withColumns(
        {"suggested_from": start, "suggested_to": to_ts if to_ts is not None else as_of}
    )


def promotion_check(models: DataFrame) -> DataFrame:
    """Eligibility and reason per model (DRF-07).

    Input: ``accuracy, macro_f1`` (resolved metrics), ``has_metrics`` and
    ``schema_matches``.
    """
    reason = (
        F.when(~F.col("has_metrics"), "metrics missing")
        .when(F.col("accuracy") < PROMOTION_MIN_ACCURACY, "accuracy below threshold")
        .when(F.col("macro_f1") < PROMOTION_MIN_MACRO_F1, "macro F1 below threshold")
        .when(~F.col("schema_matches"), "schema mismatch")
    )
    return models.withColumns({"reason": F.coalesce(reason, F.lit("ok")), "eligible": reason.isNull()})


def slo_report(measured: DataFrame, by: Sequence[str] = (), targets: Mapping[str, float] = SLO_TARGETS) -> DataFrame:
    """Measured value against target, one row per objective (DRF-08)."""
    cells = [
        F.struct(F.lit(n).alias("objective"), F.col(n).cast("double").alias("value"), F.lit(t).alias("target"))
        for n, t in targets.items()
    ]
    return measured.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*").withColumn(
        "met", F.col("value") <= F.col("target")
    )


def run_gates(
    metrics: DataFrame, by: Sequence[str] = (), hard: Sequence[tuple] = tuple(HARD_GATES), soft: Sequence[tuple] = tuple(SOFT_GATES)
) -> DataFrame:
    """Status and failed reason codes per scope from wide metric rows (MOD-09)."""
    def failed(gates: Sequence[tuple]) -> Column:
        codes = []
        for code, metric, op, limit in gates:
            ok = F.col(metric) >= limit if op == "gte" else F.col(metric) <= limit
            codes.append(F.when(~ok, F.lit(code)))
        return F.filter(F.array(*codes), lambda c: c.isNotNull())

    out = metrics.withColumns({"hard_failures": failed(hard), "soft_warnings": failed(soft)})
    status = (
        F.when(F.size("hard_failures") > 0, "FAIL").when(F.size("soft_warnings") > 0, "WARN").otherwise("PASS")
    )
    return out.withColumn("status", status).select(*by, "status", "hard_failures", "soft_warnings")


def schema_problems(features: DataFrame, by: Sequence[str] = ("version",)) -> DataFrame:
    """Invalid feature schemas: names, positions, ranges, dtypes (FST-01)."""
    n = F.count(F.lit(1))
    agg = features.groupBy(*by).agg(
        (F.count_distinct("name") != n).alias("_names"),
        (F.count_distinct("position") != n).alias("_positions"),
        ((F.min("position") != 0) | (F.max("position") != n - 1)).alias("_contiguous"),
        (F.count_if(F.col("min") > F.col("max")) > 0).alias("_range"),
        (F.count_if(F.col("dtype").isNull() | (F.col("dtype") == "")) > 0).alias("_dtype"),
    )
    texts = {
        "_names": "feature names must be unique", "_positions": "feature positions must be unique",
        "_contiguous": "positions must be contiguous from 0", "_range": "min must be <= max", "_dtype": "dtype is required",
    }
    rows = F.filter(F.array(*[F.when(F.col(c), F.lit(t)) for c, t in texts.items()]), lambda x: x.isNotNull())
    return agg.select(*by, F.explode(rows).alias("problem"))


def schema_hash(features: DataFrame, by: Sequence[str] = ("version",)) -> DataFrame:
    """SHA-256 of a schema's features as compact JSON in position order (FST-02)."""
    item = F.to_json(
        F.struct("dtype", "max", "min", "name", "position"), {"ignoreNullFields": "false"}
    )
    ordered = F.sort_array(F.collect_list(F.struct("position", item.alias("j"))))
    body = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["j"]), ","), F.lit("]"))
    return features.groupBy(*by).agg(F.sha2(body, 256).alias("schema_hash"), F.count(F.lit(1)).alias("features"))


def evolution_problems(active: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features removed without a prior deprecation (FST-03, SET-03)."""
    return (
        active.filter(F.col("deprecated_in").isNull())
        .join(new.select(*by, "name"), [*by, "name"], "left_anti")
        .select(*by, "name")
    )


def consistency(
    epochs: DataFrame, predictions: DataFrame, expected: DataFrame, by: Sequence[str]
) -> DataFrame:
    """Schema versions seen in epochs and predictions against the model's (FST-04)."""
    e = epochs.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set("feature_schema_version")), ",").alias("epoch_versions"))
    p = predictions.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set("feature_schema_version")), ",").alias("prediction_versions"))
    return e.join(p, list(by), "full_outer").join(expected, list(by), "left").withColumn(
        "consistent",
        F.col("epoch_versions").eqNullSafe(F.col("expected_version"))
        & F.col("prediction_versions").eqNullSafe(F.col("expected_version")),
    )


def failure_rate(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of failed batches (STR-07 batch form)."""
    return outcomes.groupBy(*by).agg(
        ratio(F.count_if(~F.col("ok")), F.count(F.lit(1))).alias("failure_rate"), F.count(F.lit(1)).alias("batches")
    )
