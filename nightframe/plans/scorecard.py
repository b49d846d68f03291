"""Composed reports: offline scorecard with gates and the evaluation query (MOD-08, MOD-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.operators import calibration as cal
from nightframe.operators import drift
from nightframe.operators import evaluation as ev
from nightframe.operators import nights as ni
from nightframe.operators import sequences as sq
from nightframe.session import cut_lineage

TEMPORAL = ["error_raw", "error_norm", "entropy_diff", "distance", "distance_norm", "fragmentation_error", "forbidden_rate", "pair_rate"]


def night_scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One wide row per night: classification, calibration, temporal and clinical."""
    keys = list(keys)
    labelled = df.filter(F.col("true4").isNotNull())
    top = cal.top_label(labelled).withColumn(
        "correct", (F.col("argmax") == F.col("true4")).cast("double")
    )
    temporal = sq.transition_errors(sq.transition_cells(labelled, keys, keys), keys)
    parts = [
        cal.ece(top, keys, "conf", "correct"),
        cal.brier(labelled, keys),
        temporal.select(*keys, "error_raw", "error_norm", "entropy_diff"),
        sq.edit_distance(labelled, keys),
        sq.fragmentation(labelled, keys).select(*keys, "fragmentation_error"),
        sq.pair_rates(labelled, keys).select(*keys, "forbidden_rate", "pair_rate"),
        ni.clinical(labelled, keys),
    ]
    out = ev.classification_report(labelled, keys)
    for part in parts:
        out = out.join(part, keys, "left")
    return out.na.fill(0.0, ["error_raw", "error_norm", "entropy_diff"])


def scorecard(df: DataFrame, keys: Sequence[str], night: str, dataset: str, nights: DataFrame | None = None) -> DataFrame:
    """One row of global metrics that the gates read (MOD-08).

    ``nights`` may be a stored copy of :func:`night_scores`; otherwise it is
    computed and stored here, one row per night.
    """
    # a dozen steps below read these rows: they are made once
    columns = dict.fromkeys([*keys, night, dataset, "epoch_index", "true4", "pred4", "probabilities"])
    labelled = cut_lineage(df.filter(F.col("true4").isNotNull()).select(*columns), "labelled")
    classes = ev.per_class(ev.confusion_counts(labelled, [], "true4", "pred4"), [])
    recalls = classes.agg(
        *[
            F.coalesce(F.max(F.when(F.col("label") == c, F.col("recall"))), F.lit(0.0)).alias(f"{c.lower()}_recall")
            for c in ("REM", "Deep")
        ]
    )
    per_dataset = ev.classification_report(labelled, [dataset])
    nights = cut_lineage(night_scores(labelled, list(keys)), "nights") if nights is None else nights
    summary = ni.metric_summary(nights, night, "macro_f1").select(
        F.col("p10").alias("p10_macro_f1"), F.col("worst_decile_mean").alias("worst_decile_macro_f1"), "nights"
    )
    means = nights.agg(
        F.avg("rem_latency_min_mae").alias("rem_latency_mae"),
        F.avg("forbidden_rate").alias("impossible_transition_rate"),
        F.avg("pair_rate").alias("wake_deep_direct_rate"),
        F.avg("ece").alias("mean_night_ece"),
        F.avg("distance_norm").alias("mean_edit_distance_norm"),
        F.avg("fragmentation_error").alias("mean_fragmentation_error"),
    )
    return side_by_side(
        [ev.scope_scores(classes, []), recalls, ev.spread(per_dataset, ["macro_f1", "mcc", "kappa"]), summary, means]
    )


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One wide row of doubles from several one-row tables, without a join."""
    long = None
    for part in parts:
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in part.columns]
        rows = part.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
        long = rows if long is None else long.unionByName(rows)
    names = [c for part in parts for c in part.columns]
    return long.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])


def gated_scorecard(card: DataFrame) -> DataFrame:
    """PASS / WARN / FAIL with reason codes of a scorecard (MOD-09)."""
    return drift.run_gates(card)


def evaluation_query(df: DataFrame, by: Sequence[str], as_of_sec: Column | None = None, days: int | None = None, time: str = "end_sec") -> DataFrame:
    """Headline numbers of stored predictions, optionally over a rolling period (MOD-10)."""
    by = list(by)
    rows = df
    if as_of_sec is not None and days is not None:
        rows = df.filter((F.col(time) >= as_of_sec - days * 86400) & (F.col(time) <= as_of_sec))
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count("ground_truth_stage").alias("labeled_predictions"),
        F.avg(F.when(ev.is_finite(F.col("confidence")), F.col("confidence")).otherwise(0.0)).alias("average_confidence"),
    )
    scores = ev.classification_report(rows, by, "ground_truth_stage", "predicted_stage").select(
        *by, "accuracy", "macro_f1_all"
    )
    return totals.join(scores, by, "left")


def confidence_drift(df: DataFrame, by: Sequence[str], as_of_sec: Column, days: int = 7, time: str = "end_sec") -> DataFrame:
    """Mean confidence of the last ``days`` against the ``days`` before (MOD-10)."""
    recent = df.filter(F.col(time) >= as_of_sec - 2 * days * 86400)
    split = F.when(F.col(time) >= as_of_sec - days * 86400, "current").otherwise("baseline")
    return drift.mean_drift(recent.withColumn("window", split), by, "confidence")
