"""Feature statistics, usage, latency, extraction and audit aggregates
(AGG-17 .. AGG-23, AGG-29 .. AGG-31, AGG-35 .. AGG-37)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.functions.numeric import FLAGS_B
from nightframe.operators.evaluation import ratio
from nightframe.operators.ordered import exact_quantiles
from nightframe.schema import STAGE_UNKNOWN, UINT8_UNKNOWN

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def daily_feature_stats(
    rows: DataFrame, by: Sequence[str], value: str = "value", approximate: bool = False
) -> DataFrame:
    """Sum, squares, extremes, mean, population std and percentiles (AGG-17).

    ``rows`` has one value per feature and epoch; ``by`` includes the day and
    the feature. Percentiles are exact and linear; ``approximate`` swaps in a
    one-pass sketch for very large days.
    """
    aggs = [
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"),
        F.sum(F.col(value) * F.col(value)).alias("sum_squares"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]
    if approximate:
        sketch = F.percentile_approx(value, list(QUANTILES.values()), F.lit(10000))
        base = rows.groupBy(*by).agg(*aggs, sketch.alias("_q"))
        base = base.withColumns({n: F.col("_q")[i] for i, n in enumerate(QUANTILES)}).drop("_q")
    else:
        base = rows.groupBy(*by).agg(*aggs).join(exact_quantiles(rows, by, value, QUANTILES), list(by))
    return with_moments(base)


def with_moments(stats: DataFrame) -> DataFrame:
    """Mean and population std from mergeable sums."""
    mean = F.col("sum") / F.col("count")
    variance = F.greatest(F.col("sum_squares") / F.col("count") - mean * mean, F.lit(0.0))
    return stats.withColumns({"mean": mean, "std": F.sqrt(variance)})


def merge_feature_stats(partials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge partial statistics: sums and extremes exact, percentiles weighted by count (AGG-18)."""
    merged = partials.groupBy(*by).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"),
        F.sum("sum_squares").alias("sum_squares"), F.min("min").alias("min"), F.max("max").alias("max"),
        *[(F.sum(F.col(q) * F.col("count")) / F.sum("count")).alias(q) for q in QUANTILES],
    )
    return with_moments(merged)


def recording_days(preds: DataFrame, ts: str) -> DataFrame:
    """Predictions and average confidence per recording and day (AGG-19)."""
    return preds.groupBy("tenant_id", "recording_id", F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("predictions"), F.avg("confidence").alias("avg_confidence")
    )


def device_days(epochs: DataFrame, recordings: DataFrame, ts: str) -> DataFrame:
    """Epochs per device and day (AGG-20). Epochs are counted per recording first."""
    per_recording = epochs.groupBy("tenant_id", "recording_id", F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        per_recording.join(recordings.select("tenant_id", "recording_id", "device_id"), ["tenant_id", "recording_id"])
        .groupBy("tenant_id", "device_id", "day")
        .agg(F.sum("_n").alias("epochs"))
    )


def usage_by_model(usage: DataFrame, by: Sequence[str] = ("model_version",)) -> DataFrame:
    """Usage totals with count-weighted latency (AGG-21)."""
    n = F.sum("prediction_count")
    return usage.groupBy(*by).agg(
        n.alias("prediction_count"),
        F.min("window_start_sec").alias("window_start_sec"),
        F.max("window_end_sec").alias("window_end_sec"),
        ratio(F.sum(F.col("prediction_count") * F.col("average_latency_ms")), n).alias("average_latency_ms"),
    )


def latency_snapshot(latest: DataFrame) -> DataFrame:
    """Weighted mean and nearest-rank p95/p99 of an already limited sample (AGG-22)."""
    agg = latest.agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.coalesce(F.sum("prediction_count"), F.lit(0)).alias("prediction_count"),
        F.sum(F.col("prediction_count") * F.col("average_latency_ms")).alias("_w"),
        F.array_sort(F.collect_list("average_latency_ms")).alias("_l"),
    )

    def rank(q: float) -> Column:
        return F.coalesce(
            F.try_element_at("_l", F.floor(F.lit(q) * (F.col("sample_size") - 1)).cast("int") + 1), F.lit(0.0)
        )

    return agg.select(
        "sample_size", "prediction_count",
        ratio(F.col("_w"), F.col("prediction_count")).alias("average_latency_ms"),
        F.when(F.col("sample_size") > 0, rank(0.95)).otherwise(F.lit(0.0)).alias("p95_latency_ms"),
        F.when(F.col("sample_size") > 0, rank(0.99)).otherwise(F.lit(0.0)).alias("p99_latency_ms"),
    )


def write_rate(latest: DataFrame, sec: str) -> DataFrame:
    """Rows per second over a limited sample of creation times (AGG-23)."""
    agg = latest.agg(F.count(F.lit(1)).alias("sample_size"), (F.max(sec) - F.min(sec)).alias("_w"))
    enough = F.col("sample_size") >= 2
    return agg.select(
        "sample_size",
        F.when(enough, F.col("_w").cast("double")).otherwise(F.lit(0.0)).alias("window_seconds"),
        F.when(enough & (F.col("_w") > 0), F.col("sample_size") / F.col("_w")).otherwise(F.lit(0.0)).alias("writes_per_sec"),
    )


def extraction_qc(df: DataFrame, keys: Sequence[str], channels: Column | None = None) -> DataFrame:
    """Per-night extraction quality from layout-B flags (AGG-29).

    HR and RR are uint8, so their value maps hold at most 256 entries and the
    built-in exact percentile is bounded for any night length.
    """
    def bit(name: str) -> Column:
        return F.col("flags").bitwiseAND(1 << FLAGS_B.index(name)) > 0

    def known(name: str) -> Column:
        return F.when(F.col(name) != UINT8_UNKNOWN, F.col(name))

    n = F.count(F.lit(1))
    aggs = []
    for name, flag in (("hr", "hr_valid"), ("rr", "rr_valid")):
        v = known(f"{name}_mean")
        aggs += [
            (F.count_if(bit(flag)) / n).alias(f"{name}_valid_pct"),
            F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"),
            F.percentile(v, F.lit(0.5)).alias(f"{name}_median"),
        ]
    out = df.groupBy(*keys).agg(
        n.alias("epochs"), *aggs,
        F.max(bit("rr_from_edr")).alias("_edr"), F.max(bit("resp_present")).alias("_resp"),
        F.max(bit("ecg_present")).alias("_ecg"),
    )
    missing = F.array_join(
        F.filter(
            F.array(F.when(~F.col("_ecg"), "ecg"), F.when(~F.col("_resp"), "resp")), lambda x: x.isNotNull()
        ),
        ",",
    )
    return out.withColumns(
        {
            "missing_channels": missing,
            "rr_source": F.when(F.col("_edr"), "edr").when(F.col("_resp"), "resp").otherwise("none"),
        }
    ).drop("_edr", "_resp", "_ecg")


def night_classes(df: DataFrame, keys: Sequence[str], stage: str, valid: str) -> DataFrame:
    """Counts of codes -1..4 among valid epochs and the valid ratio of a night (AGG-30)."""
    codes = [STAGE_UNKNOWN, 0, 1, 2, 3, 4]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        *[F.count_if(F.col(valid) & (F.col(stage) == c)).alias(f"n_{'unknown' if c < 0 else c}") for c in codes],
        F.avg(F.col(valid).cast("double")).alias("valid_ratio"),
    )


def extraction_summary(nights: DataFrame) -> DataFrame:
    """Records, epochs and mean valid ratio per dataset (AGG-31)."""
    return nights.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum("n_epochs").alias("epochs"), F.avg("valid_ratio").alias("avg_valid_ratio")
    )


def dump_summary(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Night summary of a device dump (AGG-35)."""
    return epochs.groupBy(*keys).agg(
        (F.count(F.lit(1)) * 30 / 3600).alias("hours"),
        F.avg(F.when(F.col("hr_mean") > 0, F.col("hr_mean"))).alias("avg_hr"),
        F.avg(F.when(F.col("rr_mean") > 0, F.col("rr_mean"))).alias("avg_rr"),
        F.avg("in_bed_pct").alias("avg_in_bed"),
        F.sum("turnovers_delta").alias("turnovers"),
        F.sum("apnea_delta").alias("apnea_events"),
    )


def table_fingerprint(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Row count and order-free digest of a table in one pass (AGG-36).

    Each row's md5 is split into four 32-bit words that are summed: equal
    tables agree for any row order or partitioning. Values are led by their
    length, so no two rows have one text; ``columns`` is all of them if empty.
    """
    values = [F.col(c).cast("string") for c in columns or df.columns]
    digest = F.md5(F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))
    words = df.select(
        *[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)").alias(f"w{i}") for i in range(4)]
    )
    return words.agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(f"w{i}").alias(f"sum{i}") for i in range(4)]
    ).select(F.lit(name).alias("table_name"), "*")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two fingerprints agree (AGG-36)."""
    cols = ["rows", "sum0", "sum1", "sum2", "sum3"]
    left = a.select("table_name", F.struct(*cols).alias("_a"))
    right = b.select("table_name", F.struct(*cols).alias("_b"))
    return left.join(right, "table_name", "full_outer").select(
        "table_name", F.col("_a.rows").alias("rows"), F.col("_a").eqNullSafe(F.col("_b")).alias("equal")
    )


def missing_epochs(
    epochs: DataFrame, keys: Sequence[str], index: str = "epoch_index", high: int = 10, complete: bool = False
) -> DataFrame:
    """Recordings with absent epochs between first and last index (AGG-37).

    ``complete`` also reports recordings without a gap, with no severity.
    """
    agg = epochs.groupBy(*keys).agg(
        (F.max(index) - F.min(index) + 1 - F.count(index)).cast("bigint").alias("missing")
    )
    gaps = agg if complete else agg.filter(F.col("missing") > 0)
    return gaps.withColumn(
        "severity", F.when(F.col("missing") >= high, "HIGH").when(F.col("missing") > 0, "MEDIUM")
    )


def audit_issues(checks: Mapping[str, DataFrame]) -> DataFrame:
    """Union of audit checks into one issue table (SET-06).

    Each check has ``tenant_id, recording_id, severity``.
    """
    out = None
    for name, df in checks.items():
        part = df.select(F.lit(name).alias("issue_type"), "severity", "tenant_id", "recording_id")
        out = part if out is None else out.unionByName(part)
    return out
