"""Per-night sleep summaries and clinical agreement (AGG-24 .. AGG-28, SEQ-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.operators.evaluation import ratio
from nightframe.operators.ordered import block_of, exact_quantiles, ranked_in_ranges, with_position
from nightframe.schema import STAGES

CLINICAL = ["tst_min", "se", "rem_pct", "n3_pct", "rem_latency_min", "waso_min"]


def positions(df: DataFrame, keys: Sequence[str], index: str = "epoch_index") -> DataFrame:
    """Zero-based list position ``pos`` of each row of a night."""
    placed = with_position(df, keys, [index], block_of(index))
    return placed.withColumn("pos", F.col("pos").cast("int"))


def recording_summary(
    df: DataFrame,
    keys: Sequence[str],
    stage: str = "predicted_stage",
    stages: Sequence[str] = tuple(STAGES),
    epoch_minutes: float = 0.5,
) -> DataFrame:
    """Total minutes, minutes per stage, sleep latency and WASO (AGG-24).

    Every row before sleep onset is wake, so ``WASO = wake - onset`` and one
    aggregate is enough. A night without sleep has no latency and no WASO.
    """
    rows = positions(df, keys)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col(stage) != "W", F.col("pos"))).alias("_onset"),
        *[F.count_if(F.col(stage) == s).alias(f"_c_{s}") for s in stages],
    )
    return agg.select(
        *keys,
        (F.col("_n") * epoch_minutes).alias("total_minutes"),
        *[(F.col(f"_c_{s}") * epoch_minutes).alias(f"minutes_{s.lower()}") for s in stages],
        (F.col("_onset") * epoch_minutes).alias("sleep_latency_minutes"),
        ((F.col("_c_W") - F.col("_onset")) * epoch_minutes).alias("waso_minutes"),
    )


def night_summary(
    rows: DataFrame, keys: Sequence[str], stage: str, prefix: str, epoch_minutes: float = 0.5
) -> list[Column]:
    """Aggregate columns of one hypnogram over positioned rows (AGG-25)."""
    n = F.count(F.lit(1))
    sleep = F.count_if(F.col(stage) != "W")
    onset = F.min(F.when(F.col(stage) != "W", F.col("pos")))
    return [
        (n * epoch_minutes).alias(f"{prefix}_total"),
        (sleep * epoch_minutes).alias(f"{prefix}_sleep"),
        (sleep / n).alias(f"{prefix}_efficiency"),
        (onset * epoch_minutes).alias(f"{prefix}_latency"),
        ((F.count_if(F.col(stage) == "W") - onset) * epoch_minutes).alias(f"{prefix}_waso"),
    ]


def night_delta(
    df: DataFrame,
    keys: Sequence[str],
    truth: str = "ground_truth_stage",
    pred: str = "predicted_stage",
    stages: Sequence[str] = tuple(STAGES),
) -> DataFrame:
    """Night summaries of both hypnograms and predicted minus true (AGG-25)."""
    rows = positions(df.filter(F.col(truth).isNotNull() & (F.col(truth) != "")), keys)
    share = [
        (
            (F.count_if(F.col(pred) == s) - F.count_if(F.col(truth) == s)) / F.count(F.lit(1))
        ).alias(f"delta_share_{s.lower()}")
        for s in stages
    ]
    wide = rows.groupBy(*keys).agg(
        *night_summary(rows, keys, pred, "pred"), *night_summary(rows, keys, truth, "true"), *share
    )
    return wide.withColumns(
        {
            f"delta_{m}": F.col(f"pred_{m}") - F.col(f"true_{m}")
            for m in ("total", "sleep", "efficiency", "latency", "waso")
        }
    )


def clinical_columns(stage: str, prefix: str, epoch_seconds: int = 30) -> list[Column]:
    """Aggregates over positioned four-class rows: TST, SE, REM %, N3 %, latencies (AGG-26)."""
    minute = epoch_seconds / 60.0
    s = F.col(stage)
    n = F.count(F.lit(1))
    sleep = F.count_if(s != "W")
    onset = F.min(F.when(s != "W", F.col("pos")))
    first_rem = F.min(F.when(s == "REM", F.col("pos")))
    return [
        (sleep * minute).alias(f"{prefix}_tst_min"),
        (sleep / n).alias(f"{prefix}_se"),
        ratio(F.count_if(s == "REM"), sleep).alias(f"{prefix}_rem_pct"),
        ratio(F.count_if(s == "Deep"), sleep).alias(f"{prefix}_n3_pct"),
        F.coalesce((first_rem - onset) * minute, F.lit(0.0)).alias(f"{prefix}_rem_latency_min"),
        F.coalesce((F.count_if(s == "W") - onset) * minute, F.lit(0.0)).alias(f"{prefix}_waso_min"),
    ]


def clinical(
    df: DataFrame, keys: Sequence[str], truth: str = "true4", pred: str = "pred4"
) -> DataFrame:
    """Clinical values of truth and prediction with absolute and relative error."""
    rows = positions(df.filter(F.col(truth).isNotNull()), keys)
    wide = rows.groupBy(*keys).agg(*clinical_columns(truth, "true"), *clinical_columns(pred, "pred"))
    errors: dict[str, Column] = {}
    for m in CLINICAL:
        gap = F.abs(F.col(f"pred_{m}") - F.col(f"true_{m}"))
        size = F.abs(F.col(f"true_{m}"))
        errors[f"{m}_mae"] = gap
        errors[f"{m}_ape"] = F.when(size > 1e-6, gap / size).otherwise(F.lit(0.0))
    return wide.withColumns(errors)


def metric_summary(nights: DataFrame, key: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population std, linear p10 and worst-decile mean over nights (AGG-27)."""
    by = list(by)
    rows = nights.select(*by, F.col(key), F.col(metric).alias("v"))
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nights"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")
    )
    p10 = exact_quantiles(rows, by, "v", {"p10": 0.1})
    tail = worst_rows(rows, by, [F.col("v"), F.col(key)], 0.1).groupBy(*by).agg(
        F.avg("v").alias("worst_decile_mean")
    )
    if by:
        return stats.join(p10, by).join(tail, by)
    return stats.withColumns({"p10": p10.scalar(), "worst_decile_mean": tail.scalar()})


def worst_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], fraction: float) -> DataFrame:
    """The first ``max(1, ceil(fraction * n))`` rows of each scope (TOP-04).

    Rows are ranked in ranges cut where they are, so neither a large scope nor
    one value that most rows share is sorted by a single task.
    """
    by = list(by)
    keyed = df.withColumns({f"_k{i}": c for i, c in enumerate(order)})
    names = [f"_k{i}" for i in range(len(order))]
    ranked = ranked_in_ranges(keyed, by, names, "_rank")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = ranked.join(sizes, by) if by else ranked.withColumn("_n", sizes.scalar())
    limit = F.greatest(F.ceil(F.col("_n") * F.lit(fraction)), F.lit(1))
    return (
        sized.filter(F.col("_rank") < limit)
        .withColumn("worst_rank", (F.col("_rank") + 1).cast("bigint"))
        .drop(*names, "_n", "_rank")
    )


def clinical_errors(nights: DataFrame) -> DataFrame:
    """Mean absolute and relative clinical error over nights, one row per value (AGG-28)."""
    agg = nights.agg(
        *[F.avg(f"{m}_{e}").alias(f"{m}_{e}") for m in CLINICAL for e in ("mae", "ape")]
    )
    return agg.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mae").alias("mae"), F.col(f"{m}_ape").alias("ape"))
                    for m in CLINICAL
                ]
            )
        ).alias("r")
    ).select("r.*")


def hypnogram_bins(df: DataFrame, keys: Sequence[str], ui_stage: Column) -> DataFrame:
    """UI bins: offset position, one-minute duration and UI stage (SEQ-13)."""
    return positions(df, keys).select(
        *keys,
        F.col("pos").alias("start_min"),
        F.lit(1).alias("duration_min"),
        ui_stage.alias("stage"),
    )
