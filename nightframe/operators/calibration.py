"""Calibration of predicted probabilities (AGG-13 .. AGG-15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.schema import CLASSES


def bin_edges(bins: int) -> list[float]:
    """``bins + 1`` equally spaced edges of [0, 1]."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def reliability_bin(conf: Column, bins: int) -> Column:
    """``[lo, hi)`` bin number, with the last bin closed."""
    inner = F.array(*[F.lit(e) for e in bin_edges(bins)[1:-1]])
    return F.size(F.filter(inner, lambda e: conf >= e))


def reliability(
    df: DataFrame, by: Sequence[str], conf: str, correct: str, bins: int = 15
) -> DataFrame:
    """Dense reliability bins: count, average confidence and accuracy, gap (AGG-13)."""
    binned = df.withColumn("_bin", reliability_bin(F.col(conf), bins))
    sparse = binned.groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(conf).alias("avg_conf"),
        F.avg(F.col(correct).cast("double")).alias("avg_acc"),
    )
    cells = F.map_from_entries(
        F.collect_list(F.struct("_bin", F.struct("count", "avg_conf", "avg_acc")))
    )
    dense = (
        sparse.groupBy(*by)
        .agg(cells.alias("_cells"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .withColumn("_c", F.try_element_at("_cells", F.col("bin")))
    )
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    return dense.select(
        *by,
        "bin",
        F.element_at(edges, F.col("bin") + 1).alias("bin_lower"),
        F.element_at(edges, F.col("bin") + 2).alias("bin_upper"),
        F.coalesce("_c.count", F.lit(0)).alias("count"),
        F.coalesce("_c.avg_conf", F.lit(0.0)).alias("avg_conf"),
        F.coalesce("_c.avg_acc", F.lit(0.0)).alias("avg_acc"),
    ).withColumn("gap", F.abs(F.col("avg_acc") - F.col("avg_conf")))


def ece(df: DataFrame, by: Sequence[str], conf: str, correct: str, bins: int = 15) -> DataFrame:
    """Expected calibration error per scope (AGG-14)."""
    per_bin = (
        df.withColumn("_bin", reliability_bin(F.col(conf), bins))
        .groupBy(*by, "_bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.abs(F.avg(F.col(correct).cast("double")) - F.avg(conf)).alias("gap"),
        )
    )
    return per_bin.groupBy(*by).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def top_label(df: DataFrame, probs: str = "probabilities", labels: Sequence[str] = CLASSES) -> DataFrame:
    """Highest probability and its label, first index on ties (EXP-23)."""
    best = F.array_max(probs)
    names = F.array(*[F.lit(x) for x in labels])
    return df.withColumn("conf", best).withColumn(
        "argmax", F.element_at(names, F.array_position(F.col(probs), F.col("conf")).cast("int"))
    )


def one_vs_rest(
    df: DataFrame, by: Sequence[str], probs: str, truth: str, labels: Sequence[str] = CLASSES
) -> DataFrame:
    """One row per class: its probability and whether it is the truth."""
    names = F.array(*[F.lit(x) for x in labels])
    return df.select(
        *by, truth, F.explode(F.arrays_zip(F.col(probs).alias("p"), names.alias("label"))).alias("z")
    ).select(
        *by,
        F.col("z.label").alias("label"),
        F.col("z.p").alias("conf"),
        (F.col("z.label") == F.col(truth)).alias("correct"),
    )


def brier_row(probs: Column, truth: Column, labels: Sequence[str] = CLASSES) -> Column:
    """Squared distance of one probability row to its one-hot truth."""
    names = F.array(*[F.lit(x) for x in labels])
    terms = F.zip_with(
        probs, names, lambda p, name: F.pow(p - F.when(name == truth, 1.0).otherwise(0.0), F.lit(2))
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def brier(
    df: DataFrame, by: Sequence[str], probs: str = "probabilities", truth: str = "true4"
) -> DataFrame:
    """Multiclass Brier score over labelled rows (AGG-15)."""
    labelled = df.filter(F.col(truth).isNotNull())
    return labelled.groupBy(*by).agg(F.avg(brier_row(F.col(probs), F.col(truth))).alias("brier"))
