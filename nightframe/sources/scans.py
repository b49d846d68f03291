"""Scans of stored epochs, predictions, recordings and samples (SRC-01 .. SRC-06, SRC-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.operators.relations import Filters, apply_filters
from nightframe.schema import EPOCH_JSON, FEATURES, SAMPLES


def read_epochs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Epoch JSON lines with a fixed schema: no inference pass (SRC-01)."""
    return spark.read.schema(EPOCH_JSON).json(path)


def epoch_json(recording: Column, index: Column, stage: Column) -> list[Column]:
    """The columns of an epoch JSON line, features in fixed order."""
    return [
        recording.cast("string").alias("recording_id"),
        index.cast("int").alias("epoch_index"),
        stage.cast("int").alias("stage"),
        F.struct(*[F.col(f).cast("double").alias(f) for f in FEATURES]).alias("features"),
    ]


def write_epochs_jsonl(df: DataFrame, path: str, drop_unknown: bool = True, mode: str = "errorifexists") -> None:
    """Write epochs as JSON lines in feature order (SRC-02).

    ``df`` has ``recording_id, epoch_index, stage`` and the feature columns.
    """
    rows = df.filter(F.col("stage") >= 0) if drop_unknown else df
    rows.select(
        *epoch_json(F.col("recording_id"), F.col("epoch_index"), F.col("stage"))
    ).write.mode(mode).json(path)


def scan_epochs(
    epochs: DataFrame, recordings: DataFrame, filters: Filters, columns: Sequence[str], time: str = "epoch_start_ts"
) -> DataFrame:
    """Filtered, projected epochs joined with their recording (SRC-03)."""
    picked = apply_filters(epochs, filters, time).select("tenant_id", "recording_id", *columns)
    return picked.join(recordings, ["tenant_id", "recording_id"])


def scan_predictions(predictions: DataFrame, filters: Filters, columns: Sequence[str]) -> DataFrame:
    """Filtered, projected predictions (SRC-04)."""
    return apply_filters(predictions, filters).select("tenant_id", "recording_id", *columns)


def between(df: DataFrame, recording_id, low: Column, high: Column, time: str, order: Sequence[str]) -> DataFrame:
    """One recording's rows in an inclusive range, ordered (SRC-05)."""
    return df.filter((F.col("recording_id") == recording_id) & F.col(time).between(low, high)).orderBy(*order)


def list_recordings(recordings: DataFrame, filters: Filters, time: str = "started_at") -> DataFrame:
    """Recordings of a tenant, newest first (SRC-06)."""
    return apply_filters(recordings, filters, time).orderBy(F.desc(time), F.desc("recording_id"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Long-format signal samples (SRC-10)."""
    return spark.read.schema(SAMPLES).parquet(path)
