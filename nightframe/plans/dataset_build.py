"""End-to-end dataset build from epochs and predictions (DST-10)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.functions.stages import four_class
from nightframe.operators import dataset as ds
from nightframe.operators.relations import require_schema
from nightframe.operators.windows import build_windows
from nightframe.schema import EPOCH_SECONDS, WINDOW_SIZE


@dataclass(frozen=True)
class DatasetConfig:
    """Build settings; the whole record is stored with a snapshot."""

    window_size: int = WINDOW_SIZE
    epoch_seconds: int = EPOCH_SECONDS
    padding: str = "zero_fill"
    label_strategy: str = "ground_truth_only"
    allow_predicted: bool = False
    balance: str = "none"
    seed: int = 42
    ratios: ds.SplitRatios = field(default_factory=lambda: ds.BUILD_RATIOS)
    split_strategy: str = "recording"
    time_aware: bool = False
    purge_gap: int = 0
    block_seconds: int = 0
    stratify: str | None = None
    schema_version: str | None = None

    def effective_gap(self) -> int:
        """An explicit gap, or window size - 1 for time-aware splits."""
        if self.purge_gap > 0:
            return self.purge_gap
        return max(self.window_size - 1, 0) if self.time_aware else 0


KEYS = ["tenant_id", "recording_id"]
SCHEMA = "feature_schema_version"


def build_dataset(epochs: DataFrame, labels: DataFrame, config: DatasetConfig) -> DataFrame:
    """Windows with labels and splits.

    Labels are joined first, so windows are gathered only for labelled epochs;
    rows whose label has no four-class form are dropped whole. Blocks of a
    recording may fall into different splits only with ``block_seconds``.
    Epochs written with a feature schema other than ``schema_version`` raise
    (FLT-03); without one, windows over two schemas are left out.
    """
    schema = SCHEMA if SCHEMA in epochs.columns else None
    if config.schema_version is not None:
        epochs = require_schema(epochs, config.schema_version, SCHEMA)
    windows = build_windows(epochs, KEYS, window_size=config.window_size, padding=config.padding, schema_id=schema)
    windows = windows.filter(F.col("status") == "ok")
    chosen = ds.select_label(labels, config.label_strategy, config.allow_predicted)
    chosen = chosen.withColumn("label", four_class(F.col("label"))).filter(F.col("label").isNotNull())
    rows = windows.select(*KEYS, "epoch_index", "window", "padded", "window_end_ts").join(
        chosen.select(*KEYS, "epoch_index", "end_sec", "dataset_id", "label", "label_source"),
        [*KEYS, "epoch_index"],
    )
    rows = ds.balance_classes(rows, "label", ["recording_id", "epoch_index"], config.balance, config.seed)
    if config.split_strategy == "stratified":
        return ds.stratified_split(rows, "label", ["recording_id", "epoch_index"], config.ratios, config.seed)
    group = ["recording_id"]
    if config.block_seconds > 0:
        rows = ds.time_blocks(rows, KEYS, "end_sec", config.block_seconds)
        group = ["recording_id", "block_start"]
    split = ds.grouped_split(
        rows, group, "end_sec", config.ratios, config.seed, config.time_aware, config.stratify
    )
    return ds.purge_gap(split, KEYS, config.effective_gap())


def dataset_metadata(dataset: DataFrame, config: DatasetConfig) -> DataFrame:
    """One-row metadata of a built dataset (DST-10, AGG-32)."""
    sizes = [F.count_if(F.col("split") == s).alias(f"{s}_windows") for s in ("train", "val", "test")]
    sources = [
        F.count_if(F.col("label_source") == s).alias(f"{s}_labels") for s in ("ground_truth", "predicted")
    ]
    return dataset.agg(
        *sizes, *sources,
        F.count_if("padded").alias("padded_windows"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("label_map"),
        F.lit(config.window_size).alias("window_size"),
        F.lit(config.seed).alias("random_seed"),
        F.lit(config.split_strategy).alias("split_strategy"),
        F.lit(config.effective_gap()).alias("purge_gap"),
    )
