"""Epoch and window construction (WIN-01 .. WIN-09)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightframe.functions.binding import bind
from nightframe.functions.numeric import clip
from nightframe.operators.ordered import (
    BLOCK,
    block_of,
    running_totals,
    with_frame,
    with_neighbours,
)
from nightframe.schema import BLOCK_ROWS, EPOCH_SECONDS, STAGE_UNKNOWN, WINDOW_SIZE
from nightframe.session import cut_lineage

# --- fixed values: device thresholds ----------------------------------------
VIB_LARGE, VIB_MINOR = 0.8, 0.15
# --- end of fixed values ----------------------------------------------------


def build_windows(
    df: DataFrame,
    keys: Sequence[str],
    features: str = "features",
    window_size: int = WINDOW_SIZE,
    padding: str = "reject",
    index: str = "epoch_index",
    start_ts: str = "epoch_start_ts",
    epoch_seconds: int = EPOCH_SECONDS,
    strict: bool = False,
    schema_id: str | None = None,
) -> DataFrame:
    """Trailing windows of ``window_size`` epochs ending at each epoch (WIN-04).

    ``zero_fill`` replaces absent epochs by zero rows. ``reject`` keeps windows
    that start at index 0 or later and marks incomplete ones ``gap``. A window
    over two feature schemas (``schema_id``) is marked ``mixed_schema``, one of
    unequal widths ``width``. With ``strict`` any such window raises instead.
    Of several rows of one index the one with the latest start (then the
    largest row) counts.
    """
    others = [c for c in df.columns if c not in (*keys, index)]
    largest = [F.col(c).cast("string").desc() if isinstance(df.schema[c].dataType, T.MapType) else F.desc(c) for c in others]
    width = F.size(features)
    checked = {"_w0": F.min(width), "_w1": F.max(width)}
    if schema_id:
        checked |= {"_s0": F.min(schema_id), "_s1": F.max(schema_id)}
    item = F.struct(F.col(index).alias("i"), F.col(features).alias("x"))
    framed = with_frame(df, keys, index, window_size - 1, 0, {"_items": F.collect_list(item), **checked}, best=[F.desc(start_ts), *largest])
    first = F.col(index) - (window_size - 1)
    present = F.size("_items")
    out = framed.withColumns(
        {
            "start_index": first,
            "end_index": F.col(index),
            "padded": present < window_size,
            "present": present,
        }
    )
    if padding == "zero_fill":
        zero = F.transform(F.col(features), lambda x: x * 0)
        steps = F.sequence(F.col("start_index"), F.col("end_index"))
        tensor = bind(
            F.map_from_entries("_items"),
            lambda held: F.transform(steps, lambda i: F.coalesce(F.try_element_at(held, i), zero)),
        )
        status = F.lit("ok")
    elif padding == "reject":
        tensor = F.transform(F.array_sort("_items"), lambda e: e["x"])
        out = out.filter(F.col("start_index") >= 0)
        status = F.when(F.col("padded"), "gap").otherwise("ok")
    else:
        raise ValueError("padding must be 'reject' or 'zero_fill'")
    status = F.when(F.col("_w0") != F.col("_w1"), "width").otherwise(status)
    if schema_id:
        status = F.when(F.col("_s0") != F.col("_s1"), "mixed_schema").otherwise(status)
    out = out.withColumn("status", status).drop(*checked)
    if strict:
        found = F.when(F.col("status") == "gap", "Missing epoch index in a window").otherwise(
            F.concat(F.lit("Window of epochs refused: "), F.col("status"))
        )
        out = out.withColumn("status", F.when(F.col("status") != "ok", F.raise_error(found)).otherwise(F.col("status")))
    if padding == "reject":
        out = out.withColumn("padded", F.lit(False))
    end = F.col(start_ts) + F.make_interval(secs=F.lit(epoch_seconds))
    return (
        out.withColumn("window", tensor)
        .withColumn("window_end_ts", end)
        .withColumn("window_start_ts", end - F.make_interval(secs=F.lit(epoch_seconds * window_size)))
        .drop("_items")
    )


def strided_windows(
    df: DataFrame,
    keys: Sequence[str],
    features: str,
    stage: str,
    pos: str = "pos",
    window_len: int = WINDOW_SIZE,
    stride: int = 1,
    label_mode: str = "center",
    drop_unknown: bool = True,
) -> DataFrame:
    """Forward windows with a centre or sequence label (WIN-05).

    ``pos`` is the dense list position. An unknown stage is null; it drops the
    window, or becomes 255 when ``drop_unknown`` is false.
    """
    item = F.struct(F.col(pos).alias("i"), F.col(features).alias("x"), F.col(stage).alias("s"))
    framed = with_frame(df, keys, pos, 0, window_len - 1, {"_items": F.collect_list(item)})
    full = framed.filter((F.size("_items") == window_len) & (F.col(pos) % stride == 0))
    items = F.array_sort("_items")
    stages = F.transform(items, lambda e: e["s"])
    labels = stages if label_mode == "sequence" else F.slice(stages, window_len // 2 + 1, 1)
    out = full.withColumn("window", F.transform(items, lambda e: e["x"])).withColumn("_labels", labels)
    known = F.transform("_labels", lambda s: s.isNotNull())
    out = out.withColumn("mask", known)
    if drop_unknown:
        out = out.filter(F.forall("mask", lambda m: m))
    return out.withColumn(
        "labels", F.transform("_labels", lambda s: F.coalesce(s, F.lit(255)))
    ).drop("_items", "_labels")


def latest_epochs(df: DataFrame, keys: Sequence[str], n: int = WINDOW_SIZE, index: str = "epoch_index") -> DataFrame:
    """The ``n`` latest epochs of each recording (WIN-06).

    Spark turns the rank filter into a per-task group limit before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(index)))
    return df.withColumn("recency", rank).filter(F.col("recency") <= n)


def model_input(window: Column, strategy: str = "mean") -> Column:
    """Window to model input: mean over time, flat vector or the sequence (WIN-07)."""
    if strategy == "mean":
        return bind(
            window,
            lambda rows: F.transform(
                F.sequence(F.lit(1), F.size(F.element_at(rows, 1))),
                lambda j: F.aggregate(
                    rows, F.lit(0.0), lambda acc, row: acc + F.element_at(row, j).cast("double")
                )
                / F.size(rows),
            ),
        )
    if strategy == "flatten":
        return F.flatten(window)
    if strategy == "sequence":
        return window
    raise ValueError("strategy must be mean, flatten or sequence")


def input_problem(window: Column, steps: int, width: int) -> Column:
    """Why a window cannot be scored, or null (WIN-07)."""
    return (
        F.when(F.size(window) != steps, "wrong length")
        .when(F.exists(window, lambda r: F.size(r) != width), "wrong width")
        .when(
            F.exists(window, lambda r: F.exists(r, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))),
            "not finite",
        )
    )


def device_epochs(samples: DataFrame, keys: Sequence[str], sec: str = "sec") -> DataFrame:
    """1 Hz device samples to 30 s epochs (WIN-01).

    Means use integer division and the standard deviation is taken around the
    integer mean, as the device does. Input columns: ``hr, rr, movement,
    vib_score, turnovers, apnea, state``.
    """
    epoch = F.floor(F.col(sec) / EPOCH_SECONDS)
    valid = (F.col("hr") > 40) & (F.col("hr") < 180) & (F.col("rr") > 8) & (F.col("rr") < 30)
    in_bed = valid & (F.col("movement") < 10)
    n = F.count(F.lit(1))
    large = F.count_if(F.col("vib_score") > VIB_LARGE)
    minor = F.count_if((F.col("vib_score") > VIB_MINOR) & (F.col("vib_score") <= VIB_LARGE))
    agg = samples.withColumn("epoch_index", epoch.cast("bigint")).groupBy(*keys, "epoch_index").agg(
        n.alias("n"),
        F.floor(F.sum("hr") / n).alias("hr_mean"),
        F.floor(F.sum("rr") / n).alias("rr_mean"),
        F.sum(F.col("hr") * F.col("hr")).alias("_hh"),
        F.sum("hr").alias("_h"),
        F.sum(F.col("rr") * F.col("rr")).alias("_rr"),
        F.sum("rr").alias("_r"),
        F.floor(F.count_if(in_bed) * 100 / n).alias("in_bed_pct"),
        F.floor(large * 100 / n).alias("large_move_pct"),
        F.floor(minor * 100 / n).alias("minor_move_pct"),
        F.avg("vib_score").alias("_vib"),
        F.max("turnovers").alias("turnovers"),
        F.max("apnea").alias("apnea"),
        F.max_by("state", sec).alias("flags"),
    )

    def spread(squares: str, total: str, mean: str) -> Column:
        m = F.col(mean)
        return F.floor(F.sqrt((F.col(squares) - 2 * m * F.col(total) + F.col("n") * m * m) / F.col("n")))

    moves = agg.withColumns(
        {
            "hr_std": spread("_hh", "_h", "hr_mean"),
            "rr_std": spread("_rr", "_r", "rr_mean"),
            "vib_move_pct": F.least(F.col("large_move_pct") + F.col("minor_move_pct"), F.lit(100)),
            "vib_resp_q": clip(100 - F.floor(F.col("_vib") * 20), 0, 100),
        }
    )
    seq = with_neighbours(
        moves, keys, ["epoch_index"], block_of("epoch_index"),
        ["hr_mean", "rr_mean", "turnovers", "apnea"],
    )

    def previous(name: str) -> Column:
        return F.coalesce(F.col(f"prev.{name}"), F.lit(0))

    bits = (
        F.when((F.col("flags") > 0) & (F.col("vib_move_pct") > 20), 1).otherwise(0)
        + F.when((F.col("in_bed_pct") < 50) & (F.col("vib_move_pct") > 10), 2).otherwise(0)
        + F.when(F.col("n") < 20, 4).otherwise(0)
        + F.when(F.col("n") < 10, 8).otherwise(0)
    )
    return seq.select(
        *keys, "epoch_index", "n", "in_bed_pct", "hr_mean", "hr_std",
        clip(F.col("hr_mean") - previous("hr_mean"), -128, 127).alias("dhr"),
        "rr_mean", "rr_std",
        clip(F.col("rr_mean") - previous("rr_mean"), -128, 127).alias("drr"),
        "large_move_pct", "minor_move_pct",
        F.greatest(F.col("turnovers") - previous("turnovers"), F.lit(0)).alias("turnovers_delta"),
        F.greatest(F.col("apnea") - previous("apnea"), F.lit(0)).alias("apnea_delta"),
        "flags", "vib_move_pct", "vib_resp_q", bits.alias("agree_flags"),
    )


def index_range(df: DataFrame, length: str, out: str, spread: bool = False) -> DataFrame:
    """One row per index ``0 .. length - 1``, exploded block by block.

    ``spread`` deals the blocks out first: for a few rows with long ranges.
    """
    last = F.col(length) - 1
    blocks = df.filter(last >= 0).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / BLOCK_ROWS)))
    )
    if spread:  # a number of partitions is named, since blocks look too small to be left apart
        blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns, "_b")
    low = F.col("_b") * BLOCK_ROWS
    return blocks.withColumn(
        out, F.explode(F.sequence(low, F.least(low + BLOCK_ROWS - 1, last.cast("bigint"))))
    ).drop("_b")


def block_pieces(df: DataFrame, first: str, count: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Index ranges ``first .. first + count - 1`` cut at block borders: ``_block``, ``_low``, ``_high`` per piece."""
    last = F.col(first) + F.col(count) - 1
    cut = df.filter(F.col(count) > 0).withColumn(BLOCK, F.explode(F.sequence(block_of(first, size), block_of(last, size))))
    low = F.greatest(F.col(first), F.col(BLOCK) * size)
    return cut.withColumns({"_low": low, "_high": F.least(last, F.col(BLOCK) * size + size - 1)}).drop(first, count)


def hypnogram_from_events(
    events: DataFrame, keys: Sequence[str], epoch_seconds: int = EPOCH_SECONDS
) -> DataFrame:
    """Stage events ``(line_no, clock_sec, duration_sec, stage)`` to a hypnogram (WIN-02).

    The clock rolls over midnight whenever it goes back; events are expanded by
    duration, a later event wins, uncovered epochs are unknown.
    """
    keys = list(keys)
    seq = with_neighbours(events, keys, ["line_no"], block_of("line_no"), ["clock_sec"])
    drop = F.when(F.col("prev").isNotNull() & (F.col("clock_sec") < F.col("prev.clock_sec")), 1).otherwise(0)
    rolled = running_totals(
        seq.withColumn("_drop", drop).withColumn(BLOCK, block_of("line_no")),
        keys, ["line_no"], BLOCK, {"_days": F.col("_drop")},
    )
    timed = rolled.withColumn("_abs", F.col("clock_sec") + F.col("_days") * 86400).filter(
        F.bround("duration_sec", 0) > 0
    )
    # stage events are few; three steps below read them
    timed = cut_lineage(timed.select(*keys, "line_no", "stage", "duration_sec", "_abs"), "stage-events")
    base = timed.groupBy(*keys).agg(F.min_by("_abs", "line_no").alias("_base"))
    placed = timed.join(base, keys).select(
        *keys,
        "line_no",
        "stage",
        F.bround((F.col("_abs") - F.col("_base")) / F.lit(float(epoch_seconds)), 0).cast("bigint").alias("_at"),
        F.greatest(
            F.bround(F.bround("duration_sec", 0) / F.lit(float(epoch_seconds)), 0), F.lit(1.0)
        ).cast("bigint").alias("_n"),
        (F.bround("duration_sec", 0) % epoch_seconds != 0).alias("_odd"),
    )
    lengths = placed.groupBy(*keys).agg(
        F.max(F.col("_at") + F.col("_n")).alias("_len"), F.max("_odd").alias("odd_duration")
    )
    # Events and grid travel as pieces of index blocks and become epochs where they arrive: the lists
    # of epochs, far longer than a planner can see, are neither shuffled nor ever sent to every task.
    count = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = block_pieces(lengths.withColumn("_at", F.lit(0).cast("bigint")), "_at", "_len").withColumn("_grid", F.lit(True))
    pieces = block_pieces(placed.drop("_odd"), "_at", "_n").unionByName(grid, allowMissingColumns=True)
    epochs = pieces.repartition(count, *keys, BLOCK).withColumn("epoch_index", F.explode(F.sequence("_low", "_high")))
    scored = epochs.groupBy(*keys, BLOCK, "epoch_index").agg(
        F.max("odd_duration").alias("odd_duration"), F.max_by("stage", "line_no").alias("stage"), F.max("_grid").alias("_grid")
    )
    return scored.filter("_grid").select(
        *keys, "epoch_index", "odd_duration", F.coalesce("stage", F.lit(STAGE_UNKNOWN)).alias("stage")
    )


def merge_annotations(
    hypnogram: DataFrame, notes: DataFrame, keys: Sequence[str], epoch_seconds: int = EPOCH_SECONDS
) -> DataFrame:
    """Fill unknown epochs from annotations ``(onset_sec, duration_sec, label, stage)`` (WIN-03).

    Annotations apply in (onset, label) order; a known stage is never replaced
    and a differing annotation is a conflict.
    """
    keys = list(keys)
    size = float(epoch_seconds)
    placed = notes.filter(F.col("stage").isNotNull()).select(
        *keys,
        F.struct("onset_sec", "label").alias("_order"),
        F.col("stage").alias("_s"),
        F.greatest(F.bround(F.col("onset_sec") / size, 0), F.lit(0.0)).cast("bigint").alias("_at"),
        F.greatest(
            F.bround(F.greatest(F.col("duration_sec"), F.lit(size)) / size, 0), F.lit(1.0)
        ).cast("bigint").alias("_n"),
    )
    known = F.col("_s") != STAGE_UNKNOWN
    per_epoch = (
        index_range(placed, "_n", "_k")
        .groupBy(*keys, (F.col("_at") + F.col("_k")).alias("epoch_index"))
        .agg(
            F.min_by(F.when(known, F.col("_s")), F.when(known, F.col("_order"))).alias("_first"),
            F.min(F.when(known, F.col("_s"))).alias("_low"),
            F.max(F.when(known, F.col("_s"))).alias("_high"),
            F.min(F.when(known, F.col("_order"))).alias("_set_at"),
            F.max(F.when(~known, F.col("_order"))).alias("_unscored_at"),
        )
    )
    scored = F.col("stage") != STAGE_UNKNOWN
    differs = (F.col("_low") != F.col("_final")) | (F.col("_high") != F.col("_final"))
    late_unscored = F.when(scored, F.col("_unscored_at").isNotNull()).otherwise(
        F.coalesce(F.col("_unscored_at") > F.col("_set_at"), F.lit(False))
    )
    return (
        hypnogram.join(per_epoch, [*keys, "epoch_index"], "left")
        .withColumn(
            "_final",
            F.when(scored, F.col("stage")).otherwise(F.coalesce("_first", F.lit(STAGE_UNKNOWN))),
        )
        .withColumn("conflict", F.coalesce(differs, F.lit(False)) | F.coalesce(late_unscored, F.lit(False)))
        .select(*keys, "epoch_index", F.col("_final").alias("stage"), "conflict")
    )


def valid_mask(stage: Column, epoch_valid: Column) -> Column:
    """Scored and valid (WIN-08)."""
    return (stage != STAGE_UNKNOWN) & epoch_valid


def day_bucket(ts: Column) -> Column:
    """Start of the UTC day (WIN-09)."""
    return F.date_trunc("day", ts)
