"""Signal operators on the long ``samples`` table (SIG-01 .. SIG-34).

Filters are windowed-sinc FIR kernels and spectra are plain sums, so the work
stays in Spark. Samples of a channel are dense in ``sample_idx``; all windows
run inside bounded blocks of a channel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightframe.functions.numeric import clip
from nightframe.functions.stages import normal_label
from nightframe.operators.evaluation import is_finite
from nightframe.operators.ordered import (
    BLOCK,
    block_of,
    exact_quantiles,
    running_totals,
    with_frame,
    with_halo,
    with_neighbours,
)
from nightframe.operators.scan import Gate, Slew, Smooth, scan
from nightframe.schema import BLOCK_ROWS
from nightframe.session import cut_lineage

SAMPLE_BLOCK = 16384
KEYS = ["recording_id", "channel"]

# --- fixed values -----------------------------------------------------------
CHANNEL_ALIASES = {
    "ecg": ["ecg1 ecg2", "ecg", "ekg", "ecg1", "ecg2", "x2", "heart rate varia"],
    "resp": [
        "pleth", "torace", "thorax", "addome", "adddome", "abdomen", "abdo", "flusso",
        "flow", "x3", "x4", "x5", "x6", "cannula", "canula", "termistore",
    ],
    "emg": ["emg1 emg2", "emg emg", "emg1", "emg2", "emg", "chin1", "chin2", "chin", "x1", "deltoide"],
    "movement": [
        "position", "posizione", "dx1 dx2", "sx1 sx2", "tib dx", "tib sx", "tib sin", "stat",
        "roc loc", "loc", "roc", "x7", "x8",
    ],
}
UNAMBIGUOUS = ["ecg"]
EPOCH_SEC = 30
RR_BAND_HZ = (0.1, 0.5)
HR_RANGE, RR_RANGE = (30.0, 220.0), (4.0, 40.0)
HR_JUMP, HR_ALPHA, HR_GAP, HR_MEDIAN = 15.0, 0.3, 2, 5
MIN_BEATS, MIN_SQI, MIN_BREATHS = 8, 0.4, 2
RR_CONF_MIN, RR_ALPHA, RR_AGREE_TOL = 0.4, 0.4, 2.0
BAND_SCALE, PEAK_SCALE, AC_SCALE = 0.4, 5.0, 0.8
MINOR_K, LARGE_K = 3.0, 6.0
IMU_LARGE, IMU_MINOR, GRAVITY = 0.8, 0.15, 9.81
QC_LIMITS = {
    "nan_inf_fraction": 0.02, "flatline_fraction": 0.9, "clipping_fraction": 0.3,
    "variance_min": 1e-8, "ecg_abs_max": 10000.0, "ecg_min_peaks": 5, "eeg_ratio_min": 0.01,
}
# --- end of fixed values ----------------------------------------------------


# --- channels and epochs ----------------------------------------------------
def resolve_channels(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Logical channel of each recording from its labels ``(label, ord)`` (SIG-01).

    The first alias in priority order that any label contains decides, then the
    first such label. Several distinct ECG labels for that alias are an error row.
    """
    keys = list(keys)
    table = F.array(
        *[
            F.struct(F.lit(name).alias("logical"), F.lit(i).alias("priority"), F.lit(alias).alias("alias"))
            for name, aliases in CHANNEL_ALIASES.items()
            for i, alias in enumerate(aliases)
        ]
    )
    clean = labels.withColumn("_l", normal_label(F.col("label")))
    hits = clean.select(
        *keys, "label", "ord", "_l",
        F.explode(F.filter(table, lambda a: F.contains(F.col("_l"), a["alias"]))).alias("a"),
    )
    per_alias = hits.groupBy(*keys, F.col("a.logical").alias("logical"), F.col("a.priority").alias("priority")).agg(
        F.min(F.struct("ord", "label")).alias("_first"), F.count_distinct("_l").alias("_labels")
    )
    best = per_alias.groupBy(*keys, "logical").agg(
        F.min_by(F.struct("_first", "_labels"), "priority").alias("_b")
    )
    ambiguous = F.col("logical").isin(*UNAMBIGUOUS) & (F.col("_b._labels") > 1)
    return best.select(
        *keys, "logical",
        F.when(~ambiguous, F.col("_b._first.label")).alias("label"),
        F.when(ambiguous, "E_CHANNEL_AMBIGUOUS").alias("error"),
    )


def first_column(values: Column) -> Column:
    """First column of a multi-column sample, non-finite as 0 (SIG-02)."""
    x = F.get(values, F.lit(0)).cast("double")
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def samples_per_epoch(fs: Column | float, epoch_sec: int = EPOCH_SEC) -> Column:
    rate = fs if isinstance(fs, Column) else F.lit(float(fs))
    return F.bround(rate * epoch_sec, 0).cast("bigint")


def with_epoch(df: DataFrame, epoch_sec: int = EPOCH_SEC, offset: int = 0) -> DataFrame:
    """Epoch number of each sample and its position inside the epoch (SIG-03)."""
    spe = samples_per_epoch(F.col("fs"), epoch_sec)
    return df.withColumns(
        {
            "epoch_index": F.floor(F.col("sample_idx") / spe).cast("bigint") - offset,
            "n": (F.col("sample_idx") % spe).cast("bigint"),
        }
    )


def alignment(samples: DataFrame, expected: DataFrame, mode: str = "reconcile", epoch_sec: int = EPOCH_SEC) -> DataFrame:
    """One decision row per channel: exact, reconciled (short/long) or an error (SIG-04).

    ``expected`` has ``recording_id, n_epochs``. In ``strict`` mode a length
    mismatch is an error row.
    """
    have = samples.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("available"), F.max("fs").alias("fs"))
    spe = samples_per_epoch(F.col("fs"), epoch_sec)
    out = have.join(expected, "recording_id").withColumn("expected", spe * F.col("n_epochs"))
    gap = F.col("available") != F.col("expected")
    reason = F.when(gap, F.when(F.col("available") < F.col("expected"), "short").otherwise("long"))
    return out.withColumns(
        {
            "status": F.when(~gap, "exact").otherwise("error" if mode == "strict" else "reconciled"),
            "reason": reason,
            "error": F.when(gap, "E_ALIGN_MISMATCH") if mode == "strict" else F.lit(None).cast("string"),
            "valid_epochs": F.least(F.floor(F.col("available") / spe), F.col("n_epochs")),
        }
    )


def covered_epochs(samples: DataFrame, epoch_sec: int = EPOCH_SEC, offset: int = 0) -> DataFrame:
    """Epochs that are fully covered by samples (SIG-04)."""
    counts = with_epoch(samples, epoch_sec, offset).groupBy(*KEYS, "epoch_index").agg(
        F.count(F.lit(1)).alias("samples"), F.max("fs").alias("fs")
    )
    full = (F.col("samples") == samples_per_epoch(F.col("fs"), epoch_sec)) & (F.col("epoch_index") >= 0)
    return counts.withColumn("valid", full).drop("fs")


# --- filtering and thresholds ------------------------------------------------
def sinc_kernel(fs: float, low: float | None, high: float | None, half: int) -> list[float]:
    """Hamming-windowed sinc taps of a low-pass or band-pass, ``2 * half + 1`` long."""
    def lowpass(cut: float) -> np.ndarray:
        n = np.arange(-half, half + 1)
        return 2 * cut / fs * np.sinc(2 * cut / fs * n)

    taps = lowpass(min(high if high is not None else fs / 2, fs / 2))
    if low is not None:
        taps = taps - lowpass(low)
    taps = taps * (0.54 + 0.46 * np.cos(np.pi * np.arange(-half, half + 1) / half))
    if low is None:
        taps = taps / taps.sum()
    return [float(t) for t in taps]


def fir(df: DataFrame, keys: Sequence[str], kernel: Sequence[float], out: str, value: str = "value", index: str = "sample_idx", causal: bool = False) -> DataFrame:
    """Convolution with a fixed kernel; samples outside the signal count as 0 (SIG-05).

    Causal filtering looks only back, zero-phase is centred. Each block carries
    the few samples of its neighbours that its border needs.
    """
    taps = len(kernel)
    before, after = (taps - 1, 0) if causal else (taps // 2, taps // 2)
    spread = with_halo(df, index, before, after, SAMPLE_BLOCK)
    order = Window.partitionBy(*keys, BLOCK).orderBy(index)
    terms = []
    for k, weight in enumerate(kernel):
        shift = k - after
        x = F.col(value) if shift == 0 else F.lag(value, shift).over(order) if shift > 0 else F.lead(value, -shift).over(order)
        terms.append(F.coalesce(x, F.lit(0.0)) * F.lit(weight))
    total = reduce(lambda a, b: a + b, terms)
    return spread.withColumn(out, total).filter(F.col(BLOCK) == F.col("_own")).drop(BLOCK, "_own")


def robust_scale(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Exact median and median absolute deviation per channel, and the standard
    deviation that replaces a MAD of 0 (SIG-06).

    Both are stored, a row per channel each: the passes of a quantile would
    else hold the plan of the one before several times over.
    """
    keys = list(keys)
    med = cut_lineage(exact_quantiles(df, keys, value, {"median": 0.5}), "medians")
    away = df.select(*keys, value).join(med, keys).withColumn("_away", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(away, keys, "_away", {"mad": 0.5})
    std = df.groupBy(*keys).agg(F.stddev_pop(value).alias("std"))
    scaled = std.join(med, keys).join(mad, keys).withColumn(
        "scale", F.when(F.col("mad") == 0, F.col("std")).otherwise(F.col("mad"))
    )
    return cut_lineage(scaled, "scales")


def robust_threshold(df: DataFrame, keys: Sequence[str], factor: float, value: str = "value") -> DataFrame:
    """``median + factor * MAD`` per channel, exactly (SIG-06)."""
    return robust_scale(df, keys, value).withColumn("threshold", F.col("median") + factor * F.col("mad"))


# --- peaks and rates ---------------------------------------------------------
def local_maxima(df: DataFrame, keys: Sequence[str], value: str, index: str = "sample_idx") -> DataFrame:
    """Strict local maxima; a flat top counts once, at its middle."""
    steps = with_neighbours(
        df.select(*keys, index, value), keys, [index], block_of(index, SAMPLE_BLOCK), [value], dense=SAMPLE_BLOCK
    )
    starts = steps.filter(F.col("prev").isNull() | (F.col(f"prev.{value}") != F.col(value))).drop("prev")
    runs = with_neighbours(starts, keys, [index], block_of(index, SAMPLE_BLOCK), [index, value], next_="next")
    top = (F.col(value) > F.col(f"prev.{value}")) & (F.col(value) > F.col(f"next.{value}"))
    middle = F.floor((F.col(index) + F.col(f"next.{index}") - 1) / 2).cast("bigint")
    return runs.filter(top).select(*keys, middle.alias(index), value)


def spaced(positions: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks in order stay: the highest (of equals the last) removes all nearer than ``distance``, and so on.

    Only peaks that stay look at their neighbours, and these are at least
    ``distance`` apart: time grows with the number of peaks.
    """
    state = np.zeros(len(positions), np.int8)  # 1: stays, 2: goes
    first = np.searchsorted(positions, positions - distance, side="right")
    after = np.searchsorted(positions, positions + distance, side="left")
    for k in np.lexsort((positions, heights))[::-1].tolist():
        if not state[k]:
            state[first[k] : after[k]] = 2
            state[k] = 1
    return state == 1


def space_peaks(peaks: DataFrame, keys: Sequence[str], distance: int, value: str, index: str = "sample_idx", rounds: int = 3) -> DataFrame:
    """Keep peaks at least ``distance`` apart; the higher peak wins, then the later.

    A peak that is highest among all open peaks within reach is final, and so is
    the removal of its neighbours. A few such rounds settle nearly everything
    with windows over one shuffle (each round looks ``2 * reach`` further); what
    stays open is cut into independent clusters and settled in order. Candidate
    peaks, a small part of the samples, are stored between the steps.
    """
    if distance <= 1:
        return peaks
    keys = list(keys)
    reach = distance - 1
    far = 2 * reach * rounds
    near = Window.partitionBy(*keys, BLOCK).orderBy(index).rangeBetween(-reach, reach)
    stored = cut_lineage(peaks.select(*keys, index, value), "peaks")
    out = with_halo(stored, index, far, far, SAMPLE_BLOCK).withColumn("_state", F.lit(0))
    rank = F.struct(value, index)
    for _ in range(rounds):
        out = out.withColumn("_top", F.max(F.when(F.col("_state") == 0, rank)).over(near))
        out = out.withColumn("_win", ((F.col("_state") == 0) & (F.col("_top") == rank)).cast("int"))
        out = out.withColumn("_near", F.max("_win").over(near))
        settled = F.when(F.col("_state") != 0, F.col("_state")).when(F.col("_win") == 1, 1).when(F.col("_near") == 1, 2).otherwise(0)
        out = out.withColumn("_state", settled)
    out = cut_lineage(
        out.filter((F.col(BLOCK) == F.col("_own")) & (F.col("_state") != 2)).select(*keys, index, value, "_state"), "peaks"
    )
    kept = out.filter(F.col("_state") == 1).drop("_state")
    open_ = out.filter(F.col("_state") == 0).drop("_state")
    gaps = with_neighbours(open_, keys, [index], block_of(index, SAMPLE_BLOCK), [index])
    apart = F.col("prev").isNull() | (F.col(index) - F.col(f"prev.{index}") >= distance)
    marked = gaps.withColumn("_new", apart.cast("int")).withColumn(BLOCK, block_of(index, SAMPLE_BLOCK)).drop("prev")
    clusters = running_totals(marked, keys, [index], BLOCK, {"_cluster": F.col("_new")}).drop("_new", BLOCK)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        keep = spaced(pdf[index].to_numpy(), pdf[value].to_numpy(dtype=float), distance)
        return pdf[keep][[*keys, index, value]]

    fields = [peaks.schema[c] for c in (*keys, index, value)]
    rest = clusters.groupBy(*keys, "_cluster").applyInPandas(settle, T.StructType(fields))
    return kept.select(*keys, index, value).unionByName(rest)


def detect_peaks(df: DataFrame, keys: Sequence[str], distance: int, value: str = "value", threshold: DataFrame | None = None, index: str = "sample_idx") -> DataFrame:
    """Local maxima above a per-key height with a minimum spacing (SIG-07)."""
    tops = local_maxima(df, keys, value, index)
    if threshold is not None:
        tops = tops.join(threshold.select(*keys, "threshold"), list(keys)).filter(F.col(value) >= F.col("threshold")).drop("threshold")
    return space_peaks(tops, keys, distance, value, index)


def intervals(peaks: DataFrame, keys: Sequence[str], fs: float, low: float, high: float, index: str = "sample_idx") -> DataFrame:
    """Intervals between consecutive peaks, validity and rate; time is the later peak (SIG-08)."""
    seq = with_neighbours(peaks, keys, [index], block_of(index, SAMPLE_BLOCK), [index])
    gap = (F.col(index) - F.col(f"prev.{index}")) / F.lit(float(fs))
    valid = gap.between(low, high)
    return seq.withColumns({"interval": gap, "valid": F.coalesce(valid, F.lit(False))}).withColumn(
        "rate", F.when(F.col("valid"), 60.0 / F.col("interval"))
    ).drop("prev")


def rate_per_epoch(
    beats: DataFrame, keys: Sequence[str], fs: float, min_peaks: int = 0, min_sqi: float = 0.0,
    min_rates: int = 1, limits: tuple[float, float] | None = None, index: str = "sample_idx",
) -> DataFrame:
    """Mean and population std of rates per epoch, null where a gate fails (SIG-09, SIG-16)."""
    spe = int(round(fs * EPOCH_SEC))
    epoch = F.floor(F.col(index) / spe).cast("bigint")
    agg = beats.groupBy(*keys, epoch.alias("epoch_index")).agg(
        F.count(F.lit(1)).alias("peaks"), F.count("interval").alias("total"), F.count("rate").alias("valid"),
        F.avg("rate").alias("_mean"), F.stddev_pop("rate").alias("_std"),
    )
    sqi = F.coalesce(F.try_divide(F.col("valid"), F.col("total")), F.lit(0.0))
    ok = (F.col("peaks") >= min_peaks) & (sqi >= min_sqi) & (F.col("valid") >= min_rates)
    if limits is not None:
        ok = ok & F.col("_mean").between(*limits)
    return agg.withColumn("sqi", sqi).select(
        *keys, "epoch_index", "peaks", "sqi", F.when(ok, F.col("_mean")).alias("mean"), F.when(ok, F.col("_std")).alias("std")
    )


# --- smoothing along epochs --------------------------------------------------
def fill_gaps(df: DataFrame, keys: Sequence[str], value: str, out: str, max_gap: int = HR_GAP, causal: bool = False, index: str = "epoch_index") -> DataFrame:
    """Fill runs of at most ``max_gap`` nulls between known values (SIG-10).

    Linear interpolation, or the last value when ``causal``. Only known rows are
    paired, so no window has to look past a long gap.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, index, value)
    pairs = with_neighbours(known, keys, [index], block_of(index), [index, value], prev=None, next_="next")
    width = F.col(f"next.{index}") - F.col(index)
    short = pairs.filter((width > 1) & (width <= max_gap + 1))
    steps = short.withColumn("_k", F.explode(F.sequence(F.lit(1).cast(width_type(df, index)), width - 1)))
    share = F.col("_k") / (F.col(f"next.{index}") - F.col(index))
    filled = F.col(value) if causal else F.col(value) + (F.col(f"next.{value}") - F.col(value)) * share
    fills = steps.select(*keys, (F.col(index) + F.col("_k")).alias(index), filled.alias("_fill"))
    return df.join(fills, [*keys, index], "left").withColumn(out, F.coalesce(value, "_fill")).drop("_fill")


def width_type(df: DataFrame, index: str) -> str:
    return df.schema[index].dataType.simpleString()


def rolling_median(df: DataFrame, keys: Sequence[str], value: str, out: str, width: int = HR_MEDIAN, causal: bool = False, index: str = "epoch_index") -> DataFrame:
    """Median of a short window at non-null rows, nulls ignored (SIG-11)."""
    before, after = (width - 1, 0) if causal else (width // 2, width // 2)
    framed = with_frame(df, keys, index, before, after, {"_vals": F.collect_list(value)})
    s = F.array_sort("_vals")
    n = F.size("_vals")
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return framed.withColumn(out, F.when(F.col(value).isNotNull(), mid)).drop("_vals")


def slew_limit(df: DataFrame, keys: Sequence[str], value: str, out: str, limit: float = HR_JUMP, index: str = "epoch_index") -> DataFrame:
    """Cap each change against the capped predecessor, reset on null (SIG-12)."""
    return scan(df, keys, index, Slew(value, limit), out)


def ewma(df: DataFrame, keys: Sequence[str], value: str, out: str, alpha: float = HR_ALPHA, index: str = "epoch_index") -> DataFrame:
    """Exponential smoothing, reset on null (SIG-13)."""
    return scan(df, keys, index, Smooth(value, alpha), out)


def rolling_mean(df: DataFrame, keys: Sequence[str], value: str, out: str, width: int, causal: bool = False, index: str = "epoch_index") -> DataFrame:
    """Mean of a short window at non-null rows (SIG-13)."""
    before, after = (width - 1, 0) if causal else (width // 2, width // 2)
    framed = with_frame(df, keys, index, before, after, {"_m": F.avg(value)})
    return framed.withColumn(out, F.when(F.col(value).isNotNull(), F.col("_m"))).drop("_m")


def first_difference(df: DataFrame, keys: Sequence[str], value: str, out: str, index: str = "epoch_index", rounding: str = "half_even") -> DataFrame:
    """Change from the previous epoch as int8, null if either is unknown (SIG-14)."""
    seq = with_neighbours(df, keys, [index], block_of(index), [index, value], dense=BLOCK_ROWS)
    delta = F.when(F.col(f"prev.{index}") == F.col(index) - 1, F.col(value) - F.col(f"prev.{value}"))
    whole = F.bround(delta, 0) if rounding == "half_even" else F.when(delta >= 0, F.floor(delta)).otherwise(F.ceil(delta))
    return seq.withColumn(out, clip(whole, -128, 127).cast("int")).drop("prev")


def delta_metrics(df: DataFrame, keys: Sequence[str], value: str, limit: float = HR_JUMP, index: str = "epoch_index") -> DataFrame:
    """Jump rate and p95 of absolute changes, reset on null (SIG-15)."""
    seq = with_neighbours(df, keys, [index], block_of(index), [index, value], dense=BLOCK_ROWS)
    follows = F.col(f"prev.{index}") == F.col(index) - 1
    deltas = seq.withColumn("_d", F.when(follows, F.abs(F.col(value) - F.col(f"prev.{value}"))))
    rates = deltas.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.count_if(F.col("_d") > limit), F.count("_d")), F.lit(0.0)).alias("jump_rate")
    )
    p95 = exact_quantiles(deltas.filter(F.col("_d").isNotNull()), keys, "_d", {"delta_p95": 0.95})
    return rates.join(p95, list(keys), "left")


def counter_delta(df: DataFrame, keys: Sequence[str], value: str, out: str, index: str = "epoch_index") -> DataFrame:
    """Non-negative step of a cumulative counter, null on the first epoch (SIG-27)."""
    seq = with_neighbours(df, keys, [index], block_of(index), [value])
    step = F.when(F.col("prev").isNotNull(), clip(F.col(value) - F.col(f"prev.{value}"), 0, 255))
    return seq.withColumn(out, step.cast("int")).drop("prev")


# --- ECG-derived respiration -------------------------------------------------
def interpolate_peaks(peaks: DataFrame, keys: Sequence[str], fs: float, grid_fs: float, lengths: DataFrame, value: str = "value", index: str = "sample_idx") -> DataFrame:
    """Peak amplitudes on a regular grid by linear interpolation (SIG-17, JON-08).

    Every grid point lies between two consecutive peaks, so each pair emits its
    own points and no as-of join is needed. Before the first and after the last
    peak the amplitude is constant. ``lengths`` has the sample count ``available``.
    """
    keys = list(keys)
    pairs = with_neighbours(peaks, keys, [index], block_of(index, SAMPLE_BLOCK), [index, value], next_="next")
    ratio = grid_fs / fs
    sized = pairs.join(lengths.select(*keys, "available"), keys)
    last = F.ceil(F.col("available") * ratio).cast("bigint") - 1
    begin = F.when(F.col("prev").isNull(), F.lit(0).cast("bigint")).otherwise(F.ceil(F.col(index) * ratio).cast("bigint"))
    stop = F.when(F.col("next").isNull(), last).otherwise(F.ceil(F.col(f"next.{index}") * ratio).cast("bigint") - 1)
    stop = F.least(stop, last)
    grid = sized.filter(begin <= stop).withColumn("_g", F.explode(F.sequence(begin, stop)))
    at = F.col("_g") / ratio
    slope = (F.col(f"next.{value}") - F.col(value)) / (F.col(f"next.{index}") - F.col(index))
    line = F.col(value) + F.greatest(at - F.col(index), F.lit(0.0)) * F.coalesce(slope, F.lit(0.0))
    return grid.select(*keys, F.col("_g").alias("sample_idx"), F.lit(float(grid_fs)).alias("fs"), line.alias("value"))


def spectrum_bins(n: int, fs: float, band: tuple[float, float]) -> list[int]:
    return [k for k in range(1, n // 2 + 1) if band[0] - 1e-12 <= k * fs / n <= band[1] + 1e-12]


def spectral(df: DataFrame, keys: Sequence[str], n: int, fs: float, bands: dict[str, tuple[float, float]], pos: str = "n", value: str = "value") -> DataFrame:
    """Periodogram powers of complete segments as sums over samples (SIG-18).

    Each DFT bin of a band is one cosine and one sine sum, combined on the map
    side; the total follows from Parseval's identity. Adds ``total`` and, per
    band, an array of bin powers. Segments with missing samples are dropped.
    """
    bins = sorted({k for band in bands.values() for k in spectrum_bins(n, fs, band)})
    x = F.col(value)
    sums = [F.count(F.lit(1)).alias("_count"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"),
            F.sum(F.when(F.col(pos) % 2 == 0, x).otherwise(-x)).alias("_ny")]
    for k in bins:
        angle = F.lit(2 * math.pi * k / n) * F.col(pos)
        sums += [F.sum(x * F.cos(angle)).alias(f"_c{k}"), F.sum(x * F.sin(angle)).alias(f"_i{k}")]
    agg = df.groupBy(*keys).agg(*sums).filter(F.col("_count") == n)
    centred = F.greatest(F.lit(float(n)) * F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0.0))
    nyquist = F.col("_ny") * F.col("_ny") if n % 2 == 0 else F.lit(0.0)
    out = {"total": (centred + nyquist) / 2}
    for name, band in bands.items():
        powers = [F.col(f"_c{k}") * F.col(f"_c{k}") + F.col(f"_i{k}") * F.col(f"_i{k}") for k in spectrum_bins(n, fs, band)]
        out[name] = F.array(*powers)
    return agg.select(*keys, *[c.alias(nm) for nm, c in out.items()])


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def rate_by_spectrum(df: DataFrame, keys: Sequence[str], n: int, fs: float, band: tuple[float, float] = RR_BAND_HZ, pos: str = "n", value: str = "value") -> DataFrame:
    """Dominant in-band rate, band power ratio and peak prominence (SIG-18)."""
    power = spectral(df, keys, n, fs, {"_band": band}, pos, value)
    bins = spectrum_bins(n, fs, band)
    inside = array_sum(F.col("_band"))
    top = F.array_max("_band")
    freq = F.element_at(F.array(*[F.lit(k * fs / n) for k in bins]), F.array_position("_band", top).cast("int"))
    some = inside > 0
    return power.select(
        *keys,
        F.when(some, freq * 60).otherwise(F.lit(0.0)).alias("rr_psd"),
        F.when(some, inside / (F.col("total") + 1e-9)).otherwise(F.lit(0.0)).alias("band_ratio"),
        F.when(some, top / (array_median(F.col("_band")) + 1e-9)).otherwise(F.lit(0.0)).alias("peak_prominence"),
    )


def rate_by_autocorrelation(df: DataFrame, keys: Sequence[str], n: int, fs: float, band: tuple[float, float] = RR_BAND_HZ, pos: str = "n", value: str = "value") -> DataFrame:
    """Rate of the strongest lag between ``fs/high`` and ``fs/low`` (SIG-19).

    A segment has exactly ``n`` samples, so its array is bounded.
    """
    segs = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(pos, value))).alias("_r"), F.avg(value).alias("_m")
    ).filter(F.size("_r") == n)
    x = F.transform("_r", lambda r: r[value] - F.col("_m"))
    segs = segs.withColumn("_x", x)
    low, high = max(1, int(fs / band[1])), min(n - 1, int(fs / band[0]))

    def lag_sum(lag: Column) -> Column:
        a = F.slice(F.col("_x"), F.lit(1), F.lit(n) - lag)
        b = F.slice(F.col("_x"), lag + 1, F.lit(n) - lag)
        return array_sum(F.zip_with(a, b, lambda p, q: p * q))

    segs = segs.withColumns({"_c0": lag_sum(F.lit(0)), "_corr": F.transform(F.sequence(F.lit(low), F.lit(high)), lag_sum)})
    top = F.array_max("_corr")
    lag = F.array_position("_corr", top) + (low - 1)
    return segs.select(
        *keys,
        F.when(F.col("_c0") != 0, 60.0 * fs / lag).otherwise(F.lit(0.0)).alias("rr_ac"),
        F.when(F.col("_c0") != 0, top / F.col("_c0")).otherwise(F.lit(0.0)).alias("ac_peak"),
    )


def rate_by_peaks(df: DataFrame, keys: Sequence[str], fs: float, band: tuple[float, float] = RR_BAND_HZ, pos: str = "n", value: str = "value") -> DataFrame:
    """Rate from the median interval between peaks inside a segment (SIG-20)."""
    distance = max(1, int(fs / band[1]))
    peaks = detect_peaks(df, keys, distance, value, index=pos)
    gaps = intervals(peaks, keys, fs, 1.0 / band[1], 1.0 / band[0], pos).filter(F.col("valid"))
    med = gaps.groupBy(*keys).agg(F.sort_array(F.collect_list("interval")).alias("_g"))
    return med.select(*keys, (60.0 / array_median(F.col("_g"))).alias("rr_peak"))


def quality(value: Column, scale: float) -> Column:
    usable = is_finite(value) & (value > 0)
    return F.when(usable, clip(value / scale, 0.0, 1.0)).otherwise(F.lit(0.0))


def fuse_rates(df: DataFrame, tolerance: float = RR_AGREE_TOL) -> DataFrame:
    """Quality-weighted rate and confidence of up to three estimates (SIG-21).

    Input: ``rr_psd, rr_ac, rr_peak, band_ratio, peak_prominence, ac_peak``.
    """
    band, prom, ac = quality(F.col("band_ratio"), BAND_SCALE), quality(F.col("peak_prominence"), PEAK_SCALE), quality(F.col("ac_peak"), AC_SCALE)
    def estimate(rate: str, weight: Column) -> Column:
        r = F.coalesce(F.col(rate), F.lit(0.0))
        return F.when(r > 0, F.struct(r.alias("r"), weight.alias("w")))

    out = df.withColumns({"_qb": band, "_qp": prom, "_qa": ac})
    items = F.array(
        estimate("rr_psd", F.greatest("_qb", "_qp")),
        estimate("rr_ac", F.when(F.col("_qa") > 0, F.col("_qa")).otherwise(0.5)),
        estimate("rr_peak", F.when(F.col("_qp") > 0, F.col("_qp")).otherwise(0.5)),
    )
    out = out.withColumn("_e", F.filter(items, lambda e: e.isNotNull()))
    rates = F.transform("_e", lambda e: e["r"])
    weight = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["w"])
    weighted = F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["r"] * e["w"])
    out = out.withColumns({"_r": rates, "_w": weight, "_rw": weighted}).withColumn("_med", array_median(F.col("_r")))
    out = out.withColumn("_mad", array_median(F.transform("_r", lambda r: F.abs(r - F.col("_med")))))
    agree = F.when(
        F.size("_r") >= 2, F.greatest(F.lit(0.0), 1 - F.col("_mad") / F.greatest(F.lit(tolerance), 0.1 * F.col("_med")))
    ).otherwise(F.lit(0.5))
    sqi = 0.4 * F.col("_qb") + 0.4 * F.col("_qp") + 0.2 * F.col("_qa")
    some = F.size("_r") > 0
    return out.withColumns(
        {
            "rr_fused": F.when(~some, F.lit(0.0)).when(F.col("_w") > 0, F.col("_rw") / F.nullif("_w", F.lit(0.0))).otherwise(F.col("_med")),
            "rr_confidence": F.when(some, clip(0.6 * sqi + 0.4 * agree, 0.0, 1.0)).otherwise(F.lit(0.0)),
        }
    ).drop("_qb", "_qp", "_qa", "_e", "_r", "_w", "_rw", "_med", "_mad")


def gate_rates(df: DataFrame, keys: Sequence[str], rate: str = "rr_fused", conf: str = "rr_confidence", out: str = "rr", index: str = "epoch_index") -> DataFrame:
    """Accepted rate per epoch, blended with the previous one at low confidence (SIG-22)."""
    return scan(df, keys, index, Gate(rate, conf, RR_CONF_MIN, RR_ALPHA, *RR_RANGE), out)


def rate_spread(df: DataFrame, keys: Sequence[str], n: int, fs: float, seconds: int = 10, band: tuple[float, float] = RR_BAND_HZ, pos: str = "n", value: str = "value") -> DataFrame:
    """Population std of spectral rates of sub-windows, at least two needed (SIG-23)."""
    sub = int(fs * seconds)
    parts = df.filter(F.col(pos) < (n // sub) * sub).withColumns(
        {"_sub": F.floor(F.col(pos) / sub), "_p": F.col(pos) % sub}
    )
    rates = rate_by_spectrum(parts, [*keys, "_sub"], sub, fs, band, "_p", value).filter(F.col("rr_psd") > 0)
    agg = rates.groupBy(*keys).agg(F.stddev_pop("rr_psd").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return agg.select(*keys, F.when(F.col("_n") >= 2, F.col("_s")).otherwise(F.lit(0.0)).alias("rr_std"))


# --- movement, bed, quality --------------------------------------------------
def movement(df: DataFrame, keys: Sequence[str], envelope: str = "envelope") -> DataFrame:
    """Minor and large movement percentages and burst counts per full epoch (SIG-24, SIG-25)."""
    keys = list(keys)
    limits = robust_scale(df, keys, envelope).select(
        *keys, (F.col("median") + MINOR_K * F.col("scale")).alias("_minor"),
        (F.col("median") + LARGE_K * F.col("scale")).alias("_large"),
    )
    rows = with_epoch(df).join(limits, keys)
    large = F.col(envelope) > F.col("_large")
    inside = Window.partitionBy(*keys, "epoch_index").orderBy("n")
    rose = large & ~F.coalesce(F.lag(large).over(inside), F.lit(False))
    flagged = rows.withColumns({"_is_large": large.cast("int"), "_is_minor": (F.col(envelope) > F.col("_minor")).cast("int"), "_rise": rose.cast("int")})
    agg = flagged.groupBy(*keys, "epoch_index").agg(
        F.count(F.lit(1)).alias("_n"), F.max("fs").alias("_fs"),
        F.bround(100.0 * F.avg("_is_minor"), 0).cast("int").alias("minor_move_pct"),
        F.bround(100.0 * F.avg("_is_large"), 0).cast("int").alias("large_move_pct"),
        F.least(F.sum("_rise"), F.lit(255)).cast("int").alias("bursts"),
    )
    return agg.filter(F.col("_n") == samples_per_epoch(F.col("_fs"))).drop("_n", "_fs")


def in_bed(df: DataFrame, keys: Sequence[str], threshold: float = 0.5, value: str = "value") -> DataFrame:
    """Percent of samples above the threshold per full epoch (SIG-26)."""
    agg = with_epoch(df).groupBy(*keys, "epoch_index").agg(
        F.count(F.lit(1)).alias("_n"), F.max("fs").alias("_fs"),
        F.avg((F.col(value) > threshold).cast("double")).alias("_share"),
    ).filter(F.col("_n") == samples_per_epoch(F.col("_fs")))
    return agg.select(*keys, "epoch_index", F.bround(100 * F.col("_share"), 0).cast("int").alias("in_bed_pct"))


def respiration_quality(df: DataFrame, keys: Sequence[str], n: int, fs: float, band: tuple[float, float] = RR_BAND_HZ, total: tuple[float, float] = (0.05, 2.0)) -> DataFrame:
    """Share of band power in the total band, as 0..100 (SIG-28)."""
    power = spectral(with_epoch(df), [*keys, "epoch_index"], n, fs, {"_in": band, "_all": total})
    share = F.coalesce(F.try_divide(array_sum(F.col("_in")), array_sum(F.col("_all"))), F.lit(0.0))
    return power.select(*keys, "epoch_index", clip(F.bround(share * 100, 0), 0.0, 100.0).cast("int").alias("resp_quality"))


def vibration_features(df: DataFrame, keys: Sequence[str], n: int, fs: float, distance: int) -> DataFrame:
    """Movement, respiration rate and quality from one vibration channel (SIG-29)."""
    env = df.withColumn("envelope", F.abs("value"))
    move = movement(env, keys).select(*keys, "epoch_index", F.col("minor_move_pct").alias("vib_move_pct"))
    limit = robust_threshold(df, keys, 0.5)
    beats = intervals(detect_peaks(df, keys, distance, threshold=limit), keys, fs, 1.0, 10.0)
    rates = rate_per_epoch(beats, keys, fs, min_rates=MIN_BREATHS, limits=RR_RANGE).select(*keys, "epoch_index", F.col("mean").alias("vib_rr"))
    q = respiration_quality(df, keys, n, fs)
    on = [*keys, "epoch_index"]
    return move.join(q, on, "full_outer").join(rates, on, "full_outer")


def channel_qc(df: DataFrame, keys: Sequence[str] = tuple(KEYS), eeg_bands: dict[str, tuple[float, float]] | None = None, segment: int = 0, fs: float = 0.0) -> DataFrame:
    """Quality checks and verdict per channel (SIG-30).

    The EEG ratio averages periodograms of short segments instead of one
    transform of the whole night.
    """
    keys = list(keys)
    x = F.col("value")
    good = df.filter(is_finite(x))
    shape = df.groupBy(*keys).agg(
        F.avg(F.when(is_finite(x), 0.0).otherwise(1.0)).alias("nan_inf_fraction"),
        F.var_pop(F.when(is_finite(x), x)).alias("variance"),
        F.max(F.when(is_finite(x), F.abs(x))).alias("abs_max"),
        F.count_if(is_finite(x)).alias("_finite"),
    )
    seq = with_neighbours(good, keys, ["sample_idx"], block_of("sample_idx", SAMPLE_BLOCK), ["value"], next_="next")
    steps = seq.groupBy(*keys).agg(
        F.avg(F.when(F.col("prev").isNotNull(), (F.abs(x - F.col("prev.value")) < 1e-12).cast("double"))).alias("_flat"),
        F.count_if((x > F.col("prev.value")) & (x > F.col("next.value"))).alias("peak_count"),
    )
    ref = exact_quantiles(good.withColumn("_a", F.abs("value")), keys, "_a", {"_ref": 0.995})
    clipped = good.join(ref, keys).groupBy(*keys).agg(
        F.avg((F.abs(x) >= F.col("_ref")).cast("double")).alias("clipping_fraction")
    )
    out = shape.join(steps, keys, "left").join(clipped, keys, "left").withColumns(
        {
            "variance": F.coalesce("variance", F.lit(0.0)),
            "flatline_fraction": F.coalesce("_flat", F.lit(1.0)),
            "clipping_fraction": F.coalesce("clipping_fraction", F.lit(1.0)),
            "peak_count": F.coalesce("peak_count", F.lit(0)),
        }
    )
    ratio = F.lit(-1.0)
    if eeg_bands is not None:
        parts = good.withColumns({"_seg": F.floor(F.col("sample_idx") / segment), "_p": F.col("sample_idx") % segment})
        power = spectral(parts, [*keys, "_seg"], segment, fs, eeg_bands, "_p")
        sums = power.groupBy(*keys).agg(F.sum(array_sum(F.col("low"))).alias("_lo"), F.sum(array_sum(F.col("high"))).alias("_hi"))
        out = out.join(sums, keys, "left")
        ratio = F.coalesce(F.col("_lo") / (F.col("_hi") + 1e-9), F.lit(-1.0))
    out = out.withColumn("eeg_ratio", ratio)
    lim = QC_LIMITS
    passed = (
        (F.col("nan_inf_fraction") <= lim["nan_inf_fraction"]) & (F.col("flatline_fraction") <= lim["flatline_fraction"])
        & (F.col("variance") >= lim["variance_min"]) & (F.col("clipping_fraction") <= lim["clipping_fraction"])
    )
    ecg = (F.col("channel") != "ecg") | ((F.col("abs_max") <= lim["ecg_abs_max"]) & (F.col("peak_count") >= lim["ecg_min_peaks"]))
    eeg = (F.col("channel") != "eeg") | (F.col("eeg_ratio") < 0) | (F.col("eeg_ratio") >= lim["eeg_ratio_min"])
    return out.withColumn("passed", passed & ecg & eeg).drop("_flat", "_finite", "_lo", "_hi")


def channel_gate(qc: DataFrame, required: Sequence[str] = ("ecg",), keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Usable channels and recording errors (SIG-31): a failed required channel is
    an error row, a failed optional channel is dropped."""
    need = F.col("channel").isin(*required)
    action = F.when(F.col("passed"), "keep").when(need, "error").otherwise("drop")
    return qc.select(*keys, "channel", action.alias("action"), F.when(action == "error", "E_QC_FAIL").alias("error"))


def sample_windows(df: DataFrame, keys: Sequence[str], size: int, stride: int, index: str = "sample_idx") -> DataFrame:
    """Assign samples to fixed-size windows with a stride (SIG-32).

    Each sample names the windows it belongs to by arithmetic; only windows that
    fit into the signal are kept.
    """
    first = F.greatest(F.ceil((F.col(index) - size + 1) / stride), F.lit(0)).cast("bigint")
    last = F.floor(F.col(index) / stride).cast("bigint")
    lengths = df.groupBy(*keys).agg((F.max(index) + 1).alias("_len"))
    placed = df.filter(first <= last).withColumn("window_no", F.explode(F.sequence(first, last)))
    return (
        placed.join(lengths, list(keys))
        .filter(F.col("window_no") * stride + size <= F.col("_len"))
        .withColumn("offset", F.col(index) - F.col("window_no") * stride)
        .drop("_len")
    )


def imu_score(df: DataFrame, keys: Sequence[str], index: str = "sample_idx", ring: int = 10) -> DataFrame:
    """Movement score of accelerometer and gyroscope samples with a ring RMS (SIG-33).

    Input ``ax, ay, az, gx, gy, gz``. The ring starts with zeros, as on the device.
    """
    axes = ["ax", "ay", "az"]
    seq = with_neighbours(df, keys, [index], block_of(index, SAMPLE_BLOCK), axes, dense=SAMPLE_BLOCK)
    moved = reduce(lambda a, b: a + b, [F.abs(F.col(a) - F.coalesce(F.col(f"prev.{a}"), F.lit(0.0))) for a in axes])

    def norm(cols: Sequence[str]) -> Column:
        return F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols]))

    score = moved + 3.0 * norm(["gx", "gy", "gz"]) + 0.5 * F.abs(norm(axes) - GRAVITY)
    scored = seq.withColumn("score", score).drop("prev")
    framed = with_frame(
        scored.withColumn("_sq", F.col("score") * F.col("score")), keys, index, ring - 1, 0, {"_sum": F.sum("_sq")}, SAMPLE_BLOCK
    )
    rms = F.sqrt(F.col("_sum") / ring)
    level = F.when(rms > IMU_LARGE, "large").when(rms > IMU_MINOR, "minor").otherwise("still")
    return framed.withColumns({"rms": rms, "level": level}).drop("_sq", "_sum")


def prefer_respiration(resp: DataFrame, edr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Respiration-channel rates where a recording has one, else EDR (SIG-34)."""
    have = resp.select(*keys).distinct()
    fallback = edr.join(have, list(keys), "left_anti")
    return resp.withColumn("source", F.lit("resp")).unionByName(fallback.withColumn("source", F.lit("edr")))
