"""Signal operators: rates of synthetic signals, causality, spacing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframe.operators import signal as sig

KEYS = ["recording_id", "channel"]


def samples(spark, values, fs, channel="ecg"):
    rows = [("r", channel, i, float(fs), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recording_id string, channel string, sample_idx long, fs double, value double")


def test_heart_rate_of_one_hertz_spikes(spark):
    fs, t = 50, np.arange(50 * 90) / 50
    signal = 0.1 * np.sin(2 * np.pi * t)
    signal[::50] += 5.0
    df = samples(spark, signal, fs)
    flt = sig.fir(df, KEYS, sig.sinc_kernel(fs, 0.5, 20.0, 12), "filtered", causal=True)
    limit = sig.robust_threshold(flt, KEYS, 3.0, "filtered")
    beats = sig.intervals(sig.detect_peaks(flt, KEYS, 12, "filtered", limit), KEYS, fs, 0.25, 2.5)
    got = sig.rate_per_epoch(beats, KEYS, fs, sig.MIN_BEATS, sig.MIN_SQI, limits=sig.HR_RANGE).collect()
    assert len(got) == 3
    assert all(r.mean == pytest.approx(60, abs=1) for r in got)


def test_respiration_estimates_of_a_sine(spark):
    fs, n = 4, 120
    t = np.arange(n * 2) / fs
    df = sig.with_epoch(samples(spark, np.sin(2 * np.pi * 0.25 * t), fs, "resp"))
    keys = [*KEYS, "epoch_index"]
    psd = sig.rate_by_spectrum(df, keys, n, fs).collect()
    ac = sig.rate_by_autocorrelation(df, keys, n, fs).collect()
    peak = sig.rate_by_peaks(df, keys, fs).collect()
    assert [r.rr_psd for r in psd] == pytest.approx([15, 15], abs=2)
    assert [r.rr_ac for r in ac] == pytest.approx([15, 15], abs=1)
    assert [r.rr_peak for r in peak] == pytest.approx([15, 15], abs=1)


def test_spectrum_matches_fft(spark):
    x = np.random.default_rng(1).normal(size=120)
    df = sig.with_epoch(samples(spark, x, 4))
    got = sig.rate_by_spectrum(df, [*KEYS, "epoch_index"], 120, 4.0).first()
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    freq = np.fft.rfftfreq(120, 0.25)
    band = (freq >= 0.1 - 1e-9) & (freq <= 0.5 + 1e-9)
    assert got.rr_psd == pytest.approx(60 * freq[band][np.argmax(power[band])])
    assert got.band_ratio == pytest.approx(power[band].sum() / power.sum())
    assert got.peak_prominence == pytest.approx(power[band].max() / np.median(power[band]))


def test_causal_filter_of_a_prefix_is_the_prefix_of_the_filter(spark, monkeypatch):
    monkeypatch.setattr(sig, "SAMPLE_BLOCK", 64)
    x = np.random.default_rng(2).normal(size=300)
    kernel = sig.sinc_kernel(50, 0.5, 20.0, 5)
    full = sig.fir(samples(spark, x, 50), KEYS, kernel, "y", causal=True)
    part = sig.fir(samples(spark, x[:170], 50), KEYS, kernel, "y", causal=True)
    want = np.convolve(x, kernel)[:300]
    whole = [r.y for r in full.orderBy("sample_idx").collect()]
    assert whole == pytest.approx(list(want))
    assert [r.y for r in part.orderBy("sample_idx").collect()] == pytest.approx(whole[:170])


def spaced_by_hand(values, distance):
    """Local maxima (flat tops at their middle), highest first, later first on ties."""
    peaks, i = [], 1
    while i < len(values) - 1:
        j = i
        while j + 1 < len(values) and values[j + 1] == values[i]:
            j += 1
        if values[i - 1] < values[i] and j + 1 < len(values) and values[j + 1] < values[i]:
            peaks.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(peaks, key=lambda p: (values[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("rounds", [1, 3])
def test_peak_spacing_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(sig, "SAMPLE_BLOCK", 128)
    values = [float(v) for v in np.random.default_rng(4).integers(0, 9, 500)]
    df = samples(spark, values, 1)
    tops = sig.local_maxima(df, KEYS, "value")
    got = sig.space_peaks(tops, KEYS, 7, "value", rounds=rounds)
    assert sorted(r.sample_idx for r in got.collect()) == spaced_by_hand(values, 7)


def test_interpolation_matches_numpy(spark):
    peaks = [(3, 1.0), (10, 4.0), (17, -2.0)]
    df = spark.createDataFrame([("r", "ecg", i, v) for i, v in peaks], "recording_id string, channel string, sample_idx long, value double")
    size = spark.createDataFrame([("r", "ecg", 20)], "recording_id string, channel string, available long")
    got = sig.interpolate_peaks(df, KEYS, 2.0, 4.0, size).orderBy("sample_idx").collect()
    grid = np.arange(0, 10, 0.25)
    want = np.interp(grid, [i / 2 for i, _ in peaks], [v for _, v in peaks])
    assert [r.value for r in got] == pytest.approx(list(want))


def test_alignment_short_signal(spark):
    df = samples(spark, np.zeros(50), 10)
    expected = spark.createDataFrame([("r", 6)], "recording_id string, n_epochs int")
    strict = sig.alignment(df, expected, "strict", epoch_sec=1).first()
    loose = sig.alignment(df, expected, "reconcile", epoch_sec=1).first()
    assert strict.error == "E_ALIGN_MISMATCH"
    assert (loose.status, loose.reason, loose.valid_epochs) == ("reconciled", "short", 5)


def test_failed_required_channel_is_an_error_row(spark):
    qc = spark.createDataFrame([("r", "ecg", False), ("r", "emg", False), ("r", "resp", True)], "recording_id string, channel string, passed boolean")
    got = {r.channel: (r.action, r.error) for r in sig.channel_gate(qc).collect()}
    assert got == {"ecg": ("error", "E_QC_FAIL"), "emg": ("drop", None), "resp": ("keep", None)}


def test_nan_channel_fails_quality(spark):
    values = np.where(np.arange(100) % 10 == 0, np.nan, np.sin(np.arange(100)))
    got = sig.channel_qc(samples(spark, values, 1, "emg")).first()
    assert got.nan_inf_fraction == pytest.approx(0.1) and not got.passed


def test_sample_windows_only_complete(spark):
    got = sig.sample_windows(samples(spark, range(10), 1), KEYS, 4, 3).groupBy("window_no").agg(F.count("*").alias("n")).collect()
    assert {r.window_no: r.n for r in got} == {0: 4, 1: 4, 2: 4}


def test_spacing_of_a_staircase_in_linear_time():
    """A hundred thousand peaks, each higher than the one before, all in one cluster; random ones against a plain loop."""
    import time

    start = time.time()
    keep = sig.spaced(np.arange(100_000) * 2, np.arange(100_000.0), 5)
    assert time.time() - start < 5 and np.flatnonzero(keep)[-3:].tolist() == [99_993, 99_996, 99_999] and keep.sum() == 33_334
    rng = np.random.default_rng(4)
    for distance in (2, 7, 30):
        at = np.sort(rng.choice(600, 150, replace=False))
        high = rng.integers(0, 6, 150).astype(float)
        chosen = []
        for k in sorted(range(150), key=lambda k: (-high[k], -at[k])):
            if all(abs(at[k] - at[j]) >= distance for j in chosen):
                chosen.append(k)
        assert np.flatnonzero(sig.spaced(at, high, distance)).tolist() == sorted(chosen)
