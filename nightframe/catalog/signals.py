"""Signal queries (SIG-01 .. SIG-34, JON-08, SRC-10)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from nightframe.catalog.base import big, query, r6
from nightframe.catalog.views import PREDS, SAMPLES, epochs, predictions, read, samples
from nightframe.operators import signal as sig
from nightframe.operators.nights import positions
from nightframe.session import cut_lineage

KEY = ["recording_id", "channel"]
K = "recording_id, channel"
EK = [*KEY, "epoch_index"]
N = 30
BINS = sig.spectrum_bins(N, 1.0, (0.1, 0.5))
LOW = sig.sinc_kernel(1.0, None, 0.2, 3)
BAND = sig.sinc_kernel(1.0, 0.05, 0.3, 4)

_POS = "pos_v AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY epoch_index) - 1 AS INT) AS pos FROM preds_v)"
_LABEL = "CASE k % 12 WHEN 0 THEN 'ECG-1' WHEN 1 THEN 'ekg lead' WHEN 2 THEN 'Flow_nasal' WHEN 3 THEN 'PLETH' WHEN 4 THEN 'chin1' WHEN 5 THEN 'X5' WHEN 6 THEN 'Position' WHEN 7 THEN 'EMG emg' ELSE 'misc ' || k END"


def _alias_sql() -> str:
    rows = [
        f"('{name}', {i}, '{alias}')" for name, aliases in sig.CHANNEL_ALIASES.items() for i, alias in enumerate(aliases)
    ]
    return f"al(logical, priority, alias) AS (VALUES {', '.join(rows)})"


def stored_samples(spark, sf):
    """The samples written once, for operators that read them in several passes."""
    return cut_lineage(samples(spark, sf), "samples")


@query(
    "sig_01_resolve_channels",
    f"""WITH {PREDS}, {_POS}, {_alias_sql()}, l AS (SELECT recording_id, pos AS ord, {_LABEL} AS label FROM pos_v WHERE pos < 12 + recording_id % 9 OR pos >= 0),
h AS (SELECT recording_id, ord, label, trim(regexp_replace(translate(lower(trim(label)), '_-', '  '), '\\s+', ' ', 'g')) AS cl, logical, priority FROM l JOIN al ON contains(trim(regexp_replace(translate(lower(trim(label)), '_-', '  '), '\\s+', ' ', 'g')), alias)),
b AS (SELECT recording_id, logical, min(priority) AS p FROM h GROUP BY 1, 2),
c AS (SELECT h.recording_id, h.logical, arg_min(label, ord) AS label, count(DISTINCT cl) AS n FROM h JOIN b ON h.recording_id = b.recording_id AND h.logical = b.logical AND h.priority = b.p GROUP BY 1, 2)
SELECT recording_id, logical, CASE WHEN logical = 'ecg' AND n > 1 THEN NULL ELSE label END AS label, CASE WHEN logical = 'ecg' AND n > 1 THEN 'E_CHANNEL_AMBIGUOUS' END AS error FROM c""",
)
def resolve(spark, sf):
    labels = positions(predictions(spark, sf), ["recording_id"]).select("recording_id", F.col("pos").alias("ord"), F.expr(_LABEL).alias("label"))
    return sig.resolve_channels(labels, ["recording_id"])


@query(
    "sig_02_first_column",
    f"WITH {SAMPLES} SELECT {K}, sample_idx, CASE WHEN sample_idx % 13 = 0 THEN 0.0 ELSE value END AS value FROM samples_v",
)
def first_column(spark, sf):
    x = F.when(F.col("sample_idx") % 13 == 0, float("nan")).otherwise(F.col("value"))
    return samples(spark, sf).select(*KEY, "sample_idx", sig.first_column(F.array(x, F.lit(1.0))).alias("value"))


@query("sig_03_epoch_assignment", f"WITH {SAMPLES} SELECT {K}, sample_idx, sample_idx // 30 - 1 AS epoch_index, sample_idx % 30 AS n FROM samples_v")
def epoch_assignment(spark, sf):
    return sig.with_epoch(samples(spark, sf), offset=1).select(*KEY, "sample_idx", "epoch_index", "n")


@query(
    "sig_04_alignment",
    f"""WITH {SAMPLES}, a AS (SELECT {K}, count(*) AS available, 270 + 30 * (recording_id % 3) AS expected FROM samples_v GROUP BY ALL)
SELECT {K}, available, expected, CASE WHEN available = expected THEN 'exact' ELSE 'reconciled' END AS status, CASE WHEN available < expected THEN 'short' WHEN available > expected THEN 'long' END AS reason,
  least(available // 30, expected // 30) AS valid_epochs FROM a""",
)
def alignment(spark, sf):
    df = samples(spark, sf)
    expected = df.select("recording_id").distinct().withColumn("n_epochs", 9 + F.col("recording_id") % 3)
    return sig.alignment(df, expected).select(*KEY, "available", "expected", "status", "reason", "valid_epochs")


@query("sig_04_covered_epochs", f"WITH {SAMPLES} SELECT {K}, sample_idx // 30 AS epoch_index, count(*) AS samples, count(*) = 30 AS valid FROM samples_v GROUP BY ALL")
def covered(spark, sf):
    return sig.covered_epochs(samples(spark, sf)).select(*EK, "samples", "valid")


def _fir_sql(kernel, after: int, col: str = "value") -> str:
    w = "OVER w"
    parts = []
    for k, weight in enumerate(kernel):
        shift = k - after
        x = col if shift == 0 else f"lag({col}, {shift}) {w}" if shift > 0 else f"lead({col}, {-shift}) {w}"
        parts.append(f"coalesce({x}, 0) * {weight!r}")
    return " + ".join(parts)


_W = f"WINDOW w AS (PARTITION BY {K} ORDER BY sample_idx)"


@query("sig_05_bandpass_causal", f"WITH {SAMPLES} SELECT {K}, sample_idx, round({_fir_sql(BAND, 0)}, 4)::DOUBLE + 0.0 AS filtered FROM samples_v {_W}")
def causal(spark, sf):
    out = sig.fir(samples(spark, sf), KEY, BAND, "filtered", causal=True)
    return out.select(*KEY, "sample_idx", (F.round("filtered", 4) + 0.0).alias("filtered"))


@query("sig_05_lowpass_zero_phase", f"WITH {SAMPLES} SELECT {K}, sample_idx, round({_fir_sql(LOW, 3)}, 4)::DOUBLE + 0.0 AS filtered FROM samples_v {_W}")
def zero_phase(spark, sf):
    out = sig.fir(samples(spark, sf), KEY, LOW, "filtered")
    return out.select(*KEY, "sample_idx", (F.round("filtered", 4) + 0.0).alias("filtered"))


def _thr_sql(factor: float, col: str = "value", src: str = "samples_v") -> str:
    return f"""md AS (SELECT {K}, median({col}) AS m FROM {src} GROUP BY ALL), th AS (SELECT {K}, any_value(m) AS median, median(abs({col} - m)) AS mad, any_value(m) + {factor} * median(abs({col} - m)) AS threshold FROM {src} JOIN md USING ({K}) GROUP BY ALL)"""


@query("sig_06_robust_threshold", f"WITH {SAMPLES}, {_thr_sql(1.5)} SELECT {K}, median, mad, round(threshold, 6) AS threshold FROM th")
def threshold(spark, sf):
    return sig.robust_threshold(stored_samples(spark, sf), KEY, 1.5).select(*KEY, "median", "mad", r6("threshold"))


_TOPS = f"""st AS (SELECT *, lag(value) OVER w AS pv FROM samples_v {_W}), ru AS (SELECT {K}, sample_idx, value FROM st WHERE pv IS NULL OR pv <> value),
rn AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv, lead(sample_idx) OVER w AS ni FROM ru {_W}),
tops AS (SELECT {K}, (sample_idx + ni - 1) // 2 AS sample_idx, value FROM rn WHERE value > pv AND value > nv)"""


@query("sig_07_local_maxima", f"WITH {SAMPLES}, {_TOPS}, {_thr_sql(0.5)} SELECT {K}, sample_idx, value FROM tops JOIN th USING ({K}) WHERE value >= threshold")
def maxima(spark, sf):
    df = stored_samples(spark, sf)
    return sig.detect_peaks(df, KEY, 1, threshold=sig.robust_threshold(df, KEY, 0.5))


def _spaced_sql(tops: str, distance: int) -> str:
    """Peaks from the highest down, each kept if none kept before is nearer than ``distance``."""
    return f"""rk AS (SELECT {K}, sample_idx, value, row_number() OVER (PARTITION BY {K} ORDER BY value DESC, sample_idx DESC) AS rn FROM {tops}),
gr AS (SELECT {K}, rn, [sample_idx] AS kept FROM rk WHERE rn = 1
  UNION ALL SELECT {K}, rk.rn, CASE WHEN len(list_filter(kept, lambda x: abs(x - rk.sample_idx) < {distance})) > 0 THEN kept ELSE list_append(kept, rk.sample_idx) END
  FROM gr JOIN rk USING ({K}) WHERE rk.rn = gr.rn + 1),
kp AS (SELECT {K}, unnest(arg_max(kept, rn)) AS sample_idx FROM gr GROUP BY {K}),
sp AS (SELECT {K}, sample_idx, value FROM kp JOIN rk USING ({K}, sample_idx))"""


@query("sig_07_spaced_peaks", f"WITH RECURSIVE {SAMPLES}, {_TOPS}, {_spaced_sql('tops', 5)} SELECT {K}, sample_idx, value FROM sp")
def spaced(spark, sf):
    df = samples(spark, sf)
    return sig.detect_peaks(df, KEY, 5)


_BEATS = f"""bt AS (SELECT {K}, sample_idx, CAST(sample_idx - lag(sample_idx) OVER w AS DOUBLE) AS iv FROM tops {_W}),
be AS (SELECT *, coalesce(iv BETWEEN 2 AND 6, false) AS valid, CASE WHEN iv BETWEEN 2 AND 6 THEN 60 / iv END AS rate FROM bt)"""


def beats(spark, sf):
    df = samples(spark, sf)
    return sig.intervals(sig.detect_peaks(df, KEY, 1), KEY, 1.0, 2.0, 6.0)


@query("sig_08_intervals", f"WITH {SAMPLES}, {_TOPS}, {_BEATS} SELECT {K}, sample_idx, valid, round(rate, 6) AS rate FROM be")
def interval_rows(spark, sf):
    return beats(spark, sf).select(*KEY, "sample_idx", "valid", r6("rate"))


_RATE = f"""ra AS (SELECT {K}, sample_idx // 30 AS epoch_index, count(*) AS peaks, count(rate) AS v, coalesce(count(rate) / nullif(count(iv), 0), 0) AS sqi, avg(rate) AS m, stddev_pop(rate) AS sd FROM be GROUP BY ALL)"""


@query(
    "sig_09_heart_rate",
    f"""WITH {SAMPLES}, {_TOPS}, {_BEATS}, {_RATE} SELECT {K}, epoch_index, peaks, round(sqi, 6)::DOUBLE AS sqi, CASE WHEN peaks >= 8 AND sqi >= 0.4 AND v >= 1 AND m BETWEEN 10 AND 20 THEN round(m, 6) END AS mean,
  CASE WHEN peaks >= 8 AND sqi >= 0.4 AND v >= 1 AND m BETWEEN 10 AND 20 THEN round(sd, 6) END AS std FROM ra""",
)
def heart_rate(spark, sf):
    out = sig.rate_per_epoch(beats(spark, sf), KEY, 1.0, sig.MIN_BEATS, sig.MIN_SQI, limits=(10.0, 20.0))
    return out.select(*EK, "peaks", r6("sqi"), r6("mean"), r6("std"))


@query(
    "sig_16_respiration_rate",
    f"""WITH {SAMPLES}, {_TOPS}, {_BEATS}, {_RATE} SELECT {K}, epoch_index, CASE WHEN v >= 2 AND m BETWEEN 4 AND 40 THEN round(m, 6) END AS mean FROM ra""",
)
def respiration(spark, sf):
    out = sig.rate_per_epoch(beats(spark, sf), KEY, 1.0, min_rates=sig.MIN_BREATHS, limits=sig.RR_RANGE)
    return out.select(*EK, r6("mean"))


# --- smoothing along epochs ------------------------------------------------
_HR = f"{_POS}, hr_v AS (SELECT recording_id, pos AS epoch_index, CASE WHEN k % 6 = 0 OR k % 6 = 4 THEN NULL ELSE CAST(hr_mean AS DOUBLE) END AS hr FROM pos_v)"
_EW = "WINDOW w AS (PARTITION BY recording_id ORDER BY epoch_index)"


def hr_rows(spark, sf):
    gone = (F.col("k") % 6 == 0) | (F.col("k") % 6 == 4)
    return positions(predictions(spark, sf), ["recording_id"]).select(
        "recording_id", F.col("pos").alias("epoch_index"), F.when(~gone, F.col("hr_mean").cast("double")).alias("hr")
    )


_GAP = """g0 AS (SELECT recording_id, epoch_index AS i, hr AS v, lead(epoch_index) OVER w AS j, lead(hr) OVER w AS nv FROM hr_v WHERE hr IS NOT NULL WINDOW w AS (PARTITION BY recording_id ORDER BY epoch_index)),
gf AS (SELECT recording_id, v, nv, i, j, unnest(range(i + 1, j)) AS epoch_index FROM g0 WHERE j - i BETWEEN 2 AND 3)"""


@query("sig_10_gap_fill_linear", f"WITH {PREDS}, {_HR}, {_GAP} SELECT h.recording_id, h.epoch_index, round(coalesce(hr, v + (nv - v) * (h.epoch_index - i) / (j - i)), 6) AS filled FROM hr_v h LEFT JOIN gf ON gf.recording_id = h.recording_id AND gf.epoch_index = h.epoch_index")
def gap_linear(spark, sf):
    return sig.fill_gaps(hr_rows(spark, sf), ["recording_id"], "hr", "filled").select("recording_id", "epoch_index", r6("filled"))


@query("sig_10_gap_fill_causal", f"WITH {PREDS}, {_HR}, {_GAP} SELECT h.recording_id, h.epoch_index, coalesce(hr, v) AS filled FROM hr_v h LEFT JOIN gf ON gf.recording_id = h.recording_id AND gf.epoch_index = h.epoch_index")
def gap_causal(spark, sf):
    return sig.fill_gaps(hr_rows(spark, sf), ["recording_id"], "hr", "filled", causal=True).select("recording_id", "epoch_index", "filled")


@query("sig_11_rolling_median", f"WITH {PREDS}, {_HR} SELECT recording_id, epoch_index, CASE WHEN hr IS NOT NULL THEN median(hr) OVER (PARTITION BY recording_id ORDER BY epoch_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS smooth FROM hr_v")
def median_centred(spark, sf):
    return sig.rolling_median(hr_rows(spark, sf), ["recording_id"], "hr", "smooth").select("recording_id", "epoch_index", "smooth")


def _recurrence(state: str, first: str = "hr") -> str:
    return f"""rw AS (SELECT recording_id, epoch_index, {first} AS y FROM hr_v WHERE epoch_index = 0
 UNION ALL SELECT h.recording_id, h.epoch_index, {state} FROM rw JOIN hr_v h ON h.recording_id = rw.recording_id AND h.epoch_index = rw.epoch_index + 1)"""


@query("sig_12_slew_limit", f"WITH RECURSIVE {PREDS}, {_HR}, {_recurrence('CASE WHEN h.hr IS NULL THEN NULL WHEN y IS NULL THEN h.hr ELSE least(greatest(h.hr, y - 15), y + 15) END')} SELECT recording_id, epoch_index, y AS capped FROM rw")
def slew(spark, sf):
    return sig.slew_limit(hr_rows(spark, sf), ["recording_id"], "hr", "capped").select("recording_id", "epoch_index", "capped")


@query("sig_13_ewma", f"WITH RECURSIVE {PREDS}, {_HR}, {_recurrence('CASE WHEN h.hr IS NULL THEN NULL WHEN y IS NULL THEN h.hr ELSE 0.3 * h.hr + 0.7 * y END')} SELECT recording_id, epoch_index, round(y, 6) AS smooth, round(CASE WHEN y IS NOT NULL THEN avg(y) OVER (PARTITION BY recording_id ORDER BY epoch_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END + 1e-9, 6) AS mean3 FROM rw")
def smoothing(spark, sf):
    out = sig.ewma(hr_rows(spark, sf), ["recording_id"], "hr", "smooth")
    out = sig.rolling_mean(out, ["recording_id"], "smooth", "mean3", 3)
    return out.select("recording_id", "epoch_index", r6("smooth"), r6(F.col("mean3") + 1e-9, "mean3"))


@query("sig_14_first_difference", f"WITH {PREDS}, {_HR}, d AS (SELECT recording_id, epoch_index, hr * 0.5 - lag(hr * 0.5) OVER w AS d FROM hr_v {_EW}) SELECT recording_id, epoch_index, CASE WHEN d IS NOT NULL THEN CAST(least(greatest(round_even(d, 0), -128), 127) AS DOUBLE) + 0.0 END AS dhr FROM d")
def difference(spark, sf):
    df = hr_rows(spark, sf).withColumn("half", F.col("hr") * 0.5)
    return sig.first_difference(df, ["recording_id"], "half", "dhr").select("recording_id", "epoch_index", F.col("dhr").cast("double").alias("dhr"))


@query("sig_15_delta_metrics", f"WITH {PREDS}, {_HR}, d AS (SELECT recording_id, abs(hr - lag(hr) OVER w) AS d FROM hr_v {_EW}) SELECT recording_id, round(coalesce(count(*) FILTER (WHERE d > 15) / nullif(count(d), 0), 0), 6)::DOUBLE AS jump_rate, round(quantile_cont(d, 0.95), 6) AS delta_p95 FROM d GROUP BY 1")
def delta_metrics(spark, sf):
    return sig.delta_metrics(hr_rows(spark, sf), ["recording_id"], "hr").select("recording_id", r6("jump_rate"), r6("delta_p95"))


@query("sig_27_counter_delta", f"WITH {PREDS}, {_POS}, c AS (SELECT recording_id, pos, hr_mean - lag(hr_mean) OVER (PARTITION BY recording_id ORDER BY pos) AS d FROM pos_v) SELECT recording_id, pos, CAST(least(greatest(d, 0), 255) AS DOUBLE) AS delta FROM c WHERE pos > 0")
def counter(spark, sf):
    df = positions(predictions(spark, sf), ["recording_id"]).select("recording_id", "pos", "hr_mean")
    out = sig.counter_delta(df, ["recording_id"], "hr_mean", "delta", "pos")
    return out.filter(F.col("pos") > 0).select("recording_id", "pos", F.col("delta").cast("double").alias("delta"))


# --- ECG-derived respiration -----------------------------------------------
def edr(spark, sf):
    df = samples(spark, sf).filter(F.col("channel") == "ecg")
    lengths = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("available"))
    return sig.interpolate_peaks(sig.detect_peaks(df, KEY, 1), KEY, 1.0, 4.0, lengths)


_EDR = f"""ln AS (SELECT {K}, count(*) AS n FROM samples_v WHERE channel = 'ecg' GROUP BY ALL), gr AS (SELECT {K}, unnest(range(n * 4)) AS g FROM ln),
pk AS (SELECT *, lead(sample_idx) OVER w AS ni, lead(value) OVER w AS nv, row_number() OVER w AS rn FROM tops WHERE channel = 'ecg' {_W}),
fx AS (SELECT {K}, arg_min(value, sample_idx) AS fv FROM pk GROUP BY ALL),
js AS (SELECT gr.recording_id, gr.channel, g, p.sample_idx AS i, p.value AS v, ni, nv FROM gr ASOF LEFT JOIN pk p ON gr.recording_id = p.recording_id AND gr.channel = p.channel AND gr.g / 4 >= p.sample_idx),
edr_v AS (SELECT {K}, g AS sample_idx, CASE WHEN i IS NULL THEN fv WHEN ni IS NULL THEN v ELSE v + (nv - v) * (g / 4 - i) / (ni - i) END AS value FROM js JOIN fx USING ({K}))"""


@query("sig_17_edr_grid", f"WITH {SAMPLES}, {_TOPS}, {_EDR} SELECT {K}, sample_idx, round(value, 6) AS value FROM edr_v")
def edr_grid(spark, sf):
    return edr(spark, sf).select(*KEY, "sample_idx", r6("value"))


@query(
    "jon_08_asof_neighbours",
    f"""WITH {SAMPLES}, {_TOPS}, {_EDR} SELECT recording_id, count(*) AS points, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM edr_v GROUP BY 1""",
)
def asof(spark, sf):
    return edr(spark, sf).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("points"), r6(F.avg("value"), "mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


_SP = f"""sp0 AS (SELECT {K}, sample_idx // 30 AS epoch_index, sample_idx % 30 AS n, value FROM samples_v), fu AS (SELECT {K}, epoch_index FROM sp0 GROUP BY ALL HAVING count(*) = 30),
sg AS (SELECT * FROM sp0 JOIN fu USING ({K}, epoch_index)),
tt AS (SELECT {K}, epoch_index, (30 * sum(value * value) - pow(sum(value), 2) + pow(sum(CASE WHEN n % 2 = 0 THEN value ELSE -value END), 2)) / 2 AS total FROM sg GROUP BY ALL),
pw AS (SELECT {K}, epoch_index, b.k, pow(sum(value * cos({2 * math.pi!r} * b.k * n / 30)), 2) + pow(sum(value * sin({2 * math.pi!r} * b.k * n / 30)), 2) AS p FROM sg, (SELECT unnest(range(1, 16)) AS k) b GROUP BY ALL)"""


@query(
    "sig_18_spectral_rate",
    f"""WITH {SAMPLES}, {_SP}, a AS (SELECT {K}, epoch_index, arg_max(k, round(p, 4)) AS k, sum(p) AS s, max(p) AS m, median(p) AS md FROM pw WHERE k BETWEEN 3 AND 15 GROUP BY ALL)
SELECT {K}, epoch_index, round(k * 2.0, 4)::DOUBLE AS rr_psd, round(s / (total + 1e-9), 4) AS band_ratio, round(m / (md + 1e-9), 3) AS peak_prominence FROM a JOIN tt USING ({K}, epoch_index)""",
)
def spectral_rate(spark, sf):
    out = sig.rate_by_spectrum(sig.with_epoch(samples(spark, sf)), EK, N, 1.0)
    return out.select(*EK, F.round("rr_psd", 4).alias("rr_psd"), F.round("band_ratio", 4).alias("band_ratio"), F.round("peak_prominence", 3).alias("peak_prominence"))


_AC = f"""mn AS (SELECT *, value - avg(value) OVER (PARTITION BY {K}, epoch_index) AS x FROM sg), c0 AS (SELECT {K}, epoch_index, sum(x * x) AS c FROM mn GROUP BY ALL),
lg AS (SELECT a.recording_id, a.channel, a.epoch_index, l.lag, sum(a.x * b.x) AS c FROM mn a, (SELECT unnest(range(2, 11)) AS lag) l, mn b
  WHERE b.recording_id = a.recording_id AND b.channel = a.channel AND b.epoch_index = a.epoch_index AND b.n = a.n + l.lag GROUP BY ALL)"""


@query(
    "sig_19_autocorrelation_rate",
    f"""WITH {SAMPLES}, {_SP}, {_AC}, b AS (SELECT {K}, epoch_index, arg_max(lag, round(c, 6) - lag * 1e-9) AS lag, max(c) AS m FROM lg GROUP BY ALL)
SELECT {K}, epoch_index, round(60.0 / lag, 6)::DOUBLE AS rr_ac, round(m / c, 6) AS ac_peak FROM b JOIN c0 USING ({K}, epoch_index) WHERE c <> 0""",
)
def autocorrelation(spark, sf):
    out = sig.rate_by_autocorrelation(sig.with_epoch(samples(spark, sf)), EK, N, 1.0)
    return out.select(*EK, r6("rr_ac"), r6("ac_peak"))


_PKQ = f"""es AS (SELECT *, lag(value) OVER w AS pv FROM sg WINDOW w AS (PARTITION BY {K}, epoch_index ORDER BY n)), er AS (SELECT {K}, epoch_index, n, value FROM es WHERE pv IS NULL OR pv <> value),
en AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv, lead(n) OVER w AS ni FROM er WINDOW w AS (PARTITION BY {K}, epoch_index ORDER BY n)),
ep AS (SELECT {K}, epoch_index, (n + ni - 1) // 2 AS n FROM en WHERE value > pv AND value > nv),
ei AS (SELECT {K}, epoch_index, n - lag(n) OVER (PARTITION BY {K}, epoch_index ORDER BY n) AS iv FROM ep),
pq AS (SELECT {K}, epoch_index, 60.0 / median(iv) AS rr_peak FROM ei WHERE iv BETWEEN 2 AND 10 GROUP BY ALL)"""


def full_epochs(spark, sf):
    """Samples of complete 30-sample epochs."""
    df = sig.with_epoch(samples(spark, sf))
    full = sig.covered_epochs(samples(spark, sf)).filter("valid").select(*EK)
    return df.join(full, EK)


@query("sig_20_peak_rate", f"WITH {SAMPLES}, {_SP}, {_PKQ} SELECT {K}, epoch_index, round(rr_peak, 6)::DOUBLE AS rr_peak FROM pq")
def peak_rate(spark, sf):
    return sig.rate_by_peaks(full_epochs(spark, sf), EK, 1.0).select(*EK, r6("rr_peak"))


def fused(spark, sf):
    rows = epochs(spark, sf)
    est = positions(rows, ["recording_id"]).select(
        "recording_id", F.col("pos").alias("epoch_index"),
        F.when(F.col("k") % 5 > 0, F.col("rr_mean").cast("double")).otherwise(0.0).alias("rr_psd"),
        F.when(F.col("k") % 7 > 0, 9.0 + F.col("hr_mean") % 17).otherwise(0.0).alias("rr_ac"),
        F.when(F.col("k") % 3 > 0, 10.0 + F.col("k") % 11).alias("rr_peak"),
        (F.col("k") / 200.0).alias("band_ratio"), (F.col("hr_mean") / 20.0).alias("peak_prominence"), ((F.col("k") % 9) / 10.0).alias("ac_peak"),
    )
    return sig.fuse_rates(est)


_FUSE = f"""fe AS (SELECT recording_id, pos AS epoch_index, CASE WHEN k % 5 > 0 THEN CAST(rr_mean AS DOUBLE) ELSE 0 END AS a, CASE WHEN k % 7 > 0 THEN 9.0 + hr_mean % 17 ELSE 0 END AS b, CASE WHEN k % 3 > 0 THEN 10.0 + k % 11 ELSE 0 END AS c,
  least(k / 200.0 / 0.4, 1) AS qb, least(hr_mean / 20.0 / 5, 1) AS qp, least((k % 9) / 10.0 / 0.8, 1) AS qa FROM pos_v),
fr AS (SELECT recording_id, epoch_index, qb, qp, qa, unnest([a, b, c])::DOUBLE AS r, unnest([greatest(qb, qp), CASE WHEN qa > 0 THEN qa ELSE 0.5 END, CASE WHEN qp > 0 THEN qp ELSE 0.5 END])::DOUBLE AS w FROM fe),
fg AS (SELECT recording_id, epoch_index, any_value(0.4 * qb + 0.4 * qp + 0.2 * qa) AS sqi, count(*) FILTER (WHERE r > 0) AS n, sum(r * w) FILTER (WHERE r > 0) AS rw, sum(w) FILTER (WHERE r > 0) AS ws, median(r) FILTER (WHERE r > 0) AS md, list(r) FILTER (WHERE r > 0) AS rs FROM fr GROUP BY 1, 2),
fm AS (SELECT *, list_median(list_transform(rs, lambda x : abs(x - md))) AS mad FROM fg),
fused_v AS (SELECT recording_id, CAST(epoch_index AS INT) AS epoch_index, CASE WHEN n = 0 THEN 0 WHEN ws > 0 THEN rw / ws ELSE md END AS rr_fused,
  CASE WHEN n = 0 THEN 0 ELSE least(greatest(0.6 * sqi + 0.4 * CASE WHEN n >= 2 THEN greatest(0, 1 - mad / greatest(2.0, 0.1 * md)) ELSE 0.5 END, 0), 1) END AS rr_confidence FROM fm)"""


@query("sig_21_rate_fusion", f"WITH {PREDS}, {_POS}, {_FUSE} SELECT recording_id, epoch_index, round(rr_fused, 6)::DOUBLE AS rr_fused, round(rr_confidence, 6)::DOUBLE AS rr_confidence FROM fused_v")
def rate_fusion(spark, sf):
    return fused(spark, sf).select("recording_id", "epoch_index", r6("rr_fused"), r6("rr_confidence"))


_GATE = """CASE WHEN f.rr_fused <= 0 THEN NULL WHEN f.rr_confidence >= 0.4 THEN CASE WHEN f.rr_fused BETWEEN 4 AND 40 THEN f.rr_fused END
 WHEN f.rr_confidence > 0 AND y > 0 THEN CASE WHEN 0.4 * f.rr_fused + 0.6 * y BETWEEN 4 AND 40 THEN 0.4 * f.rr_fused + 0.6 * y END END"""


@query(
    "sig_22_rate_gating",
    f"""WITH RECURSIVE {PREDS}, {_POS}, {_FUSE}, gt AS (SELECT recording_id, epoch_index, CASE WHEN rr_fused > 0 AND rr_confidence >= 0.4 AND rr_fused BETWEEN 4 AND 40 THEN rr_fused END AS y FROM fused_v WHERE epoch_index = 0
 UNION ALL SELECT f.recording_id, f.epoch_index, {_GATE} FROM gt JOIN fused_v f ON f.recording_id = gt.recording_id AND f.epoch_index = gt.epoch_index + 1),
d AS (SELECT *, y - lag(y) OVER (PARTITION BY recording_id ORDER BY epoch_index) AS d FROM gt)
SELECT recording_id, epoch_index, round(y, 6) AS rr, CASE WHEN d IS NOT NULL THEN CAST(least(greatest(trunc(d), -128), 127) AS DOUBLE) + 0.0 END AS drr FROM d""",
)
def rate_gating(spark, sf):
    out = sig.gate_rates(fused(spark, sf), ["recording_id"])
    out = sig.first_difference(out, ["recording_id"], "rr", "drr", rounding="truncate")
    return out.select("recording_id", "epoch_index", r6("rr"), F.col("drr").cast("double").alias("drr"))


@query(
    "sig_23_rate_spread",
    f"""WITH {SAMPLES}, {_SP}, su AS (SELECT {K}, epoch_index, n // 10 AS sub, b.k, pow(sum(value * cos({2 * math.pi!r} * b.k * (n % 10) / 10)), 2) + pow(sum(value * sin({2 * math.pi!r} * b.k * (n % 10) / 10)), 2) AS p FROM sg, (SELECT unnest(range(1, 6)) AS k) b GROUP BY ALL),
sr AS (SELECT {K}, epoch_index, sub, arg_max(k, round(p, 4)) * 6.0 AS r, sum(p) AS s FROM su GROUP BY ALL)
SELECT {K}, epoch_index, round(CASE WHEN count(*) >= 2 THEN stddev_pop(r) ELSE 0 END, 6)::DOUBLE AS rr_std FROM sr WHERE s > 0 GROUP BY ALL""",
)
def rate_spread(spark, sf):
    return sig.rate_spread(full_epochs(spark, sf), EK, N, 1.0).select(*EK, r6("rr_std"))


_MOVE = f"""ev AS (SELECT {K}, sample_idx, abs(value) AS e FROM samples_v), {_thr_sql(0.0, 'e', 'ev')}, lm AS (SELECT {K}, median + 1.0 * 3.0 * mad AS mi, median + 6.0 * mad AS la FROM th),
mv AS (SELECT {K}, sample_idx // 30 AS epoch_index, sample_idx % 30 AS n, (e > mi)::INT AS mi, (e > la)::INT AS la FROM ev JOIN lm USING ({K})),
mb AS (SELECT *, CASE WHEN la = 1 AND coalesce(lag(la) OVER (PARTITION BY {K}, epoch_index ORDER BY n), 0) = 0 THEN 1 ELSE 0 END AS rise FROM mv),
ma AS (SELECT {K}, epoch_index, CAST(round_even(100.0 * avg(mi), 0) AS INT) AS minor_move_pct, CAST(round_even(100.0 * avg(la), 0) AS INT) AS large_move_pct, CAST(sum(rise) AS INT) AS bursts FROM mb GROUP BY ALL HAVING count(*) = 30)"""


def enveloped(spark, sf):
    return stored_samples(spark, sf).withColumn("envelope", F.abs("value"))


@query("sig_24_movement", f"WITH {SAMPLES}, {_MOVE} SELECT {K}, epoch_index, minor_move_pct, large_move_pct FROM ma")
def movement(spark, sf):
    return sig.movement(enveloped(spark, sf), KEY).select(*EK, "minor_move_pct", "large_move_pct")


@query(
    "sig_25_burst_delta",
    f"""WITH {SAMPLES}, {_MOVE}, d AS (SELECT {K}, epoch_index, bursts, bursts - lag(bursts) OVER (PARTITION BY {K} ORDER BY epoch_index) AS d FROM ma)
SELECT {K}, epoch_index, bursts, CASE WHEN d IS NOT NULL THEN CAST(least(greatest(d, 0), 255) AS DOUBLE) END AS turnovers FROM d""",
)
def bursts(spark, sf):
    moves = cut_lineage(sig.movement(enveloped(spark, sf), KEY), "movement")
    out = sig.counter_delta(moves, KEY, "bursts", "turnovers")
    return out.select(*EK, "bursts", F.col("turnovers").cast("double").alias("turnovers"))


@query("sig_26_in_bed", f"WITH {SAMPLES} SELECT {K}, sample_idx // 30 AS epoch_index, CAST(round_even(100 * avg(CASE WHEN value > 0.5 THEN 1.0 ELSE 0 END), 0) AS INT) AS in_bed_pct FROM samples_v GROUP BY ALL HAVING count(*) = 30")
def in_bed(spark, sf):
    return sig.in_bed(samples(spark, sf), KEY)


_RQ = f"""rq AS (SELECT {K}, epoch_index, CAST(round_even(100 * sum(p) FILTER (WHERE k BETWEEN 3 AND 9) / sum(p) FILTER (WHERE k >= 2), 0) AS INT) AS resp_quality FROM pw GROUP BY ALL)"""


@query("sig_28_respiration_quality", f"WITH {SAMPLES}, {_SP}, {_RQ} SELECT * FROM rq")
def respiration_quality(spark, sf):
    return sig.respiration_quality(samples(spark, sf), KEY, N, 1.0, band=(0.1, 0.3))


@query(
    "sig_29_vibration_features",
    f"""WITH RECURSIVE {SAMPLES}, {_TOPS}, hi AS (WITH {_thr_sql(0.5)} SELECT {K}, sample_idx, value FROM tops JOIN th USING ({K}) WHERE value >= threshold),
{_spaced_sql('hi', 3)}, bt AS (SELECT {K}, sample_idx, CAST(sample_idx - lag(sample_idx) OVER w AS DOUBLE) AS iv FROM sp {_W}),
be AS (SELECT *, CASE WHEN iv BETWEEN 1 AND 10 THEN 60 / iv END AS rate FROM bt), {_RATE}, mo AS (WITH {_MOVE} SELECT {K}, epoch_index, minor_move_pct FROM ma), {_SP},
rq AS (SELECT {K}, epoch_index, CAST(round_even(100 * sum(p) FILTER (WHERE k BETWEEN 3 AND 15) / sum(p) FILTER (WHERE k >= 2), 0) AS INT) AS resp_quality FROM pw GROUP BY ALL)
SELECT {K}, epoch_index, CAST(minor_move_pct AS DOUBLE) AS vib_move_pct, CAST(resp_quality AS DOUBLE) AS resp_quality, CASE WHEN v >= 2 AND m BETWEEN 4 AND 40 THEN round(m, 6) END AS vib_rr
FROM mo FULL JOIN rq USING ({K}, epoch_index) FULL JOIN ra USING ({K}, epoch_index)""",
)
def vibration(spark, sf):
    out = sig.vibration_features(stored_samples(spark, sf), KEY, N, 1.0, 3)
    return out.select(*EK, F.col("vib_move_pct").cast("double").alias("vib_move_pct"), F.col("resp_quality").cast("double").alias("resp_quality"), r6("vib_rr"))


_QC = f"""fi AS (SELECT {K}, sample_idx, CASE WHEN sample_idx % 97 = 0 THEN NULL ELSE value END AS x FROM samples_v), gd AS (SELECT * FROM fi WHERE x IS NOT NULL),
qs AS (SELECT {K}, sample_idx, x, lag(x) OVER w AS px, lead(x) OVER w AS nx FROM gd {_W}), rf AS (SELECT {K}, quantile_cont(abs(x), 0.995) AS ref FROM gd GROUP BY ALL),
qa AS (SELECT {K}, count(*) FILTER (WHERE x IS NULL) / count(*) AS nan_inf_fraction, var_pop(x) AS variance FROM fi GROUP BY ALL),
qb AS (SELECT {K}, count(*) FILTER (WHERE abs(x - px) < 1e-12) / count(px) AS flatline_fraction, count(*) FILTER (WHERE x > px AND x > nx) AS peak_count FROM qs GROUP BY ALL),
qc AS (SELECT {K}, count(*) FILTER (WHERE abs(x) >= ref) / count(*) AS clipping_fraction FROM gd JOIN rf USING ({K}) GROUP BY ALL),
qq AS (SELECT *, nan_inf_fraction <= 0.02 AND flatline_fraction <= 0.9 AND variance >= 1e-8 AND clipping_fraction <= 0.3 AND (channel <> 'ecg' OR peak_count >= 5) AS passed FROM qa JOIN qb USING ({K}) JOIN qc USING ({K}))"""


def qc_rows(spark, sf):
    df = stored_samples(spark, sf).withColumn("value", F.when(F.col("sample_idx") % 97 == 0, float("nan")).otherwise(F.col("value")))
    return sig.channel_qc(df)


@query(
    "sig_30_channel_qc",
    f"WITH {SAMPLES}, {_QC} SELECT {K}, round(nan_inf_fraction, 6) AS nan_inf_fraction, round(variance, 6) AS variance, round(flatline_fraction, 6) AS flatline_fraction, round(clipping_fraction, 6) AS clipping_fraction, peak_count, passed FROM qq",
)
def channel_qc(spark, sf):
    return qc_rows(spark, sf).select(*KEY, *[r6(c) for c in ("nan_inf_fraction", "variance", "flatline_fraction", "clipping_fraction")], "peak_count", "passed")


@query(
    "sig_30_band_ratio",
    f"""WITH {SAMPLES}, {_SP}, s AS (SELECT {K}, sum(p) FILTER (WHERE k BETWEEN 2 AND 6) / (sum(p) FILTER (WHERE k BETWEEN 9 AND 15) + 1e-9) AS ratio FROM pw GROUP BY ALL)
SELECT {K}, round(ratio, 6) AS eeg_ratio FROM s""",
)
def band_ratio(spark, sf):
    out = sig.channel_qc(samples(spark, sf), eeg_bands={"low": (0.05, 0.2), "high": (0.3, 0.5)}, segment=30, fs=1.0)
    return out.select(*KEY, r6("eeg_ratio"))


@query("sig_31_channel_gate", f"WITH {SAMPLES}, {_QC} SELECT {K}, CASE WHEN passed THEN 'keep' WHEN channel = 'ecg' THEN 'error' ELSE 'drop' END AS action, CASE WHEN NOT passed AND channel = 'ecg' THEN 'E_QC_FAIL' END AS error FROM qq")
def channel_gate(spark, sf):
    return sig.channel_gate(qc_rows(spark, sf))


@query(
    "sig_32_sample_windows",
    f"""WITH {SAMPLES}, l AS (SELECT {K}, count(*) AS n FROM samples_v GROUP BY ALL), w AS (SELECT {K}, unnest(range(0, n - 50 + 1, 20)) AS start FROM l WHERE n >= 50)
SELECT w.recording_id, w.channel, w.start // 20 AS window_no, count(*) AS n, sum(value * (sample_idx - start)) AS weighted FROM w JOIN samples_v s ON s.recording_id = w.recording_id AND s.channel = w.channel AND sample_idx >= start AND sample_idx < start + 50 GROUP BY ALL""",
)
def sample_windows(spark, sf):
    out = sig.sample_windows(samples(spark, sf), KEY, 50, 20)
    return out.groupBy(*KEY, "window_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("offset")).alias("weighted"))


_IMU = "ax AS (SELECT recording_id, channel, sample_idx, value / 10 AS ax, value / 20 AS ay, 9.81::DOUBLE AS az, value / 500 AS gx, 0.0::DOUBLE AS gy, value / 300 AS gz FROM samples_v)"


@query(
    "sig_33_imu_score",
    f"""WITH {SAMPLES}, {_IMU}, sc AS (SELECT *, abs(ax - coalesce(lag(ax) OVER w, 0)) + abs(ay - coalesce(lag(ay) OVER w, 0)) + abs(az - coalesce(lag(az) OVER w, 0)) + 3 * sqrt(gx * gx + gy * gy + gz * gz) + 0.5 * abs(sqrt(ax * ax + ay * ay + az * az) - 9.81) AS score FROM ax {_W}),
rm AS (SELECT {K}, sample_idx, sqrt(sum(score * score) OVER (PARTITION BY {K} ORDER BY sample_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / 10) AS rms FROM sc)
SELECT {K}, sample_idx, round(rms, 4) AS rms, CASE WHEN rms > 0.8 THEN 'large' WHEN rms > 0.15 THEN 'minor' ELSE 'still' END AS level FROM rm""",
)
def imu(spark, sf):
    v = F.col("value")
    df = samples(spark, sf).withColumns({"ax": v / 10, "ay": v / 20, "az": F.lit(9.81), "gx": v / 500, "gy": F.lit(0.0), "gz": v / 300})
    return sig.imu_score(df, KEY).select(*KEY, "sample_idx", F.round("rms", 4).alias("rms"), "level")


@query(
    "sig_34_respiration_source",
    f"""WITH {SAMPLES}, a AS (SELECT recording_id, channel, sample_idx // 30 AS epoch_index, avg(value) AS v FROM samples_v GROUP BY ALL)
SELECT recording_id, epoch_index, round(v, 6) + 0.0 AS rate, CASE WHEN channel = 'resp' THEN 'resp' ELSE 'edr' END AS source FROM a WHERE (channel = 'resp') = (recording_id % 3 <> 0)""",
)
def source_choice(spark, sf):
    rates = sig.with_epoch(samples(spark, sf)).groupBy(*EK).agg(F.avg("value").alias("rate"))
    resp = rates.filter((F.col("channel") == "resp") & (F.col("recording_id") % 3 != 0)).drop("channel")
    derived = rates.filter(F.col("channel") == "ecg").drop("channel")
    return sig.prefer_respiration(resp, derived, ["recording_id"]).select("recording_id", "epoch_index", r6("rate"), "source")
