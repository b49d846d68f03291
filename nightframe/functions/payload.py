"""Payload, JSON, version and clock expressions (EXP-10 .. EXP-12, EXP-25 .. EXP-29)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightframe.functions.binding import bind
from nightframe.functions.stages import lookup
from nightframe.operators.evaluation import is_finite

# --- fixed values -----------------------------------------------------------
METRIC_ALIASES = {
    "delta": "delta_power", "theta": "theta_power", "alpha": "alpha_power",
    "beta": "beta_power", "sigma": "sigma_power", "emg": "emg_rms",
    "eog": "eog_variance", "hr": "hr_mean", "hrv": "hrv_rmssd", "motion": "motion_index",
}
# --- end of fixed values ----------------------------------------------------


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_from_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian float32 vectors from binary values, a batch in one piece; bytes beyond the last whole number are left out."""
    for raw in batches:
        sizes = raw.map(lambda b: 0 if b is None else len(b) // 4).to_numpy(dtype=int)
        flat = np.frombuffer(b"".join(b[: n * 4] for b, n in zip(raw, sizes) if b is not None), "<f4")
        rows = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        yield pd.Series([None if b is None else row for b, row in zip(raw, rows)], dtype=object)


def unwrap_features(payload: Column) -> Column:
    """``{"features": x}`` becomes ``x``, but only when it is the single key."""
    keys = F.json_object_keys(payload)
    single = (F.size(keys) == 1) & (F.element_at(keys, 1) == "features")
    return F.when(single, F.get_json_object(payload, "$.features")).otherwise(payload)


def decode_features(df: DataFrame, payload: str, names: Sequence[str], out: str = "decoded") -> DataFrame:
    """Add ``out``, a struct ``(features ARRAY<FLOAT>, error)``: the payload is a
    JSON list, a JSON map in schema order, or base64 text (EXP-10).

    Text goes to numpy in batches; lists and maps never leave the JVM.
    """
    order = F.array(*[F.lit(n) for n in names])
    body = F.col("_body")
    is_list, is_map = body.startswith("["), body.startswith("{")
    text = F.when(~is_list & ~is_map, F.unbase64(F.regexp_replace(body, '"', "")))
    as_map = bind(F.from_json(body, "map<string,double>"), lambda held: F.transform(order, lambda n: F.try_element_at(held, n)))
    values = F.when(is_list, F.from_json(body, "array<double>")).when(is_map, as_map).otherwise(F.col("_floats").cast("array<double>"))
    return (
        df.withColumn("_body", bind(F.col(payload), unwrap_features))
        .withColumn("_floats", floats_from_bytes(text))
        .withColumn(out, bind(values, lambda v: _checked(v, len(names))))
        .drop("_body", "_floats")
    )


def _checked(values: Column, length: int) -> Column:
    error = (
        F.when(values.isNull(), "unsupported payload")
        .when(F.size(values) != length, "wrong length")
        .when(F.exists(values, lambda v: v.isNull()), "missing features")
        .when(~F.forall(values, is_finite), "not finite")
    )
    return F.struct(values.cast("array<float>").alias("features"), error.alias("error"))


def payload_violations(values: Column, schema: Column) -> Column:
    """Violations of a feature map against an array of schema structs
    ``(position, name, dtype, min, max)`` (EXP-11)."""
    names = F.transform(schema, lambda s: s["name"])
    missing = F.transform(
        F.array_except(names, F.map_keys(values)), lambda n: F.concat(F.lit("missing "), n)
    )
    extra = F.transform(
        F.array_except(F.map_keys(values), names), lambda n: F.concat(F.lit("unknown "), n)
    )

    def problem(s: Column) -> Column:
        v = F.try_element_at(values, s["name"])
        return (
            F.when(v.isNull(), F.lit(None).cast("string"))
            .when(s["dtype"].startswith("int") & (v != F.floor(v)), F.concat(F.lit("not int "), s["name"]))
            .when(v < s["min"], F.concat(F.lit("below min "), s["name"]))
            .when(v > s["max"], F.concat(F.lit("above max "), s["name"]))
        )

    ranged = F.filter(F.transform(schema, problem), lambda p: p.isNotNull())
    return F.concat(missing, extra, ranged)


def rename_metrics(metrics: Column) -> Column:
    """Replace metric aliases by their full names (EXP-12)."""
    return F.transform_keys(metrics, lambda k, _: F.coalesce(lookup(k, METRIC_ALIASES), k))


def canonical_json_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are written (EXP-26)."""
    body = F.to_json(
        F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}
    )
    return F.sha2(body, 256)


def metric_path(metrics: Column, paths: Sequence[str]) -> Column:
    """First dotted path that holds a number, else 0 (EXP-27)."""
    found = [F.get_json_object(metrics, f"$.{p}").try_cast("double") for p in paths]
    return F.coalesce(*found, F.lit(0.0))


def semver(version: Column) -> Column:
    """``major.minor.patch`` as a comparable struct, null when malformed (EXP-29)."""
    parts = F.split(version, r"\.")
    ok = version.rlike(r"^\d+\.\d+\.\d+$")
    return F.when(
        ok,
        F.struct(
            F.element_at(parts, 1).try_cast("int").alias("major"),
            F.element_at(parts, 2).try_cast("int").alias("minor"),
            F.element_at(parts, 3).try_cast("int").alias("patch"),
        ),
    )


def bump(latest: Column, part: str = "patch") -> Column:
    """The next version after ``latest``; 0.1.0 when there is none (EXP-29)."""
    major, minor, patch = latest["major"], latest["minor"], latest["patch"]
    nxt = {
        "major": (major + 1, F.lit(0), F.lit(0)),
        "minor": (major, minor + 1, F.lit(0)),
        "patch": (major, minor, patch + 1),
    }[part]
    return F.coalesce(
        F.when(latest.isNotNull(), F.concat_ws(".", *[n.cast("string") for n in nxt])), F.lit("0.1.0")
    )


def clock_seconds(text: Column) -> Column:
    """``hh:mm:ss`` or ``hh.mm.ss`` (after an optional date and ``T``) to seconds."""
    parts = F.split(F.replace(F.element_at(F.split(text, "T"), -1), F.lit("."), F.lit(":")), ":")
    h, m, s = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    ok = (F.size(parts) == 3) & (h >= 0) & m.between(0, 59) & s.between(0, 59)
    return F.when(ok, h * 3600 + m * 60 + s)


def epoch_offset(signal_clock: Column, stage_clock: Column, epoch_seconds: int = 30) -> Column:
    """Start offset in epochs, wrapped to +-12 h, with warnings (EXP-25)."""
    raw = clock_seconds(stage_clock) - clock_seconds(signal_clock)
    delta = (
        F.when(raw > 43200, raw - 86400).when(raw < -43200, raw + 86400).otherwise(raw)
    )
    offset = F.coalesce(F.bround(delta.cast("double") / epoch_seconds, 0).cast("int"), F.lit(0))
    return F.struct(
        offset.alias("offset"),
        F.coalesce(offset != 0, F.lit(False)).alias("applied"),
        F.coalesce(F.abs(delta - offset * epoch_seconds) > 1, F.lit(False)).alias("non_multiple"),
    )


def started_at(text: Column, file_time: Column) -> Column:
    """ISO start time (``Z`` or naive means UTC), else the file's time (EXP-28)."""
    return F.coalesce(F.trim(text).try_cast("timestamp"), file_time)
