"""Numeric, flag-bit and unit expressions (EXP-01, EXP-13 .. EXP-19, EXP-30, EXP-31)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.schema import FEATURES, UINT8_UNKNOWN

# --- fixed values -----------------------------------------------------------
# bit order of the two flag layouts
FLAGS_A = ["valid", "ecg", "resp", "move", "vib", "stage"]
FLAGS_B = [
    "epoch_valid", "stage_scored", "ecg_present", "hr_valid",
    "resp_present", "rr_valid", "rr_from_edr", "unsupported",
]
HR_RANGE_BPM = (30, 220)
RR_RANGE_BPM = (4, 40)
# features a device sends as fractions of 100
PERCENT_FEATURES = [
    "in_bed_pct", "large_move_pct", "minor_move_pct", "vib_move_pct", "vib_resp_q", "agree_flags",
]
MISSING_AS_ZERO = ["flags", "agree_flags"]
EPSILON = 1e-6
LOW_AGREEMENT_QUANTILE = 0.15
LOW_AGREEMENT_DEFAULT = 0.5
# --- end of fixed values ----------------------------------------------------


def clip(x: Column, lo: float, hi: float) -> Column:
    """Limit to ``[lo, hi]`` (EXP-30); null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """``(x - mean) / std`` with a degenerate std treated as 1 (EXP-30)."""
    return (x - mean) / F.when(std > 1e-8, std).otherwise(F.lit(1.0))


def clamp_uint8(x: Column) -> Column:
    """Round half to even into 0..255 (EXP-01)."""
    return clip(F.bround(x.cast("double"), 0), 0.0, 255.0).cast("smallint")


def clamp_int8(x: Column) -> Column:
    """Round half to even into -128..127 (EXP-01)."""
    return clip(F.bround(x.cast("double"), 0), -128.0, 127.0).cast("smallint")


def unknown_to_null(x: Column, unknown: int = UINT8_UNKNOWN) -> Column:
    return F.nullif(x, F.lit(unknown))


def missing_policy(features: Mapping[str, Column]) -> dict[str, Column]:
    """Sentinel to null, then zero where a feature's policy is ``zero`` (EXP-31)."""
    out = {}
    for name, col in features.items():
        value = unknown_to_null(col)
        out[name] = F.coalesce(value, F.lit(0)) if name in MISSING_AS_ZERO else value
    return out


def device_units(features: Mapping[str, Column]) -> dict[str, Column]:
    """Stored integers to the units a device sends: percentages as fractions (EXP-13)."""
    return {
        name: col / F.lit(100.0) if name in PERCENT_FEATURES else col.cast("double")
        for name, col in features.items()
    }


def bit_flags(bits: list[Column]) -> Column:
    """Pack booleans, first one lowest; null counts as unset."""
    out = F.lit(0)
    for i, bit in enumerate(bits):
        out = out.bitwiseOR(F.when(bit, F.lit(1 << i)).otherwise(F.lit(0)))
    return out.cast("smallint")


def flags_a(
    ecg: Column, resp: Column, move: Column, vib: Column, bed: Column, stage_known: Column
) -> Column:
    """Flag layout A: an epoch is valid if any channel is (EXP-14)."""
    return bit_flags([ecg | resp | move | vib | bed, ecg, resp, move, vib, stage_known])


def flags_b(base: Column, any_segment: Column, stage_code: Column) -> Column:
    """Flag layout B: add EPOCH_VALID and STAGE_SCORED to feature flags (EXP-15)."""
    return base.bitwiseOR(bit_flags([any_segment, stage_code != -1])).cast("smallint")


def agree_a(rr: Column, vib_rr: Column) -> Column:
    """1 if two respiration rates differ by at most 2, 255 if one is unknown (EXP-16)."""
    unknown = (rr == UINT8_UNKNOWN) | (vib_rr == UINT8_UNKNOWN)
    return F.when(unknown, UINT8_UNKNOWN).when(F.abs(rr - vib_rr) <= 2, 1).otherwise(0)


def agree_b(hr: Column, rr: Column, flags: Column) -> Column:
    """HR in range, RR in range, HR/RR plausible, for layout-B flags (EXP-17)."""
    hr_ok = flags.bitwiseAND(1 << FLAGS_B.index("hr_valid")) > 0
    rr_ok = flags.bitwiseAND(1 << FLAGS_B.index("rr_valid")) > 0
    return bit_flags(
        [
            hr_ok & hr.between(*HR_RANGE_BPM),
            rr_ok & rr.between(*RR_RANGE_BPM),
            hr_ok & rr_ok & (rr > 0) & hr.between(rr, 8 * rr),
        ]
    )


def agree_c(flags: Column, vib_move: Column, in_bed: Column, radar_n: Column, buffer_n: Column) -> Column:
    """Device disagreement bits 0x01, 0x02, 0x04, 0x08 (EXP-18)."""
    return bit_flags(
        [(flags > 0) & (vib_move > 20), (in_bed < 50) & (vib_move > 10), radar_n < 20, buffer_n < 10]
    )


def engineered(low_agreement: float | Column, scale: float = 1.0) -> dict[str, Column]:
    """The 11 engineered features, computed once per epoch (EXP-19).

    Unknown and non-finite inputs count as 0. ``scale`` divides percentages:
    ``stillness`` expects fractions, stored epochs hold 0..100.
    """

    def f(name: str) -> Column:
        x = F.col(name).cast("double")
        clean = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
        return clean / scale if name.endswith("_pct") and scale != 1.0 else clean

    move_total = f("large_move_pct") + f("minor_move_pct") + f("vib_move_pct")
    limit = F.lit(low_agreement) if isinstance(low_agreement, float) else low_agreement
    return {
        "hr_cv": f("hr_std") / (F.abs(f("hr_mean")) + EPSILON),
        "rr_cv": f("rr_std") / (F.abs(f("rr_mean")) + EPSILON),
        "instability": f("hr_std") + f("rr_std") + F.abs(f("dhr")) + F.abs(f("drr")),
        "move_total": move_total,
        "move_ratio": f("large_move_pct") / (f("minor_move_pct") + EPSILON),
        "stillness": 1.0 - clip(move_total, 0.0, 1.0),
        "hr_rr_ratio": f("hr_mean") / (f("rr_mean") + EPSILON),
        "var_ratio": f("hr_std") / (f("rr_std") + EPSILON),
        "resp_instability": f("apnea_delta") * f("rr_std"),
        "vib_resp_instability": f("vib_resp_q") * f("rr_std"),
        "low_agreement": F.when(f("agree_flags") < limit, 1.0).otherwise(0.0),
    }


def feature_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in FEATURES}


def unpivot_features(df: DataFrame, keys: list[str], names: list[str], value: str = "value") -> DataFrame:
    """One row per feature: position, name and value."""
    cells = F.array(*[F.col(n).cast("double") for n in names])
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(*keys, F.posexplode(cells).alias("position", value)).withColumn(
        "feature", F.element_at(labels, F.col("position") + 1)
    )
