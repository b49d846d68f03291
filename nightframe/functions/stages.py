"""Stage-name and label expressions (EXP-02 .. EXP-09)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
STAGE_TEXT = {"w": 0, "wake": 0, "n1": 1, "n2": 2, "n3": 3, "n4": 3, "r": 4, "rem": 4}
UNKNOWN_CODES = [-1, 9, 99]
CHANNEL_KINDS = [
    ("ecg", "ecg|ekg"), ("emg", "emg"), ("resp", "resp|breath"), ("vib", "vib"),
    ("move", "acc|gyro|motion|move"), ("bed", "bed"), ("apnea", "apnea"),
]
# --- end of fixed values ----------------------------------------------------


def lookup(col: Column, table: dict) -> Column:
    """CASE over a small literal table."""
    items = list(table.items())
    out = F.when(col == items[0][0], F.lit(items[0][1]))
    for key, value in items[1:]:
        out = out.when(col == key, F.lit(value))
    return out


def stage_text_code(col: Column) -> Column:
    """Stage text to code, -1 when unknown (EXP-02)."""
    clean = F.regexp_replace(F.lower(F.trim(col)), "stage| ", "")
    return F.coalesce(lookup(clean, STAGE_TEXT), F.lit(-1))


def numeric_stage_codes(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Numeric stage to code (EXP-03).

    When the smallest known code of a recording is 1 or more, codes 1..5 are
    shifted down by one. Unknown codes and other values become -1.
    """
    lowest = df.groupBy(*keys).agg(F.min(known_code(F.col(col))).alias("_low"))
    code = known_code(F.col(col))
    shifted = F.when((F.col("_low") >= 1) & code.between(1, 5), code - 1).when(
        code.between(0, 4), code
    )
    return (
        df.join(lowest, list(keys), "left")
        .withColumn(out, F.coalesce(shifted, F.lit(-1)).cast("int"))
        .drop("_low")
    )


def known_code(col: Column) -> Column:
    return F.when(~col.isin(UNKNOWN_CODES), col)


def channel_kind(name: Column) -> Column:
    """Signal kind from a channel name, first matching kind wins (EXP-07)."""
    value = F.lower(name)
    out = F.when(value.rlike(CHANNEL_KINDS[0][1]), CHANNEL_KINDS[0][0])
    for kind, pattern in CHANNEL_KINDS[1:]:
        out = out.when(value.rlike(pattern), kind)
    return out


def four_class(col: Column) -> Column:
    """Five-class label to W / Light / Deep / REM, null when unmapped (EXP-04)."""
    value = F.upper(F.trim(col))
    return (
        F.when(value.isin("W", "WAKE"), "W")
        .when(value.isin("N1", "N2", "LIGHT"), "Light")
        .when(value.isin("N3", "DEEP"), "Deep")
        .when(value == "REM", "REM")
    )


def annotation_code(col: Column) -> Column:
    """Annotation text to stage code by ordered substring tests (EXP-05)."""
    value = F.upper(F.trim(col))
    has = value.contains
    return (
        F.when(has("REM"), 4)
        .when(has("WAKE") | value.endswith("W"), 0)
        .when(has("N1") | has("S1"), 1)
        .when(has("N2") | has("S2"), 2)
        .when(has("N3") | has("S3") | has("S4"), 3)
        .when(has("UNSCORED"), -1)
    )


def ui_stage(col: Column) -> Column:
    """Stage to the four names shown to users, light by default (EXP-06)."""
    return (
        F.when(col == "W", "awake").when(col == "N3", "deep").when(col == "R", "rem").otherwise("light")
    )


def normal_label(col: Column) -> Column:
    """Trim, lower-case, ``_`` and ``-`` to blanks, single blanks (EXP-08)."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.trim(col), "_-", "  ")), r"\s+", " "))


def dataset_id(col: Column) -> Column:
    """Dataset of a device's external id (EXP-09)."""
    value = F.lower(col)
    return (
        F.when(value.contains("dodh"), "DODH")
        .when(value.contains("cap"), "CAP")
        .when(value.contains("isruc"), "ISRUC")
        .when(value.contains("sleep-edf") | value.contains("sleepedf"), "SLEEP-EDF")
        .otherwise("UNKNOWN")
    )
