"""Fixed names, orders, codes and limits of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
EPOCH_SECONDS = 30
WINDOW_SIZE = 21
RECORDING_TIMEOUT_HOURS = 12
UINT8_UNKNOWN = 255
INT8_UNKNOWN = -1

FEATURES = [
    "in_bed_pct", "hr_mean", "hr_std", "dhr", "rr_mean", "rr_std", "drr",
    "large_move_pct", "minor_move_pct", "turnovers_delta", "apnea_delta",
    "flags", "vib_move_pct", "vib_resp_q", "agree_flags",
]
ENGINEERED = [
    "hr_cv", "rr_cv", "instability", "move_total", "move_ratio", "stillness",
    "hr_rr_ratio", "var_ratio", "resp_instability", "vib_resp_instability",
    "low_agreement",
]
STAGES = ["W", "N1", "N2", "N3", "REM"]
CLASSES = ["W", "Light", "Deep", "REM"]
DATASETS = ["DODH", "CAP", "ISRUC", "SLEEP-EDF", "UNKNOWN"]
STAGE_CODES = {"W": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 4}
STAGE_UNKNOWN = -1
FORBIDDEN_TRANSITIONS = [("Deep", "REM"), ("REM", "Deep")]
# --- end of fixed values ----------------------------------------------------

# Rows per block of an ordered operator. A night has at most 1,440 epochs; a
# longer recording is cut into blocks so that no group grows with the data.
BLOCK_ROWS = 2048

EPOCH_JSON = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("epoch_index", T.IntegerType()),
        T.StructField("stage", T.IntegerType()),
        T.StructField(
            "features", T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])
        ),
    ]
)
SAMPLES = T.StructType(
    [
        T.StructField("recording_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("sample_idx", T.LongType()),
        T.StructField("fs", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
    ]
)
