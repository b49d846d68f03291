"""Expression queries (EXP-01 .. EXP-31)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.catalog.base import big, i4, query, r6
from nightframe.catalog.views import EPOCHS, PREDS, epochs, predictions, read
from nightframe.functions import numeric as num
from nightframe.functions import payload as pay
from nightframe.functions import probability as prob
from nightframe.functions import stages as st
from nightframe.functions.binding import bind
from nightframe.operators.evaluation import row_entropy
from nightframe.schema import CLASSES, ENGINEERED, FEATURES

KEY = ["recording_id", "epoch_index"]
K = "recording_id, epoch_index"


@query(
    "exp_01_clamp_round_half_even",
    f"""WITH {EPOCHS} SELECT {K},
  CAST(least(greatest(round_even(value / 2, 0), 0), 255) AS INT) AS u8, CAST(least(greatest(round_even((k - 50) * 2.5, 0), -128), 127) AS INT) AS i8 FROM epochs_v""",
)
def clamp(spark, sf):
    return epochs(spark, sf).select(
        *KEY,
        i4(num.clamp_uint8(F.col("value") / 2), "u8"),
        i4(num.clamp_int8((F.col("k") - 50) * 2.5), "i8"),
    )


_RAW_TEXT = "CASE k % 9 WHEN 0 THEN 'Stage W' WHEN 1 THEN ' wake ' WHEN 2 THEN 'N1' WHEN 3 THEN 'stage n2' WHEN 4 THEN 'N4' WHEN 5 THEN 'R' WHEN 6 THEN 'REM ' WHEN 7 THEN 'movement' ELSE NULL END"


@query(
    "exp_02_stage_text",
    f"""WITH {EPOCHS} SELECT {K}, CASE k % 9 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE -1 END AS code FROM epochs_v""",
)
def stage_text(spark, sf):
    return epochs(spark, sf).select(*KEY, st.stage_text_code(F.expr(_RAW_TEXT)).alias("code"))


@query(
    "exp_03_numeric_stage_scheme",
    f"""WITH {EPOCHS}, r AS (SELECT {K}, CASE WHEN k % 13 = 0 THEN 9 WHEN k % 17 = 0 THEN -1 WHEN recording_id % 2 = 0 THEN 1 + k % 5 ELSE k % 6 END AS raw FROM epochs_v),
m AS (SELECT *, min(raw) FILTER (WHERE raw NOT IN (-1, 9, 99)) OVER (PARTITION BY recording_id) AS low FROM r)
SELECT {K}, CASE WHEN raw IN (-1, 9, 99) THEN -1 WHEN low >= 1 AND raw BETWEEN 1 AND 5 THEN raw - 1 WHEN raw BETWEEN 0 AND 4 THEN raw ELSE -1 END AS code FROM m""",
)
def stage_numeric(spark, sf):
    raw = F.expr(
        "CASE WHEN k % 13 = 0 THEN 9 WHEN k % 17 = 0 THEN -1 WHEN recording_id % 2 = 0 THEN 1 + k % 5 ELSE k % 6 END"
    )
    df = epochs(spark, sf).select(*KEY, raw.cast("int").alias("raw"))
    return st.numeric_stage_codes(df, ["recording_id"], "raw", "code").select(*KEY, "code")


@query("exp_04_four_class", f"WITH {PREDS} SELECT {K}, true4, pred4 FROM preds_v")
def four_class(spark, sf):
    return epochs(spark, sf).select(
        *KEY,
        st.four_class(F.col("ground_truth_stage")).alias("true4"),
        st.four_class(F.concat(F.lit(" "), F.lower("predicted_stage"))).alias("pred4"),
    )


_NOTE = "CASE k % 8 WHEN 0 THEN 'Sleep stage REM' WHEN 1 THEN 'WAKE up' WHEN 2 THEN 'Sleep stage W' WHEN 3 THEN 'n1 (auto)' WHEN 4 THEN 'Sleep S2' WHEN 5 THEN 'stage S4' WHEN 6 THEN 'unscored' ELSE 'lights' END"


@query(
    "exp_05_annotation_stage",
    f"WITH {EPOCHS} SELECT {K}, CASE k % 8 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN -1 ELSE NULL END AS code FROM epochs_v WHERE k % 8 < 7",
)
def annotation(spark, sf):
    return (
        epochs(spark, sf)
        .select(*KEY, st.annotation_code(F.expr(_NOTE)).alias("code"))
        .filter(F.col("code").isNotNull())
    )


@query(
    "exp_06_ui_stage",
    f"WITH {EPOCHS} SELECT {K}, CASE predicted_stage WHEN 'W' THEN 'awake' WHEN 'N3' THEN 'deep' WHEN 'REM' THEN 'rem' ELSE 'light' END AS ui FROM epochs_v",
)
def ui(spark, sf):
    stage = F.when(F.col("predicted_stage") == "REM", "R").otherwise(F.col("predicted_stage"))
    return epochs(spark, sf).select(*KEY, st.ui_stage(stage).alias("ui"))


_CHANNEL = "CASE k % 8 WHEN 0 THEN 'EKG lead' WHEN 1 THEN 'chin EMG' WHEN 2 THEN 'Breath flow' WHEN 3 THEN 'Vibration' WHEN 4 THEN 'gyro_x' WHEN 5 THEN 'InBed' WHEN 6 THEN 'apnea count' ELSE 'EEG' END"


@query(
    "exp_07_channel_kind",
    f"WITH {EPOCHS} SELECT {K}, CASE k % 8 WHEN 0 THEN 'ecg' WHEN 1 THEN 'emg' WHEN 2 THEN 'resp' WHEN 3 THEN 'vib' WHEN 4 THEN 'move' WHEN 5 THEN 'bed' WHEN 6 THEN 'apnea' END AS kind FROM epochs_v",
)
def channel_kind(spark, sf):
    return epochs(spark, sf).select(*KEY, st.channel_kind(F.expr(_CHANNEL)).alias("kind"))


@query(
    "exp_08_normal_label",
    "SELECT p_partkey, trim(regexp_replace(translate(lower(trim(p_name || '__' || p_type || '-x ')), '_-', '  '), '\\s+', ' ', 'g')) AS label FROM part",
)
def normal_label(spark, sf):
    text = F.concat(F.col("p_name"), F.lit("__"), F.col("p_type"), F.lit("-x "))
    return read(spark, sf, "part").select("p_partkey", st.normal_label(text).alias("label"))


@query(
    "exp_09_dataset_id",
    f"WITH {PREDS} SELECT {K}, dataset_id FROM preds_v",
)
def dataset_id(spark, sf):
    external = F.expr(
        "concat(CASE device_id WHEN 0 THEN 'subject_dodh_' WHEN 1 THEN 'CAP-night-' WHEN 2 THEN 'isruc_patient_' WHEN 3 THEN 'SleepEDF-' ELSE 'other-' END, recording_id)"
    )
    return epochs(spark, sf).select(*KEY, st.dataset_id(external).alias("dataset_id"))


def encode_float32(x):
    """Little-endian float32 hex of an integer column (test input for the decoder)."""
    size = F.abs(x).cast("bigint")
    exponent = F.length(F.bin(size)) - 1
    mantissa = size * F.pow(F.lit(2.0), 23 - exponent).cast("bigint") - (1 << 23)
    bits = F.when(size == 0, F.lit(0).cast("bigint")).otherwise(
        F.when(x < 0, F.lit(1 << 31)).otherwise(F.lit(0)).cast("bigint")
        + (exponent + 127).cast("bigint") * (1 << 23)
        + mantissa
    )
    return bind(
        F.lpad(F.hex(bits), 8, "0"),
        lambda word: F.concat(*[F.substring(word, p, 2) for p in (7, 5, 3, 1)]),
    )


def payloads(df):
    """Feature payloads in the three accepted encodings, by event number."""
    features = [F.col(n).cast("double") for n in FEATURES]
    as_list = F.to_json(F.array(*features))
    as_map = F.to_json(F.struct(*[c.alias(n) for c, n in zip(features, FEATURES)]))
    as_text = F.base64(F.unhex(F.concat(*[encode_float32(F.col(n)) for n in FEATURES])))
    inner = (
        F.when(F.col("event_id") % 4 == 0, as_list)
        .when(F.col("event_id") % 4 == 1, as_map)
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"features":'), as_list, F.lit("}")))
        .otherwise(F.concat(F.lit('{"features":"'), as_text, F.lit('"}')))
    )
    return df.withColumn("payload", inner)


_UNPIVOT = f"SELECT {K}, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, CAST(unnest([{', '.join(FEATURES)}]) AS DOUBLE) AS value FROM epochs_v"


@query("exp_10_decode_features", f"WITH {EPOCHS} {_UNPIVOT}")
def decode(spark, sf):
    df = payloads(epochs(spark, sf))
    decoded = pay.decode_features(df, "payload", FEATURES, "d").select(*KEY, "d").filter(F.col("d.error").isNull())
    names = F.array(*[F.lit(n) for n in FEATURES])
    return decoded.select(*KEY, F.explode(F.arrays_zip(names.alias("n"), F.col("d.features").alias("v"))).alias("z")).select(
        *KEY, F.col("z.n").alias("feature"), F.col("z.v").cast("double").alias("value")
    )


def feature_schema(spark):
    """The feature schema registry: one row per version and feature."""
    return spark.range(1).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(version).alias("version"), F.lit(i).alias("position"), F.lit(n).alias("name"),
                        F.lit("int").alias("dtype"), F.lit(0.0).alias("min"), F.lit(50.0).alias("max"),
                    )
                    for version in ("v0", "v1")
                    for i, n in enumerate(FEATURES)
                ]
            )
        ).alias("s")
    ).select("s.*")


@query(
    "exp_11_payload_validation",
    f"""WITH {EPOCHS}, u AS ({_UNPIVOT}),
v AS (SELECT {K}, CASE WHEN value < 0 THEN 'below min ' || feature WHEN value > 50 THEN 'above max ' || feature END AS violation FROM u WHERE feature <> 'flags' OR epoch_index % 5 > 0
  UNION ALL SELECT {K}, 'missing flags' FROM epochs_v WHERE epoch_index % 5 = 0
  UNION ALL SELECT {K}, 'unknown spo2' FROM epochs_v WHERE epoch_index % 7 = 0)
SELECT * FROM v WHERE violation IS NOT NULL""",
)
def validate(spark, sf):
    df = epochs(spark, sf)
    entries = [F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in FEATURES if n != "flags"]
    flags = F.when(F.col("epoch_index") % 5 > 0, F.array(F.struct(F.lit("flags").alias("key"), F.col("flags").cast("double").alias("value"))))
    spo2 = F.when(F.col("epoch_index") % 7 == 0, F.array(F.struct(F.lit("spo2").alias("key"), F.lit(1.0).alias("value"))))
    none = F.filter(F.array(*entries), lambda _: F.lit(False))
    values = F.map_from_entries(F.concat(F.array(*entries), F.coalesce(flags, none), F.coalesce(spo2, none)))
    version = F.concat(F.lit("v"), (F.col("device_id") % 2).cast("string"))
    packed = df.select(*KEY, version.alias("version"), values.alias("values"))
    schema = feature_schema(spark).groupBy("version").agg(
        F.sort_array(F.collect_list(F.struct("position", "name", "dtype", "min", "max"))).alias("schema")
    )
    return packed.join(schema, "version").select(
        *KEY, F.explode(pay.payload_violations(F.col("values"), F.col("schema"))).alias("violation")
    )


@query(
    "exp_12_metric_aliases",
    f"""WITH {EPOCHS} SELECT {K}, unnest(['hr_mean', 'motion_index', 'delta_power', 'spo2']) AS metric,
  unnest([hr_mean, large_move_pct, k, epoch_index]) AS value FROM epochs_v""",
)
def aliases(spark, sf):
    m = F.create_map(
        F.lit("hr"), F.col("hr_mean"), F.lit("motion"), F.col("large_move_pct"),
        F.lit("delta"), F.col("k"), F.lit("spo2"), F.col("epoch_index"),
    )
    return epochs(spark, sf).select(*KEY, F.explode(pay.rename_metrics(m)).alias("metric", "value"))


@query(
    "exp_13_device_units",
    f"""WITH {EPOCHS} SELECT {K}, in_bed_pct / 100 AS in_bed_pct, CAST(hr_mean AS DOUBLE) AS hr_mean, vib_resp_q / 100 AS vib_resp_q, agree_flags / 100 AS agree_flags FROM epochs_v""",
)
def device_units(spark, sf):
    cols = num.device_units(num.feature_columns())
    return epochs(spark, sf).select(*KEY, *[cols[n].alias(n) for n in ("in_bed_pct", "hr_mean", "vib_resp_q", "agree_flags")])


@query(
    "exp_14_flags_layout_a",
    f"""WITH {EPOCHS} SELECT {K}, CAST((CASE WHEN k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 OR k % 7 = 0 OR in_bed_pct > 90 THEN 1 ELSE 0 END)
  + (CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END) + (CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END) + (CASE WHEN k % 5 = 0 THEN 8 ELSE 0 END)
  + (CASE WHEN k % 7 = 0 THEN 16 ELSE 0 END) + (CASE WHEN ground_truth_stage IS NOT NULL THEN 32 ELSE 0 END) AS INT) AS flags FROM epochs_v""",
)
def flags_a(spark, sf):
    k = F.col("k")
    packed = num.flags_a(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0, F.col("in_bed_pct") > 90, F.col("ground_truth_stage").isNotNull())
    return epochs(spark, sf).select(*KEY, i4(packed, "flags"))


@query(
    "exp_15_flags_layout_b",
    f"""WITH {EPOCHS} SELECT {K}, CAST((flags & 60) | (CASE WHEN hr_mean > 60 THEN 1 ELSE 0 END) | (CASE WHEN ground_truth_stage IS NOT NULL THEN 2 ELSE 0 END) AS INT) AS flags FROM epochs_v""",
)
def flags_b(spark, sf):
    code = F.when(F.col("ground_truth_stage").isNull(), -1).otherwise(1)
    packed = num.flags_b(F.col("flags").bitwiseAND(60), F.col("hr_mean") > 60, code)
    return epochs(spark, sf).select(*KEY, i4(packed, "flags"))


@query(
    "exp_16_agreement_a",
    f"""WITH {EPOCHS} SELECT {K}, CASE WHEN k % 10 = 0 THEN 255 WHEN abs(rr_mean - (8 + vib_resp_q % 22)) <= 2 THEN 1 ELSE 0 END AS agree FROM epochs_v""",
)
def agree_a(spark, sf):
    rr = F.when(F.col("k") % 10 == 0, 255).otherwise(F.col("rr_mean"))
    return epochs(spark, sf).select(*KEY, num.agree_a(rr, 8 + F.col("vib_resp_q") % 22).alias("agree"))


@query(
    "exp_17_agreement_b",
    f"""WITH {EPOCHS} SELECT {K}, CAST((CASE WHEN flags & 8 > 0 AND hr_mean BETWEEN 30 AND 220 THEN 1 ELSE 0 END)
  + (CASE WHEN flags & 32 > 0 AND rr_mean BETWEEN 4 AND 40 THEN 2 ELSE 0 END)
  + (CASE WHEN flags & 8 > 0 AND flags & 32 > 0 AND rr_mean > 0 AND rr_mean <= hr_mean AND hr_mean <= 8 * rr_mean THEN 4 ELSE 0 END) AS INT) AS agree FROM epochs_v""",
)
def agree_b(spark, sf):
    return epochs(spark, sf).select(*KEY, i4(num.agree_b(F.col("hr_mean"), F.col("rr_mean"), F.col("flags")), "agree"))


@query(
    "exp_18_agreement_c",
    f"""WITH {EPOCHS} SELECT {K}, CAST((CASE WHEN flags > 0 AND vib_move_pct > 20 THEN 1 ELSE 0 END) + (CASE WHEN in_bed_pct < 50 AND vib_move_pct > 10 THEN 2 ELSE 0 END)
  + (CASE WHEN k % 31 < 20 THEN 4 ELSE 0 END) + (CASE WHEN k % 30 < 10 THEN 8 ELSE 0 END) AS INT) AS agree FROM epochs_v""",
)
def agree_c(spark, sf):
    packed = num.agree_c(F.col("flags"), F.col("vib_move_pct"), F.col("in_bed_pct"), F.col("k") % 31, F.col("k") % 30)
    return epochs(spark, sf).select(*KEY, i4(packed, "agree"))


ENGINEERED_SQL = {
    "hr_cv": "hr_std / (abs(hr_mean) + 1e-6)",
    "rr_cv": "rr_std / (abs(rr_mean) + 1e-6)",
    "instability": "hr_std + rr_std + abs(dhr) + abs(drr)",
    "move_total": "(large_move_pct + minor_move_pct + vib_move_pct) / 100",
    "move_ratio": "(large_move_pct / 100) / (minor_move_pct / 100 + 1e-6)",
    "stillness": "1 - least(greatest((large_move_pct + minor_move_pct + vib_move_pct) / 100, 0), 1)",
    "hr_rr_ratio": "hr_mean / (rr_mean + 1e-6)",
    "var_ratio": "hr_std / (rr_std + 1e-6)",
    "resp_instability": "apnea_delta * rr_std",
    "vib_resp_instability": "vib_resp_q * rr_std",
    "low_agreement": "CASE WHEN agree_flags < 1.0 THEN 1 ELSE 0 END",
}


@query(
    "exp_19_engineered_features",
    f"""WITH {EPOCHS} SELECT {K}, {", ".join(f"round(CAST({ENGINEERED_SQL[n]} AS DOUBLE), 3) AS {n}" for n in ENGINEERED)} FROM epochs_v""",
)
def engineered(spark, sf):
    cols = num.engineered(1.0, scale=100.0)
    return epochs(spark, sf).select(*KEY, *[(F.round(cols[n], 3) + 0.0).alias(n) for n in ENGINEERED])


@query(
    "exp_20_row_entropy",
    f"""WITH {PREDS} SELECT {K}, round(-(p_w * ln(p_w) + p_light * ln(p_light) + p_deep * ln(p_deep) + p_rem * ln(p_rem)), 6) AS entropy FROM preds_v""",
)
def entropy(spark, sf):
    return predictions(spark, sf).select(*KEY, r6(row_entropy(F.col("probabilities")), "entropy"))


def weight(c: int, f: int) -> float:
    return ((c * 7 + f * 3) % 11 - 5) / 100


WEIGHTS = [[weight(c, f) for f in range(len(FEATURES))] for c in range(4)]
BIAS = [0.1 * c for c in range(4)]
LOGIT_SQL = [
    " + ".join(f"{n} * {w!r}" for n, w in zip(FEATURES, row)) + f" + {b!r}" for row, b in zip(WEIGHTS, BIAS)
]
_LOGITS = "lg AS (SELECT *, " + ", ".join(f"{sql} AS z{c}" for c, sql in enumerate(LOGIT_SQL)) + " FROM preds_v)"
_SOFT = "CAST(round(exp((z{c} - greatest(z0, z1, z2, z3)) / {t}) / (" + " + ".join(f"exp((z{i} - greatest(z0, z1, z2, z3)) / {{t}})" for i in range(4)) + "), 6) AS DOUBLE) AS q{c}"


def literal_matrix(rows):
    return F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in rows])


def logits(df):
    vector = F.array(*[F.col(n).cast("double") for n in FEATURES])
    return df.withColumn(
        "logits", prob.linear_logits(vector, literal_matrix(WEIGHTS), F.array(*[F.lit(b) for b in BIAS]))
    )


@query(
    "exp_21_linear_softmax",
    f"""WITH {PREDS}, {_LOGITS} SELECT {K}, {", ".join(_SOFT.format(c=c, t="1.0") for c in range(4))} FROM lg""",
)
def linear_softmax(spark, sf):
    out = logits(predictions(spark, sf)).withColumn("p", prob.softmax(F.col("logits")))
    return out.select(*KEY, *[r6(F.col("p")[c], f"q{c}") for c in range(4)])


@query(
    "exp_22_temperature_softmax",
    f"""WITH {PREDS}, {_LOGITS} SELECT {K}, {", ".join(_SOFT.format(c=c, t="2.5") for c in range(4))} FROM lg""",
)
def tempered(spark, sf):
    out = logits(predictions(spark, sf)).withColumn("p", prob.softmax(F.col("logits"), 2.5))
    return out.select(*KEY, *[r6(F.col("p")[c], f"q{c}") for c in range(4)])


@query(
    "exp_23_argmax_label",
    f"""WITH {PREDS}, t AS (SELECT *, greatest(p_w, p_light, p_deep, p_rem) AS m FROM preds_v)
SELECT {K}, CASE WHEN p_w = m THEN 'W' WHEN p_light = m THEN 'Light' WHEN p_deep = m THEN 'Deep' ELSE 'REM' END AS label, round(m, 6) AS confidence FROM t""",
)
def argmax(spark, sf):
    label = prob.argmax_label(F.col("probabilities"), CLASSES)
    return predictions(spark, sf).select(
        *KEY, label.alias("label"), r6(prob.confidence_of(F.col("probabilities"), CLASSES, label), "confidence")
    )


@query(
    "exp_24_output_labels",
    f"""WITH {EPOCHS} SELECT {K}, CASE k % 4 WHEN 0 THEN 'W,Light,Deep' WHEN 1 THEN 'W,Light,Deep,REM' WHEN 2 THEN 'W,Light,Deep,REM,class_4' ELSE 'W,Light,Deep,REM,class_4,class_5' END AS labels FROM epochs_v""",
)
def output_labels(spark, sf):
    labels = F.array(*[F.lit(c) for c in CLASSES])
    return epochs(spark, sf).select(
        *KEY, F.array_join(prob.output_labels(labels, 3 + F.col("k") % 4), ",").alias("labels")
    )


_CLOCK = "lpad(CAST({x} // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({x} % 60 AS VARCHAR), 2, '0')"


@query(
    "exp_25_clock_offset",
    f"""WITH {EPOCHS}, c AS (SELECT {K}, CAST((event_id * 977 + k) % 86400 AS BIGINT) AS a, CAST((event_id * 641 + k * 31) % 86400 AS BIGINT) AS b FROM epochs_v),
d AS (SELECT *, CASE WHEN b - a > 43200 THEN b - a - 86400 WHEN b - a < -43200 THEN b - a + 86400 ELSE b - a END AS d FROM c),
o AS (SELECT *, CAST(round_even(d / 30, 0) AS INT) AS "offset" FROM d)
SELECT {K}, "offset", "offset" <> 0 AS applied, abs(d - "offset" * 30) > 1 AS non_multiple FROM o""",
)
def clock_offset(spark, sf):
    def clock(x, sep):
        parts = [F.lpad(F.floor(x / 3600).cast("string"), 2, "0"), F.lpad((F.floor(x / 60) % 60).cast("string"), 2, "0"), F.lpad((x % 60).cast("string"), 2, "0")]
        return F.concat_ws(sep, *parts)

    a = (F.col("event_id") * 977 + F.col("k")) % 86400
    b = (F.col("event_id") * 641 + F.col("k") * 31) % 86400
    out = pay.epoch_offset(F.concat(F.lit("2024-01-01T"), clock(a, ":")), clock(b, "."))
    return epochs(spark, sf).select(*KEY, out.alias("o")).select(*KEY, "o.*")


@query(
    "exp_26_canonical_hash",
    f"""WITH {EPOCHS} SELECT {K}, sha256('{{"epoch":' || epoch_index || ',"label":' || coalesce('"' || ground_truth_stage || '"', 'null') || ',"recording":' || recording_id || '}}') AS digest FROM epochs_v""",
)
def canonical_hash(spark, sf):
    digest = pay.canonical_json_hash(
        {"recording": F.col("recording_id"), "epoch": F.col("epoch_index"), "label": F.col("ground_truth_stage")}
    )
    return epochs(spark, sf).select(*KEY, digest.alias("digest"))


@query(
    "exp_27_metric_path",
    f"""WITH {EPOCHS} SELECT {K}, CASE k % 4 WHEN 0 THEN confidence WHEN 1 THEN CAST(k AS DOUBLE) WHEN 2 THEN CAST(hr_mean AS DOUBLE) ELSE 0.0 END AS accuracy FROM epochs_v""",
)
def metric_path(spark, sf):
    doc = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"classification":{"global":{"accuracy":'), F.col("confidence"), F.lit("}}}")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit('{"classification":{"global":{"accuracy":"bad"}},"post_decode":{"balanced_accuracy":'), F.col("k"), F.lit("}}")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit('{"accuracy":'), F.col("hr_mean"), F.lit("}")))
        .otherwise(F.lit('{"other":1}'))
    )
    paths = ["classification.global.accuracy", "classification.global.balanced_accuracy", "post_decode.balanced_accuracy", "accuracy"]
    return epochs(spark, sf).select(*KEY, pay.metric_path(doc, paths).alias("accuracy"))


@query(
    "exp_28_started_at",
    f"""WITH {EPOCHS} SELECT {K}, strftime(CASE k % 3 WHEN 0 THEN epoch_start_ts WHEN 1 THEN epoch_start_ts - INTERVAL '2' HOUR ELSE ingest_ts END, '%Y-%m-%d %H:%M:%S') AS started_at FROM epochs_v""",
)
def started_at(spark, sf):
    iso = F.date_format("epoch_start_ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("k") % 3 == 0, F.concat(iso, F.lit("Z")))
        .when(F.col("k") % 3 == 1, F.concat(iso, F.lit("+02:00")))
        .otherwise(F.lit("not a time"))
    )
    start = pay.started_at(text, F.col("ingest_ts"))
    return epochs(spark, sf).select(*KEY, F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query(
    "exp_29_next_version",
    f"""WITH {EPOCHS}, v AS (SELECT dataset, max(maj * 1000000 + mi * 1000 + pa) AS m FROM (
  SELECT device_id AS dataset, k % 3 AS maj, k % 12 AS mi, k % 101 AS pa FROM epochs_v WHERE k % 10 > 0) GROUP BY 1)
SELECT dataset AS device_id, (m // 1000000) || '.' || (m // 1000 % 1000) || '.' || (m % 1000) AS latest,
  (m // 1000000) || '.' || (m // 1000 % 1000) || '.' || (m % 1000 + 1) AS next_patch, (m // 1000000 + 1) || '.0.0' AS next_major FROM v""",
)
def next_version(spark, sf):
    version = F.when(F.col("k") % 10 > 0, F.concat_ws(".", F.col("k") % 3, F.col("k") % 12, F.col("k") % 101)).otherwise("draft")
    latest = epochs(spark, sf).groupBy("device_id").agg(F.max(pay.semver(version)).alias("v"))
    return latest.select(
        "device_id", F.concat_ws(".", "v.major", "v.minor", "v.patch").alias("latest"),
        pay.bump(F.col("v")).alias("next_patch"), pay.bump(F.col("v"), "major").alias("next_major"),
    )


@query(
    "exp_30_clip_zscore",
    f"""WITH {EPOCHS}, s AS (SELECT recording_id, avg(value) AS m, stddev_pop(value) AS sd FROM epochs_v GROUP BY 1)
SELECT {K}, least(greatest(value, 10), 100)::DOUBLE AS clipped, round((value - m) / CASE WHEN sd > 1e-8 THEN sd ELSE 1 END, 6) AS z FROM epochs_v JOIN s USING (recording_id)""",
)
def clip_zscore(spark, sf):
    df = epochs(spark, sf)
    stats = df.groupBy("recording_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return df.join(stats, "recording_id").select(
        *KEY, num.clip(F.col("value"), 10.0, 100.0).alias("clipped"), r6(num.zscore(F.col("value"), F.col("m"), F.col("sd")), "z")
    )


@query(
    "exp_31_missing_policy",
    f"""WITH {EPOCHS} SELECT {K}, CAST(CASE WHEN k % 9 = 0 THEN NULL ELSE hr_mean END AS DOUBLE) AS hr_mean, CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE flags END AS DOUBLE) AS flags FROM epochs_v""",
)
def missing(spark, sf):
    raw = {n: F.when(F.col("k") % 9 == 0, 255).otherwise(F.col(n)) for n in ("hr_mean", "flags")}
    cols = num.missing_policy(raw)
    return epochs(spark, sf).select(*KEY, *[c.cast("double").alias(n) for n, c in cols.items()])
