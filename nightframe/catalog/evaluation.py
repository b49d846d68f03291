"""Evaluation, calibration, sequence and night queries (AGG-01..16, 24..28, SEQ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightframe.catalog.base import big, i4, query, r6, ts_text
from nightframe.catalog.views import PREDS, predictions
from nightframe.functions.stages import ui_stage
from nightframe.operators import calibration as cal
from nightframe.operators import evaluation as ev
from nightframe.operators import nights as ni
from nightframe.operators import sequences as sq
from nightframe.schema import CLASSES, STAGES

REC = ["tenant_id", "recording_id"]
R = "tenant_id, recording_id"


def counts_sql(by: str, truth: str = "ground_truth_stage", pred: str = "predicted_stage", src: str = "preds_v") -> str:
    return (
        f"conf AS (SELECT {by}, {truth} AS truth, {pred} AS pred, count(*) AS n FROM {src} "
        f"WHERE {truth} IS NOT NULL GROUP BY ALL)"
    )


def class_sql(by: str, counts: str = "conf", name: str = "pc") -> str:
    return f"""
{name}_t AS (SELECT {by}, label, sum(tp) AS tp, sum(sup) AS sup, sum(prd) AS prd FROM (
    SELECT {by}, truth AS label, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS sup, 0 AS prd FROM {counts}
    UNION ALL SELECT {by}, pred, 0, 0, n FROM {counts}) GROUP BY ALL),
{name}_p AS (SELECT *, sum(sup) OVER (PARTITION BY {by}) AS total,
    CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS precision, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS recall FROM {name}_t),
{name} AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
    CASE WHEN total - sup > 0 THEN (total - sup - prd + tp) / (total - sup) ELSE 0 END AS specificity FROM {name}_p)"""


def scores_sql(by: str, src: str = "pc", name: str = "sc") -> str:
    return f"""
{name}_a AS (SELECT {by}, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(sup) AS DOUBLE) AS n,
    CAST(sum(sup * prd) AS DOUBLE) AS tp, CAST(sum(sup * sup) AS DOUBLE) AS tt, CAST(sum(prd * prd) AS DOUBLE) AS pp,
    avg(f1) AS macro_f1_all, coalesce(avg(f1) FILTER (WHERE sup > 0), 0) AS macro_f1,
    sum(f1 * sup) AS wf, coalesce(avg(recall) FILTER (WHERE sup > 0), 0) AS balanced_accuracy,
    min(recall) AS min_class_recall FROM {src} GROUP BY {by}),
{name} AS (SELECT *, CASE WHEN n > 0 THEN c / n ELSE 0 END AS accuracy, CASE WHEN n > 0 THEN wf / n ELSE 0 END AS weighted_f1,
    CASE WHEN (n*n - pp) * (n*n - tt) > 0 THEN (c * n - tp) / (sqrt(n*n - pp) * sqrt(n*n - tt)) ELSE 0 END AS mcc,
    CASE WHEN tp <> n * n THEN (c / n - tp / (n * n)) / (1 - tp / (n * n)) ELSE 0 END AS kappa FROM {name}_a)"""


_LABELS5 = "(SELECT unnest(['W','N1','N2','N3','REM']) AS l)"


@query(
    "agg_01_confusion_matrix",
    f"""WITH {PREDS}, {counts_sql(R)},
scopes AS (SELECT DISTINCT {R} FROM conf),
grid AS (SELECT s.*, a.l AS truth, b.l AS pred FROM scopes s, {_LABELS5} a, {_LABELS5} b)
SELECT g.tenant_id, g.recording_id, g.truth, g.pred, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN conf c USING (tenant_id, recording_id, truth, pred)""",
)
def confusion_matrix(spark, sf):
    counts = ev.confusion_counts(predictions(spark, sf), REC)
    return ev.confusion_matrix(counts, REC, STAGES)


@query(
    "agg_02_per_class_metrics",
    f"""WITH {PREDS}, {counts_sql(R)}, {class_sql(R)}
SELECT {R}, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(sup AS BIGINT) AS support FROM pc""",
)
def per_class(spark, sf):
    out = ev.per_class(ev.confusion_counts(predictions(spark, sf), REC), REC)
    return out.select(*REC, "label", r6("precision"), r6("recall"), r6("f1"), big("support"))


@query(
    "agg_03_accuracy_macro_f1",
    f"""WITH {PREDS}, {counts_sql(R)}, {class_sql(R)}, {scores_sql(R)}
SELECT {R}, round(accuracy, 6) AS accuracy, round(macro_f1_all, 6) AS macro_f1_all FROM sc""",
)
def accuracy_macro(spark, sf):
    out = ev.classification_report(predictions(spark, sf), REC, "ground_truth_stage", "predicted_stage")
    return out.select(*REC, r6("accuracy"), r6("macro_f1_all"))


@query(
    "agg_04_supported_class_scores",
    f"""WITH {PREDS}, {counts_sql(R, 'true4', 'pred4')}, {class_sql(R)}, {scores_sql(R)},
sp AS (SELECT {R}, min(specificity) AS lowest_specificity FROM pc GROUP BY {R})
SELECT {R}, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1,
       round(balanced_accuracy, 6) AS balanced_accuracy, round(lowest_specificity, 6) AS lowest_specificity
FROM sc JOIN sp USING (tenant_id, recording_id)""",
)
def supported_scores(spark, sf):
    classes = ev.per_class(ev.confusion_counts(predictions(spark, sf), REC, "true4", "pred4"), REC)
    low = classes.groupBy(*REC).agg(F.min("specificity").alias("lowest_specificity"))
    return ev.scope_scores(classes, REC).join(low, REC).select(
        *REC, r6("macro_f1"), r6("weighted_f1"), r6("balanced_accuracy"), r6("lowest_specificity")
    )


@query(
    "agg_05_mcc",
    f"""WITH {PREDS}, {counts_sql(R, 'true4', 'pred4')}, {class_sql(R)}, {scores_sql(R)}
SELECT {R}, round(mcc, 6) + 0.0 AS mcc FROM sc""",
)
def mcc(spark, sf):
    return ev.classification_report(predictions(spark, sf), REC).select(*REC, r6("mcc"))


@query(
    "agg_06_cohen_kappa",
    f"""WITH {PREDS}, {counts_sql(R, 'true4', 'pred4')}, {class_sql(R)}, {scores_sql(R)}
SELECT {R}, round(kappa, 6) + 0.0 AS kappa FROM sc""",
)
def kappa(spark, sf):
    return ev.classification_report(predictions(spark, sf), REC).select(*REC, r6("kappa"))


@query(
    "agg_07_report_by_scope",
    f"""WITH {PREDS}, scoped AS (
  SELECT 'global' AS scope, 'all' AS scope_id, true4, pred4 FROM preds_v
  UNION ALL SELECT 'dataset', dataset_id, true4, pred4 FROM preds_v
  UNION ALL SELECT 'recording', CAST(recording_id AS VARCHAR), true4, pred4 FROM preds_v),
{counts_sql('scope, scope_id', 'true4', 'pred4', 'scoped')}, {class_sql('scope, scope_id')}, {scores_sql('scope, scope_id')}
SELECT scope, scope_id, CAST(n AS BIGINT) AS support_total, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(weighted_f1, 6) AS weighted_f1, round(balanced_accuracy, 6) AS balanced_accuracy,
       round(mcc, 6) + 0.0 AS mcc, round(kappa, 6) + 0.0 AS kappa FROM sc""",
)
def report(spark, sf):
    out = ev.report_by_scopes(predictions(spark, sf), "dataset_id", "recording_id")
    return out.select(
        "scope", "scope_id", big("support_total"), r6("accuracy"), r6("macro_f1"), r6("weighted_f1"),
        r6("balanced_accuracy"), r6("mcc"), r6("kappa"),
    )


@query(
    "agg_08_domain_spread",
    f"""WITH {PREDS}, {counts_sql('dataset_id', 'true4', 'pred4')}, {class_sql('dataset_id')}, {scores_sql('dataset_id')}
SELECT round(max(macro_f1) - min(macro_f1), 6) AS macro_f1_spread, round(max(mcc) - min(mcc), 6) AS mcc_spread,
       round(max(kappa) - min(kappa), 6) AS kappa_spread,
       (SELECT dataset_id FROM sc ORDER BY macro_f1, dataset_id LIMIT 1) AS worst_dataset FROM sc""",
)
def domain_spread(spark, sf):
    scores = ev.classification_report(predictions(spark, sf), ["dataset_id"])
    return scores.agg(
        *[r6(F.max(m) - F.min(m), f"{m}_spread") for m in ("macro_f1", "mcc", "kappa")],
        F.min_by("dataset_id", F.struct("macro_f1", "dataset_id")).alias("worst_dataset"),
    )


@query(
    "agg_09_stage_distribution",
    f"""WITH {PREDS} SELECT {R}, predicted_stage AS label, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY {R}), 6) AS frequency
FROM preds_v GROUP BY {R}, predicted_stage""",
)
def stage_distribution(spark, sf):
    return ev.distribution(predictions(spark, sf), REC).select(*REC, "label", big("count"), r6("frequency"))


@query(
    "agg_10_confidence_histogram",
    f"""WITH {PREDS}, b AS (SELECT {R}, least(greatest(CAST(trunc(confidence * 10) AS INT), 0), 9) AS bin FROM preds_v),
g AS (SELECT d.*, CAST(r.range AS INT) AS bin FROM (SELECT DISTINCT {R} FROM b) d, range(10) r)
SELECT g.tenant_id, g.recording_id, g.bin, count(b.bin) AS count, round(g.bin / 10, 6) AS lower
FROM g LEFT JOIN b USING (tenant_id, recording_id, bin) GROUP BY ALL""",
)
def confidence_histogram(spark, sf):
    out = ev.confidence_histogram(predictions(spark, sf), REC)
    return out.select(*REC, i4("bin"), big("count"), r6("lower"))


_ENT = "-(" + " + ".join(f"CASE WHEN p_{c.lower()} > 0 THEN p_{c.lower()} * ln(p_{c.lower()}) ELSE 0 END" for c in CLASSES) + ")"


@query(
    "agg_11_entropy_summary",
    f"""WITH {PREDS}, e AS (SELECT dataset_id, {_ENT} AS e FROM preds_v),
l AS (SELECT dataset_id, avg(e) AS mean, list_sort(list(e)) AS es, count(*) AS n FROM e GROUP BY 1)
SELECT dataset_id, round(mean, 6) AS mean, round(es[1 + CAST(floor(0.5 * (n - 1)) AS INT)], 6) AS p50,
       round(es[1 + CAST(floor(0.9 * (n - 1)) AS INT)], 6) AS p90 FROM l""",
)
def entropy(spark, sf):
    out = ev.entropy_summary(predictions(spark, sf), ["dataset_id"])
    return out.select("dataset_id", r6("mean"), r6("p50"), r6("p90"))


@query(
    "agg_12_mean_confidence",
    f"""WITH {PREDS} SELECT tenant_id, model_version, round(avg(confidence), 6) AS avg_confidence
FROM preds_v GROUP BY tenant_id, model_version""",
)
def mean_confidence(spark, sf):
    return ev.mean_confidence(predictions(spark, sf), ["tenant_id", "model_version"]).select(
        "tenant_id", "model_version", r6("avg_confidence")
    )


def labelled(spark, sf):
    df = predictions(spark, sf).filter(F.col("true4").isNotNull())
    top = cal.top_label(df)
    return top.withColumn("correct", (F.col("argmax") == F.col("true4")).cast("double"))


_EDGES = "[" + ", ".join(repr(e) for e in cal.bin_edges(15)[1:-1]) + "]"
_TOP = f""", top_v AS (SELECT *, greatest(p_w, p_light, p_deep, p_rem) AS conf FROM preds_v WHERE true4 IS NOT NULL),
top_c AS (SELECT *, CASE WHEN p_w = conf THEN 'W' WHEN p_light = conf THEN 'Light' WHEN p_deep = conf THEN 'Deep' ELSE 'REM' END AS am FROM top_v),
top_b AS (SELECT *, CASE WHEN am = true4 THEN 1.0 ELSE 0.0 END AS correct,
   CAST(len(list_filter({_EDGES}, lambda e : conf >= e)) AS INT) AS bin FROM top_c)"""


@query(
    "agg_13_reliability_bins",
    f"""WITH {PREDS}{_TOP},
g AS (SELECT d.dataset_id, CAST(r.range AS INT) AS bin FROM (SELECT DISTINCT dataset_id FROM top_b) d, range(15) r),
a AS (SELECT dataset_id, bin, count(*) AS n, avg(conf) AS ac, avg(correct) AS aa FROM top_b GROUP BY 1, 2)
SELECT dataset_id, bin, coalesce(n, 0) AS count, round(coalesce(ac, 0), 6) AS avg_conf, round(coalesce(aa, 0), 6) AS avg_acc,
       round(round(abs(coalesce(aa, 0) - coalesce(ac, 0)), 10), 6) AS gap FROM g LEFT JOIN a USING (dataset_id, bin)""",
)
def reliability(spark, sf):
    out = cal.reliability(labelled(spark, sf), ["dataset_id"], "conf", "correct")
    return out.select("dataset_id", i4("bin"), big("count"), r6("avg_conf"), r6("avg_acc"), r6(F.round("gap", 10), "gap"))


@query(
    "agg_14_ece",
    f"""WITH {PREDS}{_TOP},
bins AS (SELECT recording_id, bin, count(*) AS n, abs(avg(correct) - avg(conf)) AS gap FROM top_b GROUP BY 1, 2)
SELECT recording_id, round(round(sum(gap * n) / sum(n), 10), 6) AS ece FROM bins GROUP BY 1""",
)
def ece(spark, sf):
    return cal.ece(labelled(spark, sf), ["recording_id"], "conf", "correct").select("recording_id", r6(F.round("ece", 10), "ece"))


@query(
    "agg_14_ece_per_class",
    f"""WITH {PREDS}, x AS (SELECT dataset_id, true4, unnest(['W','Light','Deep','REM']) AS label,
    unnest([p_w, p_light, p_deep, p_rem]) AS conf FROM preds_v WHERE true4 IS NOT NULL),
b AS (SELECT dataset_id, label, len(list_filter({_EDGES}, lambda e : conf >= e)) AS bin, count(*) AS n,
    abs(avg(CASE WHEN true4 = label THEN 1.0 ELSE 0.0 END) - avg(conf)) AS gap FROM x GROUP BY 1, 2, 3)
SELECT dataset_id, label, round(round(sum(gap * n) / sum(n), 10), 6) AS ece FROM b GROUP BY 1, 2""",
)
def ece_per_class(spark, sf):
    df = predictions(spark, sf).filter(F.col("true4").isNotNull())
    rows = cal.one_vs_rest(df, ["dataset_id"], "probabilities", "true4")
    return cal.ece(rows, ["dataset_id", "label"], "conf", "correct").select("dataset_id", "label", r6(F.round("ece", 10), "ece"))


_BRIER = " + ".join(f"pow(p_{c.lower()} - CASE WHEN true4 = '{c}' THEN 1 ELSE 0 END, 2)" for c in CLASSES)


@query(
    "agg_15_brier",
    f"""WITH {PREDS} SELECT {R}, round(round(avg({_BRIER}), 10), 6) AS brier FROM preds_v WHERE true4 IS NOT NULL GROUP BY {R}""",
)
def brier(spark, sf):
    return cal.brier(predictions(spark, sf), REC).select(*REC, r6(F.round("brier", 10), "brier"))


@query(
    "agg_16_guess_percentages",
    f"""WITH {PREDS}, {counts_sql('dataset_id')}
SELECT dataset_id, pred, {", ".join(f"round(100.0 * coalesce(sum(n) FILTER (WHERE truth = '{s}'), 0) / sum(n), 6) AS true_{s}" for s in STAGES)}
FROM conf GROUP BY dataset_id, pred""",
)
def guesses(spark, sf):
    counts = ev.confusion_counts(predictions(spark, sf), ["dataset_id"])
    out = ev.guess_percentages(counts, ["dataset_id"], STAGES)
    return out.select("dataset_id", "pred", *[r6(f"true_{s}") for s in STAGES])


_POS = f"pos_v AS (SELECT *, CAST(row_number() OVER (PARTITION BY {R} ORDER BY epoch_index) - 1 AS INT) AS pos FROM preds_v)"
_POST4 = f"pos_v AS (SELECT *, CAST(row_number() OVER (PARTITION BY {R} ORDER BY epoch_index) - 1 AS INT) AS pos FROM preds_v WHERE true4 IS NOT NULL)"


@query(
    "agg_24_recording_summary",
    f"""WITH {PREDS}, {_POS}, o AS (SELECT {R}, min(pos) AS onset FROM pos_v WHERE predicted_stage <> 'W' GROUP BY {R})
SELECT p.tenant_id, p.recording_id, count(*) * 0.5::DOUBLE AS total_minutes,
  {", ".join(f"count(*) FILTER (WHERE predicted_stage = '{s}') * 0.5::DOUBLE AS minutes_{s.lower()}" for s in STAGES)},
  any_value(onset) * 0.5::DOUBLE AS sleep_latency_minutes,
  CASE WHEN any_value(onset) IS NULL THEN NULL ELSE count(*) FILTER (WHERE predicted_stage = 'W' AND pos >= onset) * 0.5::DOUBLE END AS waso_minutes
FROM pos_v p LEFT JOIN o ON p.recording_id = o.recording_id AND p.tenant_id = o.tenant_id GROUP BY p.tenant_id, p.recording_id""",
)
def recording_summary(spark, sf):
    return ni.recording_summary(predictions(spark, sf), REC)


def _night(stage: str, name: str) -> str:
    return f"""{name}_o AS (SELECT {R}, min(pos) AS onset FROM pos_v WHERE {stage} <> 'W' GROUP BY {R}),
{name} AS (SELECT p.tenant_id, p.recording_id, count(*) * 0.5 AS total, count(*) FILTER (WHERE {stage} <> 'W') * 0.5 AS sleep,
  count(*) FILTER (WHERE {stage} <> 'W') / count(*) AS efficiency, any_value(onset) * 0.5 AS latency,
  CASE WHEN any_value(onset) IS NULL THEN NULL ELSE count(*) FILTER (WHERE {stage} = 'W' AND pos >= onset) * 0.5 END AS waso
  FROM pos_v p LEFT JOIN {name}_o o ON p.recording_id = o.recording_id GROUP BY 1, 2)"""


@query(
    "agg_25_night_summary_delta",
    f"""WITH {PREDS}, {_POST4}, {_night('predicted_stage', 'a')}, {_night('ground_truth_stage', 'b')}
SELECT a.tenant_id, a.recording_id, round(a.total - b.total, 6)::DOUBLE AS delta_total, round(a.sleep - b.sleep, 6)::DOUBLE AS delta_sleep,
  round(a.efficiency - b.efficiency, 6)::DOUBLE AS delta_efficiency, round(a.latency - b.latency, 6)::DOUBLE AS delta_latency,
  round(a.waso - b.waso, 6)::DOUBLE AS delta_waso,
  s.x AS delta_share_rem
FROM a JOIN b USING (tenant_id, recording_id) JOIN (SELECT recording_id, round((count(*) FILTER (WHERE predicted_stage = 'REM')
  - count(*) FILTER (WHERE ground_truth_stage = 'REM')) / count(*), 6)::DOUBLE AS x FROM pos_v GROUP BY 1) s ON s.recording_id = a.recording_id""",
)
def night_delta(spark, sf):
    out = ni.night_delta(predictions(spark, sf), REC)
    return out.select(
        *REC,
        *[r6(f"delta_{m}") for m in ("total", "sleep", "efficiency", "latency", "waso", "share_rem")],
    )


def _clin(stage: str, name: str) -> str:
    return f"""{name}_o AS (SELECT {R}, min(pos) FILTER (WHERE {stage} <> 'W') AS onset, min(pos) FILTER (WHERE {stage} = 'REM') AS rem FROM pos_v GROUP BY {R}),
{name} AS (SELECT p.tenant_id, p.recording_id, count(*) FILTER (WHERE {stage} <> 'W') * 0.5 AS tst_min,
  count(*) FILTER (WHERE {stage} <> 'W') / count(*) AS se,
  coalesce(count(*) FILTER (WHERE {stage} = 'REM') / nullif(count(*) FILTER (WHERE {stage} <> 'W'), 0), 0) AS rem_pct,
  coalesce(count(*) FILTER (WHERE {stage} = 'Deep') / nullif(count(*) FILTER (WHERE {stage} <> 'W'), 0), 0) AS n3_pct,
  coalesce((any_value(rem) - any_value(onset)) * 0.5, 0) AS rem_latency_min,
  CASE WHEN any_value(onset) IS NULL THEN 0 ELSE count(*) FILTER (WHERE {stage} = 'W' AND pos >= onset) * 0.5 END AS waso_min
  FROM pos_v p JOIN {name}_o o ON p.recording_id = o.recording_id GROUP BY 1, 2)"""


CLIN_SQL = f"""{_POST4}, {_clin('true4', 'ct')}, {_clin('pred4', 'cp')},
ce AS (SELECT ct.tenant_id, ct.recording_id, {", ".join(
    f"abs(cp.{m} - ct.{m}) AS {m}_mae, CASE WHEN abs(ct.{m}) > 1e-6 THEN abs(cp.{m} - ct.{m}) / abs(ct.{m}) ELSE 0 END AS {m}_ape"
    for m in ni.CLINICAL)} FROM ct JOIN cp USING (tenant_id, recording_id))"""


@query(
    "agg_26_clinical_agreement",
    f"""WITH {PREDS}, {CLIN_SQL}
SELECT {R}, {", ".join(f"round({m}_mae, 6)::DOUBLE AS {m}_mae, round({m}_ape, 6)::DOUBLE AS {m}_ape" for m in ni.CLINICAL)} FROM ce""",
)
def clinical(spark, sf):
    out = ni.clinical(predictions(spark, sf), REC)
    return out.select(*REC, *[r6(f"{m}_{e}") for m in ni.CLINICAL for e in ("mae", "ape")])


@query(
    "agg_27_night_metric_summary",
    f"""WITH {PREDS}, {counts_sql('dataset_id, recording_id', 'true4', 'pred4')}, {class_sql('dataset_id, recording_id')}, {scores_sql('dataset_id, recording_id')},
k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY macro_f1, recording_id) AS rn, count(*) OVER (PARTITION BY dataset_id) AS cnt FROM sc)
SELECT dataset_id, count(*) AS nights, round(avg(macro_f1), 6) AS mean, round(stddev_pop(macro_f1), 6) AS std,
  round(quantile_cont(macro_f1, 0.1), 6) AS p10, round(avg(macro_f1) FILTER (WHERE rn <= greatest(ceil(0.1 * cnt), 1)), 6) AS worst_decile_mean
FROM k GROUP BY dataset_id""",
)
def night_metrics(spark, sf):
    nights = ev.classification_report(predictions(spark, sf), ["dataset_id", "recording_id"])
    out = ni.metric_summary(nights, "recording_id", "macro_f1", ["dataset_id"])
    return out.select("dataset_id", big("nights"), r6("mean"), r6("std"), r6("p10"), r6("worst_decile_mean"))


@query(
    "agg_28_clinical_errors",
    f"""WITH {PREDS}, {CLIN_SQL}
{" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}_mae), 6)::DOUBLE AS mae, round(avg({m}_ape), 6)::DOUBLE AS ape FROM ce" for m in ni.CLINICAL)}""",
)
def clinical_errors(spark, sf):
    return ni.clinical_errors(ni.clinical(predictions(spark, sf), REC)).select("metric", r6("mae"), r6("ape"))


@query(
    "agg_28_class_recall_floors",
    f"""WITH {PREDS}, {counts_sql('dataset_id', 'true4', 'pred4')}, {class_sql('dataset_id')}
SELECT dataset_id, round(min(recall), 6) AS min_class_recall, round(max(recall) FILTER (WHERE label = 'REM'), 6) AS rem_recall,
       round(max(recall) FILTER (WHERE label = 'Deep'), 6) AS deep_recall FROM pc GROUP BY 1""",
)
def recall_floors(spark, sf):
    classes = ev.per_class(ev.confusion_counts(predictions(spark, sf), ["dataset_id"], "true4", "pred4"), ["dataset_id"])
    return classes.groupBy("dataset_id").agg(
        r6(F.min("recall"), "min_class_recall"),
        *[r6(F.max(F.when(F.col("label") == c, F.col("recall"))), f"{c.lower()}_recall") for c in ("REM", "Deep")],
    )


@query(
    "agg_33_class_weights",
    f"""WITH {PREDS}, l AS (SELECT unnest(['W','Light','Deep','REM']) AS label),
c AS (SELECT l.label, count(p.true4) AS count FROM l LEFT JOIN preds_v p ON p.true4 = l.label GROUP BY 1),
w AS (SELECT *, CASE WHEN count > 0 THEN 1.0 / count ELSE 1.0 END AS inv,
  CASE WHEN count > 0 THEN 1.0 / ln(1.02 + count / sum(count) OVER ()) ELSE 1.0 END AS logb FROM c)
SELECT label, count, round(inv * 4 / sum(inv) OVER (), 6) AS inverse_weight, round(logb * 4 / sum(logb) OVER (), 6) AS log_weight FROM w""",
)
def class_weights(spark, sf):
    df = predictions(spark, sf).filter(F.col("true4").isNotNull())
    inverse = ev.class_weights(df, "true4", CLASSES)
    logged = ev.class_weights(df, "true4", CLASSES, "log_balanced").select("label", F.col("weight").alias("log_weight"))
    return inverse.join(logged, "label").select("label", big("count"), r6("weight", "inverse_weight"), r6("log_weight"))


@query(
    "agg_34_split_class_distribution",
    f"""WITH {PREDS}, s AS (SELECT dataset_id, true4 AS label, count(*) AS count FROM preds_v WHERE true4 IS NOT NULL GROUP BY 1, 2)
SELECT dataset_id, label, count, round(count / sum(count) OVER (PARTITION BY dataset_id), 6) AS frequency FROM s""",
)
def class_distribution(spark, sf):
    df = predictions(spark, sf).filter(F.col("true4").isNotNull())
    return ev.distribution(df, ["dataset_id"], "true4").select("dataset_id", "label", big("count"), r6("frequency"))


_NEXT = f"""nx AS (SELECT *, lead(predicted_stage) OVER w AS nps, lead(pred4) OVER w AS np4, lead(true4) OVER w AS nt4, lead(1) OVER w AS has
 FROM preds_v WINDOW w AS (PARTITION BY {R} ORDER BY epoch_index))"""
_NEXT4 = f"""nx AS (SELECT *, lead(pred4) OVER w AS np4, lead(true4) OVER w AS nt4
 FROM preds_v WHERE true4 IS NOT NULL WINDOW w AS (PARTITION BY {R} ORDER BY epoch_index))"""
_CELLS = f"""{_NEXT4},
tt AS (SELECT {R}, true4 AS src, nt4 AS dst, count(*) AS n FROM nx WHERE nt4 IS NOT NULL GROUP BY ALL),
tp AS (SELECT {R}, pred4 AS src, np4 AS dst, count(*) AS n FROM nx WHERE np4 IS NOT NULL GROUP BY ALL),
g AS (SELECT d.*, a.l AS src, b.l AS dst FROM (SELECT DISTINCT {R} FROM nx) d, (SELECT unnest(['W','Light','Deep','REM']) AS l) a, (SELECT unnest(['W','Light','Deep','REM']) AS l) b),
cells AS (SELECT g.*, coalesce(tt.n, 0) AS nt, coalesce(tp.n, 0) AS np,
  coalesce(tt.n / sum(tt.n) OVER (PARTITION BY g.recording_id, g.src), 0) AS pt, coalesce(tp.n / sum(tp.n) OVER (PARTITION BY g.recording_id, g.src), 0) AS pp
  FROM g LEFT JOIN tt ON (g.recording_id, g.src, g.dst) = (tt.recording_id, tt.src, tt.dst)
         LEFT JOIN tp ON (g.recording_id, g.src, g.dst) = (tp.recording_id, tp.src, tp.dst))"""


@query(
    "seq_01_transition_counts",
    f"""WITH {PREDS}, {_NEXT} SELECT {R}, predicted_stage AS src, nps AS dst, count(*) AS n FROM nx WHERE has = 1 GROUP BY ALL""",
)
def transitions(spark, sf):
    return sq.transition_counts(predictions(spark, sf), REC, by=REC, labels=STAGES)


@query(
    "seq_02_normalised_transitions",
    f"""WITH {PREDS}, {_NEXT}, c AS (SELECT dataset_id, predicted_stage AS src, nps AS dst, count(*) AS n FROM nx WHERE has = 1 GROUP BY ALL)
SELECT dataset_id, src, dst, n, round(n / sum(n) OVER (PARTITION BY dataset_id, src), 6) AS p FROM c""",
)
def normalised(spark, sf):
    counts = sq.transition_counts(predictions(spark, sf), REC, by=["dataset_id"])
    return sq.row_normalise(counts, ["dataset_id"]).select("dataset_id", "src", "dst", big("n"), r6("p"))


def _four(spark, sf):
    return predictions(spark, sf).filter(F.col("true4").isNotNull())


@query(
    "seq_02_transition_error",
    f"""WITH {PREDS}, {_CELLS}
SELECT {R}, CAST(sum(abs(np - nt)) AS DOUBLE) AS error_raw, round(sum(abs(pp - pt)), 6) AS error_norm FROM cells GROUP BY {R}
HAVING sum(np) + sum(nt) > 0""",
)
def transition_error(spark, sf):
    cells = sq.transition_cells(_four(spark, sf), REC, REC)
    return sq.transition_errors(cells, REC).select(*REC, r6("error_raw"), r6("error_norm"))


@query(
    "seq_03_transition_entropy",
    f"""WITH {PREDS}, {_CELLS}, e AS (SELECT {R}, sum(-greatest(pt, 1e-12) * ln(greatest(pt, 1e-12))) / 4 AS et,
  sum(-greatest(pp, 1e-12) * ln(greatest(pp, 1e-12))) / 4 AS ep FROM cells GROUP BY {R} HAVING sum(np) + sum(nt) > 0)
SELECT {R}, round(et, 6) AS entropy_true, round(ep, 6) AS entropy_pred, round(abs(ep - et), 6) AS entropy_diff FROM e""",
)
def transition_entropy(spark, sf):
    cells = sq.transition_cells(_four(spark, sf), REC, REC)
    return sq.transition_errors(cells, REC).select(*REC, r6("entropy_true"), r6("entropy_pred"), r6("entropy_diff"))


@query(
    "seq_04_fragmentation",
    f"""WITH {PREDS}, {_NEXT4}, f AS (SELECT {R},
  1 + count(*) FILTER (WHERE true4 <> nt4) AS runs_true, 1 + count(*) FILTER (WHERE pred4 <> np4) AS runs_pred,
  count(*) FILTER (WHERE true4 <> 'W') * 0.5 AS tst_true, count(*) FILTER (WHERE pred4 <> 'W') * 0.5 AS tst_pred FROM nx GROUP BY {R})
SELECT {R}, runs_true, runs_pred, round(abs((runs_pred - 1) / (tst_pred + 1e-6) - (runs_true - 1) / (tst_true + 1e-6)), 6)::DOUBLE AS fragmentation_error FROM f""",
)
def fragmentation(spark, sf):
    out = sq.fragmentation(_four(spark, sf), REC)
    return out.select(*REC, big("runs_true"), big("runs_pred"), r6("fragmentation_error"))


@query(
    "seq_05_edit_distance",
    f"""WITH {PREDS}, s AS (SELECT {R},
  string_agg(CASE true4 WHEN 'W' THEN '0' WHEN 'Light' THEN '1' WHEN 'Deep' THEN '2' ELSE '3' END, '' ORDER BY epoch_index) AS t,
  string_agg(CASE pred4 WHEN 'W' THEN '0' WHEN 'Light' THEN '1' WHEN 'Deep' THEN '2' ELSE '3' END, '' ORDER BY epoch_index) AS p
  FROM preds_v WHERE true4 IS NOT NULL GROUP BY {R})
SELECT {R}, CAST(levenshtein(t, p) AS BIGINT) AS distance, round(levenshtein(t, p) / greatest(length(t), length(p), 1), 6) AS distance_norm FROM s""",
)
def edit_distance(spark, sf):
    return sq.edit_distance(_four(spark, sf), REC).select(*REC, big("distance"), r6("distance_norm"))


_RATES = f"""rates AS (SELECT {R}, count(np4) AS transitions, 1 + count(*) FILTER (WHERE pred4 <> np4) AS runs,
  coalesce(count(*) FILTER (WHERE (pred4 = 'Deep' AND np4 = 'REM') OR (pred4 = 'REM' AND np4 = 'Deep')) / nullif(count(np4), 0), 0) AS forbidden_rate,
  coalesce(count(*) FILTER (WHERE pred4 = 'W' AND np4 = 'Deep') / nullif(count(np4), 0), 0) AS pair_rate FROM nx GROUP BY {R})"""


@query(
    "seq_06_forbidden_transition_rate",
    f"""WITH {PREDS}, {_NEXT}, {_RATES} SELECT {R}, transitions, round(forbidden_rate, 6)::DOUBLE AS forbidden_rate FROM rates""",
)
def forbidden(spark, sf):
    return sq.pair_rates(predictions(spark, sf), REC).select(*REC, big("transitions"), r6("forbidden_rate"))


@query(
    "seq_07_wake_deep_rate",
    f"""WITH {PREDS}, {_NEXT}, {_RATES} SELECT {R}, runs, round(pair_rate, 6)::DOUBLE AS pair_rate FROM rates""",
)
def wake_deep(spark, sf):
    return sq.pair_rates(predictions(spark, sf), REC).select(*REC, big("runs"), r6("pair_rate"))


@query(
    "seq_08_transition_stability",
    f"""WITH {PREDS}, {_CELLS} SELECT {R}, round(sum(abs(pt - pp)), 6) AS stability FROM cells GROUP BY {R} HAVING sum(np) + sum(nt) > 0""",
)
def stability(spark, sf):
    cells = sq.transition_cells(_four(spark, sf), REC, REC)
    return sq.transition_stability(cells, REC).select(*REC, r6("stability"))


@query(
    "seq_09_window_gaps",
    f"""WITH {PREDS}, d AS (SELECT {R}, end_sec, end_sec - lag(end_sec) OVER (PARTITION BY {R} ORDER BY epoch_index) AS delta FROM preds_v)
SELECT {R}, end_sec, delta, CASE WHEN delta >= 120 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM d WHERE delta > 30""",
)
def window_gaps(spark, sf):
    return sq.window_gaps(predictions(spark, sf), REC)


@query(
    "seq_10_recent_split",
    f"""WITH {PREDS}, l AS (SELECT *, row_number() OVER (ORDER BY end_sec DESC, recording_id DESC) AS r, count(*) OVER () AS n FROM preds_v)
SELECT recording_id, end_sec, predicted_stage, CASE WHEN r <= 250 THEN 'current' ELSE 'baseline' END AS "window" FROM l WHERE r <= 500 AND n > 250""",
)
def recent_split(spark, sf):
    df = predictions(spark, sf).select("recording_id", "end_sec", "predicted_stage")
    return sq.recent_split(df, [F.desc("end_sec"), F.desc("recording_id")], 250)


@query(
    "seq_12_learned_transitions",
    f"""WITH {PREDS}, {_NEXT4},
c AS (SELECT true4 AS src, nt4 AS dst, count(*) AS n FROM nx WHERE nt4 IS NOT NULL GROUP BY ALL),
g AS (SELECT a.l AS src, b.l AS dst FROM (SELECT unnest(['W','Light','Deep','REM']) AS l) a, (SELECT unnest(['W','Light','Deep','REM']) AS l) b),
b AS (SELECT g.*, coalesce(n, 0) + 1.0 AS n, exp(-CASE WHEN g.src = g.dst THEN 0.0
   WHEN g.src || g.dst IN ('WLight','LightW','LightDeep','DeepLight','LightREM','REMLight') THEN 0.2
   WHEN g.src || g.dst IN ('WDeep','DeepREM','REMDeep') THEN 4.0 ELSE 1.4 END) AS pr FROM g LEFT JOIN c USING (src, dst)),
m AS (SELECT src, dst, (1 / 1.5) * n / sum(n) OVER (PARTITION BY src) + (1 - 1 / 1.5) * pr / sum(pr) OVER (PARTITION BY src) AS mix FROM b),
p AS (SELECT src, dst, mix / sum(mix) OVER (PARTITION BY src) AS probability FROM m)
SELECT src, dst, round(probability, 6)::DOUBLE AS probability, round(-ln(probability), 6)::DOUBLE AS penalty FROM p""",
)
def learned(spark, sf):
    from nightframe.operators.scoring import prior_transitions

    out = sq.learned_transitions(_four(spark, sf), REC, "true4", prior_transitions(CLASSES), l2_strength=0.0005)
    return out.select("src", "dst", r6("probability"), r6("penalty"))


@query(
    "seq_13_hypnogram_bins",
    f"""WITH {PREDS}, {_POS} SELECT {R}, pos AS start_min, 1 AS duration_min,
  CASE predicted_stage WHEN 'W' THEN 'awake' WHEN 'N3' THEN 'deep' WHEN 'R' THEN 'rem' ELSE 'light' END AS stage FROM pos_v""",
)
def hypnogram_bins(spark, sf):
    return ni.hypnogram_bins(predictions(spark, sf), REC, ui_stage(F.col("predicted_stage")))


@query(
    "top_04_hardest_recordings",
    f"""WITH {PREDS}, {counts_sql('recording_id', 'true4', 'pred4')}, {class_sql('recording_id')}, {scores_sql('recording_id')},
k AS (SELECT *, row_number() OVER (ORDER BY macro_f1_all, recording_id) AS rn, count(*) OVER () AS cnt FROM sc)
SELECT recording_id, round(macro_f1_all, 6) AS macro_f1_all, rn AS worst_rank FROM k WHERE rn <= greatest(ceil(cnt * 0.2), 1)""",
)
def hardest(spark, sf):
    nights = ev.classification_report(predictions(spark, sf), ["recording_id"])
    # scores are compared at nine places so that the order is the same on every run
    nights = nights.withColumn("macro_f1_all", F.round("macro_f1_all", 9))
    worst = ni.worst_rows(nights, [], [F.col("macro_f1_all"), F.col("recording_id")], 0.2)
    return worst.select("recording_id", r6("macro_f1_all"), "worst_rank")


@query(
    "top_05_worst_dataset",
    f"""WITH {PREDS}, {counts_sql('dataset_id', 'true4', 'pred4')}, {class_sql('dataset_id')}, {scores_sql('dataset_id')}
SELECT dataset_id, round(macro_f1, 6) AS macro_f1 FROM sc ORDER BY macro_f1, dataset_id LIMIT 1""",
)
def worst_dataset(spark, sf):
    scores = ev.classification_report(predictions(spark, sf), ["dataset_id"])
    return ev.worst_scope(scores, "dataset_id", "macro_f1").select("dataset_id", r6("macro_f1"))
