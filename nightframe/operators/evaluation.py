"""Classification metrics from predictions (AGG-01 .. AGG-12, AGG-16, AGG-33, AGG-34)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.operators.ordered import exact_quantiles


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 on an empty denominator."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def confusion_counts(
    df: DataFrame, by: Sequence[str], truth: str = "ground_truth_stage", pred: str = "predicted_stage"
) -> DataFrame:
    """Cell counts (truth, pred, n) per scope over labelled rows; no empty cells."""
    return (
        df.filter(F.col(truth).isNotNull() & (F.col(truth) != ""))
        .groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(counts: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Dense matrix over a fixed label order, one row per cell and scope."""
    cell = F.struct("truth", "pred")
    scopes = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(cell, F.col("n")))).alias("_cells")
    )
    axis = F.array(*[F.lit(x) for x in labels])
    return (
        scopes.withColumn("truth", F.explode(axis))
        .withColumn("pred", F.explode(axis))
        .select(
            *by,
            "truth",
            "pred",
            F.coalesce(F.try_element_at("_cells", F.struct("truth", "pred")), F.lit(0)).alias("n"),
        )
    )


def label_tallies(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per label: true positives, support and predicted count."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    parts = F.array(
        F.struct(
            F.col("truth").alias("label"),
            hit.cast("bigint").alias("tp"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
        ),
        F.struct(
            F.col("pred").alias("label"),
            F.lit(0).cast("bigint").alias("tp"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    return (
        counts.select(*by, F.explode(parts).alias("p"))
        .groupBy(*by, F.col("p.label").alias("label"))
        .agg(
            F.sum("p.tp").alias("tp"),
            F.sum("p.support").alias("support"),
            F.sum("p.predicted").alias("predicted"),
        )
    )


def per_class(counts: DataFrame, by: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1, specificity and support per label.

    With ``labels``, labels that never occur appear with zeros.
    """
    tallies = label_tallies(counts, by)
    if labels is not None:
        tallies = dense_labels(tallies, by, labels, ["tp", "support", "predicted"])
    total = F.sum("support").over(Window.partitionBy(*(by or [F.lit(0)])))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    scored = tallies.withColumns(
        {
            "total": total,
            "precision": ratio(tp, predicted),
            "recall": ratio(tp, support),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    negatives = F.col("total") - support
    return scored.withColumns(
        {
            "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)),
            "specificity": ratio(negatives - (predicted - tp), negatives),
        }
    )


def dense_labels(
    df: DataFrame, by: Sequence[str], labels: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Add zero rows for labels of a fixed order that a scope lacks."""
    maps = [
        F.map_from_entries(F.collect_list(F.struct("label", v))).alias(f"_m_{v}") for v in values
    ]
    wide = df.groupBy(*by).agg(*maps)
    return wide.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels]))).select(
        *by,
        "label",
        *[F.coalesce(F.try_element_at(f"_m_{v}", F.col("label")), F.lit(0)).alias(v) for v in values],
    )


def scope_scores(classes: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per scope from :func:`per_class` rows (AGG-03 .. AGG-06).

    ``macro_f1_all`` averages every label, ``macro_f1`` only supported ones.
    """
    supported = F.col("support") > 0
    agg = classes.groupBy(*by).agg(
        F.sum("tp").cast("double").alias("_c"),
        F.sum("support").cast("double").alias("_n"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("_tp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("_pp"),
        F.avg("f1").alias("macro_f1_all"),
        F.coalesce(F.avg(F.when(supported, F.col("f1"))), F.lit(0.0)).alias("macro_f1"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"),
        F.coalesce(F.avg(F.when(supported, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.min(F.col("recall")).alias("min_class_recall"),
        F.sum("support").alias("support_total"),
    )
    c, n = F.col("_c"), F.col("_n")
    denom = F.sqrt((n * n - F.col("_pp")) * (n * n - F.col("_tt")))
    expected = F.try_divide(F.col("_tp"), n * n)
    return agg.select(
        *by,
        "support_total",
        ratio(c, n).alias("accuracy"),
        "macro_f1_all",
        "macro_f1",
        ratio(F.col("_wf"), n).alias("weighted_f1"),
        "balanced_accuracy",
        "min_class_recall",
        F.when(denom > 0, (c * n - F.col("_tp")) / denom).otherwise(F.lit(0.0)).alias("mcc"),
        F.when(
            (n > 0) & (expected != 1.0), (c / n - expected) / (1 - expected)
        ).otherwise(F.lit(0.0)).alias("kappa"),
    )


def classification_report(
    df: DataFrame,
    by: Sequence[str],
    truth: str = "true4",
    pred: str = "pred4",
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """All classification scores per scope (AGG-07)."""
    return scope_scores(per_class(confusion_counts(df, by, truth, pred), by, labels), by)


def report_by_scopes(
    df: DataFrame, dataset: str, recording: str, truth: str = "true4", pred: str = "pred4"
) -> DataFrame:
    """Global, per-dataset and per-recording reports from one pass over the rows."""
    counts = confusion_counts(df, [dataset, recording], truth, pred)
    rolled = counts.groupingSets(
        [
            [F.col("truth"), F.col("pred")],
            [F.col(dataset), F.col("truth"), F.col("pred")],
            [F.col(dataset), F.col(recording), F.col("truth"), F.col("pred")],
        ],
        dataset,
        recording,
        "truth",
        "pred",
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("_level"))
    scope = F.when(F.col("_level") == 0, "recording").when(F.col("_level") < 8, "dataset").otherwise("global")
    keyed = rolled.withColumn("scope", scope).withColumn(
        "scope_id",
        F.when(F.col("scope") == "recording", F.col(recording).cast("string"))
        .when(F.col("scope") == "dataset", F.col(dataset))
        .otherwise("all"),
    )
    return scope_scores(per_class(keyed.select("scope", "scope_id", "truth", "pred", "n"), ["scope", "scope_id"]), ["scope", "scope_id"])


def spread(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Largest minus smallest value of each metric over scopes (AGG-08)."""
    return scores.agg(*[(F.max(m) - F.min(m)).alias(f"{m}_spread") for m in metrics])


def worst_scope(scores: DataFrame, scope: str, metric: str) -> DataFrame:
    """The scope with the lowest metric, first by name on ties (TOP-05)."""
    return scores.agg(F.min_by(F.struct(scope, metric), F.struct(metric, scope)).alias("w")).select("w.*")


def distribution(df: DataFrame, by: Sequence[str], stage: str = "predicted_stage") -> DataFrame:
    """Count and share of each stage per scope (AGG-09, AGG-34)."""
    counts = df.groupBy(*by, F.col(stage).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.withColumn("frequency", F.col("count") / total)


def is_finite(col: Column) -> Column:
    x = col.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def confidence_histogram(df: DataFrame, by: Sequence[str], conf: str = "confidence", bins: int = 10) -> DataFrame:
    """Dense histogram of ``int(v * bins)`` clipped to the bin range (AGG-10)."""
    idx = F.least(F.greatest(F.col(conf).cast("double") * bins, F.lit(0.0)), F.lit(bins - 1.0)).cast("int")
    finite = df.filter(is_finite(F.col(conf)))
    wide = finite.groupBy(*by).agg(
        F.array(*[F.count_if(idx == b) for b in range(bins)]).alias("_h")
    )
    return wide.select(*by, F.posexplode("_h").alias("bin", "count")).withColumn(
        "lower", F.col("bin") / F.lit(bins)
    )


def row_entropy(probs: Column) -> Column:
    """Natural-log entropy of an array of probabilities (EXP-20)."""
    usable = F.filter(probs, lambda p: is_finite(p) & (p > 0))
    return F.aggregate(usable, F.lit(0.0), lambda acc, p: acc - p * F.ln(p))


def entropy_summary(df: DataFrame, by: Sequence[str], probs: str = "probabilities") -> DataFrame:
    """Mean and nearest-rank p50/p90 of row entropy (AGG-11)."""
    rows = df.select(*by, row_entropy(F.col(probs)).alias("entropy"))
    means = rows.groupBy(*by).agg(F.avg("entropy").alias("mean"))
    ranks = exact_quantiles(rows, by, "entropy", {"p50": 0.5, "p90": 0.9}, method="lower_rank")
    return means.join(ranks, list(by))


def mean_confidence(
    df: DataFrame, by: Sequence[str], conf: str = "confidence", non_finite: str = "exclude"
) -> DataFrame:
    """Average confidence (AGG-12). ``non_finite``: ``exclude`` or ``zero``."""
    ok = F.when(is_finite(F.col(conf)), F.col(conf))
    value = F.coalesce(ok, F.lit(0.0)) if non_finite == "zero" else ok
    return df.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("avg_confidence"))


def guess_percentages(counts: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """For each predicted class, the percentage of each true class (AGG-16)."""
    wide = counts.groupBy(*by, "pred").pivot("truth", list(labels)).agg(F.sum("n"))
    cells = [F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in labels]
    total = sum(cells[1:], cells[0])
    return wide.select(
        *by, "pred", *[(100.0 * c / total).alias(f"true_{x}") for c, x in zip(cells, labels)]
    )


def class_weights(
    df: DataFrame, label: str, labels: Sequence[str], strategy: str = "inverse"
) -> DataFrame:
    """Class weights normalised to sum to the number of classes (AGG-33)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    dense = dense_labels(counts, [], labels, ["count"])
    everything = Window.partitionBy(F.lit(0))
    share = F.col("count") / F.greatest(F.sum("count").over(everything), F.lit(1))
    raw = (
        1.0 / F.ln(F.lit(1.02) + share) if strategy == "log_balanced" else 1.0 / F.col("count")
    )
    return (
        dense.withColumn("raw", F.when(F.col("count") > 0, raw).otherwise(F.lit(1.0)))
        .withColumn("weight", F.col("raw") * F.lit(float(len(labels))) / F.sum("raw").over(everything))
        .drop("raw")
    )
