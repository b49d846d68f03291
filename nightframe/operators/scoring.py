"""Scoring of windows and decoding of stage sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightframe.functions.numeric import LOW_AGREEMENT_DEFAULT, LOW_AGREEMENT_QUANTILE
from nightframe.functions.binding import bind
from nightframe.functions.probability import argmax_label, linear_logits, softmax, total
from nightframe.operators.evaluation import is_finite
from nightframe.operators.ordered import exact_quantiles
from nightframe.operators.sequences import transition_cells
from nightframe.operators.windows import model_input
from nightframe.session import cut_lineage

# --- fixed values -----------------------------------------------------------
PENALTY_SELF, PENALTY_NEAR, PENALTY_DEFAULT, PENALTY_FORBIDDEN = 0.0, 0.2, 1.4, 4.0
NEAR_PAIRS = [("W", "Light"), ("Light", "Deep"), ("Light", "REM")]
FAR_STEPS = [("W", "Deep"), ("Deep", "REM"), ("REM", "Deep")]
# --- end of fixed values ----------------------------------------------------


def transition_penalties(labels: Sequence[str]) -> dict[tuple[str, str], float]:
    """Default decoding penalty of every ordered pair of labels."""
    near = set(NEAR_PAIRS) | {(b, a) for a, b in NEAR_PAIRS}

    def penalty(src: str, dst: str) -> float:
        if src == dst:
            return PENALTY_SELF
        if (src, dst) in near:
            return PENALTY_NEAR
        return PENALTY_FORBIDDEN if (src, dst) in FAR_STEPS else PENALTY_DEFAULT

    return {(s, d): penalty(s, d) for s in labels for d in labels}


def prior_transitions(labels: Sequence[str]) -> dict[tuple[str, str], float]:
    """Row-normalised ``exp(-penalty)``."""
    weights = {pair: math.exp(-p) for pair, p in transition_penalties(labels).items()}
    totals = {s: sum(weights[s, d] for d in labels) for s in labels}
    return {(s, d): w / totals[s] for (s, d), w in weights.items()}


def linear_model(spark: SparkSession, weights: Sequence[Sequence[float]], bias: Sequence[float], labels: Sequence[str], version: str) -> DataFrame:
    """A linear model as a one-row table: fixed size, one weight row per class."""
    return spark.range(1).select(
        F.lit(version).alias("model_version"),
        F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights]).alias("weights"),
        F.array(*[F.lit(float(b)) for b in bias]).alias("bias"),
        F.array(*[F.lit(x) for x in labels]).alias("labels"),
    )


def score_windows(windows: DataFrame, model: DataFrame, strategy: str = "mean", temperature: float = 1.0) -> DataFrame:
    """Probabilities, label and confidence for each window (MOD-01).

    ``windows`` has a ``model_version`` to score with; the model table has one
    row per version.
    """
    joined = windows.join(model, "model_version").withColumn("_x", model_input(F.col("window"), strategy))
    scored = joined.withColumn(
        "probabilities", softmax(linear_logits(F.col("_x"), F.col("weights"), F.col("bias")), temperature)
    )
    return scored.withColumns(
        {
            "predicted": argmax_label(F.col("probabilities"), F.col("labels")),
            "confidence": F.array_max("probabilities"),
        }
    ).drop("_x", "weights", "bias", "labels")


def ensemble(members: DataFrame, keys: Sequence[str], probs: str, n_classes: int) -> DataFrame:
    """Mean probability row over the models of a window (MOD-02).

    Rows of another width fail; they are not averaged silently.
    """
    width_ok = F.size(probs) == n_classes
    cell = [
        F.avg(
            F.when(width_ok, F.element_at(probs, i + 1)).otherwise(
                F.raise_error(F.lit("Ensemble members differ in width")).cast("double")
            )
        )
        for i in range(n_classes)
    ]
    return members.groupBy(*keys).agg(F.array(*cell).alias(probs), F.count(F.lit(1)).alias("models"))


def _window_moments(windows: DataFrame, width: int) -> DataFrame:
    """Per window and feature: sum, sum of squares and number of finite values."""
    def moments(rows: Column) -> Column:
        def column(j: int) -> Column:
            cells = F.transform(rows, lambda row: F.get(row, F.lit(j)).cast("double"))
            return F.filter(cells, lambda v: is_finite(v))

        def sums(x: Column) -> Column:
            squares = total(F.transform(x, lambda v: v * v))
            return F.struct(total(x).alias("s"), squares.alias("q"), F.size(x).cast("double").alias("n"))

        return F.array(*[bind(column(j), sums) for j in range(width)])

    packed = windows.withColumn("_m", bind(F.col("window"), moments))
    return packed.withColumns(
        {f"_{m}{j}": F.get("_m", F.lit(j))[m] for j in range(width) for m in "sqn"}
    ).drop("_m")


def window_stats(windows: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Mean and population std of each feature over all cells of the windows.

    Moments are taken inside each row first, so nothing is exploded and Spark
    combines the sums on the map side. A constant or empty feature has std 1,
    an empty one mean 0.
    """
    sums = _window_moments(windows, width).groupBy(*by).agg(
        *[F.sum(f"_{m}{j}").alias(f"_{m}{j}") for j in range(width) for m in "sqn"]
    )
    means, stds = [], []
    for j in range(width):
        n = F.col(f"_n{j}")
        mean = F.coalesce(F.try_divide(F.col(f"_s{j}"), n), F.lit(0.0))
        var = F.coalesce(F.try_divide(F.col(f"_q{j}"), n), F.lit(0.0)) - mean * mean
        std = F.sqrt(F.greatest(var, F.lit(0.0)))
        means.append(mean)
        stds.append(F.when(std > 1e-8, std).otherwise(F.lit(1.0)))
    return sums.select(*by, F.array(*means).alias("_mean"), F.array(*stds).alias("_std"))


def _standardise(window: Column, mean: Column, std: Column) -> Column:
    def cell(x: Column, i: Column) -> Column:
        value = x.cast("double")
        filled = F.when(is_finite(value), value).otherwise(F.get(mean, i))
        return (filled - F.get(mean, i)) / F.get(std, i)

    return F.transform(window, lambda row: F.transform(row, cell))


def normalise_windows(
    windows: DataFrame, keys: Sequence[str], width: int, train: Column, per_recording: bool = True
) -> DataFrame:
    """Per-recording z-score, then z-score with training statistics (MOD-03)."""
    out = windows
    if per_recording:
        out = out.join(window_stats(out, keys, width), list(keys)).withColumn(
            "window", _standardise(F.col("window"), F.col("_mean"), F.col("_std"))
        ).drop("_mean", "_std")
    fit = window_stats(out.filter(train), [], width)
    fitted = out.withColumn("_fit", fit.select(F.struct("_mean", "_std")).scalar())
    return fitted.withColumn(
        "window", _standardise(F.col("window"), F.col("_fit._mean"), F.col("_fit._std"))
    ).drop("_fit")


def low_agreement_threshold(train: DataFrame, col: str = "agree_flags") -> DataFrame:
    """0.15 quantile of the training agreement flags, 0.5 without data (MOD-04)."""
    rows = train.select(F.col(col).cast("double").alias("_v")).filter(is_finite(F.col("_v")))
    fit = exact_quantiles(rows, [], "_v", {"threshold": LOW_AGREEMENT_QUANTILE})
    return fit.select(F.coalesce("threshold", F.lit(LOW_AGREEMENT_DEFAULT)).alias("threshold"))


def loss_sums(logits: pa.Array, index: pa.Array, temperatures: Sequence[float]) -> list[float | None]:
    """Sum of the rows' negative log-likelihoods at each temperature; rows with a null count as nothing.

    Classes are numbered from 1; a number that names no class is refused.
    """
    whole = pa.compute.and_(logits.is_valid(), index.is_valid()).to_numpy(zero_copy_only=False)
    lengths = pa.compute.fill_null(pa.compute.list_value_length(logits), 0).to_numpy(zero_copy_only=False)
    at = pa.compute.fill_null(index, 0).to_numpy(zero_copy_only=False)
    if (whole & ((at == 0) | (np.abs(at) > lengths))).any():
        raise ValueError("a label index names no class")
    flat = logits.flatten()
    known, cells = flat.is_valid().to_numpy(zero_copy_only=False), flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    totals: list[float | None] = [None] * len(temperatures)
    for width in np.unique(lengths[whole]).tolist():
        mine = np.flatnonzero(whole & (lengths == width))
        places = starts[mine][:, None] + np.arange(width)
        full = known[places].all(1)
        z, y = cells[places][full], at[mine][full]
        if not len(z):
            continue
        with np.errstate(invalid="ignore", over="ignore"):
            top = z.max(1, keepdims=True)
            chosen = z[np.arange(len(z)), np.where(y > 0, y - 1, y)]
            for i, t in enumerate(temperatures):
                loss = np.log(np.exp((z - top) / t).sum(1)) + (top[:, 0] - chosen) / t
                totals[i] = (totals[i] or 0.0) + float(loss.sum())
    return totals


def fit_temperature(
    df: DataFrame, logits: str, label_index: str, grid: Sequence[float]
) -> DataFrame:
    """Temperature with the smallest negative log-likelihood on a grid (MOD-05).

    Each Arrow batch of rows becomes one row of sums, a column per candidate: one
    pass, no row is copied. Candidates below 0.05 are raised to it.
    """
    usable = sorted({max(float(t), 0.05) for t in grid})
    names = [f"_t{i}" for i in range(len(usable))]

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = loss_sums(batch.column("_z"), batch.column("_y"), usable)
            rows = pa.array([batch.num_rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([s], pa.float64()) for s in sums], rows], names=[*names, "rows"])

    rows = df.select(F.col(logits).cast("array<double>").alias("_z"), F.col(label_index).cast("int").alias("_y"))
    schema = T.StructType([*[T.StructField(n, T.DoubleType()) for n in names], T.StructField("rows", T.LongType())])
    sums = rows.mapInArrow(sums_of, schema).agg(*[F.sum(n).alias(n) for n in names], F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    cells = [F.struct(F.col(f"_t{i}").alias("nll"), F.lit(t).alias("temperature")) for i, t in enumerate(usable)]
    best = F.array_min(F.array(*cells))
    return sums.select(best["temperature"].alias("temperature"), (best["nll"] / F.col("rows")).alias("nll"), "rows")


def replay_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Predictions of two models for the same windows (JON-09)."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    return left.join(right, list(keys))


def replay_summary(
    joined: DataFrame, keys: Sequence[str], by: Sequence[str], truth: str, index: str = "epoch_index"
) -> DataFrame:
    """Confidence delta, transition L1/L2 and accuracy of two models (MOD-07).

    ``joined`` has ``a_stage, b_stage, a_confidence, b_confidence``. Transition
    matrices use the union of labels, so they always have one shape.
    """
    cells = transition_cells(
        joined.withColumnsRenamed({"a_stage": "_a", "b_stage": "_b"}), keys, by, "_a", "_b", index
    )
    diff = F.col("n_true") - F.col("n_pred")
    shifts = cells.groupBy(*by).agg(
        F.sum(F.abs(diff)).cast("double").alias("transition_l1"),
        F.sqrt(F.sum(diff * diff)).alias("transition_l2"),
    )
    known = F.col(truth).isNotNull()
    base = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("windows"),
        F.avg("a_confidence").alias("a_mean"), F.avg("b_confidence").alias("b_mean"),
        F.count_if(F.col("a_stage") != F.col("b_stage")).alias("disagreements"),
        F.avg(F.when(known, (F.col("a_stage") == F.col(truth)).cast("double"))).alias("a_accuracy"),
        F.avg(F.when(known, (F.col("b_stage") == F.col(truth)).cast("double"))).alias("b_accuracy"),
    )
    return base.join(shifts, list(by), "left").withColumns(
        {
            "confidence_delta": F.col("a_mean") - F.col("b_mean"),
            "transition_l1": F.coalesce("transition_l1", F.lit(0.0)),
            "transition_l2": F.coalesce("transition_l2", F.lit(0.0)),
        }
    )


def balanced_weights(train: DataFrame, label_index: str, out: str = "_weight") -> DataFrame:
    """Rows with weights under which all classes count alike; one row per class is joined."""
    counts = train.groupBy(label_index).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy()  # over one row per class
    weights = counts.select(label_index, (F.sum("_n").over(whole) / (F.count("_n").over(whole) * F.col("_n"))).alias(out))
    return train.join(F.broadcast(weights), label_index)


def with_folds(train: DataFrame, groups: Sequence[str], folds: int, seed: int = 42, out: str = "_fold") -> DataFrame:
    """Fold of each row by its group, so that a recording is never in two folds."""
    return train.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), *groups), F.lit(folds)).cast("int"))


def train_classifier(
    train: DataFrame, features: str, label_index: str, weight: str | None = None, folds: int = 0,
    reg_params: Sequence[float] = (0.0,), max_iter: int = 20, seed: int = 42,
    groups: Sequence[str] = (), balanced: bool = False, trees: bool = False, depth: int = 3,
):
    """Multinomial logistic regression on scaled features, or one-vs-rest boosted
    trees (MOD-06).

    ``balanced`` weighs classes alike. With ``folds`` the regularisation (or the
    depth of the trees) is chosen by F1 over folds, made of whole ``groups``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = train.withColumn("_vector", array_to_vector(F.col(features)))
    if balanced:
        data, weight = balanced_weights(data, label_index), "_weight"
    if folds >= 2 and groups:
        data = with_folds(data, groups, folds, seed)
    # every fit and every score of a fold reads these rows again: they are made once
    extra = [weight] * (weight is not None) + ["_fold"] * (folds >= 2 and bool(groups))
    data = cut_lineage(data.select("_vector", label_index, *extra), "training")
    if trees:
        base = GBTClassifier(featuresCol="_vector", labelCol=label_index, maxIter=max_iter, maxDepth=depth, seed=seed)
        model = OneVsRest(classifier=base, featuresCol="_vector", labelCol=label_index, rawPredictionCol="rawPrediction")
        if weight:
            model = model.setWeightCol(weight)
        pipeline = Pipeline(stages=[model])
        grid = ParamGridBuilder().addGrid(base.maxDepth, [depth, depth + 2]).build()
    else:
        scaler = StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True)
        model = LogisticRegression(featuresCol="_scaled", labelCol=label_index, maxIter=max_iter, family="multinomial")
        if weight:
            model = model.setWeightCol(weight)
        pipeline = Pipeline(stages=[scaler, model])
        grid = ParamGridBuilder().addGrid(model.regParam, list(reg_params)).build()
    if folds < 2:
        return pipeline.fit(data)
    judge = MulticlassClassificationEvaluator(labelCol=label_index, metricName="f1")
    search = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed)
    if groups:
        search = search.setFoldCol("_fold")
    return search.fit(data).bestModel


def apply_classifier(model, df: DataFrame, features: str) -> DataFrame:
    """Class index and probability array of a fitted classifier (null for trees, which have scores only)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("_vector", array_to_vector(F.col(features))))
    if "probability" not in scored.columns:
        return scored.withColumn("probabilities", F.lit(None).cast("array<double>")).drop("_vector", "rawPrediction")
    return scored.withColumn("probabilities", vector_to_array("probability")).drop(
        "_vector", "_scaled", "rawPrediction", "probability"
    )
