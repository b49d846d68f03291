"""Quality scores by supervised subword embeddings.

Hashed vectors of words and character n-grams are averaged per document; a
softmax output is trained with them by stochastic gradient descent (``subword``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.llm.subword import Features, SubwordModel, feature_rows, fit

#: Labelled rows the model learns from at most: the ones with the smallest hashes of their ids.
SAMPLE_ROWS = 2500
FEATURES = Features(grams=(1, 2, 3), whole_words=True, lower=False, repeats=10)
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> SubwordModel | None:
    """Fit on labelled rows that are not held out.

    Ids whose labels contradict each other and null ids or labels are not
    learned. None without a usable label.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .filter("label = other")
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample_rows)
        .select("doc_id", "label")
    )
    found = [(r["doc_id"], r["label"]) for r in chosen.collect()]  # sample_rows pairs at most
    if not found:
        return None
    sample = docs.sparkSession.createDataFrame(found, "doc_id bigint, label int")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    return fit(feature_rows(rows, FEATURES).limit(sample_rows).collect(), FEATURES)


def quality_scores(docs: DataFrame, model: SubwordModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    An empty or null text has no features and gets the model's prior. Without a
    model (no labels), or with one class only, the score is that class, or 0.5.
    """
    source = docs.select(F.col("doc_id"), F.col("text"))
    score = F.lit(0.5)
    if model is not None and "1" not in model.classes:
        score = F.lit(0.0)
    elif model is not None:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = shared.value
            column = m.classes.index("1")
            for texts in batches:
                yield pd.Series(m.probabilities([t if isinstance(t, str) else None for t in texts])[:, column])

        score = good(F.col("text"))
    return source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
