"""Language identification by averaged hashed subword embeddings.

The model (``subword``) learns from a bounded sample of rows with a known
language. On a fifth of the sample its temperature is calibrated, and the
evidence that texts of each language have: the mean score of their features for
it. A text with less evidence for its likeliest language is in none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.llm.subword import Features, SubwordModel, feature_rows, fit, softmax

#: Rows the model learns from at most: the ones with the smallest hashes of their ids.
SAMPLE_ROWS = 2500
FEATURES = Features(grams=(1, 2, 3), lower=True)
UNKNOWN = "und"
#: Standard deviations of a language's evidence below which a text is in another one.
DEVIATIONS = 4.0


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, deviations: float = DEVIATIONS) -> SubwordModel | None:
    """Fit on text and non-null lang of rows that are not held out (null ids are not learned).

    Texts are rejected ``deviations`` below the evidence usual for their language.
    """
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    chosen = (
        docs.filter(usable)
        .select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "doc_id")
        .orderBy("h", "doc_id")
        .limit(sample_rows)
        .select("doc_id")
    )
    ids = [r["doc_id"] for r in chosen.collect()]  # sample_rows ids at most
    if not ids:
        return None
    sample = docs.sparkSession.createDataFrame([(i,) for i in set(ids)], "doc_id bigint")
    rows = (
        docs.filter(usable)
        .join(F.broadcast(sample), "doc_id", "left_semi")
        .select(F.col("lang").alias("label"), "text")
    )
    return fit(feature_rows(rows, FEATURES).limit(sample_rows).collect(), FEATURES, deviations=deviations)


def predicted(docs: DataFrame, model: SubwordModel | None) -> Column:
    """A struct column (lang_pred, score, rejected) over ``text``."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            evidence = m.evidence([t if isinstance(t, str) else None for t in texts])
            p = softmax((evidence + m.bias) / m.temperature)
            best = p.argmax(1)
            found = evidence[np.arange(len(best)), best]
            yield pd.DataFrame(
                {"lang_pred": [m.classes[k] for k in best], "score": p.max(1), "rejected": found < m.least[best]}
            )

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return F.when(has_letter, guess(F.col("text"))).otherwise(none)


def language_id(docs: DataFrame, model: SubwordModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    A null text or one without a letter is ``und`` with score 0 and rejected.
    ``rejected`` also marks texts with less evidence than calibrated; their
    ``lang_pred`` is still the likeliest language. Without a model all is
    ``und``.
    """
    source = docs.select(F.col("doc_id"), F.col("text"))
    return source.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(source, model).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected"
    )
