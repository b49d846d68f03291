"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm import exact_dedup, language_id, ngram_join, packing, quality_rules
from nightframe.llm.queries import prepared, tokenizer_path
from nightframe.session import cut_lineage, remove_scratch, scratch_scope

#: Ids that may be broadcast (8 bytes each); more are shuffled.
BROADCAST_IDS = 1_000_000

#: How far below a language's usual evidence a text is dropped: wide, so that odd texts in a known language stay.
DEVIATIONS = 6.0

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediates of the stage that this thread ran last.
_SPENT: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("spent", default=())


def _stage(fn: Stage) -> Stage:
    """Drop the previous stage's intermediates: its result is stored by the time the next is asked for."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_scratch(prepared(spark), list(_SPENT.get()))
        with scratch_scope() as made:
            out = fn(spark, docs, sf_dir)
        _SPENT.set(tuple(made))
        return out

    return run_stage


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of some ids (null-safe)."""
    ids = cut_lineage(ids.select(F.col("doc_id").alias("_gone")).distinct(), "dropped-ids")
    gone = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", "text")  # other columns cannot clash
    counted = cut_lineage(quality_rules.document_counts(rows), "counted-documents")
    return quality_rules.judged(counted).filter("kept").select("row.*")


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with enough confidence; all with a letter if none can be learned."""
    model = language_id.train(docs, deviations=DEVIATIONS)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    guess = language_id.predicted(docs, model)
    return docs.withColumn("_guess", guess).filter("NOT _guess.rejected").select(docs.columns)


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of repeated rows one stays too."""
    found = cut_lineage(exact_dedup.exact_dedup(docs), "exact-groups")
    per_id = found.groupBy("doc_id").agg(
        F.max(F.col("kept").cast("int")).alias("some"), F.min(F.col("kept").cast("int")).alias("every")
    )
    left = _without(docs, per_id.filter("some = 0"))
    twice = cut_lineage(per_id.filter("some = 1 AND every = 0"), "repeated-ids")
    if twice.isEmpty():
        return left
    again = left.join(twice.select(F.col("doc_id").alias("_twice")), F.col("doc_id").eqNullSafe(F.col("_twice")), "left_semi")
    normal = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), quality_rules.SPACES, " ")
    # Of an id's rows, those whose text is kept under that id stay, once each.
    texts = found.filter("kept").select(F.col("doc_id").alias("_id"), "text_sha256")
    once = again.withColumn("text_sha256", F.sha2(normal.cast("binary"), 256)).dropDuplicates(["doc_id", "text_sha256"])
    once = once.join(
        texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (once["text_sha256"] == texts["text_sha256"]), "left_semi"
    ).select(docs.columns)
    return _without(left, twice).unionByName(once)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word runs, similarity 0.8 or more."""
    found = ngram_join.ngram_jaccard_join(docs, n=5, percent=80)
    per_id = found.groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("some"))
    return _without(docs, per_id.filter("some = 0"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 4,096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("packing", pack)]

#: Learned models, similarity joins and tokenizers are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each stored before the next reads it."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
