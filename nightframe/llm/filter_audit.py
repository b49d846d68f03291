"""What each of five filters removes under every order of them, by intervals of Lehmer ranks.

The filters that a document fails form its mask. Under an order, the document
goes at the first of its failed filters. Orders are numbered lexicographically
(their Lehmer codes read as a number), so all orders that begin with the same
letters form one interval of ranks: a mask's removals at a step are a few
intervals. Documents are counted per part and mask; every count is added where
an interval begins and taken off where it ends, and prefix sums over the 120
ranks give the numbers of all orders at once.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.llm.words import SPACES

FILTERS = "ABCDE"
#: What the filters look for.
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"


def rank_interval(prefix: tuple[int, ...], n: int = len(FILTERS)) -> tuple[int, int]:
    """First rank and the one past the last of the orders of ``n`` letters that begin with ``prefix``."""
    left, first = list(range(n)), 0
    for k, letter in enumerate(prefix):
        first += left.index(letter) * math.factorial(n - 1 - k)
        left.remove(letter)
    return first, first + math.factorial(n - len(prefix))


def removal_intervals(mask: int, n: int = len(FILTERS)) -> list[tuple[int, int, int]]:
    """(step, first rank, past the last) of the orders under which ``mask`` is removed at that step."""
    failed = [k for k in range(n) if mask >> k & 1]
    passed = [k for k in range(n) if not mask >> k & 1]
    found: list[tuple[int, int, int]] = []
    for step in range(1, len(passed) + 2):
        spans = sorted(
            rank_interval((*head, letter)) for head in itertools.permutations(passed, step - 1) for letter in failed
        )
        for low, high in spans:
            if found and found[-1][0] == step and found[-1][2] == low:
                found[-1] = (step, found[-1][1], high)
            else:
                found.append((step, low, high))
    return found


def failed_filters(text: Column) -> Column:
    """Mask of the filters A to D that a text fails; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    # without white space at the ends only an empty text has an empty word
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), SPACES)
    n = F.when(F.element_at(words, 1) == "", 0).otherwise(F.size(words))
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < MIN_WORDS,
        (n > 0) & (100 * distinct < DISTINCT_PERCENT * n),
        100 * capitals > CAPITALS_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    ]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part and mask, and those with a good or a toxic label.

    Equal texts are counted together before they meet: per text only its
    smallest id and the number of rows under it are needed to know who fails E.
    """
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("_text"),
    ).select(
        "doc_id", "part", failed_filters(F.col("_text")).alias("mask"),
        F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("key"), F.length("_text").alias("chars"),
    )
    known = rows.join(marked, F.col("doc_id") == F.col("_id"), "left")
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    same = ["key", "chars", "part", "mask", "good", "toxic"]
    per_id = known.select("doc_id", "key", "chars", "part", "mask", *flags).groupBy("doc_id", *same).agg(F.count("*").alias("c"))
    has_id = F.col("doc_id").isNotNull()
    per_text = per_id.groupBy(*same).agg(
        F.sum("c").alias("n"),
        F.min(F.when(has_id, F.struct("doc_id", "c"))).alias("first"),
        F.sum(F.when(has_id, 0).otherwise(F.col("c"))).alias("no_id"),
    )
    smallest = F.min("first.doc_id").over(Window.partitionBy("key", "chars"))
    own = F.col("no_id") + F.when(F.col("first.doc_id") == smallest, F.col("first.c")).otherwise(0)
    split = per_text.withColumn("own", own).select(
        "part", "good", "toxic",
        F.explode(
            F.array(
                F.struct("mask", F.col("own").alias("n")),
                F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
            )
        ).alias("x"),
    ).select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def order_totals(counts: DataFrame) -> DataFrame:
    """The audit of (part, mask, n, good, toxic) rows: one row per part, order and step."""
    spark = counts.sparkSession
    ends = [
        (mask, step, rank, sign)
        for mask in range(1, 1 << len(FILTERS))
        for step, low, high in removal_intervals(mask)
        for rank, sign in ((low, 1), (high, -1))
    ]
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    # mask -1 stands for every (step, rank) of a part and counts nothing
    ends += [(-1, step, rank, 0) for step in range(1, len(FILTERS) + 1) for rank in range(len(orders))]
    differences = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("n"))), F.lit(0)) for k in range(5)]).alias("fails"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == 1 << k, F.col("n"))), F.lit(0)) for k in range(5)]).alias("alone"),
    )
    zeros = totals.select("part", F.lit(-1).alias("mask"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    added = (
        counts.select("part", "mask", "n", "good", "toxic").unionByName(zeros)
        .join(F.broadcast(differences), "mask")
        .groupBy("part", "step", "rank")
        .agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    )
    along = Window.partitionBy("part", "step").orderBy("rank")
    summed = added.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in ("n", "good", "toxic")])
    named = summed.filter(F.col("rank") < len(orders)).withColumn(
        "filter_order", F.element_at(F.array(*map(F.lit, orders)), F.col("rank") + 1)
    ).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    until = Window.partitionBy("part", "rank").orderBy("step")
    whole = named.withColumn("gone", F.sum("n").over(until)).withColumn(
        "shapley", F.sum("n").over(Window.partitionBy("part", "letter"))
    )
    at = F.ascii("letter") - ord(FILTERS[0]) + 1
    return whole.join(totals, "part").select(
        "part", "filter_order", "step",
        (F.col("total") - F.col("gone")).alias("kept"),
        F.col("n").alias("removed"),
        (F.element_at("fails", at) - F.col("n")).alias("redundant"),
        F.element_at("alone", at).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with document counts.

    ``part`` is the source (null: empty string). A null text is empty. Repeated
    rows count each. A row fails E if a row with a smaller id has its text; a
    null id is neither smaller nor larger than others, so such a row never
    fails E. A document is good or toxic if any of its labels says so; labels
    without an id mark nothing. An empty table gives no rows. Other columns are
    not read.
    """
    return order_totals(mask_counts(docs, labels))
