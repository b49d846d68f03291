"""Order-dependent stage operators (SEQ-01 .. SEQ-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.operators.evaluation import ratio
from nightframe.operators.ordered import block_of, with_neighbours
from nightframe.schema import CLASSES, FORBIDDEN_TRANSITIONS


def pairs(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], index: str = "epoch_index"
) -> DataFrame:
    """Each row joined with its successor in the same key (struct ``next``)."""
    return with_neighbours(
        df, keys, [index], block_of(index), cols, prev=None, next_="next"
    ).filter(F.col("next").isNotNull())


def transition_counts(
    df: DataFrame,
    keys: Sequence[str],
    stage: str = "predicted_stage",
    by: Sequence[str] = (),
    labels: Sequence[str] | None = None,
    index: str = "epoch_index",
) -> DataFrame:
    """Counts of (src, dst) stage pairs; pairs with an unknown label are skipped (SEQ-01)."""
    both = pairs(df, keys, [stage], index).select(
        *by, F.col(stage).alias("src"), F.col(f"next.{stage}").alias("dst")
    )
    if labels is not None:
        both = both.filter(F.col("src").isin(*labels) & F.col("dst").isin(*labels))
    return both.groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def row_normalise(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of each destination among the transitions out of a source (SEQ-02)."""
    total = F.sum("n").over(Window.partitionBy(*by, "src"))
    return counts.withColumn("p", F.col("n") / total)


def transition_cells(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    truth: str = "true4",
    pred: str = "pred4",
    index: str = "epoch_index",
) -> DataFrame:
    """True and predicted transition counts and row shares per cell, from one pass."""
    both = pairs(df, keys, [truth, pred], index)
    stacked = both.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col(truth).alias("src"), F.col(f"next.{truth}").alias("dst"),
                    F.lit(1).alias("t"), F.lit(0).alias("p"),
                ),
                F.struct(
                    F.col(pred).alias("src"), F.col(f"next.{pred}").alias("dst"),
                    F.lit(0).alias("t"), F.lit(1).alias("p"),
                ),
            )
        ).alias("c"),
    )
    cells = stacked.groupBy(*by, F.col("c.src").alias("src"), F.col("c.dst").alias("dst")).agg(
        F.sum("c.t").alias("n_true"), F.sum("c.p").alias("n_pred")
    )
    out_of = Window.partitionBy(*by, "src")
    return cells.withColumns(
        {
            "p_true": ratio(F.col("n_true"), F.sum("n_true").over(out_of)),
            "p_pred": ratio(F.col("n_pred"), F.sum("n_pred").over(out_of)),
        }
    )


def transition_errors(cells: DataFrame, by: Sequence[str], n_labels: int = len(CLASSES)) -> DataFrame:
    """Raw and normalised L1 errors and the row-entropy difference (SEQ-02, SEQ-03).

    A cell that never occurs counts with probability eps = 1e-12, as in a
    clipped dense ``n_labels`` square matrix.
    """
    eps = 1e-12
    empty = -eps * F.ln(F.lit(eps))

    def part(p: str) -> Column:
        clipped = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1.0))
        seen = F.sum(-clipped * F.ln(clipped))
        return (seen + (n_labels * n_labels - F.count(F.lit(1))) * empty) / n_labels

    return cells.groupBy(*by).agg(
        F.sum(F.abs(F.col("n_pred") - F.col("n_true"))).cast("double").alias("error_raw"),
        F.sum(F.abs(F.col("p_pred") - F.col("p_true"))).alias("error_norm"),
        part("p_true").alias("entropy_true"),
        part("p_pred").alias("entropy_pred"),
    ).withColumn("entropy_diff", F.abs(F.col("entropy_pred") - F.col("entropy_true")))


def pair_rates(
    df: DataFrame,
    keys: Sequence[str],
    stage: str = "pred4",
    forbidden: Sequence[tuple[str, str]] = tuple(FORBIDDEN_TRANSITIONS),
    directed: tuple[str, str] = ("W", "Deep"),
    index: str = "epoch_index",
) -> DataFrame:
    """Forbidden-transition and directed-pair rates and run counts (SEQ-04, SEQ-06, SEQ-07)."""
    seq = with_neighbours(df, keys, [index], block_of(index), [stage], prev=None, next_="next")
    nxt = F.col(f"next.{stage}")

    def is_pair(src: str, dst: str) -> Column:
        return (F.col(stage) == src) & (nxt == dst)

    bad = F.lit(False)
    for src, dst in forbidden:
        bad = bad | is_pair(src, dst)
    agg = seq.groupBy(*keys).agg(
        F.count("next").alias("transitions"),
        F.count_if(bad).alias("_bad"),
        F.count_if(is_pair(*directed)).alias("_pair"),
        (F.count_if(F.col(stage) != nxt) + 1).alias("runs"),
        F.count(F.lit(1)).alias("epochs"),
    )
    return agg.select(
        *keys,
        "epochs",
        "transitions",
        "runs",
        ratio(F.col("_bad"), F.col("transitions")).alias("forbidden_rate"),
        ratio(F.col("_pair"), F.col("transitions")).alias("pair_rate"),
    )


def fragmentation(
    df: DataFrame,
    keys: Sequence[str],
    truth: str = "true4",
    pred: str = "pred4",
    index: str = "epoch_index",
    epoch_seconds: int = 30,
) -> DataFrame:
    """Run counts and ``(runs - 1) / (TST + 1e-6)`` for truth and prediction (SEQ-04)."""
    seq = with_neighbours(df, keys, [index], block_of(index), [truth, pred], prev=None, next_="next")
    minutes = epoch_seconds / 60.0
    agg = seq.groupBy(*keys).agg(
        *[
            (F.count_if(F.col(c) != F.col(f"next.{c}")) + 1).alias(f"runs_{n}")
            for n, c in (("true", truth), ("pred", pred))
        ],
        *[
            (F.count_if(F.col(c) != "W") * minutes).alias(f"tst_{n}")
            for n, c in (("true", truth), ("pred", pred))
        ],
    )
    frag = {
        f"frag_{n}": (F.col(f"runs_{n}") - 1) / (F.col(f"tst_{n}") + 1e-6) for n in ("true", "pred")
    }
    return agg.withColumns(frag).withColumn(
        "fragmentation_error", F.abs(F.col("frag_pred") - F.col("frag_true"))
    )


def stage_string(stage: Column, labels: Sequence[str] = CLASSES) -> Column:
    """One character per label."""
    out = F.when(stage == labels[0], "0")
    for i, name in enumerate(labels[1:], start=1):
        out = out.when(stage == name, str(i))
    return out.otherwise("x")


def edit_distance(
    df: DataFrame, keys: Sequence[str], truth: str = "true4", pred: str = "pred4", index: str = "epoch_index"
) -> DataFrame:
    """Levenshtein distance of the two hypnograms of a night (SEQ-05).

    One byte per epoch is gathered per night: a night is at most 12 hours
    (1,440 epochs), and the distance itself is quadratic in that length.
    """
    rows = F.sort_array(
        F.collect_list(
            F.struct(
                F.col(index).alias("i"),
                stage_string(F.col(truth)).alias("t"),
                stage_string(F.col(pred)).alias("p"),
            )
        )
    )
    strings = df.groupBy(*keys).agg(rows.alias("_r")).select(
        *keys,
        F.array_join(F.transform("_r", lambda r: r["t"]), "").alias("_t"),
        F.array_join(F.transform("_r", lambda r: r["p"]), "").alias("_p"),
    )
    longest = F.greatest(F.length("_t"), F.length("_p"), F.lit(1))
    return strings.withColumn("distance", F.levenshtein("_t", "_p")).select(
        *keys, "distance", (F.col("distance") / longest).alias("distance_norm")
    )


def transition_stability(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of absolute differences of row-normalised matrices (SEQ-08)."""
    return cells.groupBy(*by).agg(F.sum(F.abs(F.col("p_true") - F.col("p_pred"))).alias("stability"))


def window_gaps(
    df: DataFrame, keys: Sequence[str], end_sec: str = "end_sec", index: str = "epoch_index",
    gap_seconds: int = 30,
) -> DataFrame:
    """Steps between consecutive windows longer than ``gap_seconds`` (SEQ-09)."""
    seq = with_neighbours(df, keys, [index], block_of(index), [end_sec])
    delta = F.col(end_sec) - F.col(f"prev.{end_sec}")
    return (
        seq.withColumn("delta", delta)
        .filter(F.col("delta") > gap_seconds)
        .withColumn("severity", F.when(F.col("delta") >= gap_seconds * 4, "HIGH").otherwise("MEDIUM"))
        .select(*keys, end_sec, "delta", "severity")
    )


def recent_split(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Latest ``k`` rows as ``current``, the ``k`` before them as ``baseline`` (SEQ-10).

    The limit is the operator's meaning: ``TakeOrderedAndProject`` keeps only
    ``2k`` rows per task before the final ranking. No row comes out until more
    than ``k`` exist.
    """
    latest = df.orderBy(*order).limit(2 * k)
    everything = Window.partitionBy(F.lit(0))
    ranked = latest.withColumn("_r", F.row_number().over(everything.orderBy(*order))).withColumn(
        "_n", F.count(F.lit(1)).over(everything)
    )
    return (
        ranked.filter(F.col("_n") > k)
        .withColumn("window", F.when(F.col("_r") <= k, "current").otherwise("baseline"))
        .drop("_r", "_n")
    )


def learned_transitions(
    df: DataFrame,
    keys: Sequence[str],
    stage: str,
    prior: dict[tuple[str, str], float],
    l2_strength: float = 0.0,
    labels: Sequence[str] = CLASSES,
    index: str = "epoch_index",
) -> DataFrame:
    """Laplace-smoothed transition matrix mixed with a prior, as penalties (SEQ-12)."""
    counts = transition_counts(df, keys, stage, labels=labels, index=index)
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct("src", "dst"), F.col("n"))))
    axis = F.array(*[F.lit(x) for x in labels])
    base = F.create_map(
        *[x for (s, d), p in prior.items() for x in (F.lit(f"{s}>{d}"), F.lit(float(p)))]
    )
    dense = (
        counts.agg(cells.alias("_c"))
        .withColumn("src", F.explode(axis))
        .withColumn("dst", F.explode(axis))
        .select(
            "src", "dst",
            (F.coalesce(F.try_element_at("_c", F.struct("src", "dst")), F.lit(0)) + 1.0).alias("n"),
            F.element_at(base, F.concat_ws(">", "src", "dst")).alias("prior"),
        )
    )
    alpha = 1.0 / (1.0 + max(l2_strength, 0.0) * 1000.0)
    by_src = Window.partitionBy("src")
    mixed = dense.withColumn(
        "mix", alpha * F.col("n") / F.sum("n").over(by_src) + (1 - alpha) * F.col("prior")
    ).withColumn("probability", F.col("mix") / F.sum("mix").over(by_src))
    return mixed.select(
        "src", "dst", "probability",
        (-F.ln(F.least(F.greatest(F.col("probability"), F.lit(1e-8)), F.lit(1.0)))).alias("penalty"),
    )
