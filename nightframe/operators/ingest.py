"""Upserts, recording sessions and retention (UPS, SES, RET)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.operators.ordered import with_position
from nightframe.operators.scan import Jump, scan
from nightframe.schema import RECORDING_TIMEOUT_HOURS

# --- fixed values -----------------------------------------------------------
EPOCH_RETENTION_DAYS, PREDICTION_RETENTION_DAYS = 90, 180
# --- end of fixed values ----------------------------------------------------


def first_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a stated order, as a partial aggregate.

    Copies of one key are reduced on the map side, so a key repeated many
    times does not gather in one task.
    """
    cols = [c for c in batch.columns if c not in keys]
    best = F.min_by(F.struct(*cols), F.struct(*order)).alias("_row")
    return batch.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def insert_ignore(batch: DataFrame, target: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a batch that are new to the target (UPS-01 .. UPS-03)."""
    fresh = first_per_key(batch, keys, order)
    return fresh.join(target.select(*keys), list(keys), "left_anti").select(*batch.columns)


def insert_report(batch: DataFrame, inserted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Received and inserted rows per scope (UPS-01)."""
    got = batch.groupBy(*by).agg(F.count(F.lit(1)).alias("received"))
    put = inserted.groupBy(*by).agg(F.count(F.lit(1)).alias("inserted"))
    return got.join(put, list(by), "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))


def upsert_predictions(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], truth: str = "ground_truth_stage"
) -> DataFrame:
    """Replace everything of a stored prediction but its truth (UPS-04)."""
    cols = [c for c in existing.columns if c not in keys and c != truth]
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    agg = both.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), "_v").alias("_row"),
        F.min_by(truth, "_v").alias("_truth"),
    )
    return agg.select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in cols],
        F.col("_truth").alias(truth),
    )


def recording_sessions(
    events: DataFrame,
    keys: Sequence[str],
    sec: str,
    ids: Sequence[str],
    closes: str | None = None,
    cap_hours: int = RECORDING_TIMEOUT_HOURS,
) -> DataFrame:
    """Start time of the recording each upload belongs to (SES-01).

    An open recording is reused until it is older than ``cap_hours`` counted
    from its *start*; a ``closes`` row ends the recording after itself.
    """
    keys = list(keys)
    cap = cap_hours * 3600
    placed = with_position(events, keys, [sec, *ids], F.floor(F.col(sec) / 3600), "_pos")
    rows = placed.withColumn("_close", F.col(closes).cast("double") if closes else F.lit(0.0))
    out = scan(rows, keys, "_pos", Jump(sec, cap, "_close"), "recording_start")
    return out.withColumn("recording_start", F.col("recording_start").cast("bigint")).drop("_pos", "_close")


def retained(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows younger than the retention limit (RET-01); on a table partitioned by
    date this is a partition filter."""
    return df.filter(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))


def latest_night(
    preds: DataFrame, nights: DataFrame, keys: Sequence[str], owner: str, start: str, stage: str = "predicted_stage"
) -> DataFrame:
    """UI summary of each owner's latest night (SES-02)."""
    latest = nights.groupBy(owner).agg(F.max_by(F.struct(*keys), F.struct(start, *keys)).alias("_k")).select(owner, "_k.*")
    rows = preds.join(latest.select(*keys), list(keys), "left_semi")

    def minutes(*stages: str) -> Column:
        return F.floor(F.count_if(F.col(stage).isin(*stages)) * 0.5)

    agg = rows.groupBy(*keys).agg(
        F.floor(F.count(F.lit(1)) * 0.5).alias("total_minutes"),
        (F.count(F.lit(1)) * 0.5).alias("_exact"),
        minutes("W").alias("_awake"), minutes("N1", "N2").alias("_light"),
        minutes("N3").alias("_deep"), minutes("R").alias("_rem"),
    )
    bed = F.greatest(F.col("total_minutes"), F.lit(1))
    score = F.greatest(F.lit(40), F.least(F.lit(95), F.floor(F.col("_exact") / 5)))
    out = agg.select(
        *keys, "total_minutes", score.alias("score"),
        F.when(score >= 75, "Good").otherwise("Fair").alias("score_label"),
        *[F.floor(F.col(f"_{s}") / bed * 100).alias(f"{s}_pct") for s in ("awake", "light", "deep", "rem")],
    )
    return out.withColumn("sleep_efficiency_pct", F.greatest(F.lit(0), 100 - F.col("awake_pct")))
