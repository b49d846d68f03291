"""Filters, joins, top-k and set operators (FLT, JON, TOP, SET)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.operators.evaluation import is_finite
from nightframe.operators.ordered import BLOCK, in_ranges
from nightframe.session import cut_lineage


@dataclass(frozen=True)
class Filters:
    """Optional conjunctive filters; the tenant is mandatory, time bounds inclusive."""

    tenant_id: object
    recording_id: object | None = None
    device_id: object | None = None
    model_version: str | None = None
    feature_schema_version: str | None = None
    from_ts: str | None = None
    to_ts: str | None = None


def apply_filters(df: DataFrame, filters: Filters, time: str = "window_end_ts") -> DataFrame:
    """Compose the filters so that they reach the scan (FLT-01)."""
    out = df.filter(F.col("tenant_id") == filters.tenant_id)
    for name in ("recording_id", "device_id", "model_version", "feature_schema_version"):
        value = getattr(filters, name)
        if value is not None:
            out = out.filter(F.col(name) == value)
    if filters.from_ts is not None:
        out = out.filter(F.col(time) >= F.lit(filters.from_ts).cast("timestamp"))
    if filters.to_ts is not None:
        out = out.filter(F.col(time) <= F.lit(filters.to_ts).cast("timestamp"))
    return out


def in_scope(df: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``scope`` (FLT-02)."""
    return df.join(scope.select(*keys), list(keys), "left_semi")


def schema_violations(df: DataFrame, expected: str, col: str = "feature_schema_version") -> DataFrame:
    """Rows written with another feature schema (FLT-03)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(expected)))


def require_schema(df: DataFrame, expected: str, col: str = "feature_schema_version") -> DataFrame:
    """Raise at run time on the first row with another schema (FLT-03)."""
    ok = F.col(col).eqNullSafe(F.lit(expected))
    return df.withColumn(
        col, F.when(ok, F.col(col)).otherwise(F.raise_error(F.lit("Feature schema mismatch")).cast("string"))
    )


def finite_vectors(df: DataFrame, col: str) -> DataFrame:
    """Rows whose vector has only finite numbers (FLT-04)."""
    return df.filter(F.forall(col, is_finite))


def constraint_report(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Violation counts of named rules in one pass; a null result passes (FLT-05)."""
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(~rule).alias(f"_v{i}") for i, rule in enumerate(rules.values())],
    )
    cells = [
        F.struct(F.lit(name).alias("rule"), F.col(f"_v{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return wide.select(*by, "rows", F.explode(F.array(*cells)).alias("c")).select(
        *by, "rows", "c.rule", "c.violations"
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (FLT-05)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def with_dimension(fact: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a fact table with recordings or devices (JON-01, JON-02, JON-06).

    No hint: Spark broadcasts a side whose measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting
    skewed keys at run time.
    """
    return fact.join(dim, list(keys), how)


def orphans(fact: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fact rows without a dimension row (JON-05)."""
    return fact.join(dim.select(*keys), list(keys), "left_anti")


def attach_truth(preds: DataFrame, truth: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Predictions with the stored truth of the same window, if any (JON-04)."""
    return preds.join(truth.select(*keys, col), list(keys), "left")


def overlap_groups(
    recs: DataFrame, key: str, start: str, end: str
) -> DataFrame:
    """Number groups of transitively overlapping intervals (JON-07, DST-05).

    A new group starts where ``start`` exceeds the largest end seen so far;
    touching intervals share a group. The sweep goes over ranges of start times
    that are cut where the recordings are, so one crowded evening is many
    ranges; the largest end so far and the number of groups pass from range to
    range. Recordings without a start get their own group each (SET-04): the
    group id is null and the key itself identifies it.
    """
    columns = recs.columns
    timed = in_ranges(recs.filter(F.col(start).isNotNull()), [], [start, key])
    earlier = Window.partitionBy(BLOCK).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(BLOCK).orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy().orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    edges = timed.groupBy(BLOCK).agg(F.max(end).alias("_e")).select(BLOCK, F.max("_e").over(before).alias("_before"))
    reach = F.greatest(F.max(end).over(earlier), F.col("_before"))
    flagged = cut_lineage(
        timed.join(edges, BLOCK)
        .withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
        .withColumn("_in", F.sum("_new").over(so_far)).drop("_before", "_new"),
        "sweep",
    )
    groups = flagged.groupBy(BLOCK).agg(F.max("_in").alias("_g")).select(BLOCK, F.coalesce(F.sum("_g").over(before), F.lit(0)).alias("_g"))
    grouped = flagged.join(groups, BLOCK).select(*columns, (F.col("_in") + F.col("_g")).cast("bigint").alias("time_group"))
    return grouped.unionByName(untimed_groups(recs, start))


def untimed_groups(recs: DataFrame, start: str) -> DataFrame:
    """Recordings without a start, each a group of its own: the group id is null (SET-04)."""
    return recs.filter(F.col(start).isNull()).withColumn("time_group", F.lit(None).cast("bigint"))


def split_overlap(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Keys that occur in more than one split (JON-12, DST-09)."""
    return (
        df.groupBy(*keys)
        .agg(F.size(F.collect_set(split)).alias("n_splits"), F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"))
        .filter(F.col("n_splits") > 1)
    )


def shared_keys(df: DataFrame, keys: Sequence[str], a: str, b: str, split: str = "split") -> DataFrame:
    """Keys present in both splits (SET-02)."""
    left = df.filter(F.col(split) == a).select(*keys)
    right = df.filter(F.col(split) == b).select(*keys)
    return left.intersect(right)


def merge_labels(base: Column, extra: Column) -> Column:
    """Base order, then sorted extras (SET-01)."""
    return F.concat(base, F.array_sort(F.array_except(extra, base)))


def latest_by(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The latest row of each group as a partial aggregate (TOP-01)."""
    top = F.max_by(F.struct(*cols), F.struct(*order)).alias("_top")
    return df.groupBy(*by).agg(top).select(*by, "_top.*")


def latest_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Top-k report (TOP-02): ``TakeOrderedAndProject``."""
    return df.orderBy(*order).limit(k)


def bounded_issues(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 500) -> DataFrame:
    """At most ``k`` issues per check, in a stated order (TOP-03)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")
