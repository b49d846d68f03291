"""Ordered operators that stay parallel when one key holds most of the rows.

A plain window over ``(tenant, recording)`` sorts a whole recording in one
task. The helpers here cut every key into bounded blocks, work inside
``(key, block)`` and pass only one small row per block between blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.schema import BLOCK_ROWS
from nightframe.session import cut_lineage

BLOCK = "_block"

#: Keys with more rows than this keep their fine blocks in :func:`wide_blocks`.
LONG_KEY_ROWS = 1 << 18


def block_of(index: str | Column, size: int = BLOCK_ROWS) -> Column:
    """Block number of an integer position."""
    col = F.col(index) if isinstance(index, str) else index
    return F.floor(col / F.lit(size)).cast("bigint")


def _block_column(block: str | Column) -> Column:
    """Never null, so joins on it add no filter that computes it again."""
    col = block if isinstance(block, Column) else F.col(block)
    return F.coalesce(col.cast("bigint"), F.lit(0).cast("bigint"))


def _running(df, keys, order, block, values, aggregate, identity) -> DataFrame:
    keys = list(keys)
    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    per_block = df.groupBy(*keys, block).agg(
        *[aggregate(expr).alias(f"_t_{name}") for name, expr in values.items()]
    )
    carried = per_block.select(
        *keys,
        block,
        *[aggregate(f"_t_{name}").over(before).alias(f"_o_{name}") for name in values],
    )
    local = df.withColumns({f"_l_{n}": aggregate(e).over(inside) for n, e in values.items()})
    joined = local.join(carried, [*keys, block])
    return joined.withColumns({n: identity(f"_l_{n}", f"_o_{n}") for n in values}).drop(
        *[f"_l_{n}" for n in values], *[f"_o_{n}" for n in values]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str,
    totals: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sums per key: sums inside each block plus block offsets.

    ``block`` must be monotone in ``order``. ``keys`` may be empty.
    """
    return _running(
        df, keys, order, block, totals, F.sum,
        lambda here, before: F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(before), F.lit(0)),
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, values: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running maxima per key, computed like :func:`running_totals`."""
    return _running(
        df, keys, order, block, values, F.max, lambda here, before: F.greatest(F.col(here), F.col(before))
    )


def wide_blocks(df: DataFrame, keys: Sequence[str], block: str | Column, limit: int = LONG_KEY_ROWS) -> DataFrame:
    """``df`` with ``_block``: the given block in keys of more than ``limit`` rows, one block in all others.

    Fine blocks are needed where a key is long; elsewhere they would make about as
    many blocks as rows. There are at most ``rows / limit`` long keys, and only their
    names are sent along. Null keys count as a key; a null block comes first, as in a sort.
    """
    keys = list(keys)
    named = [F.col(k).alias(f"_l_{k}") for k in keys]
    long = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit).drop("_rows")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys])
    given = block if isinstance(block, Column) else F.col(block)
    fine = F.when(F.col("_long"), F.coalesce(given.cast("bigint"), F.lit(-(1 << 62))))
    marked = df.join(F.broadcast(long.withColumn("_long", F.lit(True))), same, "left")
    return marked.withColumn(BLOCK, F.coalesce(fine, F.lit(0).cast("bigint"))).drop("_long", *[f"_l_{k}" for k in keys])


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str | Column,
    name: str = "pos",
) -> DataFrame:
    """Zero-based position of each row within its key (an exact row number)."""
    source = df.withColumn(BLOCK, _block_column(block))
    out = running_totals(source, keys, order, BLOCK, {name: F.lit(1)})
    return out.withColumn(name, (F.col(name) - 1).cast("bigint")).drop(BLOCK)


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows sorted by ``keys`` and ``order`` over all partitions, stored, with their partition in ``_block``
    and a number that grows along the order in ``_id``.

    The ranges are cut where the rows are (by quantiles of a sample), so neither
    a hot key nor a crowded stretch of the order makes a large block; rows are
    stored because their ranges must not be drawn twice.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return cut_lineage(
        dealt.withColumns({"_id": F.monotonically_increasing_id(), BLOCK: F.spark_partition_id().cast("bigint")}), "ranges"
    )


def ranked_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Zero-based position of each row within its key, in ranges cut where the rows are.

    Only one row per key and range is brought together. Ties in ``order`` get
    different positions, in any order.
    """
    keys = list(keys)
    rows = in_ranges(df, keys, order)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*keys, BLOCK).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    first = first.select(*keys, BLOCK, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return _matched(rows, first, [*keys, BLOCK]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_shift", BLOCK)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: str | Column,
    cols: Sequence[str],
    prev: str | None = "prev",
    next_: str | None = None,
    dense: int = 0,
) -> DataFrame:
    """Attach the previous and/or next row of the key as structs of ``cols``.

    The first and last row of each block come from the neighbouring block's
    edge, computed by a partial aggregate (``max_by`` / ``min_by``). When
    ``order`` is one column of consecutive integers, ``dense`` gives the block
    size and each block simply carries one row of its neighbours: one shuffle,
    one pass.
    """
    keys = list(keys)
    if dense:
        payload = F.struct(*[F.col(c) for c in cols])
        inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
        out = with_halo(df, order[0], 1, 1, dense)
        if prev:
            out = out.withColumn(prev, F.lag(payload).over(inside))
        if next_:
            out = out.withColumn(next_, F.lead(payload).over(inside))
        return out.filter(F.col(BLOCK) == F.col("_own")).drop(BLOCK, "_own")
    source = df.withColumn(BLOCK, _block_column(block))
    payload = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(c) for c in order])
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    aggs, shifted, added, drop = [], [], {}, [BLOCK]
    if prev:
        aggs.append(F.max_by(payload, rank).alias("_last"))
        shifted.append(F.lag("_last").over(across).alias("_edge_prev"))
    if next_:
        aggs.append(F.min_by(payload, rank).alias("_first"))
        shifted.append(F.lead("_first").over(across).alias("_edge_next"))
    edges = source.groupBy(*keys, BLOCK).agg(*aggs).select(*keys, BLOCK, *shifted)
    local = source
    if prev:
        local = local.withColumn("_lag", F.lag(payload).over(inside))
        added[prev] = F.coalesce("_lag", "_edge_prev")
        drop += ["_lag", "_edge_prev"]
    if next_:
        local = local.withColumn("_lead", F.lead(payload).over(inside))
        added[next_] = F.coalesce("_lead", "_edge_next")
        drop += ["_lead", "_edge_next"]
    return local.join(edges, [*keys, BLOCK]).withColumns(added).drop(*drop)


def with_halo(df: DataFrame, index: str, before: int, after: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Send each row to its block and to neighbouring blocks that look at it.

    Adds ``_block`` and ``_own``; keep rows with ``_block = _own`` afterwards.
    """
    low = F.floor((F.col(index) - F.lit(after)) / F.lit(size)).cast("bigint")
    high = F.floor((F.col(index) + F.lit(before)) / F.lit(size)).cast("bigint")
    return df.withColumn("_own", block_of(index, size)).withColumn(
        BLOCK, F.explode(F.sequence(low, high))
    )


def with_frame(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    before: int,
    after: int,
    added: Mapping[str, object],
    size: int = BLOCK_ROWS,
    best: Sequence[Column] | None = None,
) -> DataFrame:
    """Evaluate aggregates over the index range ``[i - before, i + after]``.

    With ``best`` only the first row in that order of each index counts; it is
    found in the frame's own exchange and sort.

    ``added`` maps a name to an aggregate column (without ``over``). Rows near
    a block border are also sent to the neighbouring block, so every frame is
    complete inside one block; only ``(before + after) / size`` of the rows are
    copied.
    """
    keys = list(keys)
    spread = with_halo(df, index, before, after, size)
    if best is not None:
        spread = spread.repartition(*keys, BLOCK)
        same = Window.partitionBy(*keys, BLOCK, index).orderBy(*best)
        spread = spread.withColumn("_place", F.row_number().over(same)).filter(F.col("_place") == 1).drop("_place")
    frame = Window.partitionBy(*keys, BLOCK).orderBy(index).rangeBetween(-before, after)
    out = spread.withColumns({name: agg.over(frame) for name, agg in added.items()})
    return out.filter(F.col(BLOCK) == F.col("_own")).drop(BLOCK, "_own")


#: Bands of a power of two at the first and second level of a quantile's search.
FIRST_BANDS, SECOND_BANDS = 1 << 12, 1 << 20


def value_bands(value: Column) -> tuple[Column, Column]:
    """Two numbers that order values by the bits of a double, at any scale.

    The first is exponent and 12 bits of the mantissa, the second the next 20
    bits; at most 2^20 values agree in both. Scaling by powers of two is exact.
    """
    size = F.abs(value)
    rough = F.floor(F.log2(size))
    mantissa = size / F.pow(F.lit(2.0), rough)
    exponent = rough + (mantissa >= 2).cast("bigint") - (mantissa < 1).cast("bigint")
    scaled = (size / F.pow(F.lit(2.0), exponent) - 1) * FIRST_BANDS
    first = (exponent + 1075) * FIRST_BANDS + F.floor(scaled) + 1
    second = F.floor((scaled - F.floor(scaled)) * SECOND_BANDS)
    sign = F.signum(value).cast("bigint")
    endless = size == float("inf")
    first = F.when(value == 0, 0).when(endless, 1 << 40).otherwise(first) * sign
    second = F.when((value == 0) | endless, 0).otherwise(second) * sign
    return first, second


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which null keys match."""
    there = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(there, same).drop(*[f"_r_{c}" for c in on])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per key by radix selection, without sorting a key's values.

    Values are counted per band of their leading bits; only the bands that hold
    a wanted rank are looked into again, by the next bits, and only the values
    of the narrow bands found there are ranked. Every ordered group is bounded
    by the number of bands, whatever the values are. ``method`` is ``linear``
    (numpy's default) or ``lower_rank`` (the value at sorted position
    ``int(q * (n - 1))``). A key without known values has null quantiles.
    """
    keys = list(keys)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    first, second = value_bands(F.col("_v"))
    rows = df.select(*keys, v.alias("_v"))
    counts = rows.groupBy(*keys, first.alias("_b1")).agg(F.count("_v").alias("_c"))
    scope = Window.partitionBy(*keys)
    upto = scope.orderBy("_b1").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in quantiles.items()}
    # places of the values wanted, from 0
    places = [F.floor(x) for x in exact.values()] + ([F.ceil(x) for x in exact.values()] if method == "linear" else [])
    placed = counts.select(
        *keys, "_b1", "_c", F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(scope).alias("_n")
    ).withColumn("_all", F.array_distinct(F.array(*places)))

    def inside(frame: DataFrame, below: Column) -> DataFrame:
        """Bands that hold a place, with the places they hold counted from their first value."""
        start = F.col("_upto") - F.col("_c")
        held = F.filter("_all", lambda x: (x >= start) & (x < F.col("_upto")))
        return frame.withColumns({"_held": F.transform(held, lambda x: x - start), "_below": below + start}).filter(F.size("_held") > 0)

    chosen = inside(placed, F.lit(0).cast("bigint")).select(*keys, "_b1", "_held", "_below")
    narrow = _matched(rows.withColumns({"_b1": first, "_b2": second}), chosen, [*keys, "_b1"])
    values = narrow.groupBy(*keys, "_b1", "_b2", "_v").agg(F.count("_v").alias("_c"), F.first("_held").alias("_all"), F.first("_below").alias("_below"))
    bands = values.groupBy(*keys, "_b1", "_b2").agg(F.sum("_c").alias("_c"), F.first("_all").alias("_all"), F.first("_below").alias("_base"))
    along = Window.partitionBy(*keys, "_b1").orderBy("_b2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = inside(bands.withColumn("_upto", F.sum("_c").over(along)), F.col("_base")).select(*keys, "_b1", "_b2", "_held", F.col("_below").alias("_base"))
    ranked = Window.partitionBy(*keys, "_b1", "_b2").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = inside(
        _matched(values.drop("_all", "_below"), found.withColumnRenamed("_held", "_all"), [*keys, "_b1", "_b2"])
        .withColumn("_upto", F.sum("_c").over(ranked)),
        F.col("_base"),
    ).select(*keys, "_v", F.explode(F.transform("_held", lambda x: x + F.col("_below"))).alias("_place"))
    wanted = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_at"))  # a value per place
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = totals.unionByName(wanted, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.first("_at", ignorenulls=True).alias("_at")
    )
    out = []
    for name, x in exact.items():
        low = F.try_element_at("_at", F.floor(x))
        if method == "linear":
            high = F.try_element_at("_at", F.ceil(x))
            out.append((low + (high - low) * (x - F.floor(x))).alias(name))
        else:
            out.append(low.alias(name))
    return joined.select(*keys, *out)
