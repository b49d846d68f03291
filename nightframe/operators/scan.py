"""Per-key recurrences (``state[t] = f(state[t-1], row[t])``) in parallel blocks.

Each key is cut into blocks of bounded size. What a block does to the state it
is entered with is a *step map*: a piecewise linear function of one number, put
together from the maps of its rows. Only these maps pass along a key, one after
the other; then all blocks run at once, each from its own start. A key with one
block needs no map. The recurrences work on all blocks of an Arrow batch with
numpy, and the rows pass through as they are, with every column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightframe.operators.ordered import BLOCK, block_of
from nightframe.schema import BLOCK_ROWS

#: Pieces of a step map: rows of (from this state on, slope, intercept); the first begins at -inf.
Pieces = np.ndarray


def constant(value: float) -> Pieces:
    return np.array([[-np.inf, 0.0, value]])


def evaluate(pieces: Pieces, unset: float, state: float) -> float:
    """A map at a state; NaN is the state before anything is known, which maps to ``unset``."""
    if np.isnan(state):
        return unset
    _, slope, intercept = pieces[np.searchsorted(pieces[:, 0], state, side="right") - 1]
    return float(slope * state + intercept) if slope else float(intercept)


class Recurrence:
    """Columns it reads, what one row does to all blocks' states, and the step map of whole blocks."""

    columns: tuple[str, ...]

    def step(self, state: np.ndarray, row: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(new state, output) of every block; NaN stands for an unset state and for null."""
        raise NotImplementedError

    def maps(self, rows: dict[str, np.ndarray], live: np.ndarray, ends: np.ndarray) -> list[Pieces]:
        """Pieces of each block; ``live`` marks its rows, ``ends`` is its last state if entered unset."""
        raise NotImplementedError

    def run(self, rows: dict[str, np.ndarray], live: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last state, output of each row) of every block."""
        state = start.astype(float).copy()
        outputs = np.full(live.shape, np.nan)
        for t in range(live.shape[1]):
            new, out = self.step(state, {c: v[:, t] for c, v in rows.items()})
            state = np.where(live[:, t], new, state)
            outputs[:, t] = out
        return state, outputs


@dataclass(frozen=True)
class Slew(Recurrence):
    """The value, moved by ``limit`` at most; null unsets."""

    value: str
    limit: float

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.value,)

    def step(self, state, row):
        x = row[self.value]
        capped = np.where(np.isnan(state), x, np.clip(x, state - self.limit, state + self.limit))
        new = np.where(np.isnan(x), np.nan, capped)
        return new, new

    def maps(self, rows, live, ends):
        """States more than ``limit`` from a value move towards it, the others meet in it.

        So the map of a block has flats joined by lines of slope 1. It is kept as
        knots (state before, state after) with lines of slope 1 beyond the ends;
        every row adds two knots, and those inside a flat go.
        """
        x, limit = rows[self.value], self.limit
        resets = (live & np.isnan(x)).any(1)
        before, after = np.zeros((len(x), 1)), np.zeros((len(x), 1))
        at = np.arange(len(x))
        for t in range(live.shape[1]):
            on = live[:, t] & ~resets
            if not on.any():
                continue
            v = np.where(on, x[:, t], 0.0)[:, None]
            added = []
            for level in (v - limit, v + limit):
                i = np.maximum((after <= level).sum(1) - 1, 0)
                added.append((before[at, i][:, None] + (level - after[at, i][:, None]), level))
            b = np.concatenate([before, *[s for s, _ in added]], axis=1)
            a = np.concatenate([after, *[level for _, level in added]], axis=1)
            # blocks without this row get their last knot again
            b[~on, -2:], a[~on, -2:] = before[~on, -1:], after[~on, -1:]
            order = np.argsort(b, axis=1, kind="stable")
            b, a = np.take_along_axis(b, order, 1), np.take_along_axis(a, order, 1)
            moved = np.where(a > v + limit, a - limit, np.where(a < v - limit, a + limit, v))
            a = np.where(on[:, None], moved, a)
            flat = a[:, 1:] == a[:, :-1]
            inner = np.zeros(a.shape, bool)
            inner[:, 1:-1] = flat[:, 1:] & flat[:, :-1]
            order = np.argsort(inner, axis=1, kind="stable")
            count = (~inner).sum(1)
            order = np.take_along_axis(order, np.minimum(np.arange(count.max()), count[:, None] - 1), 1)
            before, after = np.take_along_axis(b, order, 1), np.take_along_axis(a, order, 1)
        found = []
        for k in range(len(x)):
            if resets[k]:
                found.append(constant(ends[k]))
                continue
            b, keep = np.unique(before[k], return_index=True)
            a = after[k][keep]
            flat = np.append(a[1:] == a[:-1], False)
            body = np.stack([b, np.where(flat, 0.0, 1.0), np.where(flat, a, a - b)], axis=1)
            found.append(np.concatenate([[[-np.inf, 1.0, a[0] - b[0]]], body]))
        return found


@dataclass(frozen=True)
class Smooth(Recurrence):
    """Exponential smoothing; null unsets."""

    value: str
    alpha: float

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.value,)

    def step(self, state, row):
        x = row[self.value]
        new = np.where(np.isnan(state), x, self.alpha * x + (1.0 - self.alpha) * state)
        new = np.where(np.isnan(x), np.nan, new)
        return new, new

    def maps(self, rows, live, ends):
        from_zero, _ = self.run(rows, live, np.zeros(len(live)))
        resets = (live & np.isnan(rows[self.value])).any(1)
        slope = (1.0 - self.alpha) ** live.sum(1)
        return [constant(e) if r else np.array([[-np.inf, s, z]]) for e, r, s, z in zip(ends, resets, slope, from_zero)]


@dataclass(frozen=True)
class Gate(Recurrence):
    """The rate where its confidence is high, blended with the last one where it is low, within limits."""

    rate: str
    confidence: str
    least: float
    alpha: float
    low: float
    high: float

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.rate, self.confidence)

    def step(self, state, row):
        r, c = row[self.rate], row[self.confidence]
        prev = np.nan_to_num(state, nan=0.0)
        weak = c < self.least
        blended = np.where(weak & (prev > 0), self.alpha * r + (1 - self.alpha) * prev, r)
        usable = (r > 0) & ~(weak & ((c <= 0) | (prev <= 0)))
        accepted = np.where(usable & (blended >= self.low) & (blended <= self.high), blended, np.nan)
        return accepted, accepted

    def maps(self, rows, live, ends):
        """Rows that blend are lines on the states that stay within the limits; all others unset or set."""
        n = len(live)
        slope, intercept = np.ones(n), np.zeros(n)
        low, high = np.full(n, -np.inf), np.full(n, np.inf)
        resets = np.zeros(n, bool)
        for t in range(live.shape[1]):
            r, c, on = rows[self.rate][:, t], rows[self.confidence][:, t], live[:, t]
            blends = (c < self.least) & (c > 0) & (r > 0)
            resets |= on & ~blends
            on = on & blends
            slope = np.where(on, (1 - self.alpha) * slope, slope)
            intercept = np.where(on, self.alpha * r + (1 - self.alpha) * intercept, intercept)
            with np.errstate(divide="ignore", invalid="ignore"):
                low = np.where(on, np.fmax(low, (self.low - intercept) / slope), low)
                high = np.where(on, np.fmin(high, (self.high - intercept) / slope), high)
        found = []
        for k in range(n):
            if resets[k] or low[k] > high[k]:
                found.append(constant(ends[k] if resets[k] else np.nan))
            else:
                beyond = np.nextafter(high[k], np.inf)
                found.append(np.array([[-np.inf, 0.0, np.nan], [low[k], slope[k], intercept[k]], [beyond, 0.0, np.nan]]))
        return found


@dataclass(frozen=True)
class Jump(Recurrence):
    """The time a stretch began: a new one begins more than ``span`` after, or after a row that closes."""

    time: str
    span: float
    closes: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.time, self.closes) if self.closes else (self.time,)

    def step(self, state, row):
        now = row[self.time]
        start = np.where(np.isnan(state) | (now - state > self.span), now, state)
        if not self.closes:
            return start, start
        return np.where(row[self.closes] > 0, np.nan, start), start

    def maps(self, rows, live, ends):
        """From a start the first later row beyond the span begins anew, and so on to the end of the block.

        That row is the first of a running maximum, so the way from each such row
        to the last start is found by doubling jumps.
        """
        found = []
        for k in range(len(live)):
            times = rows[self.time][k, live[k]]
            if self.closes and (rows[self.closes][k, live[k]] > 0).any():
                found.append(constant(ends[k]))
                continue
            highest = np.maximum.accumulate(times[~np.isnan(times)])
            highest = highest[np.diff(highest, prepend=-np.inf) > 0]
            if not len(highest):
                found.append(np.array([[-np.inf, 1.0, 0.0]]))
                continue
            after = np.searchsorted(highest, highest + self.span, side="right")
            last = np.where(after == len(highest), np.arange(len(highest)), after)
            while (last[last] != last).any():
                last = last[last]
            start = highest[last]
            new = np.append(True, start[1:] != start[:-1])
            begins = np.append(-np.inf, highest[:-1] - self.span)[new]
            body = np.stack([begins, np.zeros(len(begins)), start[new]], axis=1)
            found.append(np.concatenate([body, [[highest[-1] - self.span, 1.0, 0.0]]]))
        return found


def _padded(rows: pa.Array, columns: Sequence[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of lists of rows as matrices, one block a line, and which places hold rows."""
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(int)
    live = np.arange(lengths.max(initial=0)) < lengths[:, None]
    flat, out = rows.flatten(), {}
    for c in columns:
        out[c] = np.full(live.shape, np.nan)
        out[c][live] = pc.struct_field(flat, c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out, live


def scan(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    recurrence: Recurrence,
    output: str,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``output`` computed by ``recurrence`` along ``index`` within each key.

    Rows of one index are taken in the order of their values; a repeated row
    stays a row of its own. Columns must be of orderable types.
    """
    keys, columns = list(keys), list(recurrence.columns)
    rest = [c for c in df.columns if c not in keys]
    order = [index, *[c for c in columns if c != index], *[c for c in rest if c != index and c not in columns]]
    blocks = (
        df.withColumn(BLOCK, block_of(index, size))
        .groupBy(*keys, BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_rows"))
    )
    key_fields = [df.schema[k] for k in keys]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, live = _padded(batch.column("_rows"), columns)
            ends, _ = recurrence.run(rows, live, np.full(len(live), np.nan))
            pieces = [p.astype("<f8").tobytes() for p in recurrence.maps(rows, live, ends)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in (*keys, BLOCK)], pa.array(ends), pa.array(pieces, pa.binary())],
                names=[*keys, BLOCK, "_unset", "_map"])

    map_type = T.StructType(
        [*key_fields, T.StructField(BLOCK, T.LongType()), T.StructField("_unset", T.DoubleType()), T.StructField("_map", T.BinaryType())]
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key and block: each block's map leads to the start of the next."""
        key, state = None, np.nan
        for batch in batches:
            starts = []
            for *here, unset, pieces in zip(*(batch.column(c).to_pylist() for c in (*keys, "_unset", "_map"))):
                if here != key:
                    key, state = here, np.nan
                starts.append(state)
                state = evaluate(np.frombuffer(pieces, "<f8").reshape(-1, 3), np.nan if unset is None else unset, state)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keys, BLOCK)], pa.array(starts, pa.float64())], names=[*keys, BLOCK, "_start"])

    start_type = T.StructType([*key_fields, T.StructField(BLOCK, T.LongType()), T.StructField("_start", T.DoubleType())])
    # Keys with a single block (every real night) need no map.
    number = block_of(index, size)
    long_keys = df.groupBy(*keys).agg(F.min(number).alias("_b0"), F.max(number).alias("_b1")).filter("_b0 < _b1").select(*keys)
    starts = (
        blocks.join(long_keys, keys, "left_semi")
        .mapInArrow(summarise, map_type)
        .repartition(*keys)
        .sortWithinPartitions(*keys, BLOCK)
        .mapInArrow(chain, start_type)
    )

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_rows")
            rows, live = _padded(lists, columns)
            start = batch.column("_start").cast(pa.float64()).to_numpy(zero_copy_only=False)
            _, outputs = recurrence.run(rows, live, start)
            edges = np.append(0, np.cumsum(live.sum(1)))
            values = pa.array(outputs[live], mask=np.isnan(outputs[live]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], lists, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)],
                names=[*keys, "_rows", "_o"])

    result_type = T.StructType(
        [*key_fields, T.StructField("_rows", blocks.schema["_rows"].dataType), T.StructField("_o", T.ArrayType(T.DoubleType()))]
    )
    return (
        blocks.join(starts, [*keys, BLOCK], "left")
        .select(*keys, "_rows", "_start")
        .mapInArrow(replay, result_type)
        .select(*keys, F.explode(F.arrays_zip("_rows", "_o")).alias("_z"))
        .select(*[F.col(c) if c in keys else F.col(f"_z._rows.{c}").alias(c) for c in df.columns], F.col("_z._o").alias(output))
    )
