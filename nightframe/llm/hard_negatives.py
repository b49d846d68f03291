"""Hard negatives by exact inner products, with most pairs ruled out by segment summaries.

Every vector is cut into segments, at several levels from one segment to many,
and each segment is stored as its mean and its deviation (the length of what is
left of the segment without the mean). For two vectors, the product of the means
plus or minus the product of the deviations, summed over the segments, bounds
the score from both sides. A pair whose bounds cannot reach what is asked goes
at the first level that shows it; the others are refined, and those left after
the finest level are scored exactly.

Rows lie in blocks that are kept in memory one at a time; the anchors stream
past every block, sorted behind its rows, so a task holds one block and one
batch of anchors. The rows that answer an anchor are reduced per block, then
over the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.session import cut_lineage

#: Segments of a vector at each level.
LEVELS = (1, 4, 16)
#: Values of a block of rows: 64 MB at four bytes each.
BLOCK_VALUES = 1 << 24
#: Rows of a small table's block, and blocks that a table is cut into if that many rows allow it.
LEAST_ROWS = 1024
BLOCKS = 48
#: Anchors and rows of one matrix of scores.
ANCHORS, ROWS = 256, 8192
#: Below this share of pairs left, pairs are scored one by one.
SPARSE = 0.02

SWEPT = pa.schema([("task", pa.int64()), ("kind", pa.int32()), ("rid", pa.int64()), ("vec_id", pa.int64()),
                   ("label", pa.int64()), ("q", pa.binary()), ("targets", pa.binary())])
FOUND = "rid bigint, vec_id bigint, n int, found_id bigint, score bigint"


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, vector) to the same with ``q``: floor(256 * x) of every component, 64-bit."""
    for batch in batches:
        flat = batch.column(2)
        q = []
        values = np.floor(256 * flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        ints = np.clip(values, -(2.0**62), 2.0**62).astype("<i8")
        edges = np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        q = [ints[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q, pa.binary())], names=["vec_id", "label", "q"])


def _matrix(q: list[bytes], dim: int) -> np.ndarray:
    """One row of integers per vector; missing components are 0."""
    if all(len(x) == 8 * dim for x in q):
        return np.frombuffer(b"".join(q), "<i8").reshape(len(q), dim)
    out = np.zeros((len(q), dim), np.int64)
    for k, x in enumerate(q):
        out[k, : len(x) // 8] = np.frombuffer(x, "<i8")
    return out


def segment_summaries(x: np.ndarray, levels: tuple[int, ...] = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) of the rows' segments at each level; a mean is scaled by its segment's root length."""
    found = []
    for n in levels:
        edges = np.linspace(0, x.shape[1], min(n, max(x.shape[1], 1)) + 1).astype(int)[:-1]
        if not x.shape[1]:
            found.append((np.zeros((len(x), 1)), np.zeros((len(x), 1))))
            continue
        sizes = np.diff(np.append(edges, x.shape[1]))
        mean = np.add.reduceat(x, edges, axis=1) / sizes
        square = np.add.reduceat((x - np.repeat(mean, sizes, axis=1)) ** 2, edges, axis=1)
        found.append(((mean * np.sqrt(sizes)), np.sqrt(square)))
    return found


@dataclass
class Block:
    """Rows sorted by label and id, with their summaries."""

    rid: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    q: np.ndarray

    def __post_init__(self) -> None:
        x = self.q.astype(np.float64)
        self.norm = np.sqrt((x**2).sum(1))
        self.summaries = [(m.astype(np.float32), d.astype(np.float32)) for m, d in segment_summaries(x)]

    @property
    def size(self) -> int:
        return len(self.rid)

    def take(self, at) -> Block:
        out = object.__new__(Block)
        out.rid, out.vec_id, out.label, out.q = self.rid[at], self.vec_id[at], self.label[at], self.q[at]
        out.norm, out.summaries = self.norm[at], [(m[at], d[at]) for m, d in self.summaries]
        return out


def bounds(a: Block, b: Block, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of ``a``'s rows with ``b``'s, widened by the rounding."""
    (mean_a, dev_a), (mean_b, dev_b) = a.summaries[level], b.summaries[level]
    middle, reach = mean_a @ mean_b.T, dev_a @ dev_b.T
    reach += np.float32(1e-5) * np.outer(a.norm, b.norm).astype(np.float32) + np.float32(1)
    return middle - reach, middle + reach


def exact_scores(a: Block, b: Block, alive: np.ndarray) -> np.ndarray:
    """Inner products of the pairs left (others -inf), in a type that cannot round them (up to 2^53)."""
    if alive.mean() < SPARSE:
        i, j = np.nonzero(alive)
        out = np.full(alive.shape, -np.inf)
        out[i, j] = np.einsum("ij,ij->i", a.q[i].astype(np.float64), b.q[j].astype(np.float64))
        return out
    # no sum of a part of the products is larger than the product of the lengths
    limit = a.norm.max(initial=0) * b.norm.max(initial=0) * 1.01 + 1
    kind = np.float32 if limit < 2**24 else np.float64
    scores = (a.q.astype(kind) @ b.q.astype(kind).T).astype(np.float64)
    scores[~alive] = -np.inf
    return scores


class Best:
    """The ``k`` best (score, id) of each anchor so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of all anchors with rows in the order of ``ids``; -inf takes no part."""
        scores = np.where(scores >= self.least[:, None], scores, -np.inf)
        rows = np.flatnonzero((scores > -np.inf).any(1))
        if not len(rows):
            return
        scores = scores[rows]
        if scores.shape[1] > self.k:
            # all above the k-th best, and of those equal to it the first ones
            edge = np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
            above, equal = scores > edge, scores == edge
            keep = above | (equal & (np.cumsum(equal, axis=1) <= self.k - above.sum(1, keepdims=True)))
            at = np.argsort(~keep, axis=1, kind="stable")[:, : self.k]
            new, new_ids = np.take_along_axis(np.where(keep, scores, -np.inf), at, 1), ids[at]
        else:
            new, new_ids = scores, np.broadcast_to(ids, scores.shape)
        both = np.concatenate([self.scores[rows], new], axis=1)
        ids_of = np.concatenate([self.ids[rows], np.where(new > -np.inf, new_ids, np.iinfo(np.int64).max)], axis=1)
        order = np.lexsort((ids_of, -both), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(ids_of, order, 1)


def _refined(a: Block, b: Block, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns of ``b`` left, pairs left): pairs whose bounds at every level can lie in [low, high] of the anchor."""
    columns = np.flatnonzero(alive.any(0))
    alive = alive[:, columns]
    if np.isneginf(low).any() and np.isposinf(high).all():
        return columns, alive
    for level in range(len(a.summaries)):
        if not len(columns):
            break
        least, most = bounds(a, b.take(columns), level)
        alive = alive & (most >= low[:, None]) & (least <= high[:, None])
        left = alive.any(0)
        if not left.all():
            columns, alive = columns[left], alive[:, left]
    return columns, alive


def positives_in(a: Block, b: Block, k: int) -> Best:
    """The best other rows of the same label of each anchor."""
    best = Best(a.size, k)
    for label in np.unique(a.label):
        rows = np.flatnonzero(a.label == label)
        mine, own = a.take(rows), Best(len(rows), k)
        first, last = np.searchsorted(b.label, [label, label], side="left")[0], np.searchsorted(b.label, label, side="right")
        for at in range(first, last, ROWS):
            part = b.take(slice(at, min(at + ROWS, last)))
            other = mine.rid[:, None] != part.rid[None, :]
            columns, alive = _refined(mine, part, other, own.least, np.full(len(rows), np.inf))
            if len(columns):
                left = part.take(columns)
                own.add(exact_scores(mine, left, alive), left.vec_id)
        best.scores[rows], best.ids[rows] = own.scores, own.ids
    return best


def negatives_in(a: Block, b: Block, positive: np.ndarray, some: np.ndarray, k: int) -> list[Best]:
    """The best rows of other labels for each anchor and positive score (where ``some``), one ``Best`` per positive."""
    # 50 * p <= 100 * n <= 95 * p in whole numbers
    low, high = np.where(some, -(-positive // 2), np.inf), np.where(some, 19 * positive // 20, -np.inf)
    found = [Best(a.size, k) for _ in range(positive.shape[1])]
    order = np.argsort(b.vec_id, kind="stable")
    for at in range(0, b.size, ROWS):
        part = b.take(order[at : at + ROWS])
        asked = np.maximum(low, np.stack([f.least for f in found], axis=1))
        other = a.label[:, None] != part.label[None, :]
        columns, alive = _refined(a, part, other, asked.min(1), high.max(1))
        if not len(columns):
            continue
        left = part.take(columns)
        scores = exact_scores(a, left, alive)
        for p, f in enumerate(found):
            inside = (scores >= low[:, p, None]) & (scores <= high[:, p, None])
            f.add(np.where(inside, scores, -np.inf), left.vec_id)
    return found


def _swept(dim: int, answer: Callable[[Block, list[bytes | None], Block], Iterator[tuple]]):
    """A function over rows sorted by task and kind: the rows of a task's block, then its anchors in batches."""

    def block_of(parts: list[pa.RecordBatch]) -> Block:
        table = pa.Table.from_batches(parts)
        q = [x for part in table.column("q").chunks for x in part.to_pylist()]
        return Block(*(table.column(c).to_numpy() for c in ("rid", "vec_id", "label")), _matrix(q, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, block = None, [], None
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, schema=SWEPT)
            tasks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if tasks[a] != task:
                    task, parts, block = tasks[a], [], None
                piece = batch.slice(a, b - a)
                if kinds[a] == 0:
                    parts.append(piece)
                    continue
                if block is None and parts:
                    block, parts = block_of(parts), []
                if block is None:
                    continue
                for c in range(0, piece.num_rows, ANCHORS):
                    few = piece.slice(c, ANCHORS)
                    yield from answer(block_of([few]), few.column("targets").to_pylist(), block)

    return run


def _rows(a: Block, n: int, best: Best) -> pa.RecordBatch:
    i, j = np.nonzero(best.scores > -np.inf)
    return pa.RecordBatch.from_arrays(
        [pa.array(a.rid[i]), pa.array(a.vec_id[i]), pa.array(np.full(len(i), n, np.int32)), pa.array(best.ids[i, j]),
         pa.array(best.scores[i, j].astype(np.int64))], names=["rid", "vec_id", "n", "found_id", "score"])


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound


def hard_negatives(
    embeddings: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 50,
    relabelled: int = 7,
    labels: int = 10,
    positives: int = 5,
    negatives: int = 3,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; where ``relabelled``
    divides the id, the label first becomes ``(label + 1) % labels``. Rows with
    a null id, label, vector or component, or a component that is not finite,
    take no part. A shorter vector counts as filled up with zeros. Repeated rows
    are rows of their own: an anchor's copy can be its positive, and a repeated
    anchor gives its rows again. An empty table, or one without anchors, gives
    no rows. Scores are exact up to 2^53. Other columns are not read.
    """
    source = embeddings.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    moved = F.when(F.col("vec_id") % relabelled == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = cut_lineage(
        source.select("vec_id", moved.alias("label"), "vector")
        .mapInArrow(quantised, "vec_id bigint, label bigint, q binary")
        .withColumn("rid", F.monotonically_increasing_id()),
        "vectors",
    )
    n, size = rows.agg(F.count("*"), F.max(F.length("q"))).first()
    dim = max((size or 0) // 8, 1)
    blocks = max(math.ceil(n * dim / BLOCK_VALUES), min(BLOCKS, math.ceil(n / LEAST_ROWS)), 1)
    # Few large blocks leave machines idle: then the anchors are dealt out too, and each block goes to every group.
    groups = max(1, min(math.ceil(2 * rows.sparkSession.sparkContext.defaultParallelism / blocks), math.ceil(n / every / ANCHORS)))
    number = F.xxhash64("rid")
    data = rows.withColumn(
        "task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g + F.pmod(number, F.lit(blocks)) * groups))
    )
    anchors = rows.filter(F.col("vec_id") % every == 0)

    def sweep(asked: DataFrame, answer) -> DataFrame:
        group = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups))
        task = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * groups + group))
        columns = ["rid", "vec_id", "label", "q", "targets"]
        none = F.lit(None).cast("binary")
        both = data.withColumn("targets", none).select(F.col("task").cast("bigint"), F.lit(0).alias("kind"), *columns).unionByName(
            asked.select(task.alias("task"), F.lit(1).alias("kind"), *columns)
        )
        dealt = both.repartition(blocks * groups, "task").sortWithinPartitions("task", "kind", "label", "vec_id", "rid")
        return dealt.mapInArrow(_swept(dim, answer), FOUND)

    def positive_rows(a: Block, _, b: Block):
        yield _rows(a, 0, positives_in(a, b, positives))

    def negative_rows(a: Block, targets: list[bytes], b: Block):
        scores, some = np.zeros((a.size, positives), np.int64), np.zeros((a.size, positives), bool)
        for k, t in enumerate(targets):
            p = np.frombuffer(t, ">i8")
            scores[k, : len(p)], some[k, : len(p)] = p, True
        for p, best in enumerate(negatives_in(a, b, scores, some, negatives)):
            yield _rows(a, p, best)

    def first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("rid", "n").orderBy(F.desc("score"), "found_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    chosen = cut_lineage(
        first(sweep(anchors.withColumn("targets", F.lit(None).cast("binary")), positive_rows), positives)
        .select("rid", (F.col("rank") - 1).alias("n"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives",
    )
    # scores of an anchor's positives in order, 8 bytes each
    packed = F.array_sort(F.collect_list(F.struct("n", "positive_score")))
    hexed = F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x["positive_score"]), 16, "0")), "")
    targets = chosen.groupBy("rid").agg(F.unhex(hexed).alias("targets"))
    mined = first(sweep(anchors.join(targets, "rid"), negative_rows), negatives)
    return mined.join(chosen, ["rid", "n"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
