"""Viterbi decoding of stage probabilities per recording (SEQ-11).

Recordings are cut into bounded blocks. A block's effect on the path scores is
a small (labels x labels) max-plus matrix, so only one matrix per block is
passed along a recording; the blocks themselves are decoded in parallel. A
normal night is one block and needs no passing. Within a task numpy works on
all blocks of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightframe.operators.ordered import BLOCK, block_of
from nightframe.operators.scoring import transition_penalties
from nightframe.schema import BLOCK_ROWS, CLASSES


def _log_probs(rows: pa.Array, probs: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(int)
    live = np.arange(lengths.max(initial=0)) < lengths[:, None]
    out = np.zeros((*live.shape, n))
    values = pc.struct_field(rows.flatten(), probs).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out[live] = np.log(np.clip(values.reshape(-1, n), 1e-12, 1.0))
    return out, lengths


def _forward(logp: np.ndarray, lengths: np.ndarray, cost: np.ndarray, start: np.ndarray):
    """Scores after the last row and back pointers. ``start`` rows are incoming
    scores, or NaN where the sequence begins here."""
    count, steps, n = logp.shape
    back = np.zeros((count, steps, n), dtype=np.int8)
    moved = start[:, :, None] - cost[None]
    first = np.isnan(start).any(axis=1)
    choice = np.where(first[:, None], 0, np.argmax(np.nan_to_num(moved, nan=-np.inf), axis=1))
    entered = np.where(first[:, None], 0.0, np.nanmax(np.where(first[:, None, None], 0.0, moved), axis=1))
    scores = entered + logp[:, 0]
    back[:, 0] = choice
    for t in range(1, steps):
        moved = scores[:, :, None] - cost[None]
        choice = np.argmax(moved, axis=1)
        stepped = np.take_along_axis(moved, choice[:, None, :], axis=1)[:, 0] + logp[:, t]
        live = (lengths > t)[:, None]
        scores = np.where(live, stepped, scores)
        back[:, t] = choice
    return scores, back


def viterbi(
    df: DataFrame,
    keys: Sequence[str],
    probs: str = "probabilities",
    labels: Sequence[str] = CLASSES,
    penalties: Mapping[tuple[str, str], float] | None = None,
    index: str = "epoch_index",
    output: str = "decoded",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the best label path; ties go to the first label. A repeated row stays a row of its own."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in (*keys, index, probs)]
    n = len(labels)
    table = penalties or transition_penalties(labels)
    cost = np.array([[table[s, d] for d in labels] for s in labels], dtype=float)
    blocks = (
        df.withColumn(BLOCK, block_of(index, size))
        .groupBy(*keys, BLOCK)
        .agg(F.sort_array(F.collect_list(F.struct(index, probs, *rest))).alias("_rows"))
    )
    key_fields = [df.schema[k] for k in keys]
    block_field = T.StructField(BLOCK, T.LongType())
    long_keys = (
        df.groupBy(*keys)
        .agg(F.min(block_of(index, size)).alias("_b0"), F.max(block_of(index, size)).alias("_b1"))
        .filter(F.col("_b0") < F.col("_b1"))
        .select(*keys)
    )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logp, lengths = _log_probs(batch.column("_rows"), probs, n)
            if not len(lengths):
                continue
            entry = np.full((len(lengths), n), np.nan)
            begin, _ = _forward(logp, lengths, cost, entry)
            matrix = []
            for i in range(n):
                entry = np.full((len(lengths), n), -np.inf)
                entry[:, i] = 0.0
                matrix.append(_forward(logp, lengths, cost, entry)[0])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in (*keys, BLOCK)], pa.array(list(begin)),
                 pa.array(list(np.stack(matrix, axis=1).reshape(len(lengths), n * n)))],
                names=[*keys, BLOCK, "begin", "matrix"])

    floats = T.ArrayType(T.DoubleType())
    summary = T.StructType(
        [*key_fields, block_field, T.StructField("begin", floats), T.StructField("matrix", floats)]
    )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK).reset_index(drop=True)
        matrices = [np.array(m).reshape(n, n) for m in pdf["matrix"]]
        vectors = [np.array(pdf["begin"][0])]
        for m in matrices[1:]:
            vectors.append((vectors[-1][:, None] + m).max(axis=0))
        ends = [int(np.argmax(vectors[-1]))]
        for b in range(len(pdf) - 1, 0, -1):
            ends.append(int(np.argmax(vectors[b - 1] + matrices[b][:, ends[-1]])))
        out = pdf[[*keys, BLOCK]].copy()
        out["_in"] = [None, *[list(v) for v in vectors[:-1]]]
        out["_end"] = ends[::-1]
        return out

    link = T.StructType([*key_fields, block_field, T.StructField("_in", floats), T.StructField("_end", T.IntegerType())])
    links = (
        blocks.join(long_keys, keys, "left_semi")
        .mapInArrow(summarise, summary)
        .groupBy(*keys)
        .applyInPandas(chain, link)
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("_rows")
            logp, lengths = _log_probs(rows, probs, n)
            if not len(lengths):
                continue
            start = np.array([[np.nan] * n if v is None else v for v in batch.column("_in").to_pylist()], dtype=float)
            scores, back = _forward(logp, lengths, cost, start.reshape(len(lengths), n))
            best = np.argmax(scores, axis=1)
            end = batch.column("_end")
            state = np.where(end.is_null().to_numpy(zero_copy_only=False), best, end.fill_null(0).to_numpy(zero_copy_only=False)).astype(int)
            path = np.zeros(logp.shape[:2], dtype=int)
            here = np.arange(len(lengths))
            for t in range(logp.shape[1] - 1, -1, -1):
                live = lengths > t
                path[:, t] = np.where(live, state, 0)
                state = np.where(live, back[here, t, state], state)
            live = np.arange(path.shape[1]) < lengths[:, None]
            chosen = pa.array(list(labels), pa.string()).take(pa.array(path[live]))
            edges = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], rows, pa.ListArray.from_arrays(edges, chosen)], names=[*keys, "_rows", "_o"])

    result = T.StructType(
        [
            *key_fields,
            T.StructField("_rows", blocks.schema["_rows"].dataType),
            T.StructField("_o", T.ArrayType(T.StringType())),
        ]
    )
    return (
        blocks.join(links, [*keys, BLOCK], "left")
        .select(*keys, "_rows", "_in", "_end")
        .mapInArrow(decode, result)
        .select(*keys, F.explode(F.arrays_zip("_rows", "_o")).alias("_z"))
        .select(*[F.col(c) if c in keys else F.col(f"_z._rows.{c}").alias(c) for c in df.columns], F.col("_z._o").alias(output))
    )
