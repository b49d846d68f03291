"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts the digests of its texts and reduces equal ones: a run.
Runs then meet in rounds: in each round the runs of ``FAN_IN`` neighbouring
nodes of the tree are exchanged, merged in order and reduced again, so a text
that is copied a million times is one row per run from the start. The digest
space is cut into slots, so every level of the tree is spread over all tasks
and no task ever holds a whole run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.words import SPACES
from nightframe.session import cut_lineage

FAN_IN = 8
RUN = "slot int, node int, digest binary, n_bytes bigint, doc_id bigint, rid bigint, copies bigint"
_SCHEMA = pa.schema(
    [("slot", pa.int32()), ("node", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("doc_id", pa.int64()),
     ("rid", pa.int64()), ("copies", pa.int64())]
)


def reduce_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the first row of each stretch of equal digests, with the sum of its copies.

    The rows come sorted by slot, digest, length and id, so the first is the
    smallest id. A stretch may go on in the next batch: its row waits.
    """
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_SCHEMA)
        table = pa.Table.from_batches([batch] if waiting is None else [waiting, batch]).combine_chunks()
        n = table.num_rows
        new = np.ones(n, bool)
        if n > 1:
            same = None
            for name in ("slot", "node", "digest", "n_bytes"):
                column = table.column(name)
                equal = pc.equal(column.slice(1), column.slice(0, n - 1))
                same = equal if same is None else pc.and_(same, equal)
            new[1:] = ~same.to_numpy()
        starts = np.flatnonzero(new)
        copies = np.add.reduceat(table.column("copies").to_numpy(), starts)
        out = table.take(pa.array(starts))
        out = out.set_column(out.schema.get_field_index("copies"), _SCHEMA.field("copies"), pa.array(copies, pa.int64()))
        out = out.combine_chunks()
        waiting = out.slice(out.num_rows - 1).to_batches()[0]
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).to_batches()
    if waiting is not None:
        yield waiting


def merge_runs(runs: DataFrame, width: int, partitions: int) -> DataFrame:
    """One run for all: (digest, n_bytes, doc_id, rid, copies), each digest once.

    ``width`` is the number of runs; rounds go on until one node is left.
    """
    order = ("slot", "node", "digest", "n_bytes", F.col("doc_id").asc_nulls_last(), "rid")
    while True:
        width = -(-width // FAN_IN)
        runs = (
            runs.withColumn("node", F.expr(f"node DIV {FAN_IN}").cast("int"))
            .repartition(partitions, "slot", "node")
            .sortWithinPartitions(*order)
            .mapInArrow(reduce_sorted, RUN)
        )
        if width <= 1:
            return runs


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after each run of white space became one
    space; a null text is an empty one. The row with the smallest id stays; a
    null id is larger than any other, and of repeated rows with that id exactly
    one stays. Digests count as equal only together with the text's length.
    """
    spark = docs.sparkSession
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), normal.alias("_n")
    ).select(
        "doc_id",
        F.unhex(F.sha2(F.col("_n").cast("binary"), 256)).alias("digest"),
        F.octet_length("_n").cast("bigint").alias("n_bytes"),
        F.monotonically_increasing_id().alias("rid"),
        F.spark_partition_id().alias("node"),
    )
    rows = cut_lineage(rows, "digests")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = (rows.agg(F.max("node")).first()[0] or 0) + 1  # one number
    slots = max(16, 8 * partitions)
    slot = F.pmod(F.xxhash64("digest"), F.lit(slots)).cast("int")
    runs = (
        rows.select(slot.alias("slot"), "node", "digest", "n_bytes", "doc_id", "rid", F.lit(1).cast("bigint").alias("copies"))
        .sortWithinPartitions("slot", "node", "digest", "n_bytes", F.col("doc_id").asc_nulls_last(), "rid")
        .mapInArrow(reduce_sorted, RUN)
    )
    winners = merge_runs(runs, width, partitions).select(
        "digest", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("rid").alias("_keep_rid"), F.col("copies").alias("group_size")
    )
    return rows.join(winners, ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("_keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
