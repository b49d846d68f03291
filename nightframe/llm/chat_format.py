"""Chat logs: cumulative snapshots collapsed, then rendered. DataFrame functions only.

Logs often hold a conversation again and again as it grows. Every turn gets a
rolling hash of the conversation up to it; a conversation whose whole hash is
the hash of a proper prefix of a longer one is a snapshot of it, and an
anti-join removes it. Of equal conversations the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.operators.ordered import block_of, running_totals, with_position
from nightframe.session import cut_lineage

#: Turns per block of a conversation's running hash.
BLOCK = 256


def rendered_turn(role: str = "role", text: str = "text"):
    """One turn as text; a null role is ``unknown``, a null text empty."""
    return F.concat(
        F.lit("<|"), F.coalesce(F.col(role), F.lit("unknown")), F.lit("|>\n"),
        F.coalesce(F.col(text), F.lit("")), F.lit("<|end|>\n"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(key, conv_id, pos, piece, h1, h2): hashes of each conversation up to each turn.

    Turns are ordered by turn, then by their text (ties and repeated rows all
    stay); a null turn comes first. Rows with a null conv_id form one
    conversation. The hashes are sums of place-bound turn hashes, so a long
    conversation is summed in blocks.
    """
    source = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "conv_id", "turn", rendered_turn().alias("piece")
    )
    placed = with_position(source, ["key"], ["turn", "piece"], block_of(F.coalesce("turn", F.lit(-1)), BLOCK))
    hashes = {
        name: F.xxhash64(F.lit(name), F.col("pos").cast("bigint"), "piece").cast("decimal(20,0)") for name in ("h1", "h2")
    }
    return running_totals(placed.withColumn("_b", block_of("pos", BLOCK)), ["key"], ["pos"], "_b", hashes).select(
        "key", "conv_id", "pos", "piece", "h1", "h2"
    )


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies, text.

    ``copies`` counts the equal logs it stands for. Prefixes and whole
    conversations are reduced to distinct hashes before they meet, so a popular
    first turn is one row.
    """
    rolling = cut_lineage(prefix_hashes(turns), "prefix-hashes")
    ends = rolling.groupBy("key", "conv_id").agg(F.max("pos").alias("last"), F.count(F.lit(1)).alias("n_turns"))
    marked = rolling.join(ends.select("key", "last"), "key")
    whole = (
        marked.filter("pos = last")
        .groupBy((F.col("pos") + 1).alias("n_turns"), "h1", "h2")
        .agg(F.min(F.struct(F.col("conv_id").isNull().alias("n"), "conv_id", "key")).alias("first"), F.count(F.lit(1)).alias("copies"))
    )
    prefixes = marked.filter("pos < last").select((F.col("pos") + 1).alias("n_turns"), "h1", "h2").distinct()
    kept = whole.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select(
        F.col("first.key").alias("key"), F.col("n_turns").cast("bigint").alias("n_turns"), "copies"
    )
    return (
        rolling.join(kept, "key")
        .groupBy("key", "n_turns", "copies")
        .agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
        .select("conv_id", "n_turns", "copies", F.array_join(F.col("p.piece"), "").alias("text"))
    )
