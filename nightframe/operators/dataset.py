"""Training-set building: labels, balance, splits, purge, snapshots (DST-01 .. DST-18)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframe.operators.ordered import (
    block_of,
    ranked_in_ranges,
    with_frame,
    with_neighbours,
    with_position,
)
from nightframe.operators.scan import Jump, scan
from nightframe.operators.windows import index_range
from nightframe.schema import BLOCK_ROWS, STAGES
from nightframe.session import cut_lineage

STRATEGIES = ("ground_truth_only", "predicted_only", "ground_truth_or_predicted")


@dataclass(frozen=True)
class SplitRatios:
    """Shares of train, validation and test."""

    train: float
    val: float
    test: float


# --- fixed values -----------------------------------------------------------
BUILD_RATIOS = SplitRatios(0.75, 0.10, 0.15)
RELOAD_RATIOS = SplitRatios(0.70, 0.15, 0.15)
REM_LOW, REM_MID = 0.15, 0.30
# --- end of fixed values ----------------------------------------------------


def select_label(
    df: DataFrame,
    strategy: str = "ground_truth_only",
    allow_predicted: bool = False,
    truth: str = "ground_truth_stage",
    pred: str = "predicted_stage",
) -> DataFrame:
    """Add ``label`` and ``label_source``; rows without a label are dropped (DST-01)."""
    if strategy not in STRATEGIES:
        raise ValueError("Unknown label strategy")
    if strategy != "ground_truth_only" and not allow_predicted:
        raise ValueError("Predicted labels are disabled for dataset build")
    t = F.when(F.col(truth) != "", F.col(truth))
    p = F.when(F.col(pred) != "", F.col(pred))
    label, source = {
        "ground_truth_only": (t, F.lit("ground_truth")),
        "predicted_only": (p, F.lit("predicted")),
        "ground_truth_or_predicted": (
            F.coalesce(t, p),
            F.when(t.isNotNull(), "ground_truth").otherwise("predicted"),
        ),
    }[strategy]
    return df.withColumns({"label": label, "label_source": source}).filter(F.col("label").isNotNull())


def seeded(seed: int, *parts: Column | str) -> Column:
    """Deterministic pseudo-random hex text of a row's identity."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def draw(seed: int, *parts: Column | str) -> Column:
    """Deterministic non-negative 48-bit integer."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 12), 16, 10).cast("bigint")


def seeded_position(df: DataFrame, keys: Sequence[str], seed: int, ids: Sequence[str], name: str = "pos") -> DataFrame:
    """Random but repeatable position within each key, ranked in hash blocks.

    There are as many blocks as the counted rows need, so a block of one key has
    ``BLOCK_ROWS`` rows or so at any size.
    """
    hashed = df.withColumn("_h", seeded(seed, *ids))
    blocks = F.greatest(F.ceil(df.agg(F.count(F.lit(1))).scalar() / BLOCK_ROWS), F.lit(1))
    spot = F.conv(F.substring("_h", 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    return with_position(hashed, keys, ["_h", *ids], F.floor(spot * blocks), name).drop("_h")


def balance_classes(
    df: DataFrame, label: str, ids: Sequence[str], strategy: str = "none", seed: int = 42
) -> DataFrame:
    """Undersample to the smallest or oversample to the largest class (DST-02)."""
    if strategy == "none":
        return df
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    pick = {"undersample": F.min, "oversample": F.max}
    if strategy not in pick:
        raise ValueError("Unknown balance strategy")
    targets = counts.withColumn("_target", pick[strategy]("_n").over(everything))
    ranked = seeded_position(df, [label], seed, ids, "_pos")
    if strategy == "undersample":
        return ranked.join(targets, label).filter(F.col("_pos") < F.col("_target")).drop("_pos", "_n", "_target")
    draws = index_range(targets, "_target", "_j", spread=True).select(
        label, "_j", (draw(seed, label, "_j") % F.col("_n")).alias("_pos")
    )
    # the planner sees the blocks of draws only, a few rows: without a word it would send all draws to every task
    return draws.hint("merge").join(ranked, [label, "_pos"]).drop("_pos").withColumnRenamed("_j", "draw")


def _split_by_position(pos: Column, total: Column, ratios: SplitRatios) -> Column:
    """Counts are rounded half to even: test first, then validation, rest train."""
    test = F.bround(total * F.lit(ratios.test), 0)
    val = F.least(F.bround(total * F.lit(ratios.val), 0), total - F.least(test, total))
    train = F.greatest(total - test - val, F.lit(0))
    return F.when(pos < train, "train").when(pos < train + val, "val").otherwise("test")


def stratified_split(
    df: DataFrame, label: str, ids: Sequence[str], ratios: SplitRatios = BUILD_RATIOS, seed: int = 42
) -> DataFrame:
    """Row split that keeps class shares (DST-03).

    Rows of each class are ranked by a seeded hash and cut at the ratios; a
    class with a single row falls into train.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    ranked = seeded_position(df, [label], seed, ids, "_pos").join(sizes, label)
    return ranked.withColumn(
        "split", _split_by_position(F.col("_pos"), F.col("_n"), ratios)
    ).drop("_pos", "_n")


def time_blocks(
    df: DataFrame, keys: Sequence[str], ts_sec: str, block_seconds: int, index: str = "epoch_index"
) -> DataFrame:
    """Start of each row's time block: a new block begins when a row is more than
    ``block_seconds`` after the block's first row (DST-06)."""
    out = scan(df, keys, index, Jump(ts_sec, block_seconds), "block_start")
    return out.withColumn("block_start", F.col("block_start").cast("bigint"))


def group_table(df: DataFrame, group: Sequence[str], ts_sec: str) -> DataFrame:
    """One row per split group: size, first time, first dataset and REM share."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min(ts_sec).alias("start_sec"),
        F.min("dataset_id").alias("dataset_id"),
        F.avg(F.when(F.col("label") == "REM", 1.0).otherwise(0.0)).alias("rem_ratio"),
    )


def order_groups(
    groups: DataFrame,
    group: Sequence[str],
    seed: int = 42,
    by_time: bool = False,
    stratify: str | None = None,
) -> DataFrame:
    """Position of each group in split order (DST-04, DST-08).

    ``by_time`` orders by first time, otherwise by seeded hash. ``stratify``
    (``dataset`` or ``dataset_rem``) deals groups round-robin over the sorted
    strata.
    """
    group = list(group)
    if stratify is not None:
        bucket = F.when(F.col("rem_ratio") < REM_LOW, "low").when(F.col("rem_ratio") < REM_MID, "mid").otherwise("high")
        stratum = (
            F.col("dataset_id") if stratify == "dataset" else F.concat_ws(":", "dataset_id", bucket)
        )
        ranked = seeded_position(groups.withColumn("stratum", stratum), ["stratum"], seed, group, "_rank")
        return ranked_in_ranges(ranked, [], ["_rank", "stratum"], "order").drop("_rank")
    if by_time:
        return ranked_in_ranges(groups, [], ["start_sec", *group], "order")
    return seeded_position(groups, [], seed, group, "order")


def assign_groups(ordered: DataFrame, ratios: SplitRatios = BUILD_RATIOS) -> DataFrame:
    """Cut ordered groups into splits (DST-04)."""
    total = ordered.agg(F.count(F.lit(1)).cast("double")).scalar()
    return (
        ordered.withColumn("_total", total)
        .withColumn("split", _split_by_position(F.col("order"), F.col("_total"), ratios))
        .drop("_total")
    )


def grouped_split(
    df: DataFrame,
    group: Sequence[str],
    ts_sec: str = "end_sec",
    ratios: SplitRatios = BUILD_RATIOS,
    seed: int = 42,
    by_time: bool = False,
    stratify: str | None = None,
) -> DataFrame:
    """Assign whole groups (recordings, time groups or blocks) to splits (DST-04).

    The group table, one row per group, is stored before it is ranked.
    """
    groups = cut_lineage(group_table(df, group, ts_sec), "groups")
    ordered = order_groups(groups, group, seed, by_time, stratify)
    return df.join(assign_groups(ordered, ratios).select(*group, "split"), list(group))


def purge_gap(
    df: DataFrame, keys: Sequence[str], gap: int, index: str = "epoch_index", split: str = "split"
) -> DataFrame:
    """Drop ``gap`` windows on both sides of each split change in a recording (DST-07)."""
    if gap <= 0:
        return df
    placed = with_position(df, keys, [index], block_of(index), "_pos")
    seq = with_neighbours(placed, keys, ["_pos"], block_of("_pos"), [split], dense=BLOCK_ROWS)
    changed = seq.withColumn(
        "_edge", F.coalesce((F.col(f"prev.{split}") != F.col(split)).cast("int"), F.lit(0))
    ).drop("prev")
    near = with_frame(changed, keys, "_pos", gap - 1, gap, {"_near": F.max("_edge")})
    return near.filter(F.col("_near") == 0).drop("_near", "_edge", "_pos")


def split_manifest(df: DataFrame, recording: str = "recording_id") -> DataFrame:
    """Windows and recordings per split, and whether a recording is shared (DST-14)."""
    pairs = df.groupBy(recording, "split").agg(F.count(F.lit(1)).alias("_n"))
    spread = Window.partitionBy(recording)
    marked = pairs.withColumn("_shared", F.count(F.lit(1)).over(spread) > 1)
    return marked.groupBy("split").agg(
        F.sum("_n").alias("windows"), F.count(F.lit(1)).alias("recordings"),
        F.max("_shared").alias("recording_overlap"),
    )


def snapshot_rows(df: DataFrame, recording: str = "recording_id", end_ts: str = "window_end_ts", label: str = "label") -> DataFrame:
    """Window id and digest of ``id|label\\n`` for every snapshot row (DST-11)."""
    iso = F.date_format(end_ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    wid = F.concat_ws(":", F.col(recording).cast("string"), iso)
    line = F.concat(wid, F.lit("|"), F.coalesce(F.col(label), F.lit("")), F.lit("\n"))
    return df.withColumns({"window_id": wid, "row_digest": F.sha2(line, 256)})


def _digest_of(col: str, order: Sequence[str]) -> Column:
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(col).alias("_d"))))
    return F.sha2(F.array_join(F.transform(items, lambda x: x["_d"]), ""), 256)


#: Children of a node of a snapshot's tree, and leaves below the deepest nodes (expected).
FAN_OUT = 16


def snapshot_tree(rows: DataFrame, recording: str = "recording_id", index: str = "epoch_index", depth: int | None = None) -> DataFrame:
    """Digest tree of a snapshot: ``(level, node, digest, n, recording, block)`` rows.

    Leaves (level -1) are bounded blocks of a recording, their rows in order.
    Each leaf has a path of hex digits from its key; a node is a path's first
    digits, the root the empty one. The deepest nodes digest their leaves, the
    others up to 16 children. ``depth`` is chosen from the counted leaves, so
    that no node gathers more as the snapshot grows; a tree to compare with
    another one takes that one's depth.
    """
    key = F.concat_ws(":", F.col(recording).cast("string"), F.col("block").cast("string"))
    leaves = cut_lineage(
        rows.groupBy(F.col(recording), block_of(index).alias("block"))
        .agg(_digest_of("row_digest", [index]).alias("digest"), F.count(F.lit(1)).alias("n"))
        .select(F.lit(-1).alias("level"), F.md5(key).alias("node"), "digest", "n", F.col(recording).alias("recording"), "block"),
        "snapshot-leaves",
    )
    if depth is None:
        depth = tree_depth(leaves.count())
    tree, below = leaves, leaves
    for level in range(depth, -1, -1):
        node = F.substring("node", 1, level)
        stored = below.groupBy(node.alias("_p")).agg(_digest_of("digest", ["node"]).alias("digest"), F.sum("n").alias("n"))
        below = stored.select(F.lit(level).alias("level"), F.col("_p").alias("node"), "digest", "n")
        if level == depth:
            below = cut_lineage(below, "snapshot-nodes")
        tree = tree.unionByName(below, allowMissingColumns=True)
    return tree


def tree_depth(leaves: int) -> int:
    """Levels below the root so that the deepest nodes have ``FAN_OUT`` leaves or so."""
    depth, nodes = 0, 1
    while nodes * FAN_OUT < leaves:
        depth, nodes = depth + 1, nodes * FAN_OUT
    return depth


def snapshot_digest(rows: DataFrame, recording: str = "recording_id", index: str = "epoch_index") -> DataFrame:
    """The root of a snapshot's digest tree: one row ``(checksum, row_count)`` (DST-11); none for no rows."""
    root = snapshot_tree(rows, recording, index).filter("level = 0")
    return root.select(F.col("digest").alias("checksum"), F.col("n").alias("row_count"))


def tree_differences(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Leaves in which two trees of one depth differ: ``(recording, block, change)`` (DST-12).

    The trees are compared from the root down, and at each level only below the
    nodes that differed in the one before: a changed row is found by as many
    comparisons as the tree has levels.
    """
    depth = stored.agg(F.max("level")).first()[0]
    other = rebuilt.agg(F.max("level")).first()[0]
    if None not in (depth, other) and depth != other:
        raise ValueError("trees of different depth")
    depth = next((d for d in (depth, other) if d is not None), 0)
    open_ = None  # the nodes of the level above that differ
    for level in [*range(depth + 1), -1]:
        sides = []
        for tree in (stored, rebuilt):
            side = tree.filter(F.col("level") == level)
            if open_ is not None:
                above = F.substring("node", 1, level - 1 if level > 0 else depth)
                side = side.withColumn("_above", above).join(open_.withColumnRenamed("node", "_above"), "_above", "left_semi").drop("_above")
            sides.append(side)
        a, b = (s.select("node", F.col("digest").alias(f"_{n}"), F.struct("recording", "block").alias(f"_l{n}")) for n, s in zip("ab", sides))
        pairs = a.join(b, "node", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
        if level < 0:
            leaf = F.coalesce("_la", "_lb")
            change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").otherwise("changed")
            return pairs.select(leaf["recording"].alias("recording"), leaf["block"].alias("block"), change.alias("change"))
        open_ = cut_lineage(pairs.select("node"), "different-nodes")


def verify_snapshot(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Compare two digest rows (DST-12)."""
    out = stored.select(
        F.col("checksum").alias("expected"), rebuilt.select("checksum").scalar().alias("computed"),
        F.col("row_count").alias("expected_rows"), rebuilt.select("row_count").scalar().alias("computed_rows"),
    )
    same = (F.col("expected") == F.col("computed")) & (F.col("expected_rows") == F.col("computed_rows"))
    return out.withColumn("matches", same)


def reload_snapshot(stored: DataFrame, windows: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Stored snapshot rows with their rebuilt windows (JON-10, DST-13)."""
    out = stored.join(windows.withColumn("_found", F.lit(True)), list(keys), "left")
    found = F.coalesce("_found", F.lit(False))
    if strict:
        found = F.when(found, found).otherwise(F.raise_error(F.lit("Snapshot window missing")).cast("boolean"))
    return out.withColumn("found", found).drop("_found")


def ground_truth_rows(df: DataFrame, stage: str, labels: Sequence[str] = tuple(STAGES)) -> DataFrame:
    """One-hot prediction with confidence 1 for every scored epoch (DST-15)."""
    probs = F.create_map(
        *[x for s in labels for x in (F.lit(s), F.when(F.col(stage) == s, 1.0).otherwise(0.0))]
    )
    return df.filter(F.col(stage).isin(*labels)).select(
        "*",
        F.col(stage).alias("truth"),
        probs.alias("truth_probabilities"),
        F.lit(1.0).alias("truth_confidence"),
        F.lit("ground_truth").alias("truth_version"),
    )


def artifact_problems(
    nights: DataFrame, features: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Contract violations of night artifacts as rows, never exceptions (DST-16).

    ``nights`` has per-night ``n_features, n_labels, n_mask, n_timestamps,
    bad_labels, n_valid, alignment_status, alignment_reason,
    failed_required``; ``features`` has ``name, causal`` per key.
    """
    non_causal = features.groupBy(*keys).agg(F.count_if(~F.col("causal")).alias("_nc"))
    lengths = (F.col("n_features") != F.col("n_labels")) | (F.col("n_labels") != F.col("n_mask"))
    needs_mask = (F.col("alignment_status") == "reconciled") & F.col("alignment_reason").isin("short", "pad")
    checks = {
        "length mismatch": lengths,
        "timestamps length mismatch": F.col("n_timestamps") != F.col("n_labels"),
        "labels outside domain": F.col("bad_labels") > 0,
        "non-causal feature": F.coalesce(F.col("_nc"), F.lit(0)) > 0,
        "mask has no invalid epochs": needs_mask & (F.col("n_valid") == F.col("n_mask")),
        "failed required channel": F.col("failed_required") > 0,
    }
    rows = F.filter(
        F.array(*[F.when(cond, F.lit(text)) for text, cond in checks.items()]), lambda p: p.isNotNull()
    )
    return nights.join(non_causal, list(keys), "left").select(*keys, F.explode(rows).alias("problem"))


def policy_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Differences of two flattened policies ``(path, value)`` (DST-17)."""
    on = [*keys, "path"]
    a = expected.select(*on, F.col("value").alias("expected"), F.lit(True).alias("_in_a"))
    b = actual.select(*on, F.col("value").alias("actual"), F.lit(True).alias("_in_b"))
    kind = (
        F.when(F.col("_in_b").isNull(), "missing key in actual")
        .when(F.col("_in_a").isNull(), "unexpected key in actual")
        .when(~F.col("expected").eqNullSafe(F.col("actual")), "value mismatch")
    )
    return a.join(b, on, "full_outer").withColumn("difference", kind).filter(
        F.col("difference").isNotNull()
    ).select(*on, "expected", "actual", "difference")


def flatten_policy(policy: Mapping, prefix: str = "") -> list[tuple[str, str]]:
    """Nested policy mapping to (dotted path, text) pairs."""
    out: list[tuple[str, str]] = []
    for key, value in policy.items():
        path = f"{prefix}{key}"
        if isinstance(value, Mapping):
            out += flatten_policy(value, f"{path}.")
        else:
            out.append((path, "null" if value is None else str(value)))
    return out


def weighted_resample(
    df: DataFrame, hard: str, ids: Sequence[str], factor: float, seed: int = 42
) -> DataFrame:
    """Draw as many rows as there are, with replacement, rows of hard recordings
    ``factor`` times as likely (DST-18).

    Two weights suffice: a draw falls into the hard or the easy part by total
    weight and then on one position of that part.
    """
    ranked = seeded_position(df, [hard], seed, ids, "_pos")
    sizes = df.agg(
        F.count_if(F.col(hard)).alias("_h"), F.count_if(~F.col(hard)).alias("_e"),
        F.count(F.lit(1)).alias("_n"),
    )
    unit = draw(seed, "_j") / F.lit(float(1 << 48))
    spot = unit * (F.col("_h") * factor + F.col("_e"))
    heavy = spot < F.col("_h") * factor
    pos = F.when(heavy, F.floor(spot / factor)).otherwise(F.floor(spot - F.col("_h") * factor))
    limit = F.when(heavy, F.col("_h") - 1).otherwise(F.col("_e") - 1)
    draws = index_range(sizes, "_n", "_j", spread=True).select(
        F.col("_j").alias("draw"), heavy.alias(hard), F.least(pos, limit).alias("_pos")
    )
    return draws.hint("merge").join(ranked, [hard, "_pos"]).drop("_pos")
