"""Near duplicates by Jaccard similarity of word n-gram sets, with PartEnum signatures.

Sizes are cut into bands; two sets similar enough lie in one band or in two that
touch, and differ in at most ``k`` features. At each level (a band and the next)
the feature domain is hashed into ``groups`` groups of three partitions. Some
group holds one difference at most, so two of its three partitions agree: the
signatures are all pairs of partitions of a group. Sets that share a signature
are candidates, and every candidate pair is compared exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.words import in_groups, mix, shingle_sets
from nightframe.session import cut_lineage

#: Rows of a side that may be broadcast (16 bytes each); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Sets compared at once: a block of them against another.
BLOCK = 256
#: Columns of the membership matrix held at a time.
COLUMNS = 8192


@dataclass(frozen=True)
class Similarity:
    """Sets link when ``100 * intersection >= percent * union`` over runs of ``n`` words."""

    n: int = 3
    percent: int = 90

    def bands(self, largest: int) -> np.ndarray:
        """First sizes of the bands up to ``largest`` and one more."""
        firsts, at = [], 1
        while at <= largest:
            firsts.append(at)
            at = at * 100 // self.percent + 1
        return np.array([*firsts, at], np.int64)

    def differences(self, last: np.ndarray) -> np.ndarray:
        """Most differing features of a similar pair whose smaller set has ``last`` features at most."""
        both = last + last * 100 // self.percent
        return both * (100 - self.percent) // (100 + self.percent)

    def groups(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(groups, spare) of each level.

        ``spare`` groups beyond the pigeonhole's need let a set leave out its
        empty signatures: as long as it has no more groups with an empty pair
        than that, a similar set shares one that is not empty.
        """
        k = self.differences(last)
        need = k // 2 + 1
        share = 3 * np.exp(-2 * first / (3 * need))
        spare = np.where(need >= 8, np.ceil(need * share + 3 * np.sqrt(need * share)), 0).astype(np.int64)
        spare = np.where(share < 1e-3, 0, np.minimum(spare, need // 4))
        return np.where(k > 0, need + spare, 0), spare


def set_keys(owner: np.ndarray, run: np.ndarray, n_docs: int) -> np.ndarray:
    """One 64-bit key per set: equal sets, equal keys."""
    total = np.zeros(n_docs, np.uint64)
    np.add.at(total, owner, mix(run + np.uint64(0x5851F42D4C957F2D)))
    return mix(total + np.bincount(owner, minlength=n_docs).astype(np.uint64)).view(np.int64)


def signatures(owner: np.ndarray, run: np.ndarray, n_docs: int, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature) of all sets, for the level of their band and the one below."""
    size = np.bincount(owner, minlength=n_docs)
    firsts = sim.bands(int(size.max(initial=1)))
    band = np.searchsorted(firsts, size, side="right") - 1
    owners, found = [], []
    lasts = np.append(firsts[1:] - 1, 0)
    all_groups, all_spare = sim.groups(firsts[:-1].astype(float), lasts[:-1])
    for below in (0, 1):
        level = band - below
        groups = np.where((level >= 0) & (size > 0), all_groups[np.maximum(level, 0)], 0)
        at = np.cumsum(groups) - groups
        if not groups.sum():
            continue
        use = groups[owner] > 0
        o, r = owner[use], run[use]
        salted = mix(r + level[o].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        part = 3 * at[o] + (salted % (3 * groups[o]).astype(np.uint64)).astype(np.int64)
        value = np.zeros(3 * int(groups.sum()), np.uint64)
        np.add.at(value, part, mix(r))
        count = np.bincount(part, minlength=len(value)).reshape(-1, 3)
        value = value.reshape(-1, 3)
        doc = np.repeat(np.arange(n_docs), groups)
        place = (np.arange(len(doc)) - at[doc]).astype(np.uint64)
        lacking = np.zeros(n_docs, np.int64)
        empty_pair = (count == 0).sum(1) >= 2
        np.add.at(lacking, doc, empty_pair)
        all_of = lacking > all_spare[np.maximum(level, 0)]
        tag = mix(level[doc].astype(np.uint64) * np.uint64(1 << 32) + place)
        for x, y in ((0, 1), (0, 2), (1, 2)):
            sig = mix(value[:, x] * np.uint64(0xD1342543DE82EF95) + mix(value[:, y] + np.uint64(y)) + tag + np.uint64(3 * x + y))
            use = (count[:, x] + count[:, y] > 0) | all_of[doc]
            owners.append(doc[use])
            found.append(sig[use])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(found).view(np.int64)


def _per_batch(make, names, types):
    """A mapInArrow function: ``make(column 0, texts)`` per group of texts gives arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            for a, b in in_groups(texts):
                columns = make(ids.slice(a, b - a), texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _describe(sim: Similarity):
    def make(ids, texts):
        owner, run = shingle_sets(texts, sim.n)
        size = np.bincount(owner, minlength=len(texts))
        return ids, size, pa.array(set_keys(owner, run, len(texts)), mask=size == 0)

    return _per_batch(make, ["doc_id", "n_shingles", "node"], [pa.int64()] * 3)


def _sign(sim: Similarity):
    def make(ids, texts):
        owner, run = shingle_sets(texts, sim.n)
        keys = set_keys(owner, run, len(texts))
        # Copies of a set sign once.
        once = np.zeros(len(texts), bool)
        once[np.unique(keys, return_index=True)[1]] = True
        owner, run = owner[once[owner]], run[once[owner]]
        doc, sig = signatures(owner, run, len(texts), sim)
        return sig, keys[doc]

    return _per_batch(make, ["sig", "node"], [pa.int64()] * 2)


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sig, node) to (leader, node) for every node but the first under a signature."""
    last, lead = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        leader = node[np.maximum.accumulate(np.where(new, np.arange(len(sig)), 0))]
        if last is not None and sig[0] == last:
            leader[sig == last] = lead
        last, lead = sig[-1], leader[-1]
        led = leader != node
        if led.any():
            yield pa.RecordBatch.from_arrays([pa.array(leader[led]), pa.array(node[led])], names=["leader", "node"])


def _sets(sim: Similarity):
    def make(ids, texts):
        owner, run = shingle_sets(texts, sim.n)
        keys = set_keys(owner, run, len(texts))
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        return keys, [run[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    return _per_batch(make, ["node", "features"], [pa.int64(), pa.binary()])


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``left`` with those numbered ``right``."""
    common = np.zeros((len(left), len(right)), np.float32)
    if len(sets) <= 3:
        for x, i in enumerate(left):
            for y, j in enumerate(right):
                common[x, y] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return common
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(code, minlength=len(values)) > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[code]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(often.sum())
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        table = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        table[row[a:b], column[a:b] - at] = 1
        common += table[left] @ table[right].T
    return common


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs link; inside one block each pair stands once."""
    size = np.array([len(s) for s in sets])
    common = _common(sets, left, right).astype(np.float64)
    union = size[left][:, None] + size[right][None, :] - common
    hit = 100 * common >= percent * union
    return np.triu(hit, 1) if left is right else hit


def _forest(nodes: list[int], left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links."""
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in np.argwhere(hit).tolist():
        i, j = root(int(left[x])), root(int(right[y]))
        if i != j:
            parent[max(i, j)] = min(i, j)
            yield nodes[left[x]], nodes[right[y]]


def _compare(percent: int):
    """Rows (leader, i, j, block, node, features, copies, earlier) sorted by leader, i, j.

    Gives (a, b, null): links enough to connect what is similar, and (a, null,
    documents): how many documents of other sets the set ``a`` links with. A
    pair under several leaders is counted under the first: ``earlier`` holds a
    set's leaders before this one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, blocks, sets, copies, earlier, out = None, [], [], [], [], [], []

        def settle():
            if len(nodes) < 2:
                return
            block = np.array(blocks)
            if key[1] == key[2]:
                left = right = np.arange(len(nodes))
            else:
                left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
            if not len(left) or not len(right):
                return
            hit = _similar(sets, left, right, percent)
            if not hit.any():
                return
            out.extend((a, b, None) for a, b in _forest(nodes, left, right, hit))
            if sum(map(len, earlier)):
                hit &= _common(earlier, left, right) == 0
            weight = np.array(copies, np.int64)
            linked = np.zeros(len(nodes), np.int64)
            np.add.at(linked, left, hit @ weight[right])
            np.add.at(linked, right, weight[left] @ hit)
            out.extend((nodes[k], None, int(linked[k])) for k in np.flatnonzero(linked).tolist())

        def flush():
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "documents"])

        for batch in batches:
            leader, i, j, block, node, weight = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6))
            features, before = batch.column(5), batch.column(7)
            for k in range(batch.num_rows):
                here = (leader[k], i[k], j[k])
                if here != key:
                    settle()
                    key, nodes, blocks, sets, copies, earlier = here, [], [], [], [], []
                nodes.append(node[k])
                blocks.append(block[k])
                sets.append(np.frombuffer(features[k].as_buffer(), np.uint64))
                copies.append(weight[k])
                earlier.append(before[k].values.to_numpy())
            if out:
                yield flush()
        settle()
        if out:
            yield flush()

    return run


def _join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a stored table, broadcast only where its counted rows are few."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def compared_sets(source: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """(a, b, documents): see ``_compare``; its links connect exactly the similar sets.

    ``source`` has doc_id and text, ``nodes`` the set key of every document.
    Signatures are sorted once; the smallest set key under a signature leads the
    others. All sets under one leader are compared in blocks of ``BLOCK``, each
    pair of blocks apart from the others. A set has no more leaders than it has
    signatures, which its own size bounds.
    """
    partitions = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = cut_lineage(
        source.mapInArrow(_sign(sim), "sig bigint, node bigint")
        .repartition(partitions, "sig")
        .sortWithinPartitions("sig", "node")
        .mapInArrow(_leaders, "leader bigint, node bigint")
        .distinct(),
        "neighbours",
    )
    near = near.unionByName(near.select("leader", F.col("leader").alias("node")).distinct())
    leaders = near.groupBy("node").agg(F.collect_list("leader").alias("leaders"))
    chosen = cut_lineage(
        nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).join(leaders, "node"),
        "set-owners",
    )
    owners = chosen.select(F.col("doc_id").alias("_owner")).distinct()
    texts = _join_checked(source, owners, F.col("doc_id").eqNullSafe(F.col("_owner")), "left_semi")
    sets = (
        texts.mapInArrow(_sets(sim), "node bigint, features binary")
        .join(chosen.select("node", "copies", "leaders"), "node")
        .dropDuplicates(["node"])
    )
    # Only leaders with more than a block of members are joined, so the members of a large one do not meet.
    blocks = cut_lineage(
        near.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n")).filter("n > 1"), "large-leaders"
    )
    rows = (
        _join_checked(near, blocks, "leader", "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .join(sets, "node")
        .withColumn("earlier", F.filter("leaders", lambda x: x < F.col("leader")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node",
                "features", "copies", "earlier")
    )
    return (
        rows.repartition(4 * partitions, "leader", "i", "j")
        .sortWithinPartitions("leader", "i", "j")
        .mapInArrow(_compare(sim.percent), "a bigint, b bigint, documents bigint")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes; a label names a component.

    Every round each node joins its smallest neighbour and the links are
    redrawn between what remains. Set keys are random, so the rounds are few.
    """
    links = cut_lineage(links, "links")
    labels = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut_lineage(
            ends.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("up")), "parents"
        )
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("up").alias("label"))
        else:
            labels = labels.join(parent, F.col("label") == F.col("a"), "left").select(
                "node", F.coalesce("up", "label").alias("label")
            )
        labels = cut_lineage(labels, "labels")
        links = cut_lineage(
            links.join(parent, "a").select(F.col("up").alias("a2"), "b")
            .join(parent.select(F.col("a").alias("b"), F.col("up").alias("b2")), "b")
            .filter("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .distinct(),
            "links",
        )
    return labels


def ngram_jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links, kept.

    Words are split at ASCII white space after A-Z became lower case. A text
    with fewer than ``n`` words is one run; one without words, or null, has an
    empty set, links with nothing and is its own component. ``component_id`` is
    the smallest id among the component's documents (null ids are passed over);
    ``n_links`` counts the other rows a row links with, copies included;
    ``kept`` marks the rows of the component's id, every row with an empty set
    and those of components without any id. Equal sets are one node throughout,
    so groups of copies cost one member.
    """
    sim = Similarity(n, percent)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    nodes = cut_lineage(source.mapInArrow(_describe(sim), "doc_id bigint, n_shingles bigint, node bigint"), "nodes")
    found = cut_lineage(compared_sets(source, nodes, sim), "compared")
    pairs = found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = components(pairs)
    linked = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("documents").alias("linked"))
    sets = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = sets.join(linked, "node", "left")
    if labels is None:
        sets = sets.withColumn("label", F.col("node"))
    else:
        sets = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sets = sets.select("node", "label", "least", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    first = sets.groupBy("label").agg(F.min("least").alias("first_id"))
    placed = nodes.join(sets.join(first, "label").select("node", "first_id", "n_links"), "node", "left")
    whole = F.coalesce(F.col("first_id"), F.col("doc_id"))
    return placed.select(
        "doc_id", "n_shingles", whole.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce(F.col("doc_id") == whole, whole.isNull()).alias("kept"),
    )
