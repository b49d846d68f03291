"""Scoring texts by a hashed maximum-entropy model that all training texts have shaped.

Texts are read once and stored as chunks: the distinct words of some texts
(hashes) and the place of every token's word among them. Words are counted in
shards of the hash space. The model (``maxent``) is trained by distributed
gradient updates: in each round every task adds up, over its share of the
training texts, how often each hashed weight was used and how often the model
expected that; the sums are added in ranges of rows and one step is taken. At
last every chunk asks the shards for the counts of its words and its texts are
scored in batches. No step holds the vocabulary in one place, and what goes to
the driver is as large as the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframe.llm.maxent import BITS, CELLS, HEAD, WAYS, MaxEnt, bias_of, tail_cell
from nightframe.llm.words import hashed_words, mix
from nightframe.session import cut_lineage

#: Characters of the texts of a chunk; a longer text is a chunk of its own.
CHUNK_CHARS = 1_000_000
#: Words that a task holds before it merges them, and of a shard at most (expected).
HELD_WORDS, SHARD_WORDS = 1_000_000, 1_000_000
LEAST_SHARDS = 16
#: Rounds of training; every training text takes part in one.
ROUNDS = 3
#: Tokens that one task of a round goes through.
TASK_TOKENS = 4_000_000
#: Ranges of rows in which gradients are added up.
RANGES = 16
#: The hash of the end of a text.
END = np.uint64(0xE2D0F7A9B3C81645)

def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes: what they have in common, mostly zeros, lies together and shrinks when written."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def packed_words(words: np.ndarray) -> bytes:
    """Sorted hashes as their differences."""
    return packed(np.diff(words, prepend=np.zeros(1, np.uint64)))


def unpacked_words(data: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[list]:
    """The rows of a batch; binary values are views of it, so that no batch is copied as a whole."""
    binary = [pa.types.is_binary(f.type) for f in batch.schema]
    for k in range(batch.num_rows):
        yield [(c[k].as_buffer() if c[k].is_valid else None) if b else c[k].as_py() for c, b in zip(batch.columns, binary)]


CHUNK = "doc_ids array<bigint>, held array<boolean>, sizes binary, words binary, at binary, tokens bigint"
VOCABULARY = "shard bigint, words binary, counts binary, n_tokens bigint, n_types bigint"
_FOUND = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 7 (a null id: learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, text) to ``CHUNK``."""

    def chunk(ids, held, texts):
        owner, words = hashed_words(texts)
        sizes = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
        words = np.insert(words.astype(np.uint64), np.cumsum(sizes), END)
        distinct, at = np.unique(words, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
             pa.array([(sizes + 1).astype("<i8").tobytes()], pa.binary()), pa.array([packed_words(distinct)], pa.binary()),
             pa.array([at.astype("<u2" if len(distinct) <= 1 << 16 else "<u4").tobytes()], pa.binary()), pa.array([len(at)], pa.int64())],
            names=["doc_ids", "held", "sizes", "words", "at", "tokens"])

    ids, held, texts, chars = [], [], [], 0
    for batch in batches:
        for i, h, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if ids and chars + len(t or "") > CHUNK_CHARS:
                yield chunk(ids, held, texts)
                ids, held, texts, chars = [], [], [], 0
            ids.append(i)
            held.append(h)
            texts.append(t)
            chars += len(t or "") + 1
    if ids:
        yield chunk(ids, held, texts)


def tokenised(docs: DataFrame) -> DataFrame:
    """The chunks of (doc_id, text) rows, stored."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    return cut_lineage(rows.mapInArrow(_tokenised, CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")


@dataclass
class Chunk:
    """The token streams of some texts."""

    sizes: np.ndarray
    words: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, sizes: pa.Buffer, words: pa.Buffer, at: pa.Buffer) -> Chunk:
        words = unpacked_words(words)
        # places are stored in two bytes where they fit
        return cls(np.frombuffer(sizes, "<i8"), words, np.frombuffer(at, "<u2" if len(words) <= 1 << 16 else "<u4"))

    @property
    def first(self) -> np.ndarray:
        """Place of every token in its text."""
        return np.arange(len(self.at)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def learned(self, held: list[bool]) -> np.ndarray:
        """Which tokens are of training texts."""
        return np.repeat(~np.array(held, bool), self.sizes)

    def in_round(self, ids: list[int | None], k: int, rounds: int) -> np.ndarray:
        """Which tokens are of the texts of a round: chosen by id, so that no layout of the table matters."""
        known = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
        return np.repeat(mix(known + np.uint64(1)) % np.uint64(rounds) == k, self.sizes)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words = np.concatenate([np.empty(0, np.uint64), *[w for w, _ in parts]])
    counts = np.concatenate([np.empty(0, np.int64), *[c for _, c in parts]])
    if not len(words):
        return words, counts
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    return words[starts], np.add.reduceat(counts, starts)


class _Counts:
    """Counts of words, merged whenever enough have come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, words: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((words, counts))
        self.held += len(words)
        if self.held > 2 * max(HELD_WORDS, len(self.parts[0][0])):
            self.parts = [_summed(self.parts)]
            self.held = len(self.parts[0][0])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(self.parts)


def _by_shard(words: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """(shard, place) of sorted words; a shard has the words with the same first bits."""
    edges = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Counts of the training words, one row per shard, stored."""
    distinct = chunks.agg(F.sum(F.length("words"))).first()[0] or 0
    bits = max(math.ceil(math.log2(max(distinct / 8 / SHARD_WORDS, LEAST_SHARDS))), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for held, *rest in _rows(batch):
                chunk = Chunk.of(*rest)
                n = np.bincount(chunk.at[chunk.learned(held)], minlength=len(chunk.words))
                counts.add(chunk.words[n > 0], n[n > 0])
        words, n = counts.result()
        for shard, part in _by_shard(words, bits):
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([packed_words(words[part])]), pa.array([packed(n[part].astype("<i8"))])],
                names=["shard", "words", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            words, n = counts.result()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([packed_words(words)]), pa.array([packed(n.astype("<i8"))]),
                 pa.array([n.sum()], pa.int64()), pa.array([len(n)], pa.int64())],
                names=["shard", "words", "counts", "n_tokens", "n_types"])

        shard, counts = None, _Counts()
        for batch in batches:
            for k, words, n in _rows(batch):
                if shard is not None and k != shard:
                    yield done()
                    counts = _Counts()
                shard = k
                counts.add(unpacked_words(words), unpacked(n))
        if shard is not None:
            yield done()

    partial = chunks.select("held", "sizes", "words", "at").mapInArrow(count, "shard bigint, words binary, counts binary")
    dealt = partial.repartition(1 << bits, "shard").sortWithinPartitions("shard")
    return cut_lineage(dealt.mapInArrow(merge, VOCABULARY).withColumn("bits", F.lit(bits)), "vocabulary")


@dataclass
class Trained:
    """The model with what its cells hold."""

    model: MaxEnt
    head: np.ndarray  # sorted hashes of the words with cells of their own
    head_cells: np.ndarray
    cell_tokens: np.ndarray
    unseen: float  # share of the shared cells' probability that new words have
    tokens: int
    types: int

    def cells(self, words: np.ndarray) -> np.ndarray:
        out = tail_cell(words)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
            own = self.head[at] == words
            out[own] = self.head_cells[at[own]]
        return out

    def score(self, chunk: Chunk, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, log10 probability) of each text of a chunk.

        A known word of a shared cell has its share of the cell's training
        tokens; all words that training did not see are one event, with the
        share ``unseen`` of what the shared cells have together.
        """
        cells = self.cells(chunk.words)
        inside = np.zeros(len(cells))
        tail = (cells >= HEAD) & (counts > 0)
        inside[tail] = np.log10((1 - self.unseen) * counts[tail] / self.cell_tokens[cells[tail]])
        path, shared = self.model.log10_paths(chunk.words[chunk.at], chunk.first, cells[chunk.at])
        known = (counts > 0)[chunk.at]
        each = np.where(known, path + inside[chunk.at], shared + math.log10(self.unseen))
        starts = np.cumsum(chunk.sizes) - chunk.sizes
        base = np.log10(counts + 1.0)[chunk.at]
        return (
            np.add.reduceat(known.astype(np.int64), starts),
            np.add.reduceat(base, starts) - chunk.sizes * math.log10(self.tokens + self.types + 1),
            np.add.reduceat(each, starts),
        )


def _cells_of(chosen: Trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, once = np.zeros(CELLS), np.zeros(CELLS)
        for batch in batches:
            for words, n in _rows(batch):
                cells, counts = chosen.cells(unpacked_words(words)), unpacked(n)
                tokens += np.bincount(cells, weights=counts, minlength=CELLS)
                once += np.bincount(cells, weights=counts == 1, minlength=CELLS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CELLS)), pa.array(tokens), pa.array(once)], names=["cell", "tokens", "once"])

    return run


def _most_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, n in _rows(batch):
            words, n = unpacked_words(words), unpacked(n)
            best = np.lexsort((words, -n))[:HEAD]
            yield pa.RecordBatch.from_arrays([pa.array(words[best].view(np.int64)), pa.array(n[best])], names=["word", "n"])


def _gradients(batches: Iterator[pa.RecordBatch], trained: Trained, k: int, rounds: int) -> Iterator[pa.RecordBatch]:
    observed = np.zeros(trained.model.weights.shape, np.float32)
    expected = np.zeros_like(observed)
    for batch in batches:
        for ids, held, *rest in _rows(batch):
            chunk = Chunk.of(*rest)
            use = np.flatnonzero(chunk.learned(held) & chunk.in_round(ids, k, rounds))
            words, cells = chunk.words[chunk.at], trained.cells(chunk.words)[chunk.at]
            trained.model.add_gradient(words[use], chunk.first[use], cells[use], observed, expected)
    for k, (o, e) in enumerate(zip(np.array_split(observed, RANGES), np.array_split(expected, RANGES))):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([o.tobytes() + e.tobytes()], pa.binary())], names=["part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}  # a few ranges of rows
    for batch in batches:
        for k, x in _rows(batch):
            x = np.frombuffer(x, "<f4").astype(np.float64)
            sums[k] = sums[k] + x if k in sums else x
    for k, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["part", "sums"])


def train(chunks: DataFrame, words: DataFrame, bits: int = BITS, rounds: int = ROUNDS) -> Trained:
    """The model of all training texts of ``chunks``; ``words`` is their vocabulary."""
    spark = chunks.sparkSession
    tokens, types = words.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    tokens, types = tokens or 0, types or 0
    most = words.select("words", "counts").mapInArrow(_most_frequent, "word bigint, n bigint")
    own = np.array([r["word"] for r in most.orderBy(F.desc("n"), "word").limit(HEAD).collect()], np.int64).view(np.uint64)
    order = np.argsort(own)
    trained = Trained(MaxEnt(np.empty(0), np.empty(0)), own[order], order, np.zeros(CELLS), 1.0, tokens, types)
    sums = words.select("words", "counts").mapInArrow(_cells_of(trained), "cell bigint, tokens double, once double")
    mass, once = np.zeros(CELLS), np.zeros(CELLS)
    for r in sums.groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.sum("once").alias("once")).collect():  # one row per cell
        mass[r["cell"]], once[r["cell"]] = r["tokens"], r["once"]
    trained.cell_tokens = mass.copy()
    shared = mass[HEAD:].sum()
    trained.unseen = (once[HEAD:].sum() + 1) / (shared + 2) if shared else 1.0
    mass[HEAD:] += (1 + 0.0005 * tokens) / (CELLS - HEAD)  # new words come in every cell
    trained.model = MaxEnt(bias_of(mass), np.zeros((1 << bits, WAYS), np.float32))
    for k in range(rounds):
        now = spark.sparkContext.broadcast(trained)
        tasks = max(math.ceil(tokens / rounds / TASK_TOKENS), spark.sparkContext.defaultParallelism)
        gradient = chunks.select("doc_ids", "held", "sizes", "words", "at").coalesce(tasks).mapInArrow(
            lambda batches, now=now, k=k: _gradients(batches, now.value, k, rounds), "part bigint, sums binary"
        )
        total = gradient.repartition(RANGES, "part").mapInArrow(_added, "part bigint, sums binary")
        parts = {r["part"]: np.frombuffer(r["sums"], "<f4").reshape(2, -1, WAYS) for r in total.collect()}  # as large as the model
        if parts:
            observed, expected = (np.concatenate([parts[p][side] for p in sorted(parts)]) for side in (0, 1))
            trained.model = trained.model.stepped(observed, expected)
        now.unpersist()
    return trained


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's words come first, then the chunks' requests: (chunk, shard, counts of the words asked for)."""
    shard, words, counts = None, np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        for k, kind, chunk, w, c in _rows(batch):
            w = unpacked_words(w)
            if k != shard:
                shard, words, counts = k, np.empty(0, np.uint64), np.empty(0, np.int64)
            if kind == 0:
                words, counts = w, unpacked(c)
                continue
            found = np.zeros(len(w), np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                found = np.where(words[at] == w, counts[at], 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([k], pa.int64()), pa.array([packed(found.astype("<i8"))], pa.binary())],
                names=["chunk", "shard", "counts"])


def _requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in _rows(batch):
                words = unpacked_words(words)
                parts = _by_shard(words, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in parts], pa.int64()), pa.array([1] * len(parts), pa.int32()),
                     pa.array([chunk] * len(parts), pa.int64()), pa.array([packed_words(words[p]) for _, p in parts], pa.binary()),
                     pa.array([None] * len(parts), pa.binary())], schema=_FOUND)

    return run


def score(chunks: DataFrame, words: DataFrame, trained: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text of the chunks."""
    schema = "shard bigint, kind int, chunk bigint, words binary, counts binary"
    first = words.select("bits").first()
    bits = first["bits"] if first else int(math.log2(LEAST_SHARDS))
    asked = chunks.select("chunk", "words").mapInArrow(_requests(bits), schema)
    known = words.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("chunk"), "words", "counts")
    dealt = known.unionByName(asked).repartition(1 << bits, "shard").sortWithinPartitions("shard", "kind")
    answers = dealt.mapInArrow(_answers, "chunk bigint, shard bigint, counts binary")
    now = chunks.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, counts = None, []
        for batch in batches:
            for k, kind, _, found, ids, held, *rest in _rows(batch):
                if k != chunk:
                    chunk, counts = k, []
                if kind == 0:
                    counts.append(unpacked(found))
                    continue
                texts = Chunk.of(*rest)
                n_known, base, total = now.value.score(texts, np.concatenate(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(texts.sizes), pa.array(n_known),
                     pa.array(np.full(len(ids), now.value.tokens)), pa.array(base), pa.array(total)], schema=_SCORED)

    none = {"doc_ids": "array<bigint>", "held": "array<boolean>", "sizes": "binary", "words": "binary", "at": "binary"}
    both = answers.select("chunk", F.lit(0).alias("kind"), "shard", "counts", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).unionByName(
        chunks.select("chunk", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("shard"), F.lit(None).cast("binary").alias("counts"), *none)
    )
    return both.repartition("chunk").sortWithinPartitions("chunk", "kind", "shard").mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``score`` is the model's log10 probability of the text and its end, and
    ``base_score`` that of add-one counts; in both, all words that training did
    not see are one event. A null text is empty: its end is its only token. A
    row with a null id is learned from. Repeated rows count each; an empty
    table gives no rows. Without training texts every word is unseen. Other
    columns are not read.
    """
    chunks = tokenised(docs)
    words = vocabulary(chunks)
    return score(chunks, words, train(chunks, words))
