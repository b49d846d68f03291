"""Packing documents into sequences of a fixed number of tokens.

Each task tokenizes its rows and packs as it goes, in bounded space: it holds
``OPEN`` windows, puts a piece where it fits best, and emits the fullest window
when it fits nowhere. What is still open at the end of a task is merged with the
leftovers of other tasks in a tree, ``FAN_IN`` nodes at a time.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.session import cut_lineage

WINDOW = 4096
OPEN = 48
FAN_IN = 16
END_ID = 2
#: Texts are tokenized in groups of so many characters at most (or one text).
CHUNK_CHARS = 2_000_000
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "window bigint, offset bigint, is_open boolean"
)
#: The tokenizer's own white space; Python's split() also takes these four separators.
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Beyond ASCII, characters that may be split here: Latin, Greek, Cyrillic, quotes and dashes.
_USUAL = [*range(0xA1, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028), 0x20AC]
#: Words kept between groups of texts; beyond it those seen least are dropped.
KNOWN_WORDS = 250_000
#: Parts of words kept; beyond it their memory starts anew.
KNOWN_PARTS = 250_000


class WordTokenizer:
    """Token ids of texts, computed once per distinct word.

    For a tokenizer that lower-cases and drops white space, so that words are
    independent of each other. Words of printable ASCII and usual characters
    without an added token are split here by the tokenizer's own rule; all others
    go through all of it.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.whole = whole
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        if any(not c or re.search(r"\s", c) for c in added):
            raise ValueError("an added token goes across the borders of words")
        # Finds more than the tokenizer does, whatever the case; it decides.
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        # A sign that all added tokens hold, if there is one.
        shared = set.intersection(*map(set, added)) if added else set()
        self.sign = min((c for c in shared if c.isascii() and not c.isalnum()), default="")
        # The model alone, for parts of words that are split and in small letters.
        self.model = Tokenizer(whole.model)
        self._learn_characters()
        self._forget_parts()
        # Word k has entry k + 1; entry 0 ends a text.
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes, self.seen = np.array([END_ID], np.uint32), np.ones(1, np.int64), np.zeros(1, np.int64)

    def _learn_characters(self) -> None:
        """Bytes and kind of every usual character, as the tokenizer has them.

        Left out are marks, which combine with others, digits, and what is not one
        character in small letters or not always the same (sigma).
        """
        normal, split = self.whole.normalizer.normalize_str, self.whole.pre_tokenizer.pre_tokenize_str
        self.bytes: dict[int, str] = {}
        usual, letters = "", ""
        for c in map(chr, _USUAL):
            low = normal(c)
            if len(low) != 1 or low != c.lower() or c == "\u03a3" or unicodedata.category(c)[0] in "MC":
                continue
            is_letter = len(split("a" + low)) == 1
            if is_letter or len(split("!" + low)) == 1:
                usual += re.escape(c)
                letters += re.escape(low) if is_letter else ""
                self.bytes[ord(low)] = split(low)[0][0]
        self.usual = re.compile(f"[!-~{usual}]+")
        # The tokenizer's rule for the parts of a word, in small letters; a line holds a word.
        self.parts = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-z{letters}]+|[0-9]|[^\sa-z0-9{letters}]+|\n")

    def _forget_parts(self) -> None:
        self.known_parts = {"\n": 0}
        self.part_ids, self.part_sizes = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the half of the words seen most, and halve their counts."""
        kept = np.argsort(-self.seen[1:], kind="stable")[: KNOWN_WORDS // 2] + 1
        kept = np.sort(kept[self.seen[kept] > 1])
        self.known = self.known.take(pa.array(kept - 1))
        kept = np.concatenate([[0], kept])
        self.ids = _gather(self.ids, self.sizes, kept)
        self.sizes, self.seen = self.sizes[kept], self.seen[kept] // 2

    def _learn_parts(self, parts: list[str]) -> None:
        known = self.known_parts
        got = self.model.encode(
            [p if p.isascii() else p.translate(self.bytes) for p in parts], is_pretokenized=True, add_special_tokens=False
        )
        sizes = np.bincount(np.array(got.word_ids, np.int64), minlength=len(parts))
        self.part_ids = np.concatenate([self.part_ids, np.array(got.ids, np.uint32)])
        self.part_sizes = np.concatenate([self.part_sizes, sizes])
        known.update(zip(parts, range(len(known), len(known) + len(parts))))

    def _learn(self, words: pa.Array) -> None:
        usual, sign, added = self.usual.fullmatch, self.sign, self.added.search
        here, whole = [], {}
        for k, w in enumerate(words.to_numpy(zero_copy_only=False).tolist()):
            if usual(w) and not (sign in w and added(w)):
                here.append(w)
            else:
                here.append("")
                whole[k] = self.whole.encode(w, add_special_tokens=False).ids
        if len(self.known_parts) > KNOWN_PARTS:
            self._forget_parts()
        found = self.parts.findall("\n".join(here).lower())
        new = [p for p in dict.fromkeys(found) if p not in self.known_parts]
        if new:
            self._learn_parts(new)
        codes = np.fromiter(map(self.known_parts.__getitem__, found), np.int64, len(found))
        line = np.cumsum(codes == 0)
        sizes = np.bincount(line, self.part_sizes[codes], len(here)).astype(np.int64)
        ids = _gather(self.part_ids, self.part_sizes, codes)
        if whole:
            at = np.repeat(np.cumsum(sizes)[list(whole)], [len(w) for w in whole.values()])
            ids = np.insert(ids, at, np.array(list(chain.from_iterable(whole.values())), np.uint32))
            sizes[list(whole)] = [len(w) for w in whole.values()]
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.known = pa.concat_arrays([self.known, words])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each followed by ``END_ID``, and the texts' bounds in them."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        if any(map(_ODD.search, texts)):
            words = pa.array(map(_WHITE.split, texts), pa.large_list(pa.large_string()))
        else:
            words = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        counts = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        flat = words.flatten().dictionary_encode()
        codes = pc.index_in(flat.dictionary, self.known).fill_null(-1).to_numpy() + 1
        new = np.flatnonzero(codes == 0)
        if len(new):
            codes[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self._learn(flat.dictionary.take(pa.array(new)))
        full = np.zeros(bounds[-1], np.int64)
        inner = np.ones(bounds[-1], bool)
        inner[bounds[1:] - 1] = False
        full[inner] = codes[flat.indices.to_numpy()]
        seen = np.bincount(full, minlength=len(self.sizes))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        ends = np.cumsum(self.sizes[full])
        return _gather(self.ids, self.sizes, full), np.concatenate([[0], ends])[bounds]


def _gather(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The values of the runs ``codes``, on end; run k has ``sizes[k]`` values."""
    n = sizes[codes]
    ends = np.cumsum(n)
    first = (np.cumsum(sizes) - sizes)[codes] - (ends - n)
    return values[np.repeat(first, n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(maxsize=1)
def _tokenizer_of(path: str, size: int, changed: int) -> WordTokenizer:
    return WordTokenizer(path)


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, read once per Python worker, so that its words serve all of the worker's tasks."""
    about = os.stat(path)
    return _tokenizer_of(path, about.st_size, about.st_mtime_ns)


class OpenWindows:
    """At most ``room`` open windows; ``place`` returns (window, offset)."""

    def __init__(self, first: int, room: int = OPEN, size: int = WINDOW) -> None:
        self.next, self.room, self.size = first, room, size
        self.free: list[tuple[int, int]] = []  # (free tokens, window), sorted

    def place(self, length: int) -> tuple[int, int]:
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) >= self.room and length < self.size:
                self.free.pop(0)  # the fullest is emitted
            free, window, self.next = self.size, self.next, self.next + 1
        if free > length:
            insort(self.free, (free - length, window))
        return window, self.size - free


def _groups(docs: list, texts: list) -> Iterator[tuple[list, list]]:
    ids, group, size = [], [], 0
    for doc, text in zip(docs, texts):
        if group and size + len(text or "") > CHUNK_CHARS:
            yield ids, group
            ids, group, size = [], [], 0
        ids.append(doc)
        group.append(text or "")
        size += len(text or "")
    if group:
        yield ids, group


def _pack(path: str, window_size: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        windows = OpenWindows(TaskContext.get().partitionId() << 40, room, window_size)
        held: list[tuple] = []  # pieces of windows that were open when last looked at
        schema = pa.schema(
            [(n, pa.bool_() if n == "is_open" else pa.int64()) for n in
             ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "is_open")]
        )

        def emit(rows):
            columns = list(zip(*rows)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for docs, texts in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, bounds = tokenizer.encode(texts)
                raw = ids.astype("<u4")
                for k, doc in enumerate(docs):
                    total = int(bounds[k + 1] - bounds[k])
                    for start in range(0, total, window_size):
                        length = min(window_size, total - start)
                        at = bounds[k] + start
                        crc = zlib.crc32(raw[at : at + length].tobytes())
                        held.append((doc, start, length, crc, total, *windows.place(length)))
                still = {w for _, w in windows.free}
                done = [(*p, False) for p in held if p[5] not in still]
                held = [p for p in held if p[5] in still]
                if done:
                    yield emit(done)
        if held:
            yield emit([(*p, True) for p in held])

    return run


def _merge_node(window_size: int, room: int, last: bool):
    """Pack the open windows of one node: the fullest first, each where it fits best."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames) or [pd.DataFrame(columns=["node", "leaf", "window", "shift", "used"])])
        out = []
        for node, part in rows.groupby("node"):
            whole = part.drop_duplicates("window").sort_values(["used", "window"], ascending=[False, True])
            free: list[tuple[int, int]] = []
            target: dict[int, tuple[int, int]] = {}
            for window, used in zip(whole["window"].tolist(), whole["used"].tolist()):
                at = bisect_left(free, (used, -1))
                room_left, into = free.pop(at) if at < len(free) else (window_size, window)
                target[window] = (into, window_size - room_left)
                if room_left > used:
                    insort(free, (room_left - used, into))
            go_on = set() if last else {w for _, w in free[-room:]}
            used_of = {w: window_size - f for f, w in free}
            part = part.assign(
                shift=[s + target[w][1] for w, s in zip(part["window"], part["shift"])],
                window=[target[w][0] for w in part["window"]],
            )
            part["used"] = [used_of.get(w, window_size) for w in part["window"]]
            part["is_open"] = [w in go_on for w in part["window"]]
            out.append(part)
        if out:
            yield pd.concat(out)[["node", "leaf", "window", "shift", "used", "is_open"]]

    return run


def merge_leftovers(leftovers: DataFrame, tasks: int, window_size: int = WINDOW, room: int = OPEN) -> DataFrame:
    """(leaf, window, shift): where each window that stayed open in a task goes.

    ``leftovers`` has node (the task), leaf and used. A node of the tree holds
    ``FAN_IN * room`` windows at most.
    """
    schema = "node bigint, leaf bigint, window bigint, shift bigint, used bigint, is_open boolean"
    rest = leftovers.select(
        "node", "leaf", F.col("leaf").alias("window"), F.lit(0).cast("bigint").alias("shift"), "used"
    )
    done = None
    while True:
        tasks = -(-tasks // FAN_IN)
        merged = cut_lineage(
            rest.withColumn("node", F.expr(f"node DIV {FAN_IN}"))
            .repartition(max(1, min(tasks, int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "node")
            .mapInPandas(_merge_node(window_size, room, tasks <= 1), schema),
            "merged-windows",
        )
        closed = merged.filter(~F.col("is_open")).select("leaf", "window", "shift")
        done = closed if done is None else done.unionByName(closed)
        if tasks <= 1:
            return done
        rest = merged.filter("is_open").drop("is_open")


def pack_documents(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window_size: int = WINDOW, room: int = OPEN
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids end with ``END_ID``; a null or empty text is that id alone.
    Documents longer than a window are cut into full windows and a rest. Repeated
    rows and null ids are packed like any other row. The placed pieces are
    written once, so a retried task cannot place a document twice.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    placed = cut_lineage(source.mapInArrow(_pack(tokenizer, window_size, room), PIECES), "pieces")
    node = F.shiftright("window", 40)
    still = placed.filter("is_open")
    tasks = (still.agg(F.max(node)).first()[0] or 0) + 1  # one number
    leftovers = still.groupBy(node.alias("node"), F.col("window").alias("leaf")).agg(
        F.max(F.col("offset") + F.col("length")).alias("used")
    )
    moves = merge_leftovers(leftovers, tasks, window_size, room).withColumnRenamed("window", "into")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    moved = still.join(moves, F.col("window") == F.col("leaf")).select(
        *columns, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset")
    )
    return placed.filter("NOT is_open").select(*columns, F.col("window").alias("sequence_id"), "offset").unionByName(moved)
