"""Encoding with a merge-type piece vocabulary and seeded merge-dropout, and lossless decoding.

Symbols merge in the order of the pieces' ranks, leftmost first. With dropout a
candidate merge is skipped when a keyed hash of (seed, document, the unit's place
in it, the merge's three borders) falls below the rate. The choice depends on the
key alone, so a lost task gives the same ids again, and every occurrence of a unit
has its own. All new units of a group of texts are merged at once without dropout,
one merge per unit and round, and remembered with their merges. An occurrence that
skips none of these comes out the same; the others are merged one by one anew.
Units longer than ``LONG`` have an agenda each, a heap of candidate merges, so
their time does not grow with the square of their length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.words import in_groups, mix

SPACE = "▁"
#: Stands for a space mark in the text itself while it is merged (no text holds it); spelled in bytes.
LITERAL = "\udcff"
#: Units a worker remembers; beyond it the memory starts anew.
KNOWN_UNITS = 400_000
#: A unit: spaces and what follows them, or a line end. No piece goes across its borders.
UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Characters of a unit from which on it has an agenda of its own.
LONG = 200
_NONE = np.int64(1) << 40
_WRAP = (1 << 64) - 1


def _borders(begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (begin << 42 | middle << 21 | end).astype(np.uint64)


def _dropped(keys: np.ndarray, borders: np.ndarray, rate: float) -> np.ndarray:
    """Whether dropout skips the merges with these borders."""
    return (mix(keys + borders) >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


def _one_dropped(key: int, begin: int, middle: int, end: int, rate: float) -> bool:
    """:func:`_dropped` of one merge, without arrays."""
    x = (key + (begin << 42 | middle << 21 | end)) & _WRAP
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _WRAP
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _WRAP
    return (x ^ x >> 31) >> 11 < rate * 2.0**53


def _slices(sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some slices of a table, and where each slice ends among them."""
    n = sizes[codes]
    ends = np.cumsum(n)
    first = (np.cumsum(sizes) - sizes)[codes] - (ends - n)
    return np.repeat(first, n) + np.arange(ends[-1] if len(ends) else 0), ends


class PieceCodec:
    """Pieces, byte pieces and merges of a sentencepiece model of the merge type."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        pieces: dict[str, int] = {}
        raw: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                raw.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                pieces[name] = i
                raw.append(name.replace(SPACE, " ").encode())
        if any(UNIT.fullmatch(p) is None for p in pieces):
            raise ValueError("a piece goes across the borders of units")
        self._forget()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_sizes) - self.raw_sizes
        chars = {p: i for p, i in pieces.items() if len(p) == 1}
        self.char_ids = np.full(0x110000, -1, np.int32)
        for c, i in chars.items():
            self.char_ids[ord(c)] = i
        rank = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: -model.get_score(pieces[p])))}
        merges = [
            (pieces[p[:k]] << 20 | pieces[p[k:]], rank[p], i)
            for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces
        ]
        table = np.array(sorted(merges), np.int64).reshape(-1, 3)
        self.pairs, self.ranks, self.merged = table[:, 0], table[:, 1], table[:, 2]
        self.merge_of = dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))

    def _look_up(self, left, right):
        key = left.astype(np.int64) << 20 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], 0)

    def _agenda(self, symbol: list[int], rank: np.ndarray, key: int, rate: float) -> tuple[list[int], list[int], list[int]]:
        """(places, symbols, borders of the merges) of one unit; ``rank``: of each symbol with the next, dropped ones out.

        Candidates leave a heap by rank, then by place. One whose symbols have
        merged otherwise meanwhile is stale and goes.
        """
        n = len(symbol)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        open_ = np.flatnonzero(rank < _NONE)
        heap = [(r, k, k + 1, k + 2) for r, k in zip(rank[open_].tolist(), open_.tolist())]
        heapq.heapify(heap)
        borders: list[int] = []

        def consider(left, right):
            found = self.merge_of.get(symbol[left] << 20 | symbol[right]) if symbol[left] >= 0 and symbol[right] >= 0 else None
            if found and not (rate and _one_dropped(key, left, right, end[right], rate)):
                heapq.heappush(heap, (found[0], left, right, end[right]))

        while heap:
            _, left, right, stop = heapq.heappop(heap)
            if end[left] != right or end[right] != stop:  # a symbol that has gone has no end
                continue
            borders.append(left << 42 | right << 21 | stop)
            symbol[left] = self.merge_of[symbol[left] << 20 | symbol[right]][1]
            end[left], end[right] = stop, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                consider(left, after[left])
            if before[left] >= 0:
                consider(before[left], left)
        places = [k for k in range(n) if end[k] > 0]
        return places, [symbol[k] for k in places], borders

    def merge(
        self, units: list[str], keys: np.ndarray, rate: float, made: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units on end, and the units' bounds in them. ``keys``: the hash key of each unit.

        ``made`` takes (units, borders) of the merges of every round.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(units)), sizes)
        first = np.cumsum(sizes) - sizes
        begin = np.arange(len(code)) - np.repeat(first, sizes)
        end = begin + 1
        symbol = self.char_ids[np.minimum(code, 0x10FFFF)].astype(np.int64)
        where = np.arange(len(code))  # place of each symbol's first character
        done_where, done_symbol = [], []

        def candidates(i):
            """Rank and merged id of the pairs (i, i + 1), with dropped ones out."""
            rank, into = self._look_up(symbol[i], symbol[i + 1])
            if rate:
                rank = np.where(_dropped(keys[owner[i]], _borders(begin[i], end[i], end[i + 1]), rate), _NONE, rank)
            return np.where(owner[i] == owner[i + 1], rank, _NONE), into

        rank, into = np.full(len(code), _NONE), np.zeros(len(code), np.int64)
        if len(code) > 1:
            rank[:-1], into[:-1] = candidates(np.arange(len(code) - 1))
        for u in np.flatnonzero(sizes > LONG).tolist():
            part = slice(first[u], first[u] + sizes[u])
            places, symbols, borders = self._agenda(symbol[part].tolist(), rank[part], int(keys[u]), rate)
            done_where.append(np.array(places) + first[u])
            done_symbol.append(np.array(symbols))
            if made is not None:
                made.append((np.full(len(borders), u), np.array([b & _WRAP for b in borders], np.uint64)))
        if done_where:
            keep = sizes[owner] <= LONG
            symbol, owner, begin, end, where = symbol[keep], owner[keep], begin[keep], end[keep], where[keep]
            rank, into = rank[keep], into[keep]
        while len(symbol):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            runs = np.diff(np.append(starts, len(symbol)))
            over = np.repeat(best >= _NONE, runs)
            if over.any():
                done_where.append(where[over])
                done_symbol.append(symbol[over])
                keep = ~over
                symbol, owner, begin, end, where = symbol[keep], owner[keep], begin[keep], end[keep], where[keep]
                rank, into = rank[keep], into[keep]
                if not len(symbol):
                    break
                runs, best = runs[best < _NONE], best[best < _NONE]
            hit = np.flatnonzero(rank == np.repeat(best, runs))
            at = hit[np.diff(owner[hit], prepend=-1) != 0]  # the leftmost of each unit
            if made is not None:
                made.append((owner[at], _borders(begin[at], end[at], end[at + 1])))
            symbol[at], end[at] = into[at], end[at + 1]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbol, owner, begin, end, where = symbol[keep], owner[keep], begin[keep], end[keep], where[keep]
            rank, into = rank[keep], into[keep]
            touched = np.zeros(len(symbol), bool)
            touched[moved] = touched[moved[moved > 0] - 1] = True
            changed = np.flatnonzero(touched)
            last = changed == len(symbol) - 1
            rank[changed[last]] = _NONE
            changed = changed[~last]
            if len(changed):
                rank[changed], into[changed] = candidates(changed)
        where = np.concatenate(done_where) if done_where else np.empty(0, np.int64)
        symbol = np.concatenate(done_symbol) if done_symbol else np.empty(0, np.int64)
        order = np.argsort(where)
        where, symbol = where[order], symbol[order]
        unit = np.searchsorted(first, where, side="right") - 1
        lone = np.flatnonzero(symbol < 0)
        if len(lone):  # characters outside the vocabulary become their bytes
            spelled = [self.byte_ids[list((SPACE if chr(c) == LITERAL else chr(c)).encode("utf-8", "surrogatepass"))] for c in code[where[lone]].tolist()]
            sizes_of = np.ones(len(symbol), np.int64)
            sizes_of[lone] = [len(s) for s in spelled]
            at = np.cumsum(sizes_of) - sizes_of
            out = np.repeat(symbol, sizes_of)
            for k, s in zip(at[lone].tolist(), spelled):
                out[k : k + len(s)] = s
            symbol, unit = out, np.repeat(unit, sizes_of)
        return symbol, np.searchsorted(unit, np.arange(len(units) + 1))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes = array("i"), array("q")
        self.made, self.made_sizes = array("Q"), array("q")  # borders of each unit's merges

    def _learn(self, units: list[str]) -> None:
        made: list[tuple[np.ndarray, np.ndarray]] = []
        new, bounds = self.merge(units, np.zeros(len(units), np.uint64), 0.0, made)
        self.ids.frombytes(new.astype(np.int32).tobytes())
        self.sizes.frombytes(np.diff(bounds).astype(np.int64).tobytes())
        of = np.concatenate([np.empty(0, np.int64), *[m[0] for m in made]])
        borders = np.concatenate([np.empty(0, np.uint64), *[m[1] for m in made]])
        self.made.frombytes(borders[np.argsort(of, kind="stable")].tobytes())
        self.made_sizes.frombytes(np.bincount(of, minlength=len(units)).astype(np.int64).tobytes())

    def _skipping(self, codes: np.ndarray, keys: np.ndarray, rate: float) -> np.ndarray:
        """Which occurrences of known units skip one of the units' merges."""
        sizes = np.array(self.made_sizes)
        at, _ = _slices(sizes, codes)
        owner = np.repeat(np.arange(len(codes)), sizes[codes])
        hit = owner[_dropped(keys[owner], np.array(self.made)[at], rate)]
        return np.unique(hit)

    def encode(self, texts: list[str], docs: list[int], seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end and the texts' bounds in them. ``docs``: a number of each text for dropout.

        Units merged before are looked up, up to ``KNOWN_UNITS`` of them.
        """
        if len(self.sizes) > KNOWN_UNITS:
            self._forget()
        # A literal space mark is spelled in bytes, so that it does not come back as a space.
        parts = [UNIT.findall((" " + t).replace(SPACE, LITERAL).replace(" ", SPACE)) if t else [] for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        flat = list(chain.from_iterable(parts))
        codes = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            units = list(dict.fromkeys(flat[k] for k in missing))
            self.known.update(zip(units, range(len(self.sizes), len(self.sizes) + len(units))))
            self._learn(units)
            codes[missing] = [self.known[flat[k]] for k in missing]
        sizes, ids = np.array(self.sizes), np.array(self.ids)
        if rate and len(flat):
            bounds = np.cumsum(counts)
            place = np.arange(len(flat)) - np.repeat(bounds - counts, counts)
            of = mix(mix(np.array([d % 2**64 for d in docs], np.uint64)) + np.uint64(seed % 2**64))
            keys = mix(np.repeat(of, counts) + place.astype(np.uint64))
            again = self._skipping(codes, keys, rate)
            new, borders = self.merge([flat[k] for k in again.tolist()], keys[again], rate)
            codes[again] = len(sizes) + np.arange(len(again))
            sizes, ids = np.concatenate([sizes, np.diff(borders)]), np.concatenate([ids, new])
        at, ends = _slices(sizes, codes)
        return ids[at].astype(np.int64), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; the space before the first word goes."""
        n = self.raw_sizes[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return ""
        raw = self.raw[np.repeat(self.raw_at[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()
        text = raw.decode("utf-8", "surrogatepass")
        return text.removeprefix(" ")


#: Characters encoded together at most (or one text).
CHUNK_CHARS = 1_000_000


def encode_documents(
    docs: DataFrame, model_path: str, seed: int = 1, rate: float = 0.1, doc_id: str = "doc_id", text: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless (and ids) of every row.

    ``lossless`` tells whether the ids, decoded, gave the text back. Dropout goes
    by the document's id and the place in it (null ids: by the text's checksum). A
    null text is empty and has no ids. Repeated rows encode alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path)
        for batch in batches:
            docs_of, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_groups(texts, CHUNK_CHARS):
                of = [zlib.crc32(t.encode("utf-8", "surrogatepass")) if d is None else d for d, t in zip(docs_of[a:b], texts[a:b])]
                ids, bounds = codec.encode(texts[a:b], of, seed, rate)
                each = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in each], pa.int64()),
                    pa.array([codec.decode(i) == t for i, t in zip(each, texts[a:b])]),
                ]
                names = ["doc_id", "n_tokens", "ids_crc32", "lossless"]
                if keep_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in each], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, lossless boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
