"""Token counts under a unigram model, by dynamic programming on a trie.

The distinct pre-tokens of a group of texts go into a trie, level by level. The
best segmentation of a prefix depends on the prefix alone, so its forward score
and token count are computed once per trie node, for all words that share it;
a word's terminal node holds its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.words import in_groups, mix, powers

SPACE = "▁"
#: Words whose counts a worker keeps between groups of texts.
KNOWN_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Unigram:
    """Pieces with scores; a character no piece covers costs one token per UTF-8 byte.

    ``pieces`` maps a piece to its log probability.
    """

    def __init__(self, pieces: dict[str, float]) -> None:
        self.longest = max(map(len, pieces))
        self.unknown = min(pieces.values()) - 10.0
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.array(list(pieces.values()))[order]
        if (np.diff(self.hashes) == 0).any():
            raise ValueError("two pieces have one hash")

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        """The ordinary pieces of a sentencepiece model, with Zipf's law over their ranks as scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls({model.id_to_piece(i): -float(np.log(rank + 10.0)) for rank, i in enumerate(ids)})

    @staticmethod
    def _codes(raw: np.ndarray) -> np.ndarray:
        return mix(raw.astype(np.uint64) + np.uint64(1))

    def _hash(self, piece: str) -> int:
        h = 0
        for c in self._codes(np.array([ord(ch) for ch in piece])).tolist():
            h = (h * int(_P) + c) % 2**64
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Scores of the pieces with these hashes, minus infinity for none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.scores[at], -np.inf)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of the best segmentation of each word (ties: fewer tokens)."""
        result = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(sizes) - sizes
        active = np.argsort(-sizes, kind="stable")  # the longest first: a level keeps a front part
        ends = sizes[active]
        node = np.zeros(len(words), np.int64)  # of each active word, in its level
        prefix = [np.zeros(1, np.uint64)]
        best, tokens, parents = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        powers_of = powers(self.longest + 1, _P)
        depth = 0
        while True:
            still = int(np.searchsorted(-ends, -depth, side="left"))  # words longer than depth
            if still < len(active):
                result[active[still:]] = tokens[-1][node[still:]]
            active, ends, node = active[:still], ends[:still], node[:still]
            if not still:
                return result
            symbol = raw[starts[active] + depth].astype(np.int64)
            keys, node = np.unique(node << 21 | symbol, return_inverse=True)
            up, char = keys >> 21, keys & ((1 << 21) - 1)
            here = prefix[-1][up] * _P + self._codes(char)
            bytes_of = np.where(char < 0x80, 1, np.where(char < 0x800, 2, np.where(char < 0x10000, 3, 4)))
            value, count = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
            back = up
            for size in range(1, min(self.longest, depth + 1) + 1):
                score = self.find(here - prefix[-size][back] * powers_of[size])
                cost = np.ones(len(keys), np.int64)
                if size == 1:
                    lone = np.isinf(score)
                    score = np.where(lone, self.unknown * bytes_of, score)
                    cost = np.where(lone, bytes_of, 1)
                total, n = best[-size][back] + score, tokens[-size][back] + cost
                better = (total > value) | ((total == value) & np.isfinite(total) & (n < count))
                value, count = np.where(better, total, value), np.where(better, n, count)
                if size < len(parents):
                    back = parents[-size][back]
            for kept, new in ((prefix, here), (best, value), (tokens, count), (parents, up)):
                kept.append(new)
                if len(kept) > self.longest + 1:
                    kept.pop(0)
            depth += 1


def token_counts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every row; a null or blank text has none of both.

    Pre-tokens are the words between ASCII white space, each led by the space
    mark. Repeated rows are counted row by row; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Unigram.from_model(model_path), {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_groups(texts, 2_000_000):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
                sizes = np.array([len(w) for w in words])
                flat = list(chain.from_iterable(words))
                counts = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
                missing = np.flatnonzero(counts < 0)
                if len(missing):
                    new = list({flat[k] for k in missing.tolist()})
                    known.update(zip(new, model.counts([SPACE + w.decode("utf-8", "surrogatepass") for w in new]).tolist()))
                    counts[missing] = np.fromiter((known[flat[k]] for k in missing.tolist()), np.int64, len(missing))
                total = np.bincount(np.repeat(np.arange(b - a), sizes), weights=counts, minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(total)],
                    names=["doc_id", "n_words", "n_tokens"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
