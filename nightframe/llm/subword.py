"""Averaged subword embeddings with a linear softmax, trained in numpy.

A text is the mean of the learned vectors of its features: the hashed character
n-grams of each word (with word edges) and, if asked for, the word itself. A
linear softmax on the mean gives class probabilities. Since the mean is linear,
a trained model folds into one table of class scores per feature bucket, and a
word's scores are computed once per distinct word of a group of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframe.llm.words import mix, powers

CHUNK_CHARS = 2_000_000
#: Calibration rows from which a class's own deviation counts; that of fewer is mostly chance.
OWN_ROWS = 10


@dataclass(frozen=True)
class Features:
    """Which features a text has: n-gram lengths, whole words, repeats, case.

    ``repeats`` is the weight of a feature that stands for every word bigram of
    one word twice; such a bigram's own hash would not carry over to new words.
    """

    grams: tuple[int, ...] = (1, 2, 3, 4)
    whole_words: bool = False
    lower: bool = True
    bits: int = 16
    repeats: int = 0


def split_words(texts: list[str | None], lower: bool) -> list[list[str]]:
    return [((t.lower() if lower else t).split() if t else []) for t in texts]


def word_features(words: list[str], f: Features) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket): the feature buckets of each word, whole words of any length."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    code = mix(raw.astype(np.uint64) + np.uint64(1))
    owners, buckets = [], []
    shift = np.uint64(64 - f.bits)
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, max(f.grams) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in f.grams:
            inside = owner[:m] == owner[n - 1 :]
            owners.append(owner[:m][inside])
            buckets.append((mix(h[inside] + np.uint64(n)) >> shift).astype(np.int64))
    if f.whole_words:
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(raw)) - np.repeat(starts, sizes)
        whole = np.add.reduceat(code * powers(int(sizes.max()))[place], starts)
        owners.append(np.arange(len(words)))
        buckets.append((mix(whole + np.uint64(99)) >> shift).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def text_features(text: str | None, f: Features) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares (summing to 1)."""
    (words,) = split_words([text], f.lower)
    codes, distinct = pd.factorize(np.array(words, dtype=object)) if words else (np.empty(0, np.int64), [])
    owner, bucket = word_features(list(distinct), f)
    weight = np.bincount(codes, minlength=len(distinct))[owner] if len(words) else np.empty(0)
    if f.repeats and len(words):
        bucket = np.append(bucket, 0)
        weight = np.append(weight, f.repeats * (codes[1:] == codes[:-1]).sum())
    total = np.bincount(bucket, weights=weight, minlength=1) if len(bucket) else np.zeros(1)
    at = np.flatnonzero(total)
    return at, (total[at] / max(total.sum(), 1)).astype(np.float32)


@dataclass
class SubwordModel:
    """A folded model: class scores per bucket, bias, and what calibration found."""

    features: Features
    classes: list
    scores: np.ndarray  # buckets x classes
    bias: np.ndarray
    temperature: float = 1.0
    least: np.ndarray | None = None  # evidence of each class that its texts have
    report: dict = field(default_factory=dict)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Class probabilities of each text; an empty text has the bias alone."""
        return softmax((self.evidence(texts) + self.bias) / self.temperature)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Mean score of each text's features for each class, without the bias: low for all classes if they are unlike what was learned."""
        f, k = self.features, len(self.classes)
        out = np.zeros((len(texts), k))
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= CHUNK_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            words = split_words(texts[at:stop], f.lower)
            counts = np.array([len(w) for w in words])
            flat = [w for ws in words for w in ws]
            if flat:
                codes, distinct = pd.factorize(np.array(flat, dtype=object))
                owner, bucket = word_features(list(distinct), f)
                doc = np.repeat(np.arange(stop - at), counts)
                seen = np.bincount(owner, minlength=len(distinct))[codes]
                total = np.bincount(doc, weights=seen, minlength=stop - at)
                again = f.repeats * np.bincount(doc[1:][(codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])], minlength=stop - at)
                total = total + again
                for c in range(k):
                    word = np.bincount(owner, weights=self.scores[bucket, c], minlength=len(distinct))
                    out[at:stop, c] = np.bincount(doc, weights=word[codes], minlength=stop - at)
                    out[at:stop, c] = (out[at:stop, c] + again * self.scores[0, c]) / np.maximum(total, 1)
            at = stop
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def feature_rows(examples: DataFrame, f: Features) -> DataFrame:
    """(label, buckets, shares) of (label, text) rows, computed where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [text_features(t, f) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array([a.astype("<u4").tobytes() for a, _ in pairs], pa.binary()),
                 pa.array([w.tobytes() for _, w in pairs], pa.binary())], names=["label", "buckets", "shares"])

    return examples.select(F.col("label").cast("string"), "text").mapInArrow(run, "label string, buckets binary, shares binary")


def _batch(data, order):
    idx = np.concatenate([data[k][0] for k in order])
    share = np.concatenate([data[k][1] for k in order])
    sizes = np.array([len(data[k][0]) for k in order])
    return idx, share, np.repeat(np.arange(len(order)), sizes)


def least_evidence(rows: list[np.ndarray], deviations: float) -> np.ndarray:
    """For each class the evidence below which a text is not its own, given that of its calibration rows."""
    known = [x for x in rows if len(x) > 1]
    freedom = sum(len(x) - 1 for x in known)
    shared = (sum(((x - x.mean()) ** 2).sum() for x in known) / freedom) ** 0.5 if freedom else 0.0
    spread = [x.std() if len(x) >= OWN_ROWS else max(x.std(), shared) for x in known]
    found = iter([x.mean() - deviations * d for x, d in zip(known, spread)])
    return np.array([next(found) if len(x) > 1 else -np.inf for x in rows])


def fit(rows: list, f: Features, dim: int = 8, epochs: int = 12, rate: float = 40.0, batch: int = 32,
        seed: int = 7, deviations: float = 4.0) -> SubwordModel | None:
    """Train by stochastic gradient descent on a bounded list of feature rows.

    Every fifth row is kept for calibration: a temperature that minimises its
    log loss, and the least evidence of each class: ``deviations`` standard
    deviations below the mean of its rightly classified rows. A class with few
    such rows has the deviation of all classes' rows from their means, if that
    is larger. Rows without features are not learned. None without rows.
    """
    data = [(np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["shares"], np.float32), r["label"])
            for r in rows if len(r["buckets"])]
    if not data:
        return None
    classes = sorted({d[2] for d in data})
    y = np.array([classes.index(d[2]) for d in data])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    held, learn = (order[::5], np.setdiff1d(order, order[::5])) if len(data) >= 50 else (order, order)
    buckets, k = 1 << f.bits, len(classes)
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    weight = rng.normal(0, 0.5, (dim, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    steps, step = epochs * -(-len(learn) // batch), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learn), -(-len(learn) // batch)):
            idx, share, doc = _batch(data, part)
            firsts = np.flatnonzero(np.diff(doc, prepend=-1))
            hidden = np.add.reduceat(embed[idx] * share[:, None], firsts)
            error = softmax(hidden @ weight + bias)
            error[np.arange(len(part)), y[part]] -= 1
            error /= len(part)
            lr = rate * (1 - step / steps)
            back = (error @ weight.T).astype(np.float32)
            grad = back[doc] * share[:, None]
            weight -= np.float32(lr * 0.02) * (hidden.T @ error).astype(np.float32)
            bias -= np.float32(lr * 0.02) * error.sum(0).astype(np.float32)
            for j in range(dim):
                embed[:, j] -= np.float32(lr) * np.bincount(idx, weights=grad[:, j], minlength=buckets).astype(np.float32)
            step += 1
    model = SubwordModel(f, classes, (embed @ weight).astype(np.float64), bias.astype(np.float64))
    evidence = np.array([(model.scores[data[h][0]] * data[h][1][:, None]).sum(0) for h in held])
    logits = evidence + model.bias
    truth = y[held]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / model.temperature)
    right = p.argmax(1) == truth
    # a class without calibration rows rejects nothing
    mine = [evidence[right & (truth == c), c] for c in range(k)]
    model.least = least_evidence(mine, deviations)
    model.report = {"rows": len(data), "accuracy": float(right.mean()), "log_loss": float(min(loss))}
    return model
