"""A hashed maximum-entropy model of the next word, factored into classes.

Every word lies in one of 4,096 cells, and a cell is a path of three choices
among 16: a class, a class within it, a cell. Frequent words have cells of their
own; all others share cells by their hashes. The model of a choice is a softmax
whose score is a bias for the path so far plus a weight for each feature of the
history: the word before, the two before (n-grams), the second before alone
(a skip). Feature and path so far are hashed into one row of 16
weights, so the model's size does not depend on the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from nightframe.llm.words import mix

WAYS, DEPTH = 16, 3
CELLS = WAYS**DEPTH
#: Cells with one word of their own.
HEAD = CELLS // 2
#: Rows of hashed weights, as a power of two.
BITS = 16
#: No weight is larger, so that no score leaves the range of exp.
LARGEST = 12.0
#: Part of a scaling step that is taken, and counts added to both sides of it.
STEP, PRIOR = 0.45, 4.0
#: Tokens scored at once.
BATCH = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x51ED270B76A3F5C1)


def tail_cell(hashes: np.ndarray) -> np.ndarray:
    """The shared cell of words without their own."""
    return (HEAD + (mix(hashes) >> np.uint64(32)) % np.uint64(CELLS - HEAD)).astype(np.int64)


def history_features(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The hashed features before every token; ``first`` has the place of each token in its text."""
    def back(k):
        out = np.full(len(words), _START, np.uint64)
        out[k:] = words[: len(words) - k]
        out[first < k] = _START + first[first < k].astype(np.uint64)
        return out

    one, two = back(1), back(2)
    return [mix(one + np.uint64(1)), mix(mix(one * _ODD + two) + np.uint64(2)), mix(two + np.uint64(3))]


def digits(cells: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(path so far as a number over all depths, choice) at each depth."""
    out, offset = [], 0
    for depth in range(DEPTH):
        before = cells // WAYS ** (DEPTH - depth)
        out.append((offset + before, (cells // WAYS ** (DEPTH - 1 - depth)) % WAYS))
        offset += WAYS**depth
    return out


PATHS = sum(WAYS**d for d in range(DEPTH))


def bias_of(mass: np.ndarray) -> np.ndarray:
    """Log weights of the choices of each path, from the training tokens of each cell."""
    out = np.zeros((PATHS, WAYS), np.float32)
    offset = 0
    for depth in range(DEPTH):
        share = mass.reshape(WAYS**depth, WAYS, -1).sum(2)
        total = share.sum(1, keepdims=True)
        p = np.where(total > 0, share / np.maximum(total, 1e-300), 1 / WAYS)
        out[offset : offset + WAYS**depth] = np.log(np.maximum(p, 1e-12))
        offset += WAYS**depth
    return out


@dataclass
class MaxEnt:
    """Bias of the paths and hashed weights."""

    bias: np.ndarray
    weights: np.ndarray  # rows x WAYS

    @property
    def bits(self) -> int:
        return int(self.weights.shape[0]).bit_length() - 1

    def rows(self, features: list[np.ndarray], path: np.ndarray) -> list[np.ndarray]:
        salt = mix(path.astype(np.uint64) + np.uint64(77))
        shift = np.uint64(64 - self.bits)
        return [(((f ^ salt) * _ODD) >> shift).astype(np.int64) for f in features]

    def choices(self, features: list[np.ndarray], path: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probabilities of the next choice and the rows they come from."""
        rows = self.rows(features, path)
        score = np.take(self.bias, path, axis=0)
        for row in rows:
            score += np.take(self.weights, row, axis=0)
        np.exp(score, out=score)
        score *= (1 / (score @ np.ones(WAYS, np.float32)))[:, None]
        return score, rows

    def log10_paths(self, words: np.ndarray, first: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token's cell, and of all cells that words share."""
        out, shared = np.zeros(len(words)), np.zeros(len(words))
        features = history_features(words, first)
        for at in range(0, len(words), BATCH):
            part = slice(at, at + BATCH)
            few = [f[part] for f in features]
            for depth, (path, choice) in enumerate(digits(cells[part])):
                p, _ = self.choices(few, path)
                out[part] += np.log10(np.maximum(p[np.arange(len(choice)), choice], 1e-30))
                if not depth:
                    shared[part] = np.log10(np.maximum(p[:, WAYS * HEAD // CELLS :].sum(1), 1e-30))
        return out, shared

    def add_gradient(self, words: np.ndarray, first: np.ndarray, cells: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        """Add how often each (row, choice) was taken and how often the model expected it."""
        features = history_features(words, first)
        taken = observed.reshape(-1)
        for at in range(0, len(words), BATCH):
            part = slice(at, at + BATCH)
            few = [f[part] for f in features]
            for path, choice in digits(cells[part]):
                p, rows = self.choices(few, path)
                for row in rows:
                    np.add.at(taken, row * WAYS + choice, np.float32(1))
                    order = np.argsort(row.astype(np.uint16) if self.bits <= 16 else row, kind="stable")
                    in_order = row[order]
                    edges = np.flatnonzero(np.diff(in_order, prepend=-1))
                    used = in_order[edges]
                    expected[used] = np.take(expected, used, axis=0) + np.add.reduceat(np.take(p, order, axis=0), edges, axis=0)

    def stepped(self, observed: np.ndarray, expected: np.ndarray) -> MaxEnt:
        """The model after one scaling step along the gradient of the counted tokens."""
        step = STEP * np.log((observed + PRIOR) / (expected + PRIOR))
        return MaxEnt(self.bias, np.clip(self.weights + step, -LARGEST, LARGEST).astype(np.float32))
