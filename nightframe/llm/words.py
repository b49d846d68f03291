"""What every text operator here means by a word, and helpers for byte texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"

#: Odd multiplier and byte values of the rolling hash (any fixed random numbers do).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for a null or blank one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_KNOWN: dict[str, np.ndarray] = {"power": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept between calls up to a million."""
    if len(_KNOWN["power"]) >= n:
        return _KNOWN["power"][:n], _KNOWN["inverse"][:n]
    size = max(n, 1 << 20) if n <= 1 << 20 else n
    power, inverse = powers(size), powers(size, np.uint64(pow(int(_BASE), -1, 2**64)))
    if size <= 1 << 20:
        _KNOWN.update(power=power, inverse=inverse)
    return power[:n], inverse[:n]


def hashed_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every word of every text, in order."""
    joined = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts)
    raw = np.frombuffer(joined, np.uint8)
    inside = ~_SPACE[raw]
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts])
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    # Sums of byte values times powers give every word's value by one subtraction;
    # the powers are odd, so a word's place in the texts can be divided out.
    power, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[raw] if lower else raw] * power[: len(raw)], out=total[1:])
    return owner, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each text's distinct runs of ``n`` words, sorted.

    A text with fewer words has one run, all of it; one without words none.
    """
    owner, w = hashed_words(texts)
    if not len(w):
        return owner, w
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    owners, runs = [], []
    h = np.zeros(len(w), np.uint64)
    for size in range(1, n + 1):
        m = len(w) - size + 1
        if m <= 0:
            break
        h = mix(h[:m] * np.uint64(0xD6E8FEB86659FD93) + w[size - 1 :] + np.uint64(size))
        if size < n:
            docs = np.flatnonzero(counts == size)
            owners.append(docs)
            runs.append(mix(h[first[docs]] + np.uint64(size)))
        else:
            whole = owner[:m] == owner[size - 1 :]
            owners.append(owner[:m][whole])
            runs.append(mix(h[whole] + np.uint64(size)))
    owner, run = np.concatenate(owners), np.concatenate(runs)
    order = np.lexsort((run, owner))
    owner, run = owner[order], run[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], run[new]


def in_groups(texts: list[str | None], most: int = 250_000) -> list[tuple[int, int]]:
    """Bounds of groups of texts with ``most`` characters at most, or one text."""
    bounds, at, size = [], 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > most:
            bounds.append((at, k))
            at, size = k, 0
        size += n
    if at < len(texts):
        bounds.append((at, len(texts)))
    return bounds
