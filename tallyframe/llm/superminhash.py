"""Shingle sets and SuperMinHash signatures in numpy; called per document inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word n-grams of a UTF-8 text, A-Z lower-cased, as sorted 64-bit hashes of the grams.

    Words are hashed by a polynomial over random values of their bytes, all at once: differences of a
    running sum, shifted back by the inverse power of the place they start at. A gram is a sum of its
    words' hashes, each times an odd constant of its place, mixed once more. Two different grams of one
    comparison collide with a probability near 2 ** -64.
    """

    def __init__(self, n: int = 5, block: int = 1 << 20) -> None:
        self.n, self.block = n, block
        seeds = mixed(np.arange(1, n + 300, dtype=np.uint64) * _STEP)
        self.place, self.byte = seeds[:n] | np.uint64(1), seeds[n : n + 256]
        self.blank = np.zeros(256, dtype=bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        base = 0x5851F42D4C957F2D
        self._powers(4096, base)
        self.base = base

    def _powers(self, size: int, base: int) -> None:
        one = np.ones(1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([one, np.full(size, base, dtype=np.uint64)]))
            inverse = pow(base, -1, 1 << 64)
            self.back = np.cumprod(np.concatenate([one, np.full(size, inverse, dtype=np.uint64)]))

    def _word_hashes(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw, dtype=np.uint8)
        if len(data) > len(self.power):
            self._powers(2 * len(data), self.base)
        edge = np.empty(len(data) + 2, dtype=bool)
        edge[0] = edge[-1] = True
        np.take(self.blank, data, out=edge[1:-1])
        turns = np.flatnonzero(edge[1:] != edge[:-1])  # a word starts, ends, starts, ...
        starts, ends = turns[::2], turns[1::2]
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def words(self, text: bytes) -> np.ndarray:
        """A hash per word. Long texts go in blocks that end before white space."""
        raw, out, at = text.lower(), [], 0
        while at < len(raw):
            end = at + self.block
            while end < len(raw) and not self.blank[raw[end]]:
                end += 1
            out.append(self._word_hashes(raw[at:end]))
            at = end
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def grams(self, text: bytes) -> np.ndarray:
        """Distinct grams; a shorter text is one gram as a whole, a text without words has none."""
        with np.errstate(over="ignore"):
            h = self.words(text)
            if not len(h):
                return h
            n = min(self.n, len(h))
            total = np.zeros(len(h) - n + 1, dtype=np.uint64)
            for k in range(n):
                total += h[k : len(h) - n + 1 + k] * self.place[k]
            if n < self.n:  # so that a short text is no gram of a longer one
                total += np.uint64(n) * _STEP
            return np.unique(mixed(total))


def digest(grams: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signature(grams: np.ndarray, size: int, block: int = 1 << 16) -> np.ndarray:
    """SuperMinHash of a set: `size` values, slot k equal in two sets with the probability of their likeness.

    Each element draws a random permutation of the slots, one place per round; in round j it offers
    j + (a fraction) to the slot at its j-th place, and a slot keeps its least offer. The permutation
    ranks correlate the slots of one element, so every slot is hit early and evenly. Once all slots hold
    an offer below j + 1, later rounds cannot lower any, and the scan stops. Elements go in blocks, so
    memory is bounded for sets of any size.
    """
    best = np.full(size, np.inf)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), block):
            part = grams[at : at + block]
            places = _Places(len(part), size) if len(part) < 2 * size else _TracedPlaces()
            for j in range(size):
                if j and best.max() < j:
                    break
                draw = mixed(part + np.uint64(j + 1) * _STEP)
                slot = places.step(j, j + ((draw >> np.uint64(40)) % np.uint64(size - j)).astype(np.int64))
                offer = j + (draw & np.uint64(0xFFFFFFFFFF)).astype(np.float64) * 2.0**-40
                np.minimum.at(best, slot, offer)
    return best


class _Places:
    """The order of the slots of each element as a table; step j of Fisher-Yates exchanges two places."""

    def __init__(self, n: int, size: int) -> None:
        self.order = np.empty((n, size), dtype=np.int16)
        self.order[:] = np.arange(size, dtype=np.int16)
        self.rows = np.arange(n)

    def step(self, j: int, other: np.ndarray) -> np.ndarray:
        chosen = self.order[self.rows, other]
        self.order[self.rows, other] = self.order[:, j]
        return chosen


class _TracedPlaces:
    """The same without a table, for many elements and few rounds: the slot at a place is traced back
    through the exchanges so far."""

    def __init__(self) -> None:
        self.swaps: list[np.ndarray] = []

    def step(self, j: int, other: np.ndarray) -> np.ndarray:
        slot = other
        for i in range(j - 1, -1, -1):
            slot = np.where(slot == self.swaps[i], i, slot)
        self.swaps.append(other)
        return slot


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit hash per band of `rows` slots."""
    bits = values.view(np.uint64).reshape(-1, rows)
    out = np.zeros(len(bits), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mixed(out * _STEP + bits[:, k] + np.uint64(1))
    return out.view(np.int64)


def marks(values: np.ndarray) -> np.ndarray:
    """One byte per slot: enough to estimate how many slots agree."""
    return (mixed(values.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
