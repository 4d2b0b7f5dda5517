"""Words of many texts at once, as fingerprints worked out on bytes."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
SEED = 41
SPACES = (0x20, *range(0x09, 0x0E))
# Longer stretches are hashed one by one.
LONG = 256
PRIME = np.uint64((1 << 31) - 1)


def release() -> None:
    """Give freed memory back to the system, where the C library can do that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def hash_stretches(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the bytes from each ``first`` to its ``stop``.

    Eight bytes at a time are mixed into the fingerprint, so no sum of products is left
    that structured strings could cancel out. Long stretches go through BLAKE2.
    """
    sizes = stop - first
    out = mix(sizes.astype(np.uint64) + np.uint64(BASE))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    at = 0
    while len(live):
        rest = np.minimum(sizes[live] - at, 8).astype(np.uint64)
        chunk = eight[first[live] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))
        out[live] = mix((out[live] ^ chunk) * np.uint64(BASE) + np.uint64(SEED))
        at += 8
        live = live[sizes[live] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        digest = hashlib.blake2b(data[first[i] : stop[i]].data, digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def _fold(x: np.ndarray) -> np.ndarray:
    """Remainder modulo 2^31 - 1 of integers below 2^63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x == PRIME, np.uint64(0), x)


class Rolling:
    """Fingerprints of any stretches of a row of numbers: two sums of products modulo the
    prime 2^31 - 1, with bases of their own, give 62 bits."""

    def __init__(self, seed: int = SEED):
        self.bases = [int(b) for b in np.random.default_rng(seed).integers(1 << 20, 1 << 30, 2)]
        self.powers = [np.ones(1, np.uint64)] * 2
        self.back = [np.ones(1, np.uint64)] * 2

    def grow(self, n: int) -> None:
        if n <= len(self.powers[0]):
            return
        n += n // 4
        prime = int(PRIME)

        def run(base):
            out, done = np.ones(n, np.uint64), 1
            while done < n:
                more = min(done, n - done)
                out[done : done + more] = _fold(out[:more] * np.uint64(pow(base, done, prime)))
                done += more
            return out

        self.powers = [run(b) for b in self.bases]
        self.back = [run(pow(b, -1, prime)) for b in self.bases]

    def sums(self, values: list[np.ndarray]) -> list[np.ndarray]:
        """Running sums for two rows of values below 2^31."""
        n = len(values[0])
        self.grow(n + 1)
        out = []
        for value, powers in zip(values, self.powers, strict=True):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_fold(value * powers[:n]), out=total[1:])
            out.append(total)
        return out

    def name(self, sums: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Fingerprints of the stretches from ``start`` to ``stop``."""
        one, two = (
            _fold(_fold(total[stop] - total[start]) * back[start])
            for total, back in zip(sums, self.back, strict=True)
        )
        return mix(one << np.uint64(31) | two)


class WordHasher:
    """64-bit fingerprints of the words between ASCII white space.

    ``fold`` takes A-Z as a-z. Equal words have equal fingerprints on every machine.
    """

    def __init__(self, fold: bool):
        self.letters = np.arange(256, dtype=np.uint8)
        if fold:
            self.letters[65:91] = self.letters[97:123]
        self.fold = fold
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True

    def stretches(self, data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return hash_stretches(self.letters[data] if self.fold else data, first, stop)

    def words(self, texts: list[bytes]):
        """Joined bytes; start, stop, fingerprint and text number of every word in order."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = self.space[data]
        first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        stop = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        word = self.stretches(data, first, stop)
        ends = np.cumsum([len(t) + 1 for t in texts])
        return data, first, stop, word, np.searchsorted(ends, first, side="right")
