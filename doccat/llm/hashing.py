"""Words and their 64-bit hashes, computed over whole batches of texts at once."""

from __future__ import annotations

import numpy as np

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20)
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(4096, STEP))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's multiplier."""
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), STEP))
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Words:
    """The words of a batch: ``starts`` and ``ends`` in bytes, ``rows``' first words in ``first``, and ``hashes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = GAP, hashed: bool = True):
        inside = ~gap[data]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        borders = offsets[:-1][np.diff(offsets) > 0]
        head[borders] = inside[borders]
        self.starts = np.flatnonzero(head)
        self.first = np.searchsorted(self.starts, offsets)
        if not hashed:
            return
        sizes = np.diff(np.append(self.starts, len(data)))
        longest = int(sizes.max()) if len(sizes) else 0
        values = BYTE[data]
        values[~inside] = 0
        if len(self.starts):
            lead = int(self.starts[0])
            place = np.arange(lead, len(data)) - np.repeat(self.starts, sizes)
            values[lead:] *= powers(longest)[place]
            hashes = np.add.reduceat(values, self.starts)
        else:
            hashes = np.zeros(0, np.uint64)
        self.hashes = mix(hashes)
        self.inside = inside

    def ends(self) -> np.ndarray:
        """One past each word's last byte."""
        size = len(self.inside)
        tail = self.inside.copy()
        tail[:-1] &= ~self.inside[1:]
        # a word that ends its text may touch the next text's first word
        tail[self.starts[self.starts > 0] - 1] |= self.inside[self.starts[self.starts > 0] - 1]
        return np.flatnonzero(tail) + 1 if size else np.zeros(0, np.int64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` neighbours, at its first; the last ``n - 1`` places are left out."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    # doubling: a run of n is made of runs of powers of two
    runs, size, out, done = hashes.copy(), 1, None, 0
    bits = n
    while bits:
        if bits & 1:
            part = runs[done : done + count]
            out = part.copy() if out is None else out * STEP + part
            done += size
        bits >>= 1
        if bits:
            runs = mix(runs[: len(runs) - size] * STEP + runs[size:])
            size *= 2
    return mix(out)
