"""Word and shingle hashes of whole texts, computed over Arrow buffers."""

from __future__ import annotations

import numpy as np

from .worker import shared

# A word is a run of bytes outside \x20 and \x09-\x0D; A-Z are lower-cased. Bare words also
# end at every other ASCII byte that is no letter or digit.
_BREAKS = (0x20, *range(0x09, 0x0E))
_BARE = tuple(b for b in range(128) if not chr(b).isalnum())
_BASE = 0x9E3779B97F4A7C15 | 1
_SLAB = 1 << 20
_M64 = (1 << 64) - 1


class _Tables:
    def __init__(self, breaks: tuple[int, ...]):
        rng = np.random.default_rng(20240229)
        self.breaks = np.zeros(256, bool)
        self.breaks[list(breaks)] = True
        lower = np.arange(256)
        lower[65:91] += 32
        self.values = (rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[lower]
        self.inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        self.grow(_SLAB + 1)

    def grow(self, n: int) -> None:
        self.up = powers(np.uint64(_BASE), n)
        self.down = powers(self.inverse, n)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(bare: bool, n: int = 0) -> _Tables:
    t = shared(("word tables", bare), lambda: _Tables(_BARE if bare else _BREAKS))
    if n >= len(t.up):
        t.grow(n + 1)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and n + 1 offsets into them.

    A word's hash depends on its bytes alone. Long buffers are walked in slabs that end at a
    break or at a text's end, so memory does not follow the length of a text.
    """
    t = _tables(bare)
    hashes, starts, a, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, len(data)
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    while a < n:
        b = min(a + _SLAB, n)
        while b < n and not t.breaks[data[b]]:
            step = t.breaks[data[b : b + 4096]]
            hit = int(step.argmax()) if step.any() else len(step)
            nxt = int(np.searchsorted(firsts, b))
            end = int(firsts[nxt]) if nxt < len(firsts) else n
            if end <= b + hit:
                b = end
                break
            b += hit
        part = data[a:b]
        t = _tables(bare, b - a + 1)
        inside = ~t.breaks[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        lo, hi = np.searchsorted(firsts, [a, b])
        cut = firsts[lo:hi] - a
        begin[cut] |= inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        inner = cut[cut > 0] - 1
        last[inner] |= inside[inner]
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        if len(s):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(t.values[part] * t.up[: len(part)], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * t.down[s] + (e - s).astype(np.uint64)))
            starts.append(s + a)
        a = b
    all_starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(all_starts, offsets)


def _shingle_weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(hashes: np.ndarray, ends: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Distinct hashes of the k-word shingles of each text, sorted; a shorter text is one shingle."""
    w = _shingle_weights(k)
    n = max(len(hashes) - k + 1, 0)
    mixed = np.zeros(n, np.uint64)
    for j in range(k):
        mixed += hashes[j : j + n] * w[j]
    mixed = mix(mixed)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(mixed[a : b - k + 1]))
        elif b > a:
            short = (hashes[a:b] * w[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
