"""Simple-8b coding of ids: 64-bit words of a 4-bit selector and 60 data bits.

The encoder walks all blocks in step, one word of each block at a time; the decoder spreads
all words of one selector at once.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: ids per word by selector. Selector 0 is the escape, one id of up
# to 60 bits in full; the other selectors give each id 60 // count bits.
COUNTS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

BLOCK = 1024
_BLOCKS = 512  # blocks decoded at once


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks of BLOCK ids, and the number of words of each block.

    Each word takes as many of the block's next ids as fit. A word's unused places hold zero.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    blocks = -(-n // BLOCK)
    ids = np.asarray(ids)
    most = int(ids.max())
    kind = np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    padded = np.zeros((blocks, BLOCK + COUNTS[-1]), kind)
    padded[:-1, :BLOCK] = ids[: (blocks - 1) * BLOCK].reshape(-1, BLOCK)
    rest = n - (blocks - 1) * BLOCK
    padded[-1, :rest] = ids[n - rest :]
    best = _selectors(padded, most).reshape(-1)
    values = padded.reshape(-1)
    taken = np.array(COUNTS, np.int64)
    starts = np.zeros(len(values), bool)
    at = np.arange(blocks, dtype=np.int64) * padded.shape[1]
    ends = at + BLOCK
    ends[-1] = at[-1] + rest
    while len(at):
        starts[at] = True
        at = at + taken[best[at]]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    at = np.flatnonzero(starts)
    chosen = best[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == s)
        first, width = at[mine], 60 // COUNTS[s]
        word = words[mine]
        for j in range(COUNTS[s]):
            word |= values[first + j].astype(np.uint64) << np.uint64(width * j)
        words[mine] = word
    return words, np.bincount(at // padded.shape[1], minlength=blocks).astype(np.uint32)


def _selectors(padded: np.ndarray, most: int) -> np.ndarray:
    """For every position the selector of the longest run that fits from there on; places
    after a block's end are zero. A run that fits a selector fits all lower ones, and those
    with room for ``most``, the largest id, fit everywhere."""
    anywhere = sum(most < 1 << (60 // count) for count in COUNTS[1:])
    best = np.full(padded.shape, anywhere, np.uint8)
    highest, reach = padded.copy(), 1
    for count in COUNTS[1 + anywhere :]:
        while reach < count:
            np.maximum(highest[:, :-reach], padded[:, reach:], out=highest[:, :-reach])
            reach += 1
        fits = highest < 1 << (60 // count)
        if not fits.any():
            break
        best += fits
    return best


def decode(words: np.ndarray, block_words: np.ndarray, n: int, dtype: type = np.uint64) -> np.ndarray:
    """The n ids of all blocks."""
    out = np.zeros(n, dtype)
    ends = np.cumsum(block_words, dtype=np.int64)
    for a in range(0, len(block_words), _BLOCKS):
        b = min(a + _BLOCKS, len(block_words))
        part = words[ends[a] - block_words[a] : ends[b - 1]]
        rows = _decoded(part, block_words[a:b], dtype)[:, :BLOCK].reshape(-1)
        out[a * BLOCK : b * BLOCK] = rows[: n - a * BLOCK]
    return out


def _decoded(words: np.ndarray, block_words: np.ndarray, dtype: type) -> np.ndarray:
    """A row of ids per block, with room for what a last word holds beyond the block's end."""
    width = BLOCK + COUNTS[-1]
    rows = np.zeros(len(block_words) * width, dtype)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    held = np.array(COUNTS)[selector]
    before = np.cumsum(held) - held
    first = np.cumsum(block_words, dtype=np.int64) - block_words
    at = before + np.repeat(np.arange(len(block_words)) * width - before[first], block_words)
    for s in np.flatnonzero(np.bincount(selector)).tolist():
        mine = np.flatnonzero(selector == s)
        own, places, bits = words[mine], at[mine], 60 // COUNTS[s]
        mask = np.uint64((1 << bits) - 1)
        for j in range(COUNTS[s]):
            rows[places + j] = (own >> np.uint64(bits * j)) & mask
    return rows.reshape(-1, width)
