"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost
smaller ones (LMS) are sorted first; all others are induced from them, bucket by bucket: a
bucket is scanned in waves, each of which appends the left neighbours of a whole array.
"""

from __future__ import annotations

import numpy as np

_SMALL_ALPHABET = 2048


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of ``text`` (small non-negative integers) in order; a suffix
    that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    t = np.append(text.astype(np.int64) + 1, 0)  # the end is the smallest symbol
    return _sorted_suffixes(t)[1:]


def _sorted_suffixes(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``t``, whose last symbol, 0, occurs once."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    symbols = t.astype(np.uint8 if t.max() < 256 else np.uint16)
    first = _induced(t, symbols, smaller, lms[np.argsort(t[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    names, count = _names(t, lms, order)
    if count < len(lms):
        order = lms[_reduced_order(names, count)]
    return _induced(t, symbols, smaller, order)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; equal symbols take their neighbour's type."""
    step = np.zeros(len(t), np.int8)
    step[:-1] = np.sign(t[1:] - t[:-1])
    step[-1] = 1
    places = np.where(step != 0, np.arange(len(t)), len(t))
    nearest = np.minimum.accumulate(places[::-1])[::-1]
    return step[nearest] > 0


def _induced(t: np.ndarray, symbols: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes from the LMS suffixes in order."""
    size = int(t.max()) + 1
    seeds = _split(lms, symbols[lms], size)
    larger = _scan(seeds, symbols, ~smaller, range(size), size)
    lower = _scan([x[::-1] for x in larger], symbols, smaller, range(size - 1, -1, -1), size)
    out = []
    for c in range(size):
        out.append(larger[c])
        if c or not len(lower[0]):
            out.append(lower[c][::-1])
    order = np.concatenate(out)
    return order if len(order) == len(t) else np.concatenate([[len(t) - 1], order])


def _scan(sources: list[np.ndarray], symbols: np.ndarray, wanted: np.ndarray, buckets: range, size: int) -> list[np.ndarray]:
    """Suffixes of the wanted type by bucket, in the order of the scan.

    In each bucket come first the entries that earlier buckets and the bucket itself have
    sent, then its sources; each entry sends its left neighbour, if that is of the type.
    """
    sent: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in buckets:
        wave = np.concatenate(sent[c]) if sent[c] else np.zeros(0, np.int64)
        done = [wave]
        while len(wave):
            left = wave[wave > 0] - 1
            left = left[wanted[left]]
            chars = symbols[left]
            own = chars == c
            wave = left[own]
            done.append(wave)
            _send(sent, left[~own], chars[~own])
        sent[c] = done
        left = sources[c]
        left = left[left > 0] - 1
        left = left[wanted[left]]
        _send(sent, left, symbols[left])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in sent]


def _send(sent: list[list[np.ndarray]], items: np.ndarray, chars: np.ndarray) -> None:
    if not len(items):
        return
    order = np.argsort(chars, kind="stable")
    items, chars = items[order], chars[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    for part, c in zip(np.split(items, cuts), chars[np.concatenate([[0], cuts])].tolist()):
        sent[c].append(part)


def _split(items: np.ndarray, chars: np.ndarray, size: int) -> list[np.ndarray]:
    order = np.argsort(chars, kind="stable")
    return np.split(items[order], np.searchsorted(chars[order], np.arange(1, size)))


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the LMS substrings in text order, equal for equal substrings; their count."""
    ends = np.append(lms[1:], len(t) - 1)
    length = np.zeros(len(t), np.int64)
    length[lms] = ends - lms + 1
    same = length[order[1:]] == length[order[:-1]]
    a, b, left = order[1:][same], order[:-1][same], length[order[1:]][same]
    equal = np.ones(len(a), bool)
    live, k = np.arange(len(a)), 0
    while len(live):
        live = live[left[live] > k]
        match = t[a[live] + k] == t[b[live] + k]
        equal[live[~match]] = False
        live, k = live[match], k + 1
    new = np.ones(len(order), bool)
    new[1:][np.flatnonzero(same)[equal]] = False
    numbers = np.zeros(len(t), np.int64)
    numbers[order] = np.cumsum(new) - 1
    return numbers[lms], int(new.sum())


def _reduced_order(names: np.ndarray, count: int) -> np.ndarray:
    """Order of the suffixes of the string of names: by the same method while there are few
    names, else by doubling of ranks, since buckets of one or two entries leave nothing to
    scan at once."""
    if count <= _SMALL_ALPHABET and len(names) > 4 * count:
        return _sorted_suffixes(names) if names[-1] == 0 and (names == 0).sum() == 1 else suffix_array(names)
    rank, k, n = names.astype(np.int64), 1, len(names)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position the length of the prefix that its suffix shares with the suffix
    before it in order; 0 for the first.

    Prefixes are compared only where the symbols to the left of both positions differ;
    elsewhere the value is one less than the left neighbour's.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    start = before <= 0
    start[0] = True
    start[1:] |= text[:-1] != text[before[1:] - 1]
    a = np.flatnonzero(start & (before >= 0))
    b = before[a]
    length = np.zeros(len(a), np.int64)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        room = n - np.maximum(x, y)
        same = np.ascontiguousarray(eight[x]) == np.ascontiguousarray(eight[y])
        run = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        run = np.minimum(run, room)
        length[live] += run
        live = live[(run == 8) & (room > 8)]
    values = np.zeros(n, np.int64)
    values[a] = length
    origin = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    return values[origin] - (np.arange(n) - origin)
