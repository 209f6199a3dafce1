"""Content-defined anchors of windows, for matching long windows across a corpus.

A window of ``width`` symbols (bytes or words) is represented by one of the grams of
``gram`` symbols inside it: the one with the smallest order value, the leftmost of
equals. Order values follow from content, so equal windows, wherever they are, have
equal anchors at equal offsets. Windows that follow each other mostly share an anchor;
such a run of windows with the text it covers is a *context*. Whatever two equal
windows a corpus holds, both lie in contexts of the same anchor gram: an anchor gram
that occurs once in the corpus rules out all windows of its context.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE_BITS = np.uint64(31)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return (h ^ (h >> np.uint64(32))) * _ODD2


@dataclass
class Runs:
    """Contexts of one stretch of symbols: window starts first[k] .. first[k] + count[k] - 1."""

    first: np.ndarray
    count: np.ndarray
    anchor: np.ndarray  # where the anchor gram starts
    gram: np.ndarray  # 64-bit hash of the anchor gram
    times: np.ndarray  # equal contexts in a row that this one stands for, each ``count`` symbols after the one before


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` neighbouring values, by doubling."""
    least, have = values, 1
    while 2 * have <= size:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < size:
        least = np.minimum(least[: len(values) - size + 1], least[size - have :])
    return least


def contexts(hashes: np.ndarray, width: int, gram: int, weight: np.ndarray | None = None) -> Runs:
    """Contexts of all windows of one text.

    ``hashes``: 64-bit hash of the gram that starts at each symbol (the last gram - 1
    symbols have none). ``weight``: whole numbers under 256 by gram, larger ones are
    preferred as anchors.
    """
    windows = len(hashes) + gram - width
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none)
    order = hashes >> _PLACE_BITS
    if weight is not None:
        order = (order >> np.uint64(8)) | ((np.uint64(255) - weight.astype(np.uint64)) << np.uint64(25))
    order = (order << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(order, width - gram + 1)
    place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    counts = np.diff(np.append(starts, windows))
    return Runs(starts, counts, place[starts], hashes[place[starts]], np.ones(len(starts), np.int64))


def collapsed(found: Runs, width: int, symbols: np.ndarray) -> Runs:
    """Contexts in a row that are equal, symbol for symbol, as one with its number of ``times``.

    Where a text repeats itself at a short distance, each period is a context of its
    own and equal to the next, so a stretch of any length becomes one context.
    """
    again = found.gram[1:] == found.gram[:-1]
    if not again.any():  # nearly every text
        return found
    again &= found.count[1:] == found.count[:-1]
    for period in np.unique(found.count[:-1][again]).tolist():
        pairs = np.flatnonzero(again & (found.count[:-1] == period))
        size = period + width - 1
        if len(pairs) * size < len(symbols):
            near = found.first[pairs][:, None] + np.arange(size)[None, :]
            again[pairs] = (symbols[near] == symbols[near + period]).all(axis=1)
        else:
            odd = np.concatenate([[0], np.cumsum(symbols[:-period] != symbols[period:])])
            at = found.first[pairs]
            again[pairs] = odd[at + size] == odd[at]
    heads = np.flatnonzero(np.concatenate([[True], ~again]))[: len(found.first)]
    times = np.diff(np.append(heads, len(found.first)))
    return Runs(found.first[heads], found.count[heads], found.anchor[heads], found.gram[heads], times)


def byte_grams(data: np.ndarray, gram: int = 32) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) that start at each byte."""
    table = np.random.default_rng(400).integers(0, 1 << 64, 256, dtype=np.uint64)
    h, have = table[data], 1
    while have < gram:
        if len(h) <= have:
            return np.zeros(0, np.uint64)
        h = h[:-have] * (_ODD ** np.uint64(have)) + h[have:]
        have *= 2
    return mix(h)


_BYTE = np.random.default_rng(13).integers(0, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 20  # bytes hashed at a time
_R = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        out[have : 2 * have] = out[: min(have, n - have)] * step
        have *= 2
    return out


_UP = _powers(_R, CHUNK + 1)
_DOWN = _powers(pow(_R, -1, 1 << 64), CHUNK + 1)


def word_borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array; words are separated by ASCII white space."""
    letter = np.concatenate([[False], ~_BLANK[data], [False]])
    change = np.flatnonzero(letter[1:] != letter[:-1])
    return change[::2], change[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(starts), np.uint64)
    # a word longer than a chunk is hashed by itself, in steps
    k = 0
    while k < len(starts):
        stop = int(np.searchsorted(ends, starts[k] + CHUNK, side="right"))
        if stop == k:
            h = np.uint64(0)
            for at in range(int(starts[k]), int(ends[k]), CHUNK):
                part = _BYTE[data[at : min(at + CHUNK, int(ends[k]))]]
                h = (part * _UP[: len(part)]).sum(dtype=np.uint64) + mix(np.array([h], np.uint64))[0]
            out[k] = h
            k += 1
            continue
        lo = int(starts[k])
        part = _BYTE[data[lo : int(ends[stop - 1])]]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)])
        s, e = starts[k:stop] - lo, ends[k:stop] - lo
        out[k:stop] = (total[e] - total[s]) * _DOWN[s]
        k = stop
    return mix(out)


def word_grams(hashes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` words that start at each word."""
    if len(hashes) < gram:
        return np.zeros(0, np.uint64)
    n = len(hashes) - gram + 1
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total = total * _ODD + hashes[k : k + n]
    return mix(total)
