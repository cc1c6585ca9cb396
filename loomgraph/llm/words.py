"""Vectorised word hashing: whole Arrow batches of UTF-8 become arrays of 64-bit word hashes.

A word is [^\x20\x09-\x0D]+ with A-Z lower-cased; all these are ASCII, so bytes can be looked at
one by one. The hash of a word is the polynomial sum of a random value for each byte, taken from
running sums over the batch (all arithmetic is modulo 2**64, where odd bases have inverses),
and then mixed. Two words differ in hash but for chances of about 2**-60.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BLOCK = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_VALUES = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]

_CASED = _VALUES.copy()
_CASED[ord("A") : ord("Z") + 1] = np.random.Generator(np.random.PCG64(20_251_128)).integers(1, 2**64, 26, np.uint64, endpoint=False) | np.uint64(1)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A finishing step that spreads each bit over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers = (made[0], made[1])
    return _powers


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in data, and the n + 1 word offsets of the documents cut at offsets."""
    inside = ~IS_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cuts[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every document, and the documents' n + 1 word offsets."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK, "right")) - 1)
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, words = spans(part, at)
        power, inverse = _power_table(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
        counts.append(np.diff(words))
        first = last
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.concatenate(counts) if counts else [], out=out[1:])
    return np.concatenate(hashes), out


def case_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words as they are written, A-Z not lower-cased: hash, start and end of each, and the documents' n + 1 word offsets."""
    starts, ends, words = spans(data, offsets)
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        # whole words of a stretch of about _BLOCK bytes
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BLOCK, "right")))
        low = starts[first]
        part = data[low : ends[last - 1]]
        power, inverse = _power_table(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CASED[part] * power[: len(part)], out=sums[1:])
        hashes[first:last] = mix((sums[ends[first:last] - low] - sums[starts[first:last] - low]) * inverse[starts[first:last] - low])
        first = last
    return hashes, starts, ends, words.astype(np.int64)


def hash_of(symbol: str) -> int:
    """The hash of a symbol that stands beside the words of a text; it may hold spaces, which no word does."""
    raw = np.frombuffer(symbol.encode(), np.uint8)
    return int(mix(np.array([np.sum(_VALUES[raw] * _power_table(len(raw))[0][: len(raw)])]))[0])


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct shingles of width words and their n + 1 offsets.

    A document of fewer words has its whole sequence as the one shingle; one without words has none.
    """
    step, size = np.uint64(0x9FB21C651E98DF25), len(hashes)
    rolled = np.zeros(max(size - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * step + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    found, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in hashes[a:b]:
                h = h * step + x
            own = mix(h ^ np.uint64(0x5851F42D4C957F2D))
        else:
            continue
        found.append(own)
        counts[i] = len(own)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out[1:])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), out
