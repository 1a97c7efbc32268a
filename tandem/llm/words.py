"""Words and word shingles of whole Arrow batches of texts, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09 to 0x0D; A-Z are lower-cased, nothing else is. Texts are
read from the Arrow buffers, so no Python string is made. All hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

GROUP_BYTES = 4 << 20  # texts are handled in groups of about this size,
GROUP_ROWS = 8192  # and of at most so many rows
SEGMENT_BYTES = 1 << 20  # and hashed in segments of about this size, also within one very long text

_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = [np.uint64(x | 1) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F,
                                     0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and its inverse modulo 2^64 for i < n; grown by need, kept by the worker."""
    if len(_powers[0]) < n:
        size = max(n, SEGMENT_BYTES * 2)
        inverse = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for i, base in enumerate((_P, inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


def running_sums(piece: np.ndarray, fold: bool = True) -> np.ndarray:
    """Sums of (byte + 1) * P^place before each place: any span's hash comes from its two ends."""
    power, _ = _power_tables(len(piece) + 1)
    with np.errstate(over="ignore"):
        terms = (_LOWER[piece] if fold else piece).astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: len(piece)]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
    return total


def span_hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [begin, end) of the piece that ``total`` is of; the same text has the same hash anywhere."""
    _, inverse = _power_tables(len(total))
    with np.errstate(over="ignore"):
        hashes = (total[end] - total[begin]) * inverse[begin]
        hashes += (end - begin).astype(np.uint64) * np.uint64(_P)
    return mix(hashes)


def text_hash(text: str) -> int:
    """The hash that a word with this text has."""
    piece = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(running_sums(piece), np.array([0]), np.array([len(piece)]))[0])


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, ends


@dataclass
class Words:
    """Words of rows ``first`` to ``last`` of a batch. ``begin`` and ``end`` are byte offsets in ``raw``; row r has the
    words ``bounds[r - first]`` to ``bounds[r - first + 1]``."""

    first: int
    last: int
    raw: np.ndarray
    offsets: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def blocks(self, size: int = 1 << 17) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Runs of words: first and last word, the place of their first byte, and their bytes."""
        for at in range(0, len(self.begin), size):
            to = min(at + size, len(self.begin))
            yield at, to, int(self.begin[at]), self.raw[self.begin[at] : self.end[to - 1]]


def _segment_words(raw, a, b, cuts, fold):
    """Words that lie in raw[a:b]; cuts are text starts within it."""
    piece = raw[a:b]
    space = _SPACE[piece]
    before = np.empty(len(piece), bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(len(piece), bool)
    after[-1] = True
    after[:-1] = space[1:]
    inner = cuts[(cuts > 0) & (cuts < len(piece))]
    before[inner] = True
    after[inner - 1] = True
    solid = ~space
    begin = np.flatnonzero(solid & before)
    end = np.flatnonzero(solid & after) + 1
    return begin + a, end + a, span_hashes(running_sums(piece, fold), begin, end)


def words_of(column, fold: bool = True) -> Iterator[Words]:
    """All words of a string column, in groups of rows of about ``GROUP_BYTES``."""
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1
        last = min(max(last, first + 1), n, first + GROUP_ROWS)
        parts = []
        a, stop = int(offsets[first]), int(offsets[last])
        starts = offsets[first : last + 1]
        while a < stop:
            b = min(a + SEGMENT_BYTES, stop)
            while b < stop and not _SPACE[raw[b]]:  # never cut within a word
                reach = raw[b : b + 4096]
                found = np.flatnonzero(_SPACE[reach])
                b = b + int(found[0]) if len(found) else min(b + 4096, stop)
            inside = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
            parts.append(_segment_words(raw, a, b, inside, fold))
            a = b
        if parts:
            begin, end, hashes = (np.concatenate(x) for x in zip(*parts))
        else:
            begin, end, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        yield Words(first, last, raw, offsets, begin, end, hashes, np.searchsorted(begin, starts))
        first = last


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, in order, and the bounds per row.

    A text with fewer than n words, but some, has one shingle: all its words.
    """
    counts = words.counts
    total = len(words.hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(total, np.uint64)
        for k in range(n):
            rolled[: max(total - k, 0)] += words.hashes[k:] * _STEPS[k % len(_STEPS)] + np.uint64(k * k * _P % (1 << 64))
    rolled = mix(rolled)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    shift = np.repeat(words.bounds[:-1] - bounds[:-1], made)
    out = rolled[np.arange(bounds[-1]) + shift]
    for row in np.flatnonzero((counts > 0) & (counts < n)):
        h = np.uint64(counts[row])
        with np.errstate(over="ignore"):
            for w in words.hashes[words.bounds[row] : words.bounds[row + 1]]:
                h = (h ^ w) * _STEPS[0] + _STEPS[1]
        out[bounds[row]] = mix(np.array([h], np.uint64))[0]
    return out, bounds


_ROW_SHIFT = np.uint64(50)
_TOKEN = np.uint64((1 << 50) - 1)


def sorted_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles of each text as ascending 50-bit numbers, and the bounds per row."""
    found, bounds = shingles(words, n)
    rows = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    both = np.sort((rows << _ROW_SHIFT) | (found >> np.uint64(14)))  # GROUP_ROWS fit above the token
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    both = both[first]
    starts = np.searchsorted(both, np.arange(len(bounds), dtype=np.uint64) << _ROW_SHIFT)
    return both & _TOKEN, starts


def slices(batch: pa.RecordBatch, columns: list[str], most: int = 4 * GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts add up to about ``most`` bytes; a longer row is a part of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += np.diff(text_buffers(batch.column(c))[1])
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
