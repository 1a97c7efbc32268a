"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, against which texts are scanned.

A word is a run of ASCII letters, digits and non-ASCII signs, with A-Z lower-cased. A window is ``size`` consecutive words
of a benchmark item, or all words of an item that has fewer. Tasks hash every window of every text with numpy, look the
hashes up in the set, and compare the words of each hit with the benchmark's own bytes, so an equal hash alone is no hit.

What is broadcast has a bound: the benchmark is cut into pieces, counted, and dealt into as many sets as hold at most
about ``SET_WORDS`` words and ``SET_BYTES`` bytes each. A benchmark of one set is one scan; of several sets each is scanned for in turn,
with the marks so far written down between, so nothing is left out whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.store import unused, written
from tandem.llm.words import Words, mix, slices, text_buffers, words_of

SIZE = 10  # words in a window
SET_WORDS = 1 << 20
SET_BYTES = 32 << 20
PIECE_WORDS = 4096  # windows that begin in one piece of an item
_TABLE_BITS = 22
_CHECK_BYTES = 8 << 20  # bytes of hits that are compared at a time

# a word's bytes are themselves, lower-cased; all other bytes part words
_AS_WORDS = np.full(256, 32, np.uint8)
for _kept in (range(48, 58), range(97, 123), range(128, 256)):
    _AS_WORDS[list(_kept)] = list(_kept)
_AS_WORDS[65:91] = np.arange(97, 123)


def normal_words(column) -> Iterator[Words]:
    """The words of a string column, in groups of rows; byte places are those of the texts."""
    raw, offsets = text_buffers(column)
    raw, offsets = _AS_WORDS[raw[offsets[0] : offsets[-1]]], offsets - offsets[0]
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(raw)]
    return words_of(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers), fold=False)


def _step(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1)


def window_hashes(words: Words, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, hashes) of all windows of each size; a window lies in one text."""
    total = len(words.hashes)
    stop = np.repeat(words.bounds[1:], words.counts)
    sums = np.zeros(total, np.uint64)
    for k in range(max(sizes, default=0)):
        with np.errstate(over="ignore"):
            sums[: max(total - k, 0)] += words.hashes[k:] * _step(k)
        if k + 1 in sizes:
            at = np.flatnonzero(np.arange(total) + (k + 1) <= stop)
            with np.errstate(over="ignore"):
                yield k + 1, at, mix(sums[at] + np.uint64(k + 1))


def _same_words(a: Words, at: np.ndarray, b: Words, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` words from ``at`` in a have the same bytes as those from ``to`` in b."""
    same = np.ones(len(at), bool)
    cost = np.cumsum(a.end[at + size - 1] - a.begin[at] + 8 * size)
    first = 0
    while first < len(at):
        last = int(np.searchsorted(cost, (cost[first - 1] if first else 0) + _CHECK_BYTES, "right"))
        last = min(max(last, first + 1), len(at))
        pick = slice(first, last)
        hit = np.repeat(np.arange(first, last), size[pick])
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(size[pick]) - size[pick], size[pick])
        x, y = np.repeat(at[pick], size[pick]) + nth, np.repeat(to[pick], size[pick]) + nth
        long_x = a.end[x] - a.begin[x]
        unlike = long_x != b.end[y] - b.begin[y]
        same[hit[unlike]] = False
        x, y, hit, long_x = x[~unlike], y[~unlike], hit[~unlike], long_x[~unlike]
        if len(x):
            nth = np.arange(int(long_x.sum())) - np.repeat(np.cumsum(long_x) - long_x, long_x)
            differ = a.raw[np.repeat(a.begin[x], long_x) + nth] != b.raw[np.repeat(b.begin[y], long_x) + nth]
            same[np.repeat(hit, long_x)[differ]] = False
        first = last
    return same


@dataclass
class WindowSet:
    """Different windows, sorted by hash, each with the first place of its words and the items that hold it."""

    words: Words
    sizes: list[int]
    hashes: np.ndarray
    first: np.ndarray
    size: np.ndarray
    item_bounds: np.ndarray
    items: np.ndarray
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first words, windows) of all verified occurrences in the texts."""
        if self._table is None:
            self._table = np.zeros(1 << _TABLE_BITS, bool)
            self._table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size, at, hashes in window_hashes(words, self.sizes):
            likely = self._table[hashes >> np.uint64(64 - _TABLE_BITS)]
            at, hashes = at[likely], hashes[likely]
            low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
            n = high - low  # one, but for different windows with one hash
            at = np.repeat(at, n)
            window = np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            fits = self.size[window] == size
            at, window = at[fits], window[fits]
            same = _same_words(words, at, self.words, self.first[window], self.size[window])
            found.append((at[same], window[same]))
        return tuple(np.concatenate(c) for c in zip(*found))


def _joined(column) -> Words:
    """All words of a column as one group."""
    groups = list(normal_words(column))
    if not groups:
        none = np.zeros(0, np.int64)
        return Words(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64))
    before = np.cumsum([0] + [len(g.begin) for g in groups])
    bounds = np.concatenate([groups[0].bounds[:1], *(g.bounds[1:] + n for g, n in zip(groups, before))])
    begin, end, hashes = (np.concatenate([getattr(g, c) for g in groups]) for c in ("begin", "end", "hashes"))
    return Words(0, groups[-1].last, groups[0].raw, groups[0].offsets, begin, end, hashes, bounds)


def window_set(pieces: list[tuple[str | None, str, int]]) -> WindowSet:
    """The set of (item, words, size) pieces: all windows of ``size`` words of each piece."""
    words = _joined(pa.array([p[1] for p in pieces], pa.large_string()))
    wanted = np.array([p[2] for p in pieces], np.int64)
    row = np.repeat(np.arange(len(pieces)), words.counts)
    parts = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]]
    for size, at, hashes in window_hashes(words, sorted(set(wanted.tolist()))):
        own = wanted[row[at]] == size
        parts.append([at[own], np.full(int(own.sum()), size), hashes[own]])
    first, sizes, hashes = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((first, sizes, hashes))
    first, sizes, hashes = first[order], sizes[order], hashes[order]
    # a window is the first one of its hash that has the same words
    window, chosen, left = np.full(len(first), -1), [], np.arange(len(first))
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = (hashes[left][1:] != hashes[left][:-1]) | (sizes[left][1:] != sizes[left][:-1])
        head = left[new][np.cumsum(new) - 1]
        same = _same_words(words, first[left], words, first[head], sizes[left])
        window[left[same]] = head[same]
        chosen.append(left[new])
        left = left[~same]
    heads = np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    names = np.array([p[0] for p in pieces], object)
    known, number = np.unique([n for n in names if n is not None], return_inverse=True) if len(names) else ([], [])
    of_piece = np.full(len(pieces), -1)
    of_piece[[i for i, n in enumerate(names) if n is not None]] = number
    pairs = np.stack([np.searchsorted(heads, window), of_piece[row[first]] if len(first) else first], axis=1)
    pairs = np.unique(pairs[pairs[:, 1] >= 0], axis=0)
    return WindowSet(
        words, sorted(set(sizes.tolist())), hashes[heads], first[heads], sizes[heads],
        np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1)), np.array(known, object)[pairs[:, 1]],
    )


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column("item").to_pylist(), []
            for words in normal_words(batch.column("text")):
                for r, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                    for at in range(a, max(b - size + 1, a + (b > a)), PIECE_WORDS):
                        to = min(at + PIECE_WORDS + size - 1, b)
                        text = words.raw[words.begin[at] : words.end[to - 1]].tobytes().decode()
                        out.append((names[words.first + r], text, int(to - at), min(size, int(b - a))))
            columns = [list(c) for c in zip(*out)] or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "words", "n", "size"])

    return run


def benchmark_pieces(benchmark: DataFrame, size: int) -> tuple[Callable[[int], list[tuple]], int]:
    """What gives the pieces (item, words, size) of each set, and the number of sets, at least one.

    ``benchmark``: item_id, text. Items without words have no windows; an item without id marks words but is not named.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    pieces = written(items.mapInArrow(_pieces(size), "item string, words string, n int, size int").distinct(), "benchmark")
    n, length = pieces.agg(F.sum("n"), F.sum(F.octet_length("words"))).first()
    parts = max(1, -(-(n or 0) // SET_WORDS), -(-(length or 0) // SET_BYTES))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    # the rows of one set, whose number and size are bounded above
    return lambda p: [(r["item"], r["words"], r["size"]) for r in pieces.where(part == p).collect()], parts


@dataclass
class Hits:
    """What was found in the rows of a batch. ``runs`` are runs of hit words: row, first word, word after the last, and
    the same as code points of the row's text."""

    n_words: np.ndarray
    n_hit: np.ndarray
    items: list[list[str]]
    runs: np.ndarray

    def per_row(self, *columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bounds of the rows' runs, and the columns."""
        bounds = np.searchsorted(self.runs[:, 0], np.arange(len(self.n_words) + 1))
        return bounds, [self.runs[:, c] for c in columns]


def scan(column, known: WindowSet, earlier: pa.Array | None = None, named: list | None = None) -> Hits:
    """Hits of the set in the texts, joined with ``earlier`` runs of words (begin, end, ...) and ``named`` items."""
    n_words, n_hit, items, runs = [], [], [], []
    for words in normal_words(column):
        at, window = known.find(words)
        step = np.zeros(len(words.begin) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + known.size[window], -1)
        rows = words.last - words.first
        if earlier is not None:
            own = earlier.slice(words.first, rows)
            ends = own.flatten().to_numpy().reshape(-1, 2) + np.repeat(
                words.bounds[:-1], np.asarray(own.value_lengths().fill_null(0)) // 2
            )[:, None]
            np.add.at(step, ends[:, 0], 1)
            np.add.at(step, ends[:, 1], -1)
        hit = np.cumsum(step[:-1]) > 0
        # runs end with their text
        edge = np.zeros(len(hit) + 1, bool)
        edge[words.bounds] = True
        begin = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit])[:-1]))
        end = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit, [False]])[1:])) + 1
        of = np.searchsorted(words.bounds, begin, "right") - 1
        if len(begin):
            # continued bytes of UTF-8 are no code points of their own
            low = int(words.offsets[words.first])
            points = np.concatenate([[0], np.cumsum((words.raw[low : words.offsets[words.last]] & 0xC0) != 0x80)])
            start = points[words.offsets[words.first + of] - low]
            places = (points[words.begin[begin] - low] - start, points[words.end[end - 1] - low] - start)
        else:
            places = (begin, begin)
        runs.append(np.stack([of + words.first, begin - words.bounds[of], end - words.bounds[of], *places], axis=1))
        n_words.append(words.counts)
        n_hit.append(np.diff(np.concatenate([[0], np.cumsum(hit)])[words.bounds]))
        found = [set() for _ in range(rows)]
        # each window of a row once, whatever the number of its places
        pairs = np.unique(np.stack([np.searchsorted(words.bounds, at, "right") - 1, window], axis=1), axis=0)
        for r, w in pairs.tolist():
            found[r].update(known.items[known.item_bounds[w] : known.item_bounds[w + 1]])
        for r in range(rows):
            items.append(sorted(found[r].union(named[words.first + r] or [] if named else [])))
    if not n_words:
        return Hits(np.zeros(0, np.int64), np.zeros(0, np.int64), [], np.zeros((0, 5), np.int64))
    return Hits(np.concatenate(n_words), np.concatenate(n_hit), items, np.concatenate(runs))


def _over(docs: DataFrame, benchmark: DataFrame, size: int, schema, finish: Callable[[pa.RecordBatch, Hits], pa.RecordBatch]) -> DataFrame:
    """``finish(rows, hits)`` of all rows, after the scans of all sets."""
    runs_of, items_of = unused(docs, "_runs"), unused(docs, "_items")
    own = docs.columns
    current = docs
    spark = docs.sparkSession

    def step(shared, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch, ["text"]):
                    state = () if first else (rows.column(runs_of), rows.column(items_of).to_pylist())
                    hits = scan(rows.column("text"), shared.value, *state)
                    rows = rows.select(own)
                    if last:
                        yield finish(rows, hits)
                    else:
                        bounds, (begin, end) = hits.per_row(1, 2)
                        flat = pa.array(np.stack([begin, end], axis=1).ravel(), pa.int64())
                        runs = pa.ListArray.from_arrays(pa.array(bounds * 2, pa.int32()), flat)
                        yield pa.RecordBatch.from_arrays(
                            [*rows.columns, runs, pa.array(hits.items, pa.list_(pa.string()))], names=[*own, runs_of, items_of]
                        )

        return run

    between = T.StructType([
        *docs.schema.fields, T.StructField(runs_of, T.ArrayType(T.LongType())), T.StructField(items_of, T.ArrayType(T.StringType()))
    ])
    pieces, parts = benchmark_pieces(benchmark, size)
    for p in range(parts):
        shared, last = spark.sparkContext.broadcast(window_set(pieces(p))), p == parts - 1
        current = current.mapInArrow(step(shared, p == 0, last), schema if last else between)
        if not last:
            current = written(current, "marked")
    return current


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, items and spans of every row of ``docs`` (doc_id, text).

    ``n_hit`` counts the words that lie in an occurrence of a benchmark window, ``items`` names the items whose windows
    occur (ids as strings, sorted as such), ``spans`` are the runs of hit words as code points (begin, end). Null and empty texts have no words. Repeated
    rows stay, repeated items count once. An empty benchmark hits nothing. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def finish(rows: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        bounds, places = hits.per_row(3, 4)
        spans = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in places], names=["begin", "end"])
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(hits.n_words, pa.int64()), pa.array(hits.n_hit, pa.int64()),
             pa.array(hits.items, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)],
            names=["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    schema = f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<begin: bigint, end: bigint>>"
    return _over(docs.select("doc_id", "text"), benchmark, size, schema, finish)


def cut(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with all their columns, the runs of hit words cut out of ``text``; a text that loses all words stays as what is left."""

    def finish(rows: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        texts = rows.column("text").to_pylist()
        for r, begin, end in reversed(hits.runs[:, [0, 3, 4]].tolist()):
            texts[r] = texts[r][:begin] + texts[r][end:]
        at = rows.schema.get_field_index("text")
        return rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))

    return _over(docs, benchmark, size, docs.schema, finish)


def reject(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, share: float = 0.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, of whose words at most ``share`` are hit."""

    def finish(rows: pa.RecordBatch, hits: Hits) -> pa.RecordBatch:
        return rows.filter(pa.array(hits.n_hit <= share * hits.n_words))

    return _over(docs, benchmark, size, docs.schema, finish)
