"""Exact Jaccard join of word n-gram sets by partitioning the universe of shingles.

Sizes fall into bands so that similar sets are in one band or in neighbouring ones. For the larger set's band the two
sets differ in at most H shingles. Shingles are hashed into segments, and each segment is allotted 1 or 2: a segment
allotted 1 is indexed by the hash of the set's subset in it, one allotted 2 also by the hashes of that subset with one
shingle left out. The allotments add up to H + 1 + slack, so the segments in which the two sets have a key in common are
allotted at least slack + 1: a pair shares a key outside the segments that are (nearly) empty in both, unless these are
allotted more than the slack in both sets, which then index their empty segments too. How many segments are allotted 2,
and the slack, are chosen per band by the cost of keys written and of chance collisions at the band's number of sets.

A set is known by a 64-bit fingerprint, so copies of a text are one. Sets under a common key are first compared
with the one that shares most keys, which joins groups of near copies without all their pairs. Then all
sets under a key that are not yet in one component are compared, in blocks, within tasks: no link between components
is lost, and only pairs that may link leave the task. Sets are compared by parity signatures: the bits in which two
signatures differ are at most the shingles in which the sets differ, so a pair with more of them than the threshold
allows does not link. The pairs that remain are verified on their texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.store import limited, written
from tandem.llm.words import mix, slices, sorted_sets, words_of
from tandem.operators.distributed import components, order_number

_SEEN = 500_000  # fingerprints that a task remembers, so as not to index its copies again


@dataclass(frozen=True)
class Scheme:
    """How sets are indexed for pairs whose larger set is in one band."""

    ones: int
    twos: int
    slack: int

    @property
    def segments(self) -> int:
        return self.ones + self.twos


class Join:
    """The threshold: two sets link when ``den`` * intersection >= ``num`` * union."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def band_starts(self, largest: int) -> list[int]:
        """Smallest size of each band; the partners of a size are in its band or the next ones to it."""
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * self.den // self.num + 1)
        return starts

    def most_different(self, larger: int) -> int:
        """The symmetric difference that two linked sets of at most ``larger`` shingles can have."""
        return 2 * larger * (self.den - self.num) // (self.den + self.num)

    def allot(self, least: int, larger: int, sets: float) -> Scheme | None:
        """The cheapest scheme for ``sets`` sets of least to larger shingles; None if only equal sets link."""
        h = self.most_different(larger)
        return None if h == 0 else _allot(h, (least + larger) / 2, round(np.log2(max(2.0, sets))))


@functools.cache
def _allot(h: int, size: float, log_sets: int) -> Scheme:
    sets, shared = 2.0**log_sets, 1e-4  # chance that two lone shingles of unrelated texts are the same
    best = None
    for slack in sorted({0, 1, 2, 3, *(int(h * x) for x in (0.01, 0.02, 0.04, 0.08))}):
        for twos in sorted({0, 1, 2, 4, (h + 1 + slack) // 4, (h + 1 + slack) // 2}):
            ones = h + 1 + slack - 2 * twos
            if ones < 0 or 2 * twos > h + 1 + slack:
                continue
            fill = size / (ones + twos)
            empty, lone = np.exp(-fill), fill * np.exp(-fill)
            # sets with more weak segments than the slack index these: they meet all their like there
            weak = ones * empty + 2 * twos * (empty + lone)
            deviation = np.sqrt(weak) + 1e-9
            over = min(1.0, np.exp(-0.5 * max(0.0, (slack + 1 - weak) / deviation) ** 2)) if weak < slack + 1 else 1.0
            meet = over**2 * weak * (empty + 1e-12) + shared * (ones * lone**2 + twos * (2 * lone * empty + lone**2) ** 2)
            cost = ones + twos * (fill + 1) + over * weak + 25.0 * sets * meet
            if best is None or cost < best[0]:
                best = (cost, Scheme(ones, twos, slack))
    return best[1]


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number, and the places 0, 1, ... within it, ``counts`` times."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def segment_keys(tokens: np.ndarray, bounds: np.ndarray, row: np.ndarray, band: np.ndarray, schemes: list[Scheme | None]):
    """(row, key) of the sets of ``row`` under the schemes of ``band``."""
    use = np.array([schemes[b] is not None for b in band], bool)
    row, band = row[use], band[use]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ones, twos, slack = (np.array([getattr(schemes[b], k) for b in band]) for k in ("ones", "twos", "slack"))
    segments = ones + twos
    base = np.cumsum(segments) - segments
    size = bounds[row + 1] - bounds[row]
    of, place = _ranges(size)
    token = tokens[bounds[row][of] + place]
    salt = mix((band.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    dealt = mix(token ^ salt[of])
    segment = ((dealt >> np.uint64(32)) * segments[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    slot = base[of] + segment
    total = int(segments.sum())
    print_ = mix(token)
    low = np.bincount(slot, (print_ & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(slot, (print_ >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    count = np.bincount(slot, minlength=total)
    entry, at = _ranges(segments)
    with np.errstate(over="ignore"):
        content = low + (high << np.uint64(32))
        name = mix(salt[entry] + at.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        key = mix(content ^ name)
    double = at >= ones[entry]
    weak = count <= double
    weight = np.bincount(entry, weak * (1 + double), len(row))
    write = (count > 0) | (weight > slack)[entry]
    out_row, out_key = [row[entry[write]]], [key[write]]
    # one shingle left out, in the segments allotted 2
    left = double[slot]
    if left.any():
        with np.errstate(over="ignore"):
            rest = mix((content[slot[left]] - print_[left]) ^ name[slot[left]])
        keep = (count[slot[left]] > 1) | (weight > slack)[of[left]]
        out_row.append(row[of[left]][keep])
        out_key.append(rest[keep])
    return np.concatenate(out_row), np.concatenate(out_key)


def fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number per set; 0 for the empty set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(1)))])
        size = np.diff(bounds)
        out = mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64))
    out[size == 0] = 0
    return out


def signatures(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of all sets as 64-bit words, and the bounds per set.

    A signature has a power of two of bits, at least twice as many as the set has shingles; a bit is 1 if an odd number
    of shingles end in its number. Its halves, combined by exclusive or, are the signature of half as many bits.
    """
    size = np.diff(bounds)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(size)), size)
    place = base[row] + (tokens & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8"), base // 64


def folded(words: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """(sets, width): the signatures brought down to ``width`` words."""
    out = np.zeros((len(bounds) - 1, width), np.uint64)
    for r, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        out[r] = np.bitwise_xor.reduce(words[a:b].reshape(-1, width), axis=0)
    return out


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text")):
                tokens, bounds = sorted_sets(words, n)
                marks, ends = signatures(tokens, bounds)
                marks = pa.Array.from_buffers(
                    pa.binary(), len(ends) - 1, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(marks)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(words.first, words.last - words.first), pa.array(np.diff(bounds)),
                     pa.array(fingerprints(tokens, bounds).view(np.int64)), marks],
                    names=["doc_id", "n_shingles", "fp", "marks"],
                )

    return run


def _index(n: int, starts: list[int], schemes: list[Scheme | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for words in words_of(batch.column("text")):
                tokens, bounds = sorted_sets(words, n)
                print_ = fingerprints(tokens, bounds)
                fresh = []
                for r, p in enumerate(print_.tolist()):
                    if p and p not in seen:
                        fresh.append(r)
                        if len(seen) < _SEEN:
                            seen.add(p)
                row = np.array(fresh, np.int64)
                band = np.searchsorted(starts, np.diff(bounds)[row], "right") - 1
                parts = [segment_keys(tokens, bounds, row, band, schemes), segment_keys(tokens, bounds, row, band + 1, schemes)]
                rows, keys = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(print_[rows].view(np.int64))], names=["key", "fp"]
                )

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and fp: the distinct ones whose key another fp has too. Remembers one row only."""
    held = None  # the last distinct row, and whether the one before it has its key
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if held is not None:
            key, fp = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], fp])
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp = key[first], fp[first]
        same = key[1:] == key[:-1]
        before = np.concatenate([[held is not None and held[2]], same])
        keep = before[:-1] | same
        held = (key[-1], fp[-1], bool(before[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(fp[:-1][keep])], names=["key", "fp"])
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], names=["key", "fp"])


def _marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit words of a column of signatures, and the bounds per row."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, "<u8", (ends[-1] - ends[0]) // 8, ends[0]), (ends - ends[0]) // 8


def may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sizes and the signatures (rows of x and y) allow a link."""
    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    fits = den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)
    return fits & (differ <= (nx + ny) * (den - num) // (den + num))


def _sift(num: int, den: int):
    """Pairs (a, b, size and signature of both) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, bx), (y, by) = _marks(batch.column("marks_a")), _marks(batch.column("marks_b"))
            width = np.minimum(np.diff(bx), np.diff(by))
            nx, ny = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            good = np.zeros(batch.num_rows, bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                left = np.stack([np.bitwise_xor.reduce(x[bx[i] : bx[i + 1]].reshape(-1, w), axis=0) for i in at])
                right = np.stack([np.bitwise_xor.reduce(y[by[i] : by[i + 1]].reshape(-1, w), axis=0) for i in at])
                good[at] = may_link(left, right, nx[at], ny[at], num, den)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


BLOCK = 512  # sets under a key that are compared at a time
_STEP = 1 << 16  # pairs that are compared at a time


def _compare_groups(group, block, same, root, fp, size, marks, ends, num, den):
    """Pairs of fingerprints of different components within each group that may link. Rows are sorted by group."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    narrow = np.repeat(np.minimum.reduceat(np.diff(ends), first), np.diff(np.append(first, len(group))))
    found = []
    for width in np.unique(narrow):
        rows = np.flatnonzero(narrow == width)
        bits = np.stack([np.bitwise_xor.reduce(marks[ends[r] : ends[r + 1]].reshape(-1, width), axis=0) for r in rows])
        g, k, s, c, n = group[rows], block[rows], same[rows], root[rows], size[rows]
        left, step = np.arange(len(rows)), 1
        while True:
            left = left[left + step < len(rows)]
            left = left[g[left] == g[left + step]]
            if not len(left):
                break
            ask = left[(c[left] != c[left + step]) & (s[left] | (k[left] != k[left + step]))]
            for a in range(0, len(ask), _STEP):
                x = ask[a : a + _STEP]
                x = x[may_link(bits[x], bits[x + step], n[x], n[x + step], num, den)]
                found.append((fp[rows[x]], fp[rows[x + step]]))
            step += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _compare(num: int, den: int):
    """Reads rows sorted by key and blocks; remembers the rows of one group, which has at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def pairs(table):
            columns = [table.column(c).to_numpy() for c in ("key", "i", "j", "block", "root", "fp", "n")]
            key, i, j, block, root, fp, size = columns
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            marks, ends = _marks(table.column("marks"))
            a, b = _compare_groups(np.cumsum(new), block, i == j, root, fp, size, marks, ends, num, den)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_batches([held, batch]) if held is not None else batch
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            last = int(np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[-1:].sum() + 1) if (
                (key[0], i[0], j[0]) != (key[-1], i[-1], j[-1])
            ) else 0
            held = table.slice(last)
            if last:
                yield pairs(table.slice(0, last))
        if held is not None:
            yield pairs(held)

    return run


def _verify(n: int, num: int, den: int):
    def sets(column):
        flat, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for words in words_of(column):
            tokens, own = sorted_sets(words, n)
            bounds.append(own[1:] + bounds[-1][-1])
            flat.append(tokens)
        return np.concatenate(flat), np.concatenate(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, ["text_a", "text_b"]):
                (x, bx), (y, by) = sets(rows.column("text_a")), sets(rows.column("text_b"))
                right = (fingerprints(x, bx).view(np.int64) == rows.column("a").to_numpy()) & (
                    fingerprints(y, by).view(np.int64) == rows.column("b").to_numpy()
                )
                good = np.zeros(rows.num_rows, bool)
                for r in np.flatnonzero(right):
                    p, q = x[bx[r] : bx[r + 1]], y[by[r] : by[r + 1]]
                    both = np.sort(np.concatenate([p, q]))
                    common = int((both[1:] == both[:-1]).sum())
                    good[r] = den * common >= num * (len(both) - common)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("a").filter(pa.array(good)), rows.column("b").filter(pa.array(good))], names=["a", "b"]
                )

    return run


def _verified(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of fingerprints whose sets link."""
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    found = joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify(join.n, join.num, join.den), "a bigint, b bigint")
    return written(found, "links")


def link(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Two texts link when ``den`` * intersection >= ``num`` * union of their n-word shingle sets; component_id is the
    smallest doc_id that links reach. A text with fewer than n words has one shingle, all its words. Texts without
    words, null or empty, and rows without id have no links; component_id is then their own id. Rows that repeat an id
    or a text are linked with it. Other columns are not read.
    """
    join = Join(n, num, den)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sized = written(docs.mapInArrow(_sizes(n), "doc_id bigint, n_shingles bigint, fp bigint, marks binary"), "sets")
    real = sized.where("doc_id IS NOT NULL AND n_shingles > 0").drop("marks")
    classes = written(
        real.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size")), "set-classes"
    )
    largest = classes.agg(F.max("size")).first()[0] or 0
    starts = join.band_starts(largest)
    bands = F.array(*[F.lit(s) for s in starts])
    tally = dict(
        classes.groupBy(F.size(F.filter(bands, lambda s: s <= F.col("size"))).alias("band")).count().collect()
    )  # a row per band: bands grow by a factor, so there are few
    schemes: list[Scheme | None] = []
    for b in range(len(starts)):
        end = starts[b] * den // num
        schemes.append(join.allot(starts[max(0, b - 1)], end, tally.get(b + 1, 0) + tally.get(b, 0)))

    keyed = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_index(n, starts, schemes), "key bigint, fp bigint")
    common = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_shared_keys, "key bigint, fp bigint")
    common = written(common, "common-keys")

    # size, signature and text of the sets that share a key
    fame = common.groupBy("fp").agg(F.count("*").alias("fame"))
    known = classes.join(fame, "fp").select("fp", F.col("rep").alias("doc_id"), "fame")
    known = written(known, "shared-sets")
    by_id = known.select("fp", "doc_id")
    marked = sized.join(limited(by_id, known.count()), ["fp", "doc_id"]).select("fp", F.col("n_shingles").alias("n"), "marks")
    marked = written(marked.dropDuplicates(["fp"]), "signatures")
    texts = docs.join(limited(by_id, known.count()), "doc_id").select("fp", "text")

    hubs = common.join(known, "fp").groupBy("key").agg(F.max_by("fp", order_number(F.col("fame"), F.col("fp"))).alias("hub"))
    near = common.join(hubs, "key").where("fp <> hub").select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b"))
    near = (
        near.distinct().join(marked.toDF("a", "n_a", "marks_a"), "a").join(marked.toDF("b", "n_b", "marks_b"), "b")
        .mapInArrow(_sift(num, den), "a bigint, b bigint")
    )
    first = _verified(near, texts, join)
    roots = components(first)
    # what the hubs have not joined: sets of different components under a common key
    placed = common.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = placed.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    ).where("lo <> hi").select("key", "blocks")
    dealt = (
        placed.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "fp", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    rest = (
        dealt.join(marked, "fp").select("key", "i", "j", "block", "root", "fp", "n", "marks")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(num, den), "a bigint, b bigint")
        .distinct()
    )
    second = _verified(written(rest, "other-pairs"), texts, join)
    roots = components(first.union(second))

    member = classes.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "rep")
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    groups = member.join(least, "root").select("fp", "least")
    ids = classes.join(groups, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    linked = real.join(ids, "fp").select("doc_id", "n_shingles", "component_id")
    alone = sized.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone)
