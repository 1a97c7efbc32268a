"""Hard negatives by slots of scores: for each anchor and each of its positives, the best rows of other labels whose
score lies between a share of the positive's score and that score.

The windows of an anchor's positives overlap, but their upper limits, the positives' scores in descending order, part all
scores into disjoint slots (p2, p1], (p3, p2], ... down to the last. Tasks keep the best ``negatives`` rows of each (anchor,
slot) of their rows, and these are merged per slot. The rows of a window are the best of its own slot and all slots below, so one
descending merge of an anchor's slots answers all its windows; the lower limit only ends that list.

Anchors are a stated set of queries and meet all rows, in blocks: rows are dealt into blocks of ``BLOCK_VALUES``
components by the hash of their id, and the anchors are read past each block, so a task holds one block and one batch of
anchors, whatever the number of either. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.store import written

BLOCK_VALUES = 1 << 20  # components in a block of rows
SCORES = 1 << 21  # scores worked out at a time
SCALE = 256
_EXACT = float(1 << 53)  # sums of whole numbers below this are exact in double precision
_LEAST, _MOST = -(1 << 63) + 1, (1 << 63) - 1


def quantised(x: np.ndarray) -> np.ndarray:
    """Whole numbers floor(256 * x), as doubles."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(x.astype(np.float64) * SCALE))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, both whole numbers; beyond 64 bits the largest number of that sign."""
    size_a, size_b = (np.abs(m).max(axis=1, initial=0.0) for m in (a, b))
    with np.errstate(over="ignore", invalid="ignore"):
        wide = max(a.shape[1], 1) * size_a[:, None] * size_b[None, :] >= _EXACT
        out = np.where(wide, 0.0, a @ b.T).astype(np.int64)
    for i, j in np.argwhere(wide):
        exact = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[j].tolist()))
        out[i, j] = min(max(exact, _LEAST), _MOST)
    return out


def _best(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int, group: np.ndarray | None = None) -> np.ndarray:
    """Places of the k entries with the largest score of each row (and group), ties to the smaller column."""
    group = np.zeros(len(row), np.int64) if group is None else group
    order = np.lexsort((col, -score, group, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (group[order][1:] != group[order][:-1])
    starts = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


class Block:
    """Rows of one dimension, by ascending id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.by_label = np.argsort(labels, kind="stable")

    def positives(self, ids, labels, vectors, limits, k):
        """(anchor, 0, row, score) of the k best other rows of each anchor's label."""
        out = []
        for label in np.unique(labels):
            low, high = (np.searchsorted(self.labels[self.by_label], label, side) for side in ("left", "right"))
            own, asked = self.by_label[low:high], np.flatnonzero(labels == label)
            for at in range(0, len(asked) if len(own) else 0, max(1, SCORES // max(len(own), 1))):
                pick = asked[at : at + max(1, SCORES // len(own))]
                found = scores(vectors[pick], self.vectors[own])
                found[ids[pick][:, None] == self.ids[own][None, :]] = _LEAST - 1
                take = min(k, len(own))
                least = np.partition(found, len(own) - take, axis=1)[:, len(own) - take]
                row, col = np.nonzero((found >= least[:, None]) & (found >= _LEAST))
                best = _best(row, col, found[row, col], k)
                row, col = row[best], col[best]
                out.append((ids[pick[row]], np.zeros(len(row), np.int64), self.ids[own[col]], found[row, col]))
        return out

    def negatives(self, ids, labels, vectors, limits, k, low, high):
        """(anchor, slot, row, score) of the k best rows of other labels in each slot of each anchor."""
        out, step = [], max(1, SCORES // max(len(self.ids), 1))
        width = max((len(x) for x in limits), default=0)
        # slots end at the positives' scores; a missing positive opens no slot
        upper = np.array([x + [_LEAST - 1] * (width - len(x)) for x in limits], np.int64).reshape(len(limits), width)
        floor = np.array([min([_MOST, *(window_floor(p, low, high) for p in x if window_floor(p, low, high) <= p)]) for x in limits], np.int64)
        for at in range(0, len(ids), step):
            pick = slice(at, at + step)
            found = scores(vectors[pick], self.vectors)
            fits = (found >= floor[pick][:, None]) & (found <= upper[pick][:, :1]) & (labels[pick][:, None] != self.labels[None, :])
            row, col = np.nonzero(fits)
            score = found[row, col]
            slot = (upper[pick][row] >= score[:, None]).sum(axis=1) - 1
            best = _best(row, col, score, k, slot)
            out.append((ids[pick][row[best]], slot[best], self.ids[col[best]], score[best]))
        return out


def window_floor(positive: int, low: int, high: int) -> int:
    """The least whole score s with low * positive <= high * s."""
    return min(max(-((-low * int(positive)) // high), _LEAST), _MOST)


def _stream(kernel: Callable):
    """Reads rows sorted by block, rows of the table before anchors; holds the rows of one block."""

    def arrays(batch: pa.RecordBatch):
        """(ids, labels, vectors, limits) of each dimension in the batch."""
        vector = batch.column("vector")
        sizes = np.asarray(vector.value_lengths())
        for dim in np.unique(sizes):
            own = batch.take(pa.array(np.flatnonzero(sizes == dim))) if (sizes != dim).any() else batch
            flat = own.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield int(dim), (
                own.column("vec_id").to_numpy(), own.column("label").to_numpy(),
                quantised(flat.reshape(own.num_rows, int(dim))), own.column("limits").to_pylist(),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, gathered, blocks = None, {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, asked = batch.column("block").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((block[1:] != block[:-1]) | (asked[1:] != asked[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(block)]):
                if block[a] != open_:
                    open_, gathered, blocks = block[a], {}, None
                for dim, part in arrays(batch.slice(a, b - a)):
                    if not asked[a]:
                        gathered.setdefault(dim, []).append(part[:3])
                        continue
                    if blocks is None:
                        blocks = {d: Block(*(np.concatenate(c) for c in zip(*p))) for d, p in gathered.items()}
                        gathered = {}
                    found = kernel(blocks[dim], *part) if dim in blocks else []
                    if found:
                        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "vec_id", "score"])

    return run


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, kernel: Callable, k: int) -> DataFrame:
    """The best k rows per (anchor, slot) that ``kernel`` finds, over all blocks. ``anchors``: vec_id, label, vector, limits."""
    columns = ["block", "asked", "vec_id", "label", "vector", "limits"]
    stored = rows.withColumns({
        "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), "asked": F.lit(False),
        "limits": F.lit(None).cast("array<bigint>"),
    })
    asked = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "asked": F.lit(True)})
    dealt = stored.select(*columns).union(asked.select(*columns)).repartition(blocks, "block")
    found = dealt.sortWithinPartitions("block", "asked", "vec_id").mapInArrow(
        _stream(kernel), "anchor_id bigint, slot bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)


def mine(
    embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings``: vec_id, label, embedding. A row's score is its inner product with the anchor over floor(256 * x); a
    higher score comes first, ties go to the smaller id. An anchor's positives are its first ``positives`` other rows of the same
    label, all if fewer. For each, the first ``negatives`` rows of other labels are returned whose score s has
    low * p <= high * s <= high * p, p being the positive's score.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. Rows that repeat an id count
    once, the one with the least label and vector. Vectors of another dimension than the anchor's have no score. A score
    beyond 64 bits is the largest number of its sign. Other columns are not read.
    """
    c = F.col("vector")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = embeddings.select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vector"))
    whole = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & c.isNotNull() & finite)
    once = whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    rows = written(once.select("vec_id", "r.label", "r.vector"), "negatives-rows")
    values = rows.agg(F.sum(F.greatest(F.size("vector"), F.lit(1)).cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-values // BLOCK_VALUES))
    anchors = rows.where(is_anchor)

    best = _meet(
        rows, anchors.withColumn("limits", F.lit(None).cast("array<bigint>")), blocks,
        lambda block, *asked: block.positives(*asked, positives), positives,
    )
    own = written(best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
                              (F.col("_rank") - 1).alias("slot")), "negatives-positives")
    # at most ``positives`` numbers a row
    by_slot = F.array_sort(F.collect_list(F.struct("slot", "positive_score")))
    limits = own.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(by_slot, lambda s: s.positive_score).alias("limits"))
    slots = _meet(
        rows, anchors.join(limits, "vec_id"), blocks,
        lambda block, *asked: block.negatives(*asked, negatives, low, high), negatives,
    )
    # the suffix merge: a window's rows are the first of its own slot and those below
    entry = F.struct((-F.col("score")).alias("down"), "vec_id", "slot")
    merged = slots.groupBy("anchor_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    first = F.slice(F.filter("all", lambda e: e.slot >= F.col("slot")), 1, negatives)
    answered = own.join(merged, "anchor_id").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(first).alias("at", "e")
    )
    wide = lambda x: F.col(x).cast("decimal(25,0)")
    out = answered.select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("negative_id"), "positive_score",
        (-F.col("e.down")).alias("negative_score"),
    )
    return out.where(F.lit(low) * wide("positive_score") <= F.lit(high) * wide("negative_score"))
