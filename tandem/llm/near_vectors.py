"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, exact verification.

A vector is rotated by three rounds of random signs and a Hadamard transform; its hash is the axis, with sign, of the
largest coordinate. A bucket is the pair of two such hashes; every vector is stored in one bucket per table and looks
into ``PROBES`` buckets more, those of its next largest coordinates. Copies of a vector are one before hashing. Buckets with more
than ``BLOCK`` members are cut into blocks that are compared two by two, so a task never holds more than two blocks,
whatever the size of a bucket, and no member is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.store import written
from tandem.operators.distributed import components

TABLES = 10
PROBES = 5
BLOCK = 512
SEED = 20260


def usable(vector: str):
    """Not null, not zero, without null or non-finite components."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def _rotated(x: np.ndarray, table: int, part: int) -> np.ndarray:
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table, part, size]).choice([-1.0, 1.0], (3, size))
    for s in signs:
        out = _hadamard(out * s) / np.sqrt(size)
    return out


def codes(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers; the first is the vector's own."""
    rows, out = np.arange(len(x))[:, None], np.empty((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        axes, lacks = [], []
        for part in range(2):
            turned = _rotated(x, t, part)
            take = min(probes + 1, turned.shape[1])
            top = np.argpartition(-np.abs(turned), take - 1, axis=1)[:, :take]
            size = np.abs(turned)[rows, top]
            order = np.argsort(-size, axis=1, kind="stable")
            top, size = top[rows, order], size[rows, order]
            axes.append(top * 2 + (turned[rows, top] < 0))
            lacks.append((size[:, :1] - size) ** 2)
        # the pairs of axes whose squared gaps to the best axes sum to the least
        gaps = lacks[0][:, :, None] + lacks[1][:, None, :]
        pairs = axes[0][:, :, None] * (4 << 32) + axes[1][:, None, :]
        flat = np.argsort(gaps.reshape(len(x), -1), axis=1, kind="stable")[:, : probes + 1]
        picked = pairs.reshape(len(x), -1)[rows, flat]
        out[:, t, : picked.shape[1]] = picked
        out[:, t, picked.shape[1] :] = picked[:, :1]
    return out


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = batch.slice(at, 1024)
            vectors = rows.column("vector").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes):
                pick = np.flatnonzero(sizes == size)
                own = rows.take(pa.array(pick))
                found = codes(_stacked([vectors[i] for i in pick]))
                yield pa.RecordBatch.from_arrays(
                    [own.column("rep"), own.column("label"), pa.array(np.full(len(pick), size, np.int32)),
                     pa.array(found.reshape(len(pick), -1).tolist(), pa.list_(pa.int64()))],
                    names=["rep", "label", "size", "codes"],
                )


_STEP = 1 << 15  # pairs that are compared at a time


def _pairs(group, block, same, own, rep, table, stored, x, least):
    """Pairs (a < b) within the groups whose cosine is large enough. Rows are sorted by group; x has the vectors' rows."""
    norm = np.sqrt((x * x).sum(1))
    found = []
    left, step = np.arange(len(group)), 1
    while True:
        left = left[left + step < len(group)]
        left = left[group[left] == group[left + step]]
        if not len(left):
            break
        right = left + step
        fits = (rep[left] != rep[right]) & (own[left] | own[right]) & (same[left] | (block[left] != block[right]))
        for at in range(0, len(left), _STEP):
            a = left[at : at + _STEP][fits[at : at + _STEP]]
            b = a + step
            a = a[(x[a] * x[b]).sum(1) >= least * norm[a] * norm[b] * (1 - 1e-12)]
            b = a + step
            cosine = (x[a] * x[b]).sum(1) / (norm[a] * norm[b])
            a = a[cosine >= least]
            b = a + step
            # a pair that an earlier table has in one bucket has been found there
            earlier = ((stored[a] == stored[b]) & (np.arange(stored.shape[1]) < table[a][:, None])).any(1)
            a, b = a[~earlier], b[~earlier]
            found.append((np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])))
        step += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


_GROUP = ("label", "table", "size", "code", "i", "j")


def _compare(least: float):
    """Reads rows sorted by bucket and blocks; remembers the rows of one group, which has at most two blocks."""

    def lists(column) -> np.ndarray:
        """(rows, width) of a column of lists of one length."""
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def pairs(rows):
        keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in _GROUP], axis=1)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        group, size, out = np.cumsum(new), keys[:, 2], []
        for dim in np.unique(size):
            pick = np.flatnonzero(size == dim)
            own = rows.take(pa.array(pick)) if len(pick) < len(size) else rows
            flag = own.column("own").to_numpy(zero_copy_only=False)
            out.append(_pairs(
                group[pick], own.column("block").to_numpy(), keys[pick, 4] == keys[pick, 5], flag, own.column("rep").to_numpy(),
                keys[pick, 1], lists(own.column("stored")), lists(own.column("vector")).astype(np.float64), least,
            ))
        a, b = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in _GROUP], axis=1)
            other = np.flatnonzero((keys != keys[-1]).any(1))
            last = int(other[-1]) + 1 if len(other) else 0
            held = rows.slice(last)
            if last:
                yield pairs(rows.slice(0, last))
        if held is not None:
            yield pairs(held)

    return run


def near_pairs(classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b) of classes whose cosine is at least ``least``; ``classes``: rep, label, vector."""
    hashed = written(classes.mapInArrow(_hash, "rep bigint, label int, size int, codes array<bigint>"), "hashes")
    each = 1 + PROBES
    entries = hashed.select("rep", "label", "size", F.posexplode("codes").alias("at", "code")).select(
        "rep", "label", "size", F.expr(f"int(at div {each})").alias("table"), "code", (F.col("at") % each == 0).alias("own")
    )
    entries = entries.groupBy("rep", "label", "size", "table", "code").agg(F.max("own").alias("own"))
    bucket = ["label", "table", "size", "code"]
    counts = entries.groupBy(*bucket).agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 AND any")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = entries.join(counts.select(*bucket, blocks.alias("blocks")), bucket).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    )
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *bucket, "rep", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    stored = F.transform(F.sequence(F.lit(0), F.lit(TABLES - 1)), lambda t: F.get("codes", t * each))
    vectors = classes.select("rep", "vector").join(hashed.select("rep", stored.alias("stored")), "rep")
    fields = [*bucket, "i", "j", "block", "own", "rep", "stored", "vector"]
    return (
        dealt.join(vectors, "rep").select(*fields)
        .repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")
        .mapInArrow(_compare(least), "a bigint, b bigint")
        .distinct()
    )


def deduplicate(embeddings: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings`` (vec_id, embedding, label).

    Only vectors of one label and one dimension are compared. A vector that is null, zero or holds null or non-finite
    components, or whose label or id is null, links with nothing and is its own component. Rows with the same vector
    and label link with each other. A repeated vec_id counts as another vector each time. Other columns are not read.
    """
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector"), F.col("label").cast("int").alias("label"))
    good = rows.where(usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    groups = good.groupBy("label", "vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("members"))
    # a class is known by a number of its own: an id that occurs with two vectors has two classes
    classes = written(groups.withColumn("rep", F.monotonically_increasing_id()), "classes")
    pairs = written(near_pairs(classes.select("rep", "label", "vector"), least), "pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("rep", "other")
    degree = (
        both.join(classes.select(F.col("rep").alias("other"), F.col("members").alias("n")), "other")
        .groupBy("rep").agg(F.sum("n").alias("others"))
    )
    roots = components(pairs).withColumnRenamed("node", "rep")
    named = roots.join(classes.select("rep", "least_id"), "rep").groupBy("root").agg(F.min("least_id").alias("component_id"))
    facts = (
        classes.join(degree, "rep", "left").join(roots.join(named, "root").select("rep", "component_id"), "rep", "left")
        .select("label", "vector", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "least_id").alias("component_id"))
    )
    linked = good.join(facts, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
