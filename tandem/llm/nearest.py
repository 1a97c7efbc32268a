"""Nearest neighbours by counting collisions in sorted single projections.

Rows are dealt into blocks by the hash of their id, and every block answers every block of queries. Within a block each
of ``PROJECTIONS`` random directions has a sorted array of the rows' projections. Around a query's projection a window
of half-width ``HALF_WIDTH`` x radius is opened in every array; the radius grows step by step (virtual rehashing), and
only the entries that a window gains are counted. A row that lies in at least ``THRESHOLD`` of the windows is verified
with its exact distance. A row within the radius lies in a window with probability 0.79, so it misses the threshold
with a probability below 0.001; the search ends when the k-th distance found is within the radius, or all rows are
verified. No number of candidates is capped. The best k of all blocks are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.near_vectors import usable

PROJECTIONS = 64
HALF_WIDTH = 1.25
THRESHOLD = 40
GROWTH = 1.2
BLOCK_VALUES = 1 << 19  # components in a block
QUERY_ROWS = 1024
SEED = 771


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, row id, distance) of the k nearest rows found in the block for each query."""
    n, dim = x.shape
    directions = np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))
    projected = x @ directions
    order = np.argsort(projected, axis=0, kind="stable").T.copy()
    values = np.take_along_axis(projected.T, order, axis=1)
    places = queries @ directions
    spread = np.sqrt(2 * np.maximum(x.var(axis=0).sum(), 1e-300))  # the rows' root mean square distance
    out = []
    for query_id, query, place in zip(query_ids, queries, places):
        counts, seen = np.zeros(n, np.int32), ids == query_id
        low = high = None
        found, radius = [(np.zeros(0, np.int64), np.zeros(0))], spread / 8
        while True:
            a = np.array([np.searchsorted(values[i], place[i] - HALF_WIDTH * radius, "left") for i in range(PROJECTIONS)])
            b = np.array([np.searchsorted(values[i], place[i] + HALF_WIDTH * radius, "right") for i in range(PROJECTIONS)])
            if low is None:
                gained = [order[i, a[i] : b[i]] for i in range(PROJECTIONS)]
            else:
                gained = [order[i, a[i] : low[i]] for i in range(PROJECTIONS)]
                gained += [order[i, high[i] : b[i]] for i in range(PROJECTIONS)]
            low, high = a, b
            counts += np.bincount(np.concatenate(gained), minlength=n).astype(np.int32)
            new = np.flatnonzero((counts >= THRESHOLD) & ~seen)
            if len(new):
                seen[new] = True
                found.append((ids[new], np.sqrt(((x[new] - query) ** 2).sum(1))))
            if seen.all():
                break
            near = np.concatenate([d for _, d in found])
            if len(near) >= k and np.partition(near, k - 1)[k - 1] <= radius:
                break
            radius *= GROWTH
        near_ids, near = (np.concatenate(c) for c in zip(*found))
        best = np.lexsort((near_ids, near))[:k]
        out.append((np.full(len(best), query_id), near_ids[best], near[best]))
    return out


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _answer(k: int):
    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.drop_duplicates("vec_id")
            queries = queries.drop_duplicates("vec_id")
            size, asked = rows.vector.map(len), queries.vector.map(len)
            for dim in set(size) & set(asked):
                own, ask = rows[size == dim], queries[asked == dim]
                out += search_block(
                    own.vec_id.to_numpy(), _stacked(own.vector), ask.vec_id.to_numpy(), _stacked(ask.vector), k
                )
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def search(embeddings: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (the distance) of the k nearest rows found for every row where ``is_query``.

    Nearest first, ties to the smaller id; all other rows, if there are fewer than k. Vectors that are null, zero or
    hold null or non-finite components, or have no id, take no part; rows of another dimension than the query's are no
    candidates. Rows that repeat an id count once. Other columns are not read.
    """
    rows = embeddings.select("vec_id", F.col("embedding").alias("vector")).where(
        usable("vector") & F.col("vec_id").isNotNull()
    )
    facts = rows.agg(
        F.count("*").alias("n"), F.count_if(is_query).alias("asked"), F.max(F.size("vector")).alias("dim")
    ).first()
    height = max(64, BLOCK_VALUES // max(1, facts.dim or 1))
    blocks, parts = -(-facts.n // height) or 1, -(-facts.asked // QUERY_ROWS) or 1
    by = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = rows.select("vec_id", "vector", by(blocks).alias("block"), every(parts).alias("part"))
    asked = rows.where(is_query).select("vec_id", "vector", every(blocks).alias("block"), by(parts).alias("part"))
    found = (
        stored.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
        .applyInPandas(_answer(k), "query_id bigint, vec_id bigint, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
