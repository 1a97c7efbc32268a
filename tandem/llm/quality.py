"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Terms of a text are its words and pairs of words, and the same of the words' shapes (runs of letters, capitals and
digits as one mark, other signs as they are, and a mark for a word that repeats the one before). A term is a number
below 2^BITS; a text is the sparse vector of its terms' counts over the square root of its number of words. Shards of
a bounded sample are learned apart, in tasks, and their weights averaged; the weights are at most 2^BITS numbers and
are broadcast. Scoring adds the weights of the terms of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.labels import held_out, sample
from tandem.llm.words import Words, mix, running_sums, span_hashes, words_of

BITS = 20
SAMPLE_ROWS = 20_000  # labelled rows that are learned from, at most
SHARDS = 4
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.3, 1.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("x")
_SHAPE[65:91] = ord("X")
_SHAPE[48:58] = ord("9")
_RUNS = np.zeros(256, bool)
_RUNS[[ord("x"), ord("X"), ord("9")]] = True


def shape_hashes(words: Words) -> np.ndarray:
    """A hash of each word's shape; a word that equals the one before it in its text has another one."""
    out = np.empty(len(words.begin), np.uint64)
    for at, to, base, piece in words.blocks():
        marks = _SHAPE[piece]
        begin, end = words.begin[at:to] - base, words.end[at:to] - base
        first = np.ones(len(marks), bool)
        first[1:] = (marks[1:] != marks[:-1]) | ~_RUNS[marks[1:]]
        first[begin] = True
        place = np.concatenate([[0], np.cumsum(first)])
        out[at:to] = span_hashes(running_sums(marks[first], False), place[begin], place[end])
    again = np.zeros(len(out), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.bounds[:-1][words.counts > 0]] = False
    out[again] ^= np.uint64(0x5BD1E995)
    return out


def terms(words: Words) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Term numbers and the rows they belong to, for words, shapes and pairs of either."""
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    same = row[1:] == row[:-1]
    found, rows = [], []
    for kind, one in enumerate((words.hashes, shape_hashes(words))):
        with np.errstate(over="ignore"):
            two = one[:-1][same] * np.uint64(0x9E3779B97F4A7C15) + one[1:][same]
            found += [mix(one + np.uint64(2 * kind)) >> np.uint64(64 - BITS), mix(two + np.uint64(2 * kind + 1)) >> np.uint64(64 - BITS)]
        rows += [row, row[1:][same]]
    return found, rows


def vectors(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, terms, values) of each text of a column."""
    for words in words_of(column):
        found, rows = terms(words)
        row, term = np.concatenate(rows), np.concatenate(found).astype(np.int64)
        order = np.argsort(row, kind="stable")
        bounds = np.searchsorted(row[order], np.arange(len(words.counts) + 1))
        term = term[order]
        for r, n in enumerate(words.counts):
            own, count = np.unique(term[bounds[r] : bounds[r + 1]], return_counts=True)
            yield words.first + r, own, count / np.sqrt(max(n, 1))


class Learner:
    """Follow the regularised leader, with a rate of its own for every term; the last place is the constant."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, term: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(term, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def _learn_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("place")
    made, learner = list(vectors(pa.array(frame.text, pa.string()))), Learner(1 << BITS)
    for _ in range(EPOCHS):
        for (_, term, value), label in zip(made, frame.label):
            learner.learn(term, value, int(label > 0))
    w = learner.weights()
    at = np.flatnonzero(w)
    return pd.DataFrame({"term": at, "weight": w[at]})


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """2^BITS + 1 weights, the last one the constant; all 0 without labels."""
    chosen = sample(docs, labels, "quality", rows).withColumn("place", F.xxhash64("doc_id", F.lit("order")))
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS))
    found = (
        chosen.groupBy(shard.alias("shard")).applyInPandas(_learn_shard, "term int, weight double")
        .groupBy("term").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()
    )
    out = np.zeros((1 << BITS) + 1, np.float32)
    out[found.term.to_numpy()] = found.weight.to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, accept: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts have the score of the constant alone. Repeated rows stay. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for words in words_of(batch.column("text")):
                own = np.zeros(words.last - words.first)
                for term, row in zip(*terms(words)):
                    own += np.bincount(row, w[term], len(own))
                total[words.first : words.last] = own / np.sqrt(np.maximum(words.counts, 1))
            chance = 1 / (1 + np.exp(-np.clip(total + float(w[-1]), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chance)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
