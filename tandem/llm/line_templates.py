"""Line dedup with a log-template tree.

A line's path in the tree is its number of words, then its first ``DEPTH`` words, words with a digit standing for any such
word. The rest is taken in ``PARTS`` parts; below the leaf, a template fixes all of them but one, whose words are the
variable field. So a line has up to ``PARTS`` templates, and two lines share one if their words differ in one part only (and
in words with digits). Lines with fewer than ``LEAST_VARIED`` words have one template, without a variable part. A template that
occurs in ``LEAST_DOCS`` documents or more recurs: its lines are dropped everywhere but in the first document.

The templates of a line do not depend on the order of lines, so they are counted with one grouped count that combines
before the shuffle; no leaf's lines are ever brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.store import unused, written
from tandem.llm.words import mix, words_of

DEPTH = 3
PARTS = 4
LEAST_WORDS = 3  # shorter lines are kept
LEAST_VARIED = 8
LEAST_DOCS = 5

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ANY = np.uint64(0x5851F42D4C957F2D)


def templates(words):
    """(row, line number, template) of all lines with enough words."""
    n = len(words.begin)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    token = words.hashes.copy()
    for at, to, base, piece in words.blocks():
        digits = np.concatenate([[0], np.cumsum(_DIGIT[piece])])
        varies = digits[words.end[at:to] - base] > digits[words.begin[at:to] - base]
        token[at:to][varies] = _ANY
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    breaks = np.flatnonzero(words.raw[words.offsets[words.first] : words.offsets[words.last]] == 10) + words.offsets[words.first]
    line = np.searchsorted(breaks, words.begin) - np.searchsorted(breaks, words.offsets[words.first : words.last])[row]
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    keep = size >= LEAST_WORDS
    start, size = start[keep], size[keep]
    with np.errstate(over="ignore"):
        leaf = mix(size.astype(np.uint64))
        for k in range(DEPTH):
            leaf = mix(leaf * np.uint64(0x9E3779B97F4A7C15) + token[start + np.minimum(k, size - 1)])
        # the parts: the word k of what follows the leading words is in part k * PARTS // rest
        rest = size - np.minimum(DEPTH, size)
        each = np.repeat(np.arange(len(start)), rest)
        k = np.arange(len(each)) - np.repeat(np.cumsum(rest) - rest, rest)
        part = k * PARTS // np.maximum(rest[each], 1)
        value = mix(token[start[each] + DEPTH + k] + mix(k.astype(np.uint64) + np.uint64(1)))
        slot = each * PARTS + part
        low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), len(start) * PARTS).astype(np.uint64)
        high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), len(start) * PARTS).astype(np.uint64)
        sums = (low + (high << np.uint64(32))).reshape(-1, PARTS)
        whole = sums.sum(axis=1, dtype=np.uint64)
        fixed = mix(leaf ^ mix(whole + np.uint64(PARTS)))
        varied = [mix(leaf ^ mix(whole - sums[:, p] + np.uint64(p))) for p in range(PARTS)]
    short = size < LEAST_VARIED
    found = [(start[short], fixed[short])] + [(start[~short], v[~short]) for v in varied]
    place = np.concatenate([s for s, _ in found])
    return row[place], line[place], np.concatenate([t for _, t in found])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in words_of(batch.column("text")):
            row, line, template = templates(words)
            order = np.lexsort((line, template, row))
            row, line, template = row[order], line[order], template[order]
            first = np.ones(len(row), bool)  # a template counts once per document
            first[1:] = (row[1:] != row[:-1]) | (template[1:] != template[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(template.view(np.int64)), batch.column("doc_id").take(pa.array(words.first + row)),
                 pa.array(line.astype(np.int32)), pa.array(first)],
                names=["template", "doc_id", "line", "first"],
            )


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id and line (number, from 0) of every line to drop.

    Null and empty texts have none; rows without id are left alone. Rows that repeat an id are one document: they lose
    no line to each other, and a line number that one of them loses is lost by all.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    lines = written(docs.mapInArrow(_lines, "template bigint, doc_id bigint, line int, first boolean"), "lines")
    recurring = (
        lines.where("first").groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("keeper"))
        .where(F.col("docs") >= least_docs).select("template", "keeper")
    )
    return lines.join(recurring, "template").where("doc_id <> keeper").select("doc_id", "line").distinct()


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, lines = batch.column("text").to_pylist(), batch.columns[-1].to_pylist()
        count, dropped = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        for r, (t, gone) in enumerate(zip(text, lines)):
            parts = (t or "").split("\n")
            count[r] = len(parts) if t else 0
            if gone and t:
                out = set(gone)
                kept = [p for k, p in enumerate(parts) if k not in out]
                dropped[r] = len(parts) - len(kept)
                text[r] = "\n".join(kept)
        names = batch.schema.names[:-1]
        columns = [pa.array(text, pa.string()) if n == "text" else c for n, c in zip(names, batch.columns)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(count), pa.array(dropped)], names=[*names, "n_lines", "n_dropped"]
        )


def deduplicate(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` with the recurring lines dropped from ``text``, and n_lines and n_dropped.

    All rows and columns stay, also texts of which nothing is left; columns named n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    gone = recurring_lines(docs, least_docs)
    own, name = unused(docs, "_own_id"), unused(docs, "_lines")
    lists = gone.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("line").alias(name))
    joined = docs.join(lists, F.col("doc_id").cast("bigint") == F.col(own), "left").drop(own)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_drop, f"{fields}, n_lines int, n_dropped int")
