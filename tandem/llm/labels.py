"""What the two classifiers share: the held-out rule, the sample of labelled rows, the text's family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out():
    """True where crc32 of the id as text, modulo 5, is 0; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled rows that are not held out, the same ones every time.

    A document with several labels has the least of them. Rows without id or label are no labels.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # the sample has a fixed number of rows, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
