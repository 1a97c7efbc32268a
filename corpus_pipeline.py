"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go; then lines that recur across documents, but in the first; then all but the smallest id of each group
of near copies; then passages that an earlier document has; what is left is packed. A document of which a stage leaves
no word goes with that stage. Null and empty texts that come in stay. Rows that repeat an id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import line_templates, ngram_join, packing, passages, toxicity
from tandem.llm.store import unused, written


def _edited(docs: DataFrame, edited: DataFrame, edits: str) -> DataFrame:
    """The columns of ``docs`` with the new texts and their lengths, without texts that have lost all words."""
    changed = F.col(edits) > 0
    out = edited.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _edited(docs, line_templates.deduplicate(docs), "n_dropped")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = ngram_join.link(docs, n=5, num=4, den=5)
    own = unused(docs, "_own_id")
    copies = linked.where("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(copies, F.col("doc_id").cast("bigint") == F.col(own), "left_anti")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _edited(docs, passages.remove(docs, passages.find(docs)), "n_passages")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("packing", pack),
]

#: No SQL has the tokenizer's ids or the learned grammar; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
