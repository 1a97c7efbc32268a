"""Tables written to the shared folder and read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import shared_dir


#: While a table is written. Its shuffle files have no reader afterwards; else they stay until the driver collects its garbage.
#: Python gets texts in batches that two workers of an executor hold several times over.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed meanwhile."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """The table, written as Parquet in the folder of ``spark.checkpoint.dir`` and read from there.

    Lineage ends here: a lost executor costs a read. The folder's owner removes run folders when the job has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _settings(spark, _WRITING):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BROADCAST_ROWS = 1 << 20  # rows of a few numbers that one task can hold without notice


def limited(df: DataFrame, rows: int) -> DataFrame:
    """A table of a few numbers per row for a join: broadcast if its counted rows are few, else shuffled."""
    return F.broadcast(df) if rows <= _BROADCAST_ROWS else df


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
