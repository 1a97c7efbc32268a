"""Tables kept by key in the state of a stream.

The state store is the table: a batch reads and writes the keys it touches, the change log of the batch is what is
written to the shared folder, and Spark's state reader gives the table as a DataFrame. Nothing that an earlier batch has
put out is read again. The store cleans up old versions of itself and is rebuilt from the folder when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch uploads what it changed and not the whole store
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """The settings of the state store while a stream starts; a stream keeps those it started with."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run(stream: DataFrame, folder: str, mode: str, sink: str = "noop", **options: str) -> StreamingQuery:
    """Everything available now, with the state in ``folder``/state."""
    writer = stream.writeStream.format(sink).outputMode(mode).options(checkpointLocation=f"{folder}/state", **options)
    with state_settings(stream.sparkSession):
        query = writer.trigger(availableNow=True).start()
    finish(query)
    return query


@dataclass
class KeptTable:
    """The rows of a table kept in the state of the stream in ``folder``, one per key."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    variable: str | None = None

    def read(self) -> DataFrame:
        """The table as of the last finished batch."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/commits")
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], self.schema)  # no batch yet
        reader = self.spark.read.format("statestore").option("path", f"{self.folder}/state")
        if self.variable is not None:
            return reader.option("stateVarName", self.variable).load().select("key.*", "value.*").select(*self.schema.names)
        state = reader.load()
        kept = state.schema["value"].dataType[0]  # the one aggregate: a row, or a number
        if isinstance(kept.dataType, T.StructType):
            return state.select("key.*", f"value.{kept.name}.*").select(*self.schema.names)
        return state.select("key.*", F.col(f"value.{kept.name}").alias(self.schema.names[-1]))


def keep(
    stream: DataFrame, folder: str, key: Sequence[str], order: Sequence[Column], columns: Sequence[str], first: bool = False
) -> KeptTable:
    """Of each key the last row by ``order`` (or the first), in the state of a stream; equal rows are told apart by a hash."""
    rest = [c for c in columns if c not in key]
    rank = [o.alias(f"_o{i}") for i, o in enumerate([*order, F.xxhash64(*columns)])]
    best = (F.min if first else F.max)(F.struct(*rank, *rest)).alias("r")
    run(stream.groupBy(*key).agg(best), folder, "update")
    schema = T.StructType([stream.schema[c] for c in [*key, *rest]])
    return KeptTable(stream.sparkSession, folder, schema)
