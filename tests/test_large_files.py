"""Files and streams whose parts grow with the table are not held by one task, row or call."""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.plans.sources import large_files
from tandem.streaming import streams


def test_large_files_are_written_row_by_row(spark):
    rows = spark.createDataFrame([(i % 3, i, f"k{i}") for i in range(500)], "doc int, i int, k string").repartition(5)

    def line(first, last):
        entry = F.concat(F.when(first, "{").otherwise(","), F.lit('"'), "k", F.lit('":{"v":"'), F.col("i").cast("string"), F.lit('"'))
        return F.when(last, F.concat(entry, F.lit("}"))).otherwise(entry)

    read = spark.read.option("wholetext", True).text(large_files(rows, ["i"], line, "}")).collect()
    assert len(read) == 3
    for r in read:
        assert json.loads(r.value) == {f"k{i}": {"v": str(i)} for i in range(r.doc, 500, 3)}


class _Held:
    def __init__(self):
        self.rows = {}

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        return self.rows.get(key)

    def updateValue(self, key, value):
        self.rows[key] = value


def test_one_call_moves_the_votes_of_many_readers():
    moves = streams._Moves(T.StructType([T.StructField(c, T.LongType()) for c in ("work_id", "capitulo_manhwa", "user_id")]))
    moves.init(_Held())

    def call(*votes):
        frame = pd.DataFrame(votes, columns=["work_id", "capitulo_manhwa", "user_id", "id", "capitulo_novela", "creada_en", "borrado"])
        out = pd.concat(moves.handleInputRows((0,), iter([frame]), None))
        return sorted(out.itertuples(index=False, name=None))

    day = [pd.Timestamp(f"2026-01-0{d}") for d in range(1, 6)]
    assert call((1, 1, 7, 1, 5, day[1], False), (1, 1, 8, 2, 5, day[1], False), (1, 1, 8, 3, 6, day[2], False)) == [(1, 1, 5, 1), (1, 1, 6, 1)]
    assert call((1, 1, 7, 4, 9, day[0], False), (1, 1, 8, 5, 4, day[3], False)) == [(1, 1, 4, 1), (1, 1, 6, -1)]
    assert call((1, 1, 8, 6, 4, day[4], True)) == [(1, 1, 4, -1)]
    assert call((1, 1, 8, 7, 4, day[3], False)) == []


def test_changes_are_not_written_by_one_task(spark, sf_dir, monkeypatch):
    from __spark_entry__ import spark_queries

    def one_task(*_):
        raise AssertionError("a table that grows is brought into a fixed number of tasks")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", one_task)
    assert spark_queries()["t1_apply_stream"](spark, sf_dir).limit(1).count() == 1
