"""Every stage against a plain version of what it should do, on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import line_templates

from . import brute
from .test_line_templates import plain

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents, then what each stage makes of them, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages):
    for df in stages[:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()
        assert df.where(F.length("text") != F.col("n_chars")).count() == 0
    assert stages[-1].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_toxic_documents_go_and_others_stay(spark):
    folder = "/root/testdata/sf0.1"  # enough labels to learn from
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, after = texts(docs), texts(corpus_pipeline.drop_toxic(spark, docs, folder))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert after == {d: before[d] for d in after}
    kept = {t: [d in after for d, y in labels.items() if y == t] for t in (0, 1)}
    assert sum(kept[0]) >= 0.98 * len(kept[0]) and sum(kept[1]) <= 0.1 * len(kept[1])


def test_lines_go(stages):
    before, after = texts(stages[1]), texts(stages[2])
    want = {d: t for d, t, n, gone in plain(list(before.items())) if not gone or brute.words(t)}
    assert after == want


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    linked = brute.linked(list(before.items()), 5, 4, 5)
    assert after == {d: t for d, t in before.items() if linked[d][1] == d}


def test_passages_go_from_later_documents(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(after) <= set(before)
    seen = {}
    for d in sorted(after):
        own = set()
        for i in range(len(ws := brute.words(after[d])) - 50):
            own.add(tuple(ws[i : i + 51]))
        for key in own:
            assert key not in seen, (seen[key], d)
        seen.update(dict.fromkeys(own, d))
    for d, t in before.items():
        if after.get(d) != t:
            assert len(brute.words(after.get(d))) < len(brute.words(t))


def test_all_that_is_left_is_packed(stages):
    left, pieces = stages[4], stages[5]
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in left.select("doc_id").collect()}
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n != 2048 for r in sizes) <= 1


def test_odd_rows_pass_all_stages(table, spark, sf_dir, tmp_path):
    line = "a line that is found in very many of these documents\n"
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, line + "own words " + " ".join(letters[i] + c + "x" for c in letters), None, "s", None) for i in range(20)]
    rows += [(100, None, "en", None, None), (101, "", "en", "s", 0), (None, "text without id", None, None, 15), (102, line.strip(), "x", "y", 52)]
    rows += [(0, rows[0][1], None, "s", None), (103, "v " * 30_000, "en", "s", 60_000)]
    docs = table(rows, DOCUMENTS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        if k == 1:  # the document that was that line alone is gone, the first keeps it
            left = texts(docs)
            assert 102 not in left and left[0].startswith(line) and left[1].startswith("own words b")
            assert left[100] is None and left[101] == "" and left[None] == "text without id"
    assert {r.doc_id for r in docs.collect()} == {*range(20), 100, 101, 103, None}
    assert line_templates.LEAST_DOCS <= 20


def test_empty_table(table, spark, sf_dir):
    docs = table([], DOCUMENTS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_run(stages, spark, sf_dir):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(
        map(tuple, stages[5].select("doc_id", "start", "length", "ids_crc32").collect())
    )
    assert corpus_pipeline.ORACLE_SQL is None
