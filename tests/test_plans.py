"""Plans: what reaches the scan, how often data moves."""

import re
from datetime import datetime

import pytest

from tandem.operators import covers, gap, incremental, rollup, votes, work_pages
from tandem.plans.fixtures import Tables
from tandem.session import small_table
from tandem.sources import catalog, payloads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "chapters")
    Tables(spark, sf_dir).all_chapters.write.parquet(path)
    return path


def test_filter_and_columns_reach_the_scan(spark, stored):
    text = plan(gap.gap(catalog.read_chapters(spark, stored)))
    assert "EqualTo(aprobado,true)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "titulo" not in schema and "url" not in schema


def test_gap_moves_the_data_once(spark, stored):
    text = plan(gap.gap(catalog.read_chapters(spark, stored)))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_work_summary_reads_the_chapters_once(spark, stored):
    text = plan(rollup.work_summary(catalog.read_chapters(spark, stored)))
    assert text.count("FileScan") == 1 and "SortAggregate" not in text


def test_interpolation_has_no_pairwise_join(spark, stored, sf_dir):
    text = plan(votes.manhwa_to_novel(catalog.read_chapters(spark, stored), Tables(spark, sf_dir).anchors))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_fixed_tables_have_a_known_size(spark, stored):
    names = small_table(spark, [("manhwa", "comic"), ("novela", "prose")], "tipo string, kind string")
    text = plan(catalog.read_chapters(spark, stored).join(names, "tipo"))
    assert "BroadcastHashJoin" in text and "BuildRight" in text


def aggregates_by_hash(df):
    text = plan(df)
    return "SortAggregate" not in text and "HashAggregate" in text


def test_facts_of_sources_aggregate_by_hash(spark, stored, sf_dir):
    chapters = catalog.read_chapters(spark, stored)
    assert aggregates_by_hash(rollup.source_facts(chapters))
    assert aggregates_by_hash(rollup.source_rollup(chapters, Tables(spark, sf_dir).sources))


def test_incremental_operators_aggregate_by_hash(spark, stored, sf_dir):
    t = Tables(spark, sf_dir)
    chapters = spark.read.parquet(stored)
    state = chapters.select("id", "source_id", "numero", "titulo", "url")
    changed = chapters.select("id", "source_id", "numero", "titulo", "url", "aprobado", chapters.visto_en.alias("modificado_en"))
    dead = chapters.select("id", chapters.visto_en.alias("borrado_en"))
    assert aggregates_by_hash(incremental.apply_changes(state, changed, dead, datetime(1999, 1, 1)))
    assert aggregates_by_hash(incremental.insert_new_chapters(state, state))
    works = spark.createDataFrame([("a", "A", 1)], "slug string, titulo string, orden int")
    assert aggregates_by_hash(incremental.upsert_works(works.drop("orden"), works))
    assert aggregates_by_hash(votes.upsert_votes(t.votes))
    feed = spark.createDataFrame([("s", 0, "{}")], "serie string, doc int, json string")
    assert aggregates_by_hash(payloads.feed_chapters(feed, "https://w.test"))


def test_frames_only_grow(spark, stored, sf_dir):
    """A frame that ends at the last row is worked out anew for every row."""
    chapters, anchors = catalog.read_chapters(spark, stored), Tables(spark, sf_dir).anchors
    for df in (votes.manhwa_to_novel(chapters, anchors), work_pages.chapter_pages(chapters, anchors)):
        assert "unboundedfollowing" not in plan(df).lower()


def test_covers_are_numbered_without_a_global_order(spark, sf_dir):
    t = Tables(spark, sf_dir)
    text = plan(covers.cover_candidates(t.works, t.sources))
    assert "rangepartitioning" not in text and "Scan ExistingRDD" not in text


def test_title_search_broadcasts_questions_only(spark):
    """The lists of names and the names grow with the works, however small their files look."""
    schema = "work_id long, titulo string, destacada boolean, titulos_alternativos array<string>"
    works = spark.createDataFrame([(i, f"old ring {i}", i % 3 == 0, ["Anillo"]) for i in range(40)], schema)
    text = plan(work_pages.search_titles_of(works, spark.createDataFrame([("ring",), ("ANI",), ("9",)], "q string")))
    assert text.count("BroadcastExchange") == 1 and text.count("SortMergeJoin") == 2
