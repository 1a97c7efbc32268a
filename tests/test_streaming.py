from datetime import datetime

from pyspark.sql import functions as F

from tandem.operators import incremental
from tandem.streaming import streams


def _files(spark, folder, frames):
    """Each frame is one later file of the stream."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.read.parquet(f"{folder}/in").schema


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")


def ts(text):
    return datetime.fromisoformat(text)


def test_late_rows_are_dropped_after_the_watermark(spark):
    folder = streams.run_folder(spark)
    schema = "work_id bigint, visto_en timestamp"
    first = spark.createDataFrame([(1, ts("2026-01-01T10:00")), (1, ts("2026-01-05T10:00"))], schema)
    late = spark.createDataFrame([(1, ts("2026-01-01T11:00")), (2, ts("2026-01-09T10:00"))], schema)
    # rows are late against the watermark of the batch before, so one batch lies between
    between = spark.createDataFrame([(1, ts("2026-01-05T12:00"))], schema)
    read = _files(spark, folder, [first, between, late])
    streams.store(streams.activity_stream(_stream(spark, folder, read)), folder)
    rows = {(r.work_id, r.desde, r.n) for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert (1, ts("2026-01-01T00:00"), 1) in rows, "the late row of 1 January did not count"
    assert (1, ts("2026-01-05T00:00"), 2) in rows


def test_changes_stream_equals_batch(spark):
    folder = streams.run_folder(spark)
    schema = "id bigint, numero int, aprobado boolean, borrado boolean, modificado_en timestamp"
    one = spark.createDataFrame([(1, 1, True, False, ts("2026-01-01")), (2, 2, True, False, ts("2026-01-01")),
                                 (3, 3, True, False, ts("2026-01-01"))], schema)
    two = spark.createDataFrame([(1, 10, True, False, ts("2026-01-02")), (2, 2, False, False, ts("2026-01-02")),
                                 (3, None, True, True, ts("2026-01-02")), (4, 4, True, False, ts("2026-01-02"))], schema)
    read = _files(spark, folder, [one, two])
    state = streams.apply_changes_stream(_stream(spark, folder, read), folder, ["id", "numero"])
    assert sorted((r.id, r.numero) for r in state.read().collect()) == [(1, 10), (4, 4)]


def test_a_table_kept_in_state_takes_the_latest_change_whenever_it_comes(spark):
    folder = streams.run_folder(spark)
    schema = "id bigint, numero int, aprobado boolean, borrado boolean, modificado_en timestamp"
    read = _files(spark, folder, [
        spark.createDataFrame([(i, i, True, False, ts("2026-01-05")) for i in range(50)], schema),
        spark.createDataFrame([(7, 70, True, False, ts("2026-01-04")), (8, None, True, True, ts("2026-01-06"))], schema),
        spark.createDataFrame([(8, 80, True, False, ts("2026-01-05T12:00")), (9, 90, True, False, ts("2026-01-07")), (9, None, True, True, ts("2026-01-07"))], schema),
        spark.createDataFrame([(8, 81, True, False, ts("2026-01-08"))], schema),
    ])
    table = streams.apply_changes_stream(_stream(spark, folder, read), folder, ["id", "numero"])
    want = {i: i for i in range(50)} | {8: 81}
    del want[9]
    assert {r.id: r.numero for r in table.read().collect()} == want
    # the stream goes on where it ended: a batch more, and one that brings nothing
    spark.createDataFrame([(7, 71, True, False, ts("2026-01-09"))], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for _ in range(2):
        table = streams.apply_changes_stream(_stream(spark, folder, read), folder, ["id", "numero"])
    assert {r.id: r.numero for r in table.read().collect()} == want | {7: 71}


def test_a_batch_of_few_changes_writes_little(spark):
    """What a batch adds to the shared folder follows its rows and not the table."""
    import os

    folder = streams.run_folder(spark)
    schema = "id bigint, numero int, aprobado boolean, borrado boolean, modificado_en timestamp"
    row = lambda ids, day: spark.range(ids).select(
        "id", F.lit(day).alias("numero"), F.lit(True).alias("aprobado"), F.lit(False).alias("borrado"), F.lit(ts(f"2026-01-{day:02}")).alias("modificado_en"))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{folder}/state/state") for f in fs)
    grown = []
    for day, ids in ((1, 40_000), (2, 100), (3, 100), (4, 100)):
        row(ids, day).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        before = size() if grown else 0
        read = spark.read.parquet(f"{folder}/in").schema
        table = streams.apply_changes_stream(_stream(spark, folder, read), folder, ["id", "numero"])
        grown.append(size() - before)
    assert max(grown[1:]) < grown[0] / 10
    assert {(r.numero, r["count"]) for r in table.read().groupBy("numero").count().collect()} == {(1, 39_900), (4, 100)}


def test_tables_without_a_batch_are_empty(spark):
    folder = streams.run_folder(spark)
    schema = "id bigint, user_id bigint, work_id bigint, capitulo_manhwa int, capitulo_novela int, creada_en timestamp"
    read = _files(spark, folder, [spark.createDataFrame([], schema)])
    table = streams.latest_votes_stream(_stream(spark, folder, read), folder)
    assert table.read().count() == 0 and set(table.read().columns) == set(read.names)


def test_growth_stream_follows_found_counts(spark):
    folder = streams.run_folder(spark)
    schema = "source_id bigint, cuando timestamp, ok boolean, encontrados bigint"
    log = [(1, ts("2026-01-01"), True, 5), (1, ts("2026-01-02"), False, 99), (1, ts("2026-01-03"), True, 5),
           (1, ts("2026-01-04"), True, 3), (1, ts("2026-01-05"), True, 4)]
    read = _files(spark, folder, [spark.createDataFrame([row], schema) for row in log])
    followed = streams.growth_stream(_stream(spark, folder, read), folder).read().first()
    batch = incremental.growth(spark.createDataFrame(log, schema)).first()
    for state in (followed, batch):
        assert (state.n_caps, state.ultimo_cambio, state.ultimo_scrape) == (4, ts("2026-01-05"), ts("2026-01-05"))


def test_votes_stream_carries_accepted_votes_over(spark):
    folder = streams.run_folder(spark)
    schema = "id bigint, user_id bigint, creada_en timestamp"
    read = _files(spark, folder, [
        spark.createDataFrame([(i, 7, ts(f"2026-01-01T10:0{i}")) for i in range(4)], schema),
        spark.createDataFrame([(10, 7, ts("2026-01-02T10:00:30")), (11, 7, ts("2026-01-02T10:00:40")), (12, 8, ts("2026-01-02"))], schema),
    ])
    streams.rate_limit_stream(_stream(spark, folder, read), folder, limit=3)
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/rows").collect()) == [0, 1, 2, 10, 12]


def test_late_and_empty_batches_of_votes(spark):
    folder = streams.run_folder(spark)
    schema = "id bigint, user_id bigint, creada_en timestamp"
    read = _files(spark, folder, [
        spark.createDataFrame([(1, 7, ts("2026-01-05T10:00")), (2, 7, ts("2026-01-05T11:00"))], schema),
        spark.createDataFrame([], schema),
        # late: judged by the votes of the day before it, of which there are none
        spark.createDataFrame([(3, 7, ts("2026-01-04T12:00")), (4, 7, ts("2026-01-05T12:00"))], schema),
    ])
    streams.rate_limit_stream(_stream(spark, folder, read), folder, limit=2)
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/rows").collect()) == [1, 2, 3]


def test_sessions_that_ended_carry_their_chapters(spark):
    folder = streams.run_folder(spark)
    schema = "user_id bigint, ts timestamp, capitulo int"
    read = _files(spark, folder, [
        spark.createDataFrame([(1, ts("2026-01-01T10:00"), 4), (1, ts("2026-01-01T10:20"), 3)], schema),
        spark.createDataFrame([(1, ts("2026-01-01T10:40"), 4), (2, ts("2026-01-01T15:00"), 1)], schema),
        spark.createDataFrame([(2, ts("2026-01-02T15:00"), 1)], schema),
    ])
    streams.store(streams.session_stream(_stream(spark, folder, read)), folder)
    rows = spark.read.parquet(f"{folder}/rows").where("user_id = 1").collect()
    assert [(r.n, r.ultima, r.capitulos) for r in rows] == [(3, ts("2026-01-01T10:40"), [3, 4])]


def test_latest_votes_are_kept_by_key(spark):
    folder = streams.run_folder(spark)
    schema = "id bigint, user_id bigint, work_id bigint, capitulo_manhwa int, capitulo_novela int, creada_en timestamp"
    read = _files(spark, folder, [
        spark.createDataFrame([(1, 7, 1, 3, 9, ts("2026-01-01"))], schema),
        spark.createDataFrame([(2, 7, 1, 3, 11, ts("2026-01-02"))], schema),
    ])
    state = streams.latest_votes_stream(_stream(spark, folder, read), folder)
    assert [r.capitulo_novela for r in state.read().collect()] == [11]


def test_inserted_chapters_are_not_repeated_across_batches(spark):
    folder = streams.run_folder(spark)
    schema = "source_id bigint, url string, visto_en timestamp"
    read = _files(spark, folder, [
        spark.createDataFrame([(1, "a", ts("2026-01-01")), (1, "b", ts("2026-01-01"))], schema),
        spark.createDataFrame([(1, "a", ts("2026-03-01")), (2, "a", ts("2026-03-01"))], schema),
    ])
    rows = streams.insert_chapters(_stream(spark, folder, read), folder).read().collect()
    assert sorted((r.source_id, r.url, r.visto_en.month) for r in rows) == [(1, "a", 1), (1, "b", 1), (2, "a", 3)]


def test_of_one_batch_the_chapter_seen_first_is_inserted(spark):
    folder = streams.run_folder(spark)
    schema = "source_id bigint, url string, visto_en timestamp, titulo string"
    rows = [(1, "a", ts(f"2026-01-0{d}"), f"t{d}") for d in (5, 2, 9)]
    read = _files(spark, folder, [spark.createDataFrame(rows, schema), spark.createDataFrame([(1, "a", ts("2025-01-01"), "old")], schema)])
    assert [r.titulo for r in streams.insert_chapters(_stream(spark, folder, read), folder).read().collect()] == ["t2"]


def test_the_times_of_quiet_readers_are_forgotten(spark):
    folder = streams.run_folder(spark)
    schema = "id bigint, user_id bigint, creada_en timestamp"
    read = _files(spark, folder, [
        spark.createDataFrame([(i, 7, ts("2026-01-01T10:00")) for i in range(5)], schema),
        spark.createDataFrame([(10, 8, ts("2026-01-20T10:00")), (11, 8, ts("2026-01-20T10:00"))], schema),
        spark.createDataFrame([(12, 8, ts("2026-01-20T11:00")), (13, 7, ts("2026-01-20T11:00"))], schema),
    ])
    streams.rate_limit_stream(_stream(spark, folder, read), folder, limit=2)
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/rows").collect()) == [0, 1, 10, 11, 13]
    left = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "accepted").load()
    times = [(r.key.user_id, len(r.list_value) if "list_value" in r else 1) for r in left.collect()]
    assert sum(n for u, n in times if u == 8) == 2 and sum(n for u, n in times if u == 7) == 1


def test_consensus_follows_changed_and_withdrawn_votes(spark):
    import random

    from tandem.operators import votes as batch

    rng, folder = random.Random(2), streams.run_folder(spark)
    schema = "id bigint, work_id bigint, capitulo_manhwa int, user_id bigint, capitulo_novela int, creada_en timestamp, borrado boolean"
    rows = [(i, rng.randrange(2), rng.randrange(3), rng.randrange(12), rng.randrange(1, 4), ts(f"2026-01-{rng.randrange(1, 29):02}"), rng.random() < 0.2)
            for i in range(300)]
    parts = [rows[i::3] for i in range(3)]

    def plain(seen):
        last = {}
        for r in sorted(seen, key=lambda r: (r[5], r[0])):
            last[r[1:4]] = None if r[6] else r[4]
        kept = [(i, *k, c) for i, (k, c) in enumerate(last.items()) if c is not None]
        df = spark.createDataFrame(kept, "id int, work_id bigint, capitulo_manhwa int, user_id bigint, capitulo_novela int")
        return sorted(map(tuple, batch.consensus(df).collect()))

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(f"{folder}/in")
        table = streams.consensus_stream(_stream(spark, folder, spark.read.parquet(f"{folder}/in").schema), folder)
        if i != 1:
            assert sorted(map(tuple, table.read().collect())) == plain([r for p in parts[: i + 1] for r in p])
    steps = spark.read.parquet(f"{folder}/moves/rows")
    assert steps.count() < 2 * len(rows) and steps.where("paso < 0").count() > 0
