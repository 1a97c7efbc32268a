"""Registered queries: snapshots, inserts, upserts, limits, growth, windows, withdrawals; batch and streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tandem.operators import incremental, visibility
from tandem.plans.rankings import published
from tandem.plans.registry import check_view, query
from tandem.sinks.exports import write_snapshot
from tandem.sources.catalog import latest_snapshot
from tandem.streaming import streams

SINCE = datetime(1999, 1, 1)
_COLS = ["id", "source_id", "numero", "titulo", "url"]

# one row per chapter id: an older state, a later change for a part of them, and some deletions
_STATE = """
SELECT id, max(source_id) AS source_id, max(coalesce(numero, -1)) AS numero, max(titulo) AS titulo, max(url) AS url
FROM {f_chapters} WHERE visto_en < TIMESTAMP '1999-01-01 00:00:00' AND aprobado GROUP BY id"""
_CHANGED = """
SELECT id, max(source_id) AS source_id, max(coalesce(numero, -1)) + 1000 AS numero, concat('Nuevo ', max(titulo)) AS titulo, max(url) AS url,
       id % 3 <> 0 AS aprobado, max(visto_en) AS modificado_en
FROM {f_chapters} WHERE id % 5 = 0 OR visto_en >= TIMESTAMP '2001-01-01 00:00:00' GROUP BY id"""
_TOMBS = """
SELECT id, max(visto_en) AS borrado_en FROM {f_chapters} WHERE id % 11 = 0 GROUP BY id"""
check_view("o_state", _STATE.replace("{f_chapters}", "f_chapters"))
check_view("o_changed", _CHANGED.replace("{f_chapters}", "f_chapters"))
check_view("o_tombs", _TOMBS.replace("{f_chapters}", "f_chapters"))
_APPLIED = """
    WITH c AS (SELECT * FROM o_changed WHERE modificado_en > TIMESTAMP '1999-01-01'),
    d AS (SELECT id FROM o_tombs WHERE borrado_en > TIMESTAMP '1999-01-01')
    SELECT id, source_id, numero, titulo, url FROM o_state WHERE id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT id FROM d)
    UNION ALL SELECT id, source_id, numero, titulo, url FROM c WHERE aprobado AND id NOT IN (SELECT id FROM d)"""


@query("t1_apply_changes", _APPLIED)
def _(t):
    return incremental.apply_changes(t.sql(_STATE).select(*_COLS), t.sql(_CHANGED), t.sql(_TOMBS), SINCE)


@query("t1_apply_changes_twice", _APPLIED)
def _(t):
    once = incremental.apply_changes(t.sql(_STATE).select(*_COLS), t.sql(_CHANGED), t.sql(_TOMBS), SINCE)
    return incremental.apply_changes(once, t.sql(_CHANGED), t.sql(_TOMBS), SINCE)


@query("t2_needs_rebuild", """
    SELECT count(*) <> (SELECT count(*) FROM o_chapters) AS completo, 'row counts differ' AS motivo FROM f_chapters""")
def _(t):
    path = f"{streams.run_folder(t.spark)}/snapshot"
    state = t.all_chapters.select(*_COLS)
    write_snapshot(state, path, datetime(2001, 11, 5), datetime(2001, 11, 1))
    rows, meta = latest_snapshot(t.spark, path)
    return incremental.needs_rebuild(t.spark, meta, _COLS, datetime(2001, 11, 6), rows.count(), t.chapters.count())


@query("t3_purge_tombstones", "SELECT id FROM o_tombs WHERE borrado_en >= TIMESTAMP '2001-06-01' - INTERVAL 14 DAY")
def _(t):
    return incremental.purge_tombstones(t.sql(_TOMBS), datetime(2001, 6, 1)).select("id")


_INCOMING = """
SELECT CAST(l_partkey * 100000 + l_suppkey AS BIGINT) AS source_id, l_partkey AS work_id, CAST(l_quantity AS INT) AS numero,
       concat('https://www.site', CAST(l_suppkey % 10 AS VARCHAR(10)), '.example.com/w/', CAST(l_partkey AS VARCHAR(10)),
              '/capitulo-', CAST(l_orderkey * 10 + CASE WHEN l_orderkey % 4 = 0 THEN 9 ELSE l_linenumber END AS VARCHAR(20))) AS url
FROM {lineitem}"""
check_view("o_incoming", _INCOMING.replace("{lineitem}", "lineitem"))


@query("t4_insert_new_chapters", """
    SELECT i.source_id, i.url, min(i.numero) AS numero FROM o_incoming i
    WHERE NOT EXISTS (SELECT 1 FROM f_chapters c WHERE c.source_id = i.source_id AND c.url = i.url) GROUP BY i.source_id, i.url""")
def _(t):
    return incremental.insert_new_chapters(t.all_chapters, t.sql(_INCOMING)).select("source_id", "url", "numero")


@query("t4_keep_current_link", """
    WITH cur AS (SELECT source_id, arg_max(url, visto_en) AS url FROM f_chapters WHERE site_id % 10 = 0 GROUP BY source_id)
    SELECT c.source_id, count(*) AS n FROM f_chapters c LEFT JOIN cur USING (source_id) WHERE cur.url IS NULL OR c.url = cur.url GROUP BY c.source_id""")
def _(t):
    link = t.sources.where("plataforma = 'enlace'")
    kept = incremental.keep_current_link(t.all_chapters, t.all_chapters, link)
    return kept.groupBy("source_id").agg(F.count("*").alias("n"))


_DAILY = 3  # votes per day: the tables hold few votes per reader


@query("t5_rate_limit", """
    WITH RECURSIVE v AS (SELECT id, user_id, creada_en, row_number() OVER (PARTITION BY user_id ORDER BY creada_en, id) AS n FROM f_votes),
    r(user_id, n, id, ok, acc) AS (
      SELECT user_id, n, id, true, [creada_en] FROM v WHERE n = 1
      UNION ALL
      SELECT v.user_id, v.n, v.id, len(list_filter(r.acc, lambda a: a > v.creada_en - INTERVAL 24 HOUR)) < 3,
             CASE WHEN len(list_filter(r.acc, lambda a: a > v.creada_en - INTERVAL 24 HOUR)) < 3
                  THEN list_append(list_filter(r.acc, lambda a: a > v.creada_en - INTERVAL 24 HOUR), v.creada_en) ELSE r.acc END
      FROM r JOIN v ON v.user_id = r.user_id AND v.n = r.n + 1)
    SELECT id, ok AS aceptado FROM r""")
def _(t):
    return incremental.rate_limit(t.votes, _DAILY).select("id", "aceptado")


@query("t5_trailing_votes", """
    SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY creada_en RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM f_votes""")
def _(t):
    return incremental.trailing_votes(t.votes)


_VISITS = """
SELECT CAST(l_partkey % 50 AS BIGINT) AS source_id, l_shipdate AS cuando, l_suppkey % 5 <> 0 AS ok, CAST(l_quantity AS BIGINT) AS encontrados FROM {lineitem}"""
check_view("o_visits", _VISITS.replace("{lineitem}", "lineitem"))


@query("t7_growth", """
    WITH g AS (SELECT source_id, cuando, max(encontrados) AS n FROM o_visits WHERE ok GROUP BY source_id, cuando),
    p AS (SELECT *, lag(n) OVER (PARTITION BY source_id ORDER BY cuando) AS antes FROM g)
    SELECT s.source_id, strftime(s.u, '%Y-%m-%d') AS ultimo_scrape, strftime(x.c, '%Y-%m-%d') AS ultimo_cambio, x.n AS n_caps
    FROM (SELECT source_id, max(cuando) AS u FROM o_visits GROUP BY source_id) s
    LEFT JOIN (SELECT source_id, arg_max(n, cuando) AS n, max(cuando) FILTER (n > coalesce(antes, 0)) AS c FROM p GROUP BY source_id) x USING (source_id)""")
def _(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return incremental.growth(t.sql(_VISITS)).select("source_id", day("ultimo_scrape"), day("ultimo_cambio"), "n_caps")


@query("t8_upsert_works", """
    SELECT slug, titulo, concat_ws('|', alt1, alt2, alt3) AS alt FROM o_works
    UNION ALL SELECT concat('nueva-', k), concat('Nueva ', k), '' FROM (SELECT DISTINCT o_custkey AS k FROM orders)""")
def _(t):
    from tandem.operators.catalog_text import joined

    existing = published(t).select("slug", "titulo", "titulos_alternativos")
    new = t.base("orders").select(
        F.concat(F.lit("nueva-"), F.col("o_custkey").cast("string")).alias("slug"),
        F.concat(F.lit("Nueva "), F.col("o_custkey").cast("string")).alias("titulo"), F.col("o_orderkey").alias("orden"),
    )
    edited = existing.select("slug", F.lit("no pisa").alias("titulo"), F.lit(0).cast("bigint").alias("orden"))
    rows = incremental.upsert_works(existing, new.unionByName(edited))
    return rows.select("slug", "titulo", joined("titulos_alternativos").alias("alt"))


@query("t8_upsert_sources", """
    WITH i AS (SELECT l_suppkey AS sitio_id, l_partkey + 7 AS work_id, arg_min(concat('https://n.example.org/', l_orderkey), l_orderkey) AS url
               FROM lineitem GROUP BY 1, 2),
    e AS (SELECT site_id AS sitio_id, work_id, activa, nombre FROM f_sources)
    SELECT coalesce(e.sitio_id, i.sitio_id) AS sitio_id, coalesce(e.work_id, i.work_id) AS work_id, coalesce(e.activa, true) AS activa,
           CASE WHEN i.url IS NOT NULL THEN 'Sitio' ELSE e.nombre END AS nombre, coalesce(i.url, 'vieja') AS url_listado
    FROM e FULL JOIN i ON e.sitio_id = i.sitio_id AND e.work_id = i.work_id""")
def _(t):
    existing = t.sources.withColumnRenamed("site_id", "sitio_id").withColumn("url_listado", F.lit("vieja"))
    incoming = t.base("lineitem").select(
        F.col("l_suppkey").alias("sitio_id"), (F.col("l_partkey") + 7).alias("work_id"), F.col("l_orderkey").alias("orden"),
        F.lit("Sitio").alias("nombre"), F.concat(F.lit("https://n.example.org/"), F.col("l_orderkey").cast("string")).alias("url_listado"),
        F.lit("es").alias("idioma"), F.lit("manhwa").alias("tipo"), F.lit("css").alias("plataforma"), F.lit(None).cast("string").alias("portada_vista"),
    )
    rows = incremental.upsert_sources(existing, incoming)
    return rows.select("sitio_id", "work_id", "activa", "nombre", "url_listado")


def changes_of(t):
    return t.chapters.select("work_id", F.col("visto_en").cast("timestamp").alias("visto_en"))


_FMT = "yyyy-MM-dd HH:mm:ss"


def stored(t, rows, name):
    """Rows of a fixture as a folder of files, for a stream to read."""
    folder = streams.run_folder(t.spark)
    rows.write.parquet(f"{folder}/{name}")
    return folder


@query("t1_apply_stream", _APPLIED)
def _(t):
    stamp = F.to_timestamp(F.lit("1999-01-01 00:00:00"))
    state = t.sql(_STATE).select(*_COLS, F.lit(True).alias("aprobado"), stamp.alias("modificado_en"), F.lit(False).alias("borrado"))
    since = F.col("modificado_en") > stamp
    changed = t.sql(_CHANGED).withColumn("modificado_en", F.col("modificado_en").cast("timestamp")).where(since).select(
        *_COLS, "aprobado", "modificado_en", F.lit(False).alias("borrado")
    )
    gone = t.sql(_TOMBS).withColumn("modificado_en", F.col("borrado_en").cast("timestamp")).where(since)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in state.select(*_COLS[1:]).schema]
    dead = gone.select("id", *none, F.lit(True).alias("aprobado"), "modificado_en", F.lit(True).alias("borrado"))
    # the older state, then its changes: the stream goes on where it stopped
    folder = streams.run_folder(t.spark)
    for rows in (state, changed.unionByName(dead)):
        rows.write.mode("append").parquet(f"{folder}/changes.parquet")
        changes = streams.folder_stream(t.spark, f"{folder}/changes.parquet")
        table = streams.apply_changes_stream(changes, folder, _COLS)
    return table.read()


@query("t6_votes_stream", """
    SELECT work_id, capitulo_manhwa, user_id, arg_max(capitulo_novela, (creada_en, id)) AS capitulo_novela,
           strftime(max(creada_en), '%Y-%m-%d %H:%M:%S') AS creada_en
    FROM f_votes GROUP BY work_id, capitulo_manhwa, user_id""")
def _(t):
    folder = stored(t, t.votes.withColumn("creada_en", F.col("creada_en").cast("timestamp")), "votes.parquet")
    votes = streams.folder_stream(t.spark, f"{folder}/votes.parquet")
    rows = streams.latest_votes_stream(votes, folder).read().drop("id")
    return rows.withColumn("creada_en", F.date_format("creada_en", _FMT))


@query("t7_growth_stream", """
    WITH g AS (SELECT source_id, cuando, max(encontrados) AS n FROM o_visits WHERE ok GROUP BY source_id, cuando),
    p AS (SELECT *, lag(n) OVER (PARTITION BY source_id ORDER BY cuando) AS antes FROM g)
    SELECT s.source_id, strftime(s.u, '%Y-%m-%d') AS ultimo_scrape, strftime(x.c, '%Y-%m-%d') AS ultimo_cambio, x.n AS n_caps
    FROM (SELECT source_id, max(cuando) AS u FROM o_visits GROUP BY source_id) s
    LEFT JOIN (SELECT source_id, arg_max(n, cuando) AS n, max(cuando) FILTER (n > coalesce(antes, 0)) AS c FROM p GROUP BY source_id) x USING (source_id)""")
def _(t):
    folder = stored(t, t.sql(_VISITS).withColumn("cuando", F.col("cuando").cast("timestamp")), "visits.parquet")
    visits = streams.folder_stream(t.spark, f"{folder}/visits.parquet")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return streams.growth_stream(visits, folder).read().select("source_id", day("ultimo_scrape"), day("ultimo_cambio"), "n_caps")


@query("t10_activity_windows", """
    SELECT work_id, strftime(time_bucket(INTERVAL 1 DAY, visto_en), '%Y-%m-%d %H:%M:%S') AS desde, count(*) AS n FROM o_chapters GROUP BY 1, 2""")
def _(t):
    rows = incremental.activity_windows(changes_of(t))
    return rows.select("work_id", F.date_format("desde", _FMT).alias("desde"), "n")


@query("t10_sliding_windows", """
    SELECT work_id, strftime(d, '%Y-%m-%d %H:%M:%S') AS desde, count(*) AS n FROM (
      SELECT work_id, time_bucket(INTERVAL 1 DAY, visto_en) - k * INTERVAL 1 DAY AS d FROM o_chapters, (VALUES (0), (1)) x(k)) GROUP BY 1, 2""")
def _(t):
    rows = incremental.activity_windows(changes_of(t), "2 days", "1 day")
    return rows.select("work_id", F.date_format("desde", _FMT).alias("desde"), "n")


@query("t10_activity_stream", """
    SELECT l_partkey AS work_id, strftime(time_bucket(INTERVAL 1 DAY, l_shipdate), '%Y-%m-%d %H:%M:%S') AS desde, count(*) AS n FROM lineitem
    WHERE time_bucket(INTERVAL 1 DAY, l_shipdate) + INTERVAL 1 DAY <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(t):
    folder = streams.run_folder(t.spark)
    lines = streams.table_stream(t.spark, t.sf_dir, "lineitem.parquet")
    changes = lines.select(F.col("l_partkey").alias("work_id"), F.col("l_shipdate").cast("timestamp").alias("visto_en"))
    streams.store(streams.activity_stream(changes), folder)
    rows = t.spark.read.parquet(f"{folder}/rows")
    return rows.select("work_id", F.date_format("desde", _FMT).alias("desde"), "n")


check_view("o_sessions", """
    WITH p AS (SELECT user_id, ts, capitulo, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s
               FROM f_progress WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    q AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM p)
    SELECT user_id, min(ts) AS inicio, max(ts) AS ultima, count(*) AS n, array_to_string(list_sort(list_distinct(list(capitulo))), ',') AS capitulos
    FROM q GROUP BY user_id, k""")


@query("t11_reading_sessions", """
    SELECT user_id, strftime(inicio, '%Y-%m-%d %H:%M:%S') AS inicio, strftime(ultima, '%Y-%m-%d %H:%M:%S') AS ultima, n, capitulos FROM o_sessions""")
def _(t):
    rows = incremental.reading_sessions(t.progress)
    return rows.select(
        "user_id", F.date_format("inicio", _FMT).alias("inicio"), F.date_format("ultima", _FMT).alias("ultima"), "n",
        F.array_join(F.col("capitulos").cast("array<string>"), ",").alias("capitulos"),
    )


@query("t11_read_sets", """
    SELECT user_id, work_id, array_to_string(list_sort(list_distinct(list(capitulo))), ',') AS capitulos, bool_or(favorito) AS favorito
    FROM f_progress GROUP BY user_id, work_id""")
def _(t):
    return incremental.read_sets(t.progress).withColumn("capitulos", F.array_join(F.col("capitulos").cast("array<string>"), ","))


@query("t11_session_stream", """
    SELECT user_id, strftime(inicio, '%Y-%m-%d %H:%M:%S') AS inicio, strftime(ultima, '%Y-%m-%d %H:%M:%S') AS ultima, n, capitulos FROM o_sessions
    WHERE ultima + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM f_progress) - INTERVAL 1 HOUR""")
def _(t):
    folder = streams.run_folder(t.spark)
    events = streams.table_stream(t.spark, t.sf_dir, "events.parquet")
    chapter = (F.floor(F.abs("value")).cast("int") % 50 + 1).alias("capitulo")
    progress = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), chapter)
    streams.store(streams.session_stream(progress), folder)
    rows = t.spark.read.parquet(f"{folder}/rows")
    return rows.select(
        "user_id", F.date_format("inicio", _FMT).alias("inicio"), F.date_format("ultima", _FMT).alias("ultima"), "n",
        F.array_join(F.col("capitulos").cast("array<string>"), ",").alias("capitulos"),
    )


@query("t12_withdraw", """
    SELECT 'works' AS tabla, count(*) AS n FROM o_works WHERE work_id % 101 <> 7
    UNION ALL SELECT 'chapters', count(*) FROM o_chapters WHERE work_id % 101 <> 7
    UNION ALL SELECT 'sources', count(*) FROM f_sources WHERE work_id % 101 <> 7
    UNION ALL SELECT 'anchors', count(*) FROM f_anchors WHERE work_id % 101 <> 7 OR work_id NOT IN (SELECT work_id FROM f_works)
    UNION ALL SELECT 'traffic', count(*) FROM o_works WHERE con_trafico AND work_id % 101 <> 7""")
def _(t):
    gone = t.works.where("work_id % 101 = 7").select("work_id", F.concat(F.lit(" "), F.upper("slug")).alias("slug"))
    tables = {
        "works": published(t), "chapters": t.chapters, "sources": t.sources, "anchors": t.anchors,
        "traffic": published(t).where("con_trafico").select("slug"),
    }
    counts = None
    for name, table in visibility.withdraw(tables, gone).items():
        part = table.groupBy(F.lit(name).alias("tabla")).agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    return counts


@query("t4_insert_stream", """
    SELECT CAST(l_partkey * 100000 + l_suppkey AS BIGINT) AS source_id, l_orderkey AS pedido, count(*) AS n FROM (
      SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem) GROUP BY 1, 2""")
def _(t):
    folder = streams.run_folder(t.spark)
    lines = streams.table_stream(t.spark, t.sf_dir, "lineitem.parquet")
    chapters = lines.select(
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("source_id"), F.col("l_orderkey").alias("pedido"),
        F.concat(F.lit("https://x.example.org/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.col("l_shipdate").cast("timestamp").alias("visto_en"),
    )
    rows = streams.insert_chapters(chapters, folder).read()
    return rows.groupBy("source_id", "pedido").agg(F.count("*").alias("n"))


@query("t5_rate_limit_stream", """
    WITH RECURSIVE v AS (SELECT id, user_id, creada_en, row_number() OVER (PARTITION BY user_id ORDER BY creada_en, id) AS n FROM f_votes),
    r(user_id, n, id, ok, acc) AS (
      SELECT user_id, n, id, true, [creada_en] FROM v WHERE n = 1
      UNION ALL
      SELECT v.user_id, v.n, v.id, len(list_filter(r.acc, lambda a: a > v.creada_en - INTERVAL 24 HOUR)) < 3,
             CASE WHEN len(list_filter(r.acc, lambda a: a > v.creada_en - INTERVAL 24 HOUR)) < 3
                  THEN list_append(list_filter(r.acc, lambda a: a > v.creada_en - INTERVAL 24 HOUR), v.creada_en) ELSE r.acc END
      FROM r JOIN v ON v.user_id = r.user_id AND v.n = r.n + 1)
    SELECT user_id, id FROM r WHERE ok""")
def _(t):
    folder = streams.run_folder(t.spark)
    events = streams.table_stream(t.spark, t.sf_dir, "events.parquet")
    votes = events.select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("creada_en"))
    streams.rate_limit_stream(votes, folder, _DAILY)
    return t.spark.read.parquet(f"{folder}/rows").select("user_id", "id")


