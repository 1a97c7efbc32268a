"""Registered queries: tiers, top lists, pages, related works, readers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tandem.operators import covers, levels, ranking, rollup, votes
from tandem.plans.fixtures import Tables
from tandem.plans.registry import check_view, query

NOW = datetime(2026, 11, 5)  # two days into the release: 85 works
VISIT_NOW = datetime(1999, 6, 1)

check_view("o_works", "SELECT * FROM f_works WHERE publicada")
check_view(
    "o_facts",
    """SELECT w.work_id, w.adulta, w.con_trafico, w.creada_ord, g.work_id IS NOT NULL AS ambos, coalesce(r.u, 0) AS ultimo
       FROM o_works w LEFT JOIN o_gap g USING (work_id)
       LEFT JOIN (SELECT work_id, max(total) AS u FROM o_rollup GROUP BY work_id) r USING (work_id)""",
)
check_view(
    "o_released",
    """SELECT work_id FROM o_facts WHERE NOT adulta AND NOT ambos AND NOT con_trafico AND ultimo >= 5
       ORDER BY creada_ord NULLS LAST, work_id LIMIT 85""",
)
check_view(
    "o_levels",
    """SELECT f.work_id, CASE WHEN adulta THEN CASE WHEN con_trafico THEN 'B' ELSE 'C' END WHEN ambos THEN 'A'
              WHEN con_trafico THEN 'B' WHEN ultimo >= 5 AND r.work_id IS NOT NULL THEN 'B' ELSE 'C' END AS nivel
       FROM o_facts f LEFT JOIN o_released r USING (work_id)""",
)
check_view("o_caps", "SELECT work_id, count(*) AS caps FROM o_chapters GROUP BY work_id")
check_view("o_both", "SELECT work_id FROM o_chapters GROUP BY work_id HAVING count(DISTINCT tipo) = 2")
check_view(
    "o_covers",
    """SELECT work_id, url, regexp_matches(url, '(?i)mangadex|imageshack') AS ult, min(ord) AS ord FROM (
         SELECT work_id, portada_url AS url, -1 AS ord FROM o_works
         UNION ALL SELECT s.work_id, s.portada_vista, s.source_id FROM f_sources s JOIN o_works USING (work_id))
       WHERE url LIKE 'http://%' OR url LIKE 'https://%' GROUP BY work_id, url""",
)


def published(t: Tables):
    return t.works.where("publicada")


def facts_of(t: Tables):
    return levels.work_facts(published(t), t.chapters)


def levels_of(t: Tables):
    return levels.index_levels(facts_of(t), NOW)


@query("w1_ranking_lists", """
    WITH g AS (SELECT o_gap.* FROM o_gap JOIN o_works USING (work_id)),
    p AS (SELECT o_caps.* FROM o_caps JOIN o_works USING (work_id))
    SELECT lista, puesto, work_id, CAST(valor AS BIGINT) AS valor FROM (
      SELECT 'populares' AS lista, row_number() OVER (ORDER BY caps DESC, work_id) AS puesto, work_id, caps AS valor FROM p
      UNION ALL SELECT 'adelantadas', row_number() OVER (ORDER BY faltan DESC, work_id), work_id, faltan FROM g
      UNION ALL SELECT 'al-dia', row_number() OVER (ORDER BY faltan, manhwa DESC, work_id), work_id, faltan FROM g WHERE faltan <= 5
      UNION ALL SELECT 'largas', row_number() OVER (ORDER BY novela DESC, work_id), work_id, novela FROM g)
    WHERE puesto <= 50""")
def _(t):
    return ranking.ranking_lists(t.chapters, published(t))


@query("w2_index_levels", "SELECT work_id, nivel FROM o_levels")
def _(t):
    return levels_of(t)


@query("w3_cold_release", "SELECT work_id FROM o_released")
def _(t):
    return levels.cold_release(facts_of(t), NOW)


@query("a14_level_counts", "SELECT nivel, count(*) AS n FROM o_levels GROUP BY nivel")
def _(t):
    return levels.level_counts(levels_of(t))


@query("w4_english_budget", """
    SELECT work_id, caps FROM (
      SELECT g.work_id, c.caps, row_number() OVER (ORDER BY c.caps DESC, g.work_id) AS rn
      FROM o_gap g JOIN o_works w USING (work_id) JOIN o_caps c USING (work_id) WHERE NOT w.adulta)
    WHERE rn * 2 <= greatest(0, 19500 - 500 - (SELECT count(*) FROM o_works)
                                - (SELECT count(*) FROM o_gap JOIN o_works USING (work_id)))""")
def _(t):
    return levels.english_budget(published(t), t.chapters)


_GENRES = """CASE WHEN work_id % 10 = 0 THEN {empty} WHEN work_id % 10 = 1 THEN {one} ELSE {two} END"""
check_view(
    "o_tagged",
    "SELECT w.work_id, w.titulo, w.adulta, l.nivel = 'A' AS a, unnest("
    + _GENRES.format(empty="CAST([] AS VARCHAR[])", one="[concat('raro-', CAST(work_id % 700 AS VARCHAR))]",
                     two="[genre1, genre2]")
    + ") AS genero FROM o_works w JOIN o_levels l USING (work_id)",
)


@query("w5_related_works", """
    WITH sc AS (SELECT t.work_id, b.work_id AS otra, b.a, count(*) AS comunes FROM o_tagged t JOIN o_tagged b USING (genero)
           WHERE t.work_id <> b.work_id AND NOT b.adulta GROUP BY t.work_id, b.work_id, b.a),
    chosen AS (SELECT * FROM (SELECT work_id, otra, row_number() OVER (PARTITION BY work_id
                                ORDER BY a DESC, comunes DESC, otra) AS puesto FROM sc) WHERE puesto <= 6),
    ring AS (SELECT w.work_id, w.adulta, l.nivel = 'A' AS a, row_number() OVER (ORDER BY w.titulo, w.work_id) - 1 AS i,
                    count(*) OVER () AS n, coalesce(c.c, 0) AS tiene
             FROM o_works w JOIN o_levels l USING (work_id)
             LEFT JOIN (SELECT work_id, count(*) AS c FROM chosen GROUP BY work_id) c USING (work_id)),
    cand AS (SELECT s.work_id, s.tiene, o.work_id AS otra, (o.i - s.i + s.n) % s.n AS k, o.a
             FROM ring s JOIN ring o ON o.work_id <> s.work_id AND NOT o.adulta
             WHERE s.tiene < 6 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.work_id = s.work_id AND c.otra = o.work_id)),
    fill AS (SELECT work_id, otra, tiene + row_number() OVER (PARTITION BY work_id ORDER BY a DESC, k) AS puesto FROM cand)
    SELECT work_id, otra, CAST(puesto AS INT) AS puesto, 'genero' AS origen FROM chosen
    UNION ALL SELECT work_id, otra, CAST(puesto AS INT), 'vecina' FROM fill WHERE puesto <= 6""")
def _(t):
    genres = _GENRES.format(
        empty="CAST(array() AS array<string>)", one="array(concat('raro-', CAST(work_id % 700 AS STRING)))",
        two="array(genre1, genre2)",
    )
    return ranking.related_works(published(t).withColumn("categorias", F.expr(genres)), levels_of(t))


@query("w6_paginate", """
    SELECT work_id, puesto, CAST(floor((puesto - 1) / 96) AS INT) + 2 AS pagina FROM (
      SELECT work_id, row_number() OVER (ORDER BY titulo, work_id) AS puesto FROM o_works)""")
def _(t):
    return ranking.paginate(published(t)).drop("titulo")


@query("w6_page_windows", """
    WITH z AS (SELECT CAST(ceil(count(*) / 96.0) AS INT) + 1 AS z FROM o_works),
    p AS (SELECT unnest(generate_series(2, z)) AS p, z FROM z)
    SELECT CAST(p AS INT) AS pagina, array_to_string(list_sort(list_distinct(
             list_filter([1, 2, p - 1, p, p + 1, z - 1, z], lambda x: x >= 1 AND x <= z))), ',') AS ventana FROM p""")
def _(t):
    pages = ranking.page_windows(ranking.paginate(published(t)))
    return pages.withColumn("ventana", F.array_join(F.col("ventana").cast("array<string>"), ","))


check_view(
    "o_recent",
    """SELECT a.work_id, a.cuando, a.fuentes, w.titulo FROM o_activity a JOIN o_works w USING (work_id)
       ORDER BY a.cuando DESC, a.work_id""",
)


@query("w7_news", """
    SELECT r.work_id, r.titulo, strftime(r.cuando, '%Y-%m-%d') AS dia, coalesce(l.u, 0) AS ultimo_cap
    FROM (SELECT * FROM o_recent ORDER BY cuando DESC, work_id LIMIT 240) r
    LEFT JOIN (SELECT work_id, max(numero) AS u FROM o_listed GROUP BY work_id) l USING (work_id)""")
def _(t):
    rows = ranking.news(rollup.activity(t.sources), published(t), rollup.listed_numbers(t.chapters))
    return rows.select(
        "work_id", "titulo", F.col("dia").cast("string").alias("dia"), F.coalesce("ultimo_cap", F.lit(0)).alias("ultimo_cap")
    )


@query("w8_new_releases", """
    SELECT work_id, CAST(creada_en AS VARCHAR) AS creada_en,
           CAST(row_number() OVER (ORDER BY creada_en DESC, work_id) AS INT) AS puesto
    FROM o_works JOIN o_both USING (work_id) WHERE creada_en IS NOT NULL
    ORDER BY o_works.creada_en DESC, work_id LIMIT 12""")
def _(t):
    return ranking.new_releases(published(t), t.chapters).withColumn("creada_en", F.col("creada_en").cast("string"))


@query("w8_carousel", """
    SELECT b.work_id, b.caps, CAST(b.puesto AS INT) AS puesto, coalesce(max(c.capitulo_manhwa), -1) AS capitulo_manhwa,
           coalesce(arg_max(c.capitulo_novela, c.capitulo_manhwa), -1) AS capitulo_novela
    FROM (SELECT work_id, caps, row_number() OVER (ORDER BY caps DESC, work_id) AS puesto
          FROM o_caps JOIN o_both USING (work_id) JOIN o_works USING (work_id)) b
    LEFT JOIN o_combined c USING (work_id) WHERE b.puesto <= 10 GROUP BY b.work_id, b.caps, b.puesto""")
def _(t):
    far = votes.furthest_equivalence(votes.combined_equivalences(t.votes, t.anchors))
    return ranking.carousel(published(t), t.chapters, far).fillna(-1)


@query("w8_catalogue_grid", """
    SELECT work_id, caps, CAST(puesto AS INT) AS puesto FROM (
      SELECT work_id, caps, row_number() OVER (ORDER BY caps DESC, work_id) AS puesto
      FROM o_caps JOIN o_both USING (work_id) JOIN o_works USING (work_id)
      WHERE work_id IN (SELECT work_id FROM o_covers)) WHERE puesto <= 120""")
def _(t):
    works = published(t)
    return ranking.catalogue_grid(works, t.chapters, covers.works_with_cover(works, t.sources))


@query("w8_latest_grid", """
    SELECT work_id, strftime(cuando, '%Y-%m-%d') AS cuando, tarjeta, CAST(puesto AS INT) AS puesto FROM (
      SELECT *, row_number() OVER (ORDER BY cuando DESC, work_id) AS puesto FROM (
        SELECT a.work_id, a.cuando, array_to_string(CASE WHEN len(nums) > 0 THEN nums[1:2]
               ELSE list_filter([tope, tope - 1], lambda n: n > 0) END, ',') AS tarjeta
        FROM o_activity a JOIN o_works USING (work_id) JOIN o_cards c USING (work_id)
        WHERE a.work_id IN (SELECT work_id FROM o_covers)) WHERE tarjeta <> '') WHERE puesto <= 72""")
def _(t):
    works = published(t)
    rows = ranking.latest_grid(
        rollup.activity(t.sources), works, rollup.home_cards(t.chapters), covers.works_with_cover(works, t.sources)
    )
    return rows.select(
        "work_id", "puesto", F.date_format("cuando", "yyyy-MM-dd").alias("cuando"),
        F.array_join(F.col("tarjeta").cast("array<string>"), ",").alias("tarjeta"),
    )


@query("w9_title_index", """
    SELECT DISTINCT work_id, nombre, CASE WHEN regexp_matches(i, '^[A-Z]$') THEN i ELSE '#' END AS inicial FROM (
      SELECT work_id, nombre, upper(strip_accents(nombre)[1:1]) AS i FROM (
        SELECT work_id, unnest([titulo, alt1, alt2, alt3]) AS nombre FROM o_works) WHERE nombre <> '')""")
def _(t):
    return ranking.title_index(published(t))


@query("w10_due_sources", """
    SELECT source_id, work_id FROM f_sources
    WHERE activa AND epoch(TIMESTAMP '1999-06-01') - epoch(ultimo_scrape) >= CASE
            WHEN epoch(TIMESTAMP '1999-06-01') - epoch(ultimo_cambio) < 7 * 86400 THEN 86400
            WHEN epoch(TIMESTAMP '1999-06-01') - epoch(ultimo_cambio) < 30 * 86400 THEN 3 * 86400
            ELSE 7 * 86400 END - 7200""")
def _(t):
    return ranking.due_sources(t.sources, VISIT_NOW).select("source_id", "work_id")


@query("w10_due_per_site", """
    SELECT site_id, count(*) AS n FROM f_sources WHERE activa
      AND epoch(TIMESTAMP '1999-06-01') - epoch(ultimo_scrape) >= CASE
            WHEN epoch(TIMESTAMP '1999-06-01') - epoch(ultimo_cambio) < 7 * 86400 THEN 86400
            WHEN epoch(TIMESTAMP '1999-06-01') - epoch(ultimo_cambio) < 30 * 86400 THEN 3 * 86400
            ELSE 7 * 86400 END - 7200 GROUP BY site_id""")
def _(t):
    due = ranking.due_sources(t.sources, VISIT_NOW)
    return due.groupBy("site_id").agg(F.count("*").alias("n"))


@query("w11_library", """
    SELECT user_id, work_id, len(l) AS n_leidos, CAST(floor(len(l) * 100 / t.total + 0.5) AS INT) AS pct,
           list_max(l) AS ultimo, least(list_max(l) + 1, t.total) AS siguiente
    FROM (SELECT user_id, work_id, list_distinct(list(capitulo)) AS l FROM f_progress GROUP BY user_id, work_id)
    JOIN (SELECT work_id, CAST(max(total) AS INT) AS total FROM o_rollup GROUP BY work_id) t USING (work_id)
    WHERE t.total > 0""")
def _(t):
    read = t.progress.groupBy("user_id", "work_id").agg(
        F.collect_set("capitulo").alias("leidos"), F.bool_or("favorito").alias("favorito")
    )
    totals = rollup.source_facts(t.chapters).groupBy("work_id").agg(F.max("total").cast("int").alias("total"))
    return ranking.library(read, totals.where("total > 0"))


@query("w12_catalog_sort", """
    SELECT work_id, titulo, destacada, row_number() OVER (ORDER BY destacada DESC, titulo, work_id) AS puesto FROM o_works""")
def _(t):
    return ranking.catalog_sort(published(t))


_SUGGESTIONS = """
SELECT concat('obra ', CAST(l_partkey AS VARCHAR(10))) AS titulo, CASE WHEN l_suppkey % 2 = 0 THEN 'es' ELSE 'en' END AS idioma,
       concat('obra ', CAST(l_partkey AS VARCHAR(10)), CASE WHEN l_suppkey % 3 = 0 THEN ' Novela ' ELSE ' capitulo ' END,
              CAST(CAST(l_quantity AS INT) AS VARCHAR(10))) AS consulta,
       l_orderkey * 10 + l_linenumber AS orden
FROM {lineitem}"""


@query("w13_suggest_rank", f"""
    SELECT titulo, idioma, consulta, puesto FROM (
      SELECT titulo, idioma, consulta, row_number() OVER (PARTITION BY titulo
               ORDER BY contains(lower(consulta), 'novel') DESC, min(orden), idioma, consulta) AS puesto
      FROM ({_SUGGESTIONS.replace('{lineitem}', 'lineitem')}) GROUP BY titulo, idioma, consulta) WHERE puesto <= 24""")
def _(t):
    return ranking.suggest_rank(t.sql(_SUGGESTIONS)).drop("orden")
