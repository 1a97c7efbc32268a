"""Registered queries: sitemaps, feed, indexes, bulk export, queues, notices, reports."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.operators import covers, gap, levels, rollup
from tandem.operators.catalog_text import joined
from tandem.plans.rankings import levels_of, published
from tandem.plans.registry import check_view, query
from tandem.session import shared_dir
from tandem.sinks import exports

SITE = "https://catalogo.example.com"
SINCE = datetime(2001, 3, 1)


@query("k1_chapter_sitemap_shards", """
    SELECT puesto, CAST(floor((puesto - 1) / 2000) AS INT) AS shard, ruta FROM (
      SELECT concat('/novela/', w.slug, '/capitulo-', l.numero) AS ruta,
             row_number() OVER (ORDER BY w.destacada DESC, w.titulo, w.work_id, l.numero DESC) AS puesto
      FROM o_listed l JOIN o_works w USING (work_id) JOIN o_levels v USING (work_id) WHERE v.nivel = 'A')""")
def _(t):
    rows = exports.chapter_sitemap_shards(rollup.listed_numbers(t.chapters), published(t), levels_of(t), per_file=2000)
    return rows


@query("k1_manifest", f"""
    SELECT 0 AS orden, 'Sitemap: {SITE}/sitemap-index.xml' AS linea
    UNION ALL SELECT CAST(i AS INT), concat('Sitemap: {SITE}/sitemap-capitulos-', i, '.xml') FROM (
      SELECT unnest(generate_series(1, greatest(1, CAST(ceil(count(*) / 2000.0) AS BIGINT)))) AS i
      FROM o_listed l JOIN o_levels v USING (work_id) JOIN o_works w USING (work_id) WHERE v.nivel = 'A')""")
def _(t):
    rows = exports.chapter_sitemap_shards(rollup.listed_numbers(t.chapters), published(t), levels_of(t), per_file=2000)
    return exports.sitemap_manifest(rows, SITE)


check_view("o_english", """
    SELECT work_id FROM (SELECT g.work_id, row_number() OVER (ORDER BY c.caps DESC, g.work_id) AS rn
      FROM o_gap g JOIN o_works w USING (work_id) JOIN o_caps c USING (work_id) WHERE NOT w.adulta)
    WHERE rn * 2 <= greatest(0, 19500 - 500 - (SELECT count(*) FROM o_works) - (SELECT count(*) FROM o_gap JOIN o_works USING (work_id)))""")


@query("k2_work_sitemap_rows", f"""
    WITH p AS (SELECT w.*, v.nivel, unnest(CASE WHEN v.nivel = 'A' THEN [concat('/novela/', slug, '/'), concat('/novela/', slug, '/equivalencia/')]
                 ELSE [concat('/novela/', slug, '/')] END) AS pag FROM o_works w JOIN o_levels v USING (work_id) WHERE v.nivel <> 'C'),
    l AS (SELECT p.*, e.work_id IS NOT NULL AS en, unnest(CASE WHEN e.work_id IS NULL THEN [''] ELSE ['', '/en'] END) AS pre
          FROM p LEFT JOIN o_english e USING (work_id))
    SELECT concat('{SITE}', pre, pag) AS loc, coalesce(strftime(a.cuando, '%Y-%m-%dT%H:%M:%SZ'), '') AS lastmod,
           CASE WHEN nivel = 'A' THEN '1.0' ELSE '0.5' END AS prioridad,
           CASE WHEN en THEN concat('es={SITE}', pag, '|en={SITE}/en', pag, '|x-default={SITE}/en', pag) ELSE '' END AS alternas,
           CASE WHEN pag LIKE '%equivalencia/' OR l.work_id NOT IN (SELECT work_id FROM o_covers) THEN ''
                ELSE concat('{SITE}/portada/', slug, '.jpg') END AS imagen
    FROM l LEFT JOIN o_activity a USING (work_id)
    UNION ALL SELECT concat('{SITE}', h), '', CASE WHEN h IN ('/', '/en/') THEN '1.0' WHEN h = '/novelas/' THEN '' ELSE '0.8' END, '', ''
    FROM (SELECT unnest({fv.HUB_PAGES}) AS h)""")
def _(t):
    works = published(t)
    english = levels.english_budget(works, t.chapters)
    return exports.work_sitemap_rows(
        works, levels_of(t), rollup.activity(t.sources), english, covers.works_with_cover(works, t.sources), SITE
    )


@query("k3_feed_items", f"""
    SELECT r.titulo AS title, concat('{SITE}/novela/', w.slug) AS link,
           concat('{SITE}/novela/', w.slug, '#', strftime(r.cuando, '%Y-%m-%dT%H:%M:%SZ')) AS guid,
           strftime(r.cuando, '%a, %d %b %Y %H:%M:%S GMT') AS pub_date,
           concat('Capítulo nuevo en ', r.fuentes, '.', CASE WHEN alt = '' THEN '' ELSE concat(' También conocida como ', alt, '.') END) AS description
    FROM (SELECT * FROM o_recent ORDER BY cuando DESC, work_id LIMIT 100) r
    JOIN (SELECT work_id, slug, concat_ws(' · ', alt1, alt2, alt3) AS alt FROM o_works) w USING (work_id)""")
def _(t):
    return exports.feed_items(rollup.activity(t.sources), published(t), SITE)


@query("k4_search_index", """
    SELECT w.slug AS s, w.titulo AS t, concat_ws('|', alt1, alt2, alt3) AS a,
           CASE WHEN w.work_id IN (SELECT work_id FROM o_covers) THEN concat('/portada/', w.slug, '.jpg') ELSE '/portadas/sin-portada.svg' END AS p,
           coalesce(f.f, CASE WHEN w.tipo = 'ambos' THEN 'manhwa|novela' ELSE w.tipo END) AS f
    FROM o_works w LEFT JOIN (SELECT work_id, array_to_string(list_sort(list_distinct(list(tipo))), '|') AS f
                              FROM o_chapters GROUP BY work_id) f USING (work_id)""")
def _(t):
    works = published(t)
    rows = exports.search_index(works, gap.formats(t.chapters), covers.works_with_cover(works, t.sources))
    return rows.withColumn("a", joined("a")).withColumn("f", joined("f"))


@query("k5_cover_map", """
    SELECT slug, url, CAST(puesto AS INT) AS puesto FROM (
      SELECT w.slug, c.url, row_number() OVER (PARTITION BY c.work_id ORDER BY ult, ord) AS puesto
      FROM o_covers c JOIN o_works w USING (work_id)) WHERE puesto <= 3""")
def _(t):
    works = published(t)
    return covers.cover_map(works, t.sources).join(works.select("work_id", "slug"), "work_id").drop("work_id")


@query("k5_linkout_ids", "SELECT DISTINCT source_id FROM o_rollup WHERE solo_enlace")
def _(t):
    return exports.linkout_ids(t.chapters)


@query("k5_level_a_slugs", "SELECT slug FROM o_works JOIN o_levels USING (work_id) WHERE nivel = 'A'")
def _(t):
    return exports.level_a_slugs(published(t), levels_of(t))


@query("k5_redirect_map", """
    SELECT unnest(CASE WHEN work_id % 6 = 0 THEN [concat('vieja-', work_id), concat('mas-vieja-', work_id)]
                  ELSE CAST([] AS VARCHAR[]) END) AS viejo, slug AS nuevo FROM o_works""")
def _(t):
    old = F.when(
        F.col("work_id") % 6 == 0, F.array(F.concat(F.lit("vieja-"), "work_id"), F.concat(F.lit("mas-vieja-"), "work_id"))
    )
    return exports.redirect_map(published(t).withColumn("slugs_antiguos", old))


check_view("o_boards", "SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{b}')" for g, b in fv.board_rows()) + ") AS b(etiqueta, tablero)")
check_view("o_pins", f"""
    WITH m AS (SELECT work_id, coalesce(max(numero) FILTER (tipo = 'manhwa' AND numero > 0), 0) AS manhwa,
                      coalesce(max(numero) FILTER (tipo = 'novela' AND numero > 0), 0) AS novela FROM o_chapters GROUP BY work_id),
    tb AS (SELECT work_id, arg_min(tablero, pos) AS tablero FROM o_labels_raw JOIN o_boards ON etiqueta = lower(trim(label)) GROUP BY work_id),
    f AS (SELECT w.*, m.manhwa, m.novela, greatest(m.manhwa, m.novela) AS total, tb.tablero,
                 CASE WHEN m.manhwa > 0 AND m.novela > 0 THEN greatest(0, m.novela - m.manhwa) ELSE 0 END AS faltan
          FROM o_works w JOIN m USING (work_id) LEFT JOIN tb USING (work_id)
          WHERE w.work_id % 19 <> 0 AND (w.portada_url LIKE 'http%' OR w.work_id IN (SELECT work_id FROM f_sources WHERE portada_vista <> ''))),
    i AS (SELECT *, row_number() OVER (ORDER BY faltan DESC, total DESC, work_id) - 1 AS i FROM f WHERE total > 0),
    x AS (SELECT *, CASE WHEN faltan > 0 THEN concat(titulo, ': la novela va ', faltan, ' capítulos por delante del manhwa')
                    ELSE concat(titulo, ' — dónde leer todos los capítulos en español') END AS tt,
             concat_ws(' ', CASE WHEN faltan > 0 THEN concat('El manhwa va por el capítulo ', manhwa, ' y la novela por el ', novela, ': te faltan ', faltan,
                   ' capítulos de historia. Te decimos por qué capítulo seguir y dónde leerla, gratis.')
                 ELSE concat('Todas las fuentes de ', titulo, ' indexadas en un sitio: ', total,
                   ' capítulos con enlace al sitio original, y el aviso cuando sale uno nuevo.') END,
               CASE WHEN coalesce(alt1, alt2, alt3) IS NOT NULL THEN concat('También conocida como ', concat_ws(', ', alt1, nullif(alt2, titulo), alt3), '.') END) AS dd
          FROM i WHERE i < 1000)
    SELECT slug, CAST(floor(i / 200) AS INT) AS file,
           CASE WHEN length(tt) <= 100 THEN tt ELSE concat(rtrim(substr(tt, 1, 99)), '…') END AS title,
           concat('{SITE}/portada/', slug, '.jpg') AS media_url, coalesce(tablero, 'Manhwa con novela') AS board,
           CASE WHEN length(dd) <= 500 THEN dd ELSE concat(rtrim(substr(dd, 1, 499)), '…') END AS description,
           concat('{SITE}/novela/', slug, CASE WHEN faltan > 0 THEN '/equivalencia' ELSE '' END) AS link,
           concat(strftime(DATE '2026-01-02' + CAST(floor(i / 10) AS INT), '%Y-%m-%d'), 'T',
                  lpad(CAST(CAST(9 + floor((i % 10) * 12 / 10 + 0.5) AS INT) AS VARCHAR), 2, '0'), ':00:00') AS publish_date,
           array_to_string(list_concat(list_filter([tag1, tag2, tag3], lambda z: z IS NOT NULL)[1:3],
                                       ['manhwa', 'novela ligera', 'dónde leer']), ', ') AS keywords
    FROM x""")


def pins_of(t):
    ledger = published(t).where("work_id % 19 = 0").select("slug")
    return exports.bulk_export(published(t), t.chapters, t.sources, ledger, SITE, date(2026, 1, 2), batches=5)


@query("k6_bulk_export", "SELECT * FROM o_pins")
def _(t):
    return pins_of(t)


@query("a14_board_counts", "SELECT board, count(*) AS n FROM o_pins GROUP BY board")
def _(t):
    return exports.board_counts(pins_of(t))


@query("k7_editorial_queue", f"""
    SELECT slug, nivel, concat('{SITE}/novela/', slug, '/') AS url FROM o_works JOIN o_levels USING (work_id)
    WHERE con_trafico AND nivel <> 'C' AND work_id NOT IN (SELECT doc_id FROM documents WHERE trim(text) <> '')""")
def _(t):
    works = published(t)
    blank = works.select("work_id").join(t.synopses.where(F.trim("sinopsis") != ""), "work_id", "left_anti")
    return exports.editorial_queue(works.where("con_trafico"), levels_of(t), works, blank, SITE)


@query("k8_notify_batches", f"""
    WITH c AS (SELECT w.work_id, w.slug, v.nivel FROM o_works w JOIN o_levels v USING (work_id)
               WHERE v.nivel <> 'C' AND w.work_id IN (SELECT work_id FROM f_sources WHERE ultimo_cambio >= TIMESTAMP '2001-03-01')),
    r AS (SELECT 0 AS parte, -1 AS work_id, i AS n, ['{SITE}/', '{SITE}/en/', '{SITE}/novelas/', '{SITE}/series/', '{SITE}/en/series/'][i + 1] AS url
          FROM (SELECT unnest(generate_series(0, 4)) AS i)
      UNION ALL SELECT 1, work_id, i, concat('{SITE}', CASE WHEN i % 2 = 1 THEN '/en' ELSE '' END, '/novela/', slug, '/',
                                             CASE WHEN i >= 2 THEN 'equivalencia/' ELSE '' END)
          FROM c, (SELECT unnest(generate_series(0, 3)) AS i) WHERE nivel = 'A'
      UNION ALL SELECT 2, work_id, 0, concat('{SITE}/novela/', slug, '/') FROM c WHERE nivel = 'B'
      UNION ALL SELECT DISTINCT 3, h.work_id, h.numero, concat('{SITE}/novela/', c.slug, '/capitulo-', h.numero)
          FROM o_chapters h JOIN c USING (work_id) JOIN o_rollup r USING (work_id, source_id)
          WHERE c.nivel = 'A' AND h.numero IS NOT NULL AND h.visto_en >= TIMESTAMP '2001-03-01' AND NOT r.solo_enlace)
    SELECT url, row_number() OVER (ORDER BY parte, work_id, n) AS puesto,
           CAST(floor((row_number() OVER (ORDER BY parte, work_id, n) - 1) / 1000) AS INT) AS lote FROM r""")
def _(t):
    return exports.notify_batches(published(t), levels_of(t), t.sources, t.chapters, SINCE, SITE, per_batch=1000)


@query("k9_write_snapshot", "SELECT id, work_id, source_id, tipo, idioma, coalesce(numero, -1) AS numero, titulo, url FROM o_chapters")
def _(t):
    from tandem.sources.catalog import latest_snapshot
    import uuid

    path = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    state = t.chapters.select("id", "work_id", "source_id", "tipo", "idioma", "numero", "titulo", "url")
    exports.write_snapshot(state, path, datetime(2001, 11, 5), datetime(2001, 11, 1))
    return latest_snapshot(t.spark, path)[0].fillna(-1, ["numero"])


@query("k10_domain_report", """
    SELECT host, n, floor(n * 1000 / sum(n) OVER () + 0.5) / 10 AS pct FROM (
      SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, count(*) AS n
      FROM o_chapters GROUP BY 1)""")
def _(t):
    return exports.domain_report(t.chapters)


@query("k10_page_domain_report", """
    SELECT host, n, floor(n * 1000 / sum(n) OVER () + 0.5) / 10 AS pct FROM (
      SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, count(*) AS n
      FROM pages GROUP BY 1)""")
def _(t):
    return exports.domain_report(t.base("pages"))
