"""Registered queries: predicates, covers, requests, pages, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import covers, requests, visibility, work_pages
from tandem.plans.rankings import published
from tandem.plans.registry import check_view, query

_ITEMS = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS work_id,
       CASE WHEN l_partkey % 10 = 0 THEN '' WHEN l_partkey % 10 = 1 THEN NULL ELSE concat('Obra ', CAST(l_partkey AS VARCHAR(10))) END AS titulo,
       CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE concat('https://x.example.com/', CAST(l_orderkey AS VARCHAR(20))) END AS url
FROM {lineitem}"""


@query("p1_useful", f"""
    SELECT id, work_id, titulo, url FROM ({_ITEMS.replace('{lineitem}', 'lineitem')}) WHERE titulo <> '' AND url <> ''""")
def _(t):
    return visibility.useful(t.sql(_ITEMS))


@query("p2_prefix_filter", """
    SELECT c.id, c.source_id, c.titulo FROM o_chapters c JOIN f_sources s USING (source_id)
    WHERE s.titulo_prefijo IS NULL OR starts_with(c.titulo, s.titulo_prefijo)""")
def _(t):
    return visibility.prefix_filter(t.chapters, t.sources).select("id", "source_id", "titulo")


_TAKEDOWN = "SELECT p_partkey AS work_id, concat(' W-', CAST(p_partkey AS VARCHAR(10)), ' ') AS slug FROM {part} WHERE p_partkey % 101 = 7"
check_view("o_takedown", _TAKEDOWN)
check_view("o_flags", """
    SELECT w.work_id, coalesce(bool_or(l.clave IN ('lolicon', 'shotacon')), false) AS prohibida,
           coalesce(bool_or(l.clave IN ('lolicon', 'shotacon', 'adulto', 'hentai', 'smut', 'erotico')), false) AS adulta_g
    FROM o_works w LEFT JOIN o_labels l USING (work_id) GROUP BY w.work_id""")


@query("p3_drop_blocked", """
    SELECT work_id, slug FROM o_works JOIN o_flags USING (work_id)
    WHERE NOT prohibida AND slug NOT IN (SELECT lower(trim(slug)) FROM o_takedown)""")
def _(t):
    return visibility.drop_blocked(published(t), t.sql(_TAKEDOWN)).select("work_id", "slug")


_ODD_TITLE = """CASE WHEN work_id % 50 = 3 THEN concat(titulo, ' Uncensored') WHEN work_id % 50 = 4 THEN concat('Theoretical ', titulo)
    WHEN work_id % 50 = 5 THEN concat(titulo, ' +18') WHEN work_id % 50 = 6 THEN concat('El taller erótico ', titulo) ELSE titulo END"""


@query("p4_flag_adult", f"""
    SELECT work_id, adulta_g OR regexp_matches({_ODD_TITLE}, '(?i)\\buncensored\\b|\\+18|\\ber[oó]tic|\\bhentai\\b') AS es_adulta
    FROM o_works JOIN o_flags USING (work_id)""")
def _(t):
    return visibility.flag_adult(published(t).withColumn("titulo", F.expr(_ODD_TITLE))).select("work_id", "es_adulta")


_ALLOWED, _NO_VIEWER = ["example.net", "blog.ththan.example.com", "example.org"], ["ththn.example.net", "blog.tionsh.example.net"]


def _below(host: str, domains: list[str]) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR ends_with({host}, '.{d}')" for d in domains) + ")"


@query("p5_allowed_url", f"""
    WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS h FROM pages)
    SELECT page_id, {_below('h', _ALLOWED)} AS permitida, {_below('h', _ALLOWED)} AND NOT {_below('h', _NO_VIEWER)} AS en_visor FROM h""")
def _(t):
    rows = visibility.allowed_url(t.base("pages"), _ALLOWED, _NO_VIEWER)
    return rows.select("page_id", "permitida", "en_visor")


@query("p6_with_content", """
    SELECT work_id FROM f_works WHERE work_id IN (SELECT work_id FROM o_chapters) OR work_id IN (SELECT doc_id FROM documents WHERE trim(text) <> '')""")
def _(t):
    return visibility.with_content(t.works, t.chapters, t.synopses).select("work_id")


@query("p7_cover_candidates", """
    SELECT work_id, url, row_number() OVER (PARTITION BY work_id ORDER BY ult, ord) AS puesto FROM o_covers""")
def _(t):
    return covers.cover_candidates(published(t), t.sources)


_PROBES = """
SELECT portada_vista AS url, CASE WHEN site_id % 3 = 0 THEN 404 ELSE 200 END AS status,
       CASE WHEN site_id % 5 = 0 THEN 'text/html' ELSE 'image/jpeg' END AS content_type
FROM {f_sources} WHERE portada_vista IS NOT NULL
UNION ALL SELECT portada_url, CASE WHEN work_id % 7 = 0 THEN 200 ELSE 403 END, 'image/webp' FROM {f_works}"""
check_view("o_probes", _PROBES)


@query("p8_pick_live_cover", """
    SELECT w.work_id, coalesce(b.url, '/portadas/sin-portada.svg') AS url FROM o_works w LEFT JOIN (
      SELECT work_id, arg_min(url, (ult, ord)) AS url FROM o_covers
      WHERE url IN (SELECT url FROM o_probes WHERE status BETWEEN 200 AND 299 AND content_type LIKE 'image/%')
      GROUP BY work_id) b USING (work_id)""")
def _(t):
    works = published(t)
    return covers.pick_live_cover(covers.cover_options(works, t.sources), t.sql(_PROBES), works)


@query("p9_works_missing_cover", """
    SELECT work_id FROM o_works WHERE (portada_url = '' OR regexp_matches(portada_url, '(?i)imageshack|mangadex'))
      AND work_id NOT IN (SELECT work_id FROM f_sources WHERE work_id % 5 <> 0 AND portada_vista IS NOT NULL
                          AND NOT regexp_matches(portada_vista, '(?i)imageshack|mangadex'))""")
def _(t):
    # the sources of every fifth work have shown no cover
    seen = t.sources.withColumn("portada_vista", F.when(F.col("work_id") % 5 != 0, F.col("portada_vista")))
    return covers.works_missing_cover(published(t), seen).select("work_id")


# requests of every kind, from the event log
_REQUESTS = """
SELECT event_id, CASE event_id % 12
    WHEN 0 THEN concat('/novela/w-', CAST(event_id % 1000 AS VARCHAR(10)), '/')
    WHEN 1 THEN concat('/novela/w-', CAST(event_id % 1000 AS VARCHAR(10)), '/capitulo-', CAST(CAST(floor(value) AS INT) AS VARCHAR(10)))
    WHEN 2 THEN concat('/novela/w-', CAST(event_id % 1000 AS VARCHAR(10)), '/capitulo-00', CAST(CAST(floor(value) AS INT) + 1 AS VARCHAR(10)))
    WHEN 3 THEN concat('/pt/novela/w-', CAST(event_id % 1000 AS VARCHAR(10)), '/capitulo-', CAST(CAST(floor(value) AS INT) AS VARCHAR(10)))
    WHEN 4 THEN concat('/novela/w-', CAST(event_id % 1000 AS VARCHAR(10)), '-capitulo-', CAST(CAST(floor(value) AS INT) AS VARCHAR(10)))
    WHEN 5 THEN CASE WHEN event_id % 5 = 0 THEN '/categoria/martial-arts/' WHEN event_id % 5 = 1 THEN '/categoria/erotica'
                     WHEN event_id % 5 = 2 THEN '/categoria/accion/' ELSE '/categoria/inventada/' END
    WHEN 6 THEN concat('/novela/vieja-', CAST(event_id % 90 AS VARCHAR(10)), '/capitulo-', CAST(CAST(floor(value) AS INT) AS VARCHAR(10)))
    WHEN 7 THEN concat('/en/novela/vieja-', CAST(event_id % 90 AS VARCHAR(10)))
    WHEN 8 THEN concat('/portada/w-', CAST(event_id % 1000 AS VARCHAR(10)), '.jpg')
    WHEN 9 THEN concat('/novela/nada-', CAST(event_id % 20 AS VARCHAR(10)), '/capitulo-100000')
    WHEN 10 THEN CASE WHEN event_id % 2 = 0 THEN '/de' ELSE '/entrevista/' END
    ELSE concat('/novela/W%2D', CAST(event_id % 1000 AS VARCHAR(10)), '/') END AS path
FROM {events}"""
# vieja-k was merged into vieja-(k-1), and every fifth one into a living work
_REDIRECTS = """
SELECT DISTINCT concat('vieja-', CAST(event_id % 90 AS VARCHAR(10))) AS slug,
       CASE WHEN event_id % 90 % 5 = 0 THEN concat('w-', CAST(event_id % 90 * 3 AS VARCHAR(10)))
            ELSE concat('vieja-', CAST(event_id % 90 - 1 AS VARCHAR(10))) END AS nuevo
FROM {events}"""
_EXISTING = """
SELECT DISTINCT concat('/novela/w-', CAST(work_id AS VARCHAR(10)), '/capitulo-', CAST(numero AS VARCHAR(10))) AS path
FROM {f_chapters} WHERE aprobado AND numero > 0
UNION ALL SELECT concat('/novela/w-', CAST(p_partkey AS VARCHAR(10))) FROM {part} WHERE p_partkey % 4 <> 3
UNION ALL SELECT '/' UNION ALL SELECT '/categoria/accion' UNION ALL SELECT '/categoria/artes-marciales'"""
check_view("o_requests", _REQUESTS)
check_view("o_redirects", _REDIRECTS)
check_view("o_existing", _EXISTING)
check_view("o_final_redirect", """
    SELECT slug, concat('w-', CAST((CAST(substr(slug, 7) AS INT) - CAST(substr(slug, 7) AS INT) % 5) * 3 AS VARCHAR)) AS final
    FROM o_redirects""")


@query("j13_resolve_redirects", """
    SELECT r.event_id, r.path, CASE WHEN f.final IS NULL THEN '' ELSE concat(
             regexp_extract(path, '^(/(?:[a-z]{2}/)?novela/)([^/]+)(/.*)?$', 1), f.final,
             coalesce(nullif(regexp_extract(path, '^(/(?:[a-z]{2}/)?novela/)([^/]+)(/.*)?$', 3), ''), '/')) END AS destino
    FROM o_requests r LEFT JOIN o_final_redirect f ON f.slug = regexp_extract(path, '^(/(?:[a-z]{2}/)?novela/)([^/]+)(/.*)?$', 2)""")
def _(t):
    rows = requests.resolve_redirects(t.sql(_REQUESTS), t.sql(_REDIRECTS))
    return rows.select("event_id", "path", F.coalesce("destino", F.lit("")).alias("destino"))


_RP = "(?:en|pt|id|fr|de|vi)"


@query("p10_classify_requests", f"""
    WITH p AS (SELECT path, count(*) AS hits FROM o_requests GROUP BY path),
    s AS (SELECT *, lower(trim(replace(replace(coalesce(
              nullif(regexp_extract(path, '(?i)^(?:/(?:en|pt|de|fr|it|br))?/novela/([^/]+)', 1), ''),
              nullif(regexp_extract(path, '^/portada/([^/.]+)', 1), '')), '%2D', '-'), '%20', ' '))) AS slug,
            TRY_CAST(regexp_extract(path, '^/novela/[^/]+/capitulo-([0-9]+)/?$', 1) AS BIGINT) AS num,
            CASE WHEN regexp_matches(path, '^/{_RP}(?:/.*)?$') THEN coalesce(nullif(regexp_extract(path, '^/{_RP}(/.*)?$', 1), ''), '/')
                 WHEN regexp_matches(path, '^/novela/(.+)-capitulo-([0-9]+)/?$')
                   THEN regexp_replace(path, '^/novela/(.+)-capitulo-([0-9]+)/?$', '/novela/\\1/capitulo-\\2')
                 WHEN g.clave IS NOT NULL AND g.clave <> regexp_extract(path, '^/categoria/([^/]+)/?$', 1)
                   THEN concat('/categoria/', g.clave, '/') ELSE path END AS fixed
          FROM p LEFT JOIN o_genres g ON g.spelling = replace(nullif(regexp_extract(path, '^/categoria/([^/]+)/?$', 1), ''), '-', ' ')),
    d AS (SELECT s.*, coalesce(CASE WHEN f.final IS NOT NULL THEN concat(
              regexp_extract(fixed, '^(/(?:[a-z]{{2}}/)?novela/)([^/]+)(/.*)?$', 1), f.final,
              coalesce(nullif(regexp_extract(fixed, '^(/(?:[a-z]{{2}}/)?novela/)([^/]+)(/.*)?$', 3), ''), '/')) END,
              CASE WHEN fixed <> path THEN fixed END) AS dest
          FROM s LEFT JOIN o_final_redirect f ON f.slug = regexp_extract(fixed, '^(/(?:[a-z]{{2}}/)?novela/)([^/]+)(/.*)?$', 2)),
    e AS (SELECT *, regexp_replace(dest, '/capitulo-[0-9]+/?$', '/') AS work FROM d),
    x AS (SELECT *, slug IN (SELECT lower(trim(slug)) FROM o_takedown) AS gone,
            CASE WHEN path = '/' THEN '/' ELSE rtrim(path, '/') END IN (SELECT path FROM o_existing) AS here,
            CASE WHEN dest = '/' THEN '/' ELSE rtrim(dest, '/') END IN (SELECT path FROM o_existing) AS there,
            regexp_matches(dest, '/capitulo-[0-9]+/?$') AND rtrim(work, '/') IN (SELECT path FROM o_existing) AS work_there FROM e),
    y AS (SELECT *, CASE WHEN gone THEN 410 WHEN num BETWEEN 1 AND 99999 AND path LIKE '%/capitulo-0%' THEN 301 WHEN here THEN 200
                    WHEN there OR work_there THEN 301 ELSE 404 END AS status FROM x)
    SELECT path, hits, status, CASE WHEN status <> 301 THEN ''
             WHEN num BETWEEN 1 AND 99999 AND path LIKE '%/capitulo-0%'
               THEN regexp_replace(path, '/capitulo-0+', '/capitulo-')
             WHEN there THEN dest ELSE work END AS destino FROM y""")
def _(t):
    rows = requests.classify_requests(t.sql(_REQUESTS), t.sql(_EXISTING), t.sql(_REDIRECTS), t.sql(_TAKEDOWN))
    return rows.withColumn("destino", F.coalesce("destino", F.lit("")))


@query("j14_recover_dead_slugs", """
    WITH asked AS (SELECT DISTINCT slug AS viejo FROM (
        SELECT regexp_replace(regexp_replace(lower(strip_accents(coalesce(alt1, 'nada'))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug
        FROM f_works)),
    named AS (SELECT substr(slug, 1, 80) AS viejo, max(work_id) AS work_id FROM (
        SELECT work_id, regexp_replace(regexp_replace(lower(strip_accents(a)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug
        FROM (SELECT work_id, unnest([alt1, alt2, alt3]) AS a FROM f_works) WHERE a IS NOT NULL) GROUP BY 1)
    SELECT viejo, concat('w-', CAST(work_id AS VARCHAR)) AS slug FROM asked JOIN named USING (viejo) WHERE work_id % 6 <> 0""")
def _(t):
    from tandem.functions.text import slugify

    old = slugify(F.coalesce("alt1", F.lit("nada")))
    asked = t.works.select(
        F.concat(F.lit("https://catalogo.example.com/novela/"), old,
                 F.when(F.col("work_id") % 2 == 0, "/").otherwise("-capitulo-7")).alias("url")
    )
    recorded = F.when(F.col("work_id") % 6 == 0, F.transform("titulos_alternativos", lambda a: slugify(a)))
    works = t.works.withColumn("slugs_antiguos", F.coalesce(recorded, F.array().cast("array<string>")))
    return requests.recover_dead_slugs(asked, works)


@query("p11_search_titles", """
    SELECT work_id, titulo, CAST(puesto AS INT) AS puesto FROM (SELECT work_id, titulo, row_number() OVER (
        ORDER BY starts_with(q, 'red') DESC, destacada DESC, titulo, work_id) AS puesto FROM (
      SELECT *, trim(regexp_replace(lower(strip_accents(array_to_string(list_filter([titulo, alt1, alt2, alt3], lambda x: x IS NOT NULL), ' '))),
             '[^\\pL\\pN]+', ' ', 'g')) AS q FROM o_works) WHERE contains(q, 'red')) WHERE puesto <= 8""")
def _(t):
    return work_pages.search_titles(published(t), "¡RéD!")


_NORMAL = "trim(regexp_replace(lower(strip_accents({x})), '[^\\pL\\pN]+', ' ', 'g'))"


@query("p11_many_questions", f"""
    WITH n AS (SELECT work_id, titulo, destacada, {_NORMAL.format(x="array_to_string(list_filter([titulo, alt1, alt2, alt3], lambda x: x IS NOT NULL), ' ')")} AS names FROM o_works),
    q AS (SELECT DISTINCT q FROM (SELECT concat('¡', upper(substr(p_name, 2, 4)), '!') AS q FROM part
            UNION ALL SELECT substr(p_name, length(p_name) - p_partkey % 3) FROM part UNION ALL SELECT p_brand FROM part))
    SELECT q, work_id, titulo, CAST(puesto AS INT) AS puesto FROM (
      SELECT q, work_id, titulo, row_number() OVER (PARTITION BY q ORDER BY starts_with(names, w) DESC, destacada DESC, titulo, work_id) AS puesto
      FROM (SELECT q, {_NORMAL.format(x="q")} AS w FROM q) JOIN n ON contains(names, w)) WHERE puesto <= 8""")
def _(t):
    asked = t.sql("""
        SELECT concat('¡', upper(substr(p_name, 2, 4)), '!') AS q FROM {part}
        UNION ALL SELECT substr(p_name, CAST(length(p_name) - p_partkey % 3 AS INT)) FROM {part} UNION ALL SELECT p_brand FROM {part}""")
    return work_pages.search_titles_of(published(t), asked)


@query("p11_search_admin", "SELECT work_id, titulo FROM o_works WHERE titulo ILIKE '%GEAR%' ORDER BY titulo, work_id LIMIT 8")
def _(t):
    return work_pages.search_admin(published(t), "GEAR")


check_view("o_source_cards", """
    SELECT r.*, s.nombre FROM o_rollup r JOIN f_sources s USING (source_id)""")


@query("p12_page_meta", """
    WITH pw AS (SELECT work_id, count(*) AS n, coalesce(max(ultimo) FILTER (tipo = 'manhwa'), 0) AS um,
                       coalesce(max(ultimo) FILTER (tipo = 'novela'), 0) AS un FROM o_rollup GROUP BY work_id),
    nm AS (SELECT work_id, nombre, max(total) AS total, row_number() OVER (PARTITION BY work_id ORDER BY max(total) DESC, nombre) AS rn,
                  count(*) OVER (PARTITION BY work_id) AS c FROM o_source_cards WHERE nombre <> '' GROUP BY work_id, nombre),
    n5 AS (SELECT work_id, max(c) AS c, string_agg(nombre, ', ' ORDER BY rn) FILTER (rn <= 5) AS nombres FROM nm GROUP BY work_id),
    en AS (SELECT work_id, nullif(segundo_nombre, '') AS alt FROM o_second_names),
    fm AS (SELECT work_id, list_sort(list_distinct(list(tipo))) AS f FROM o_chapters GROUP BY work_id),
    w AS (SELECT o.work_id, o.titulo AS t, o.estado, o.tipo, nullif(en.alt, o.titulo) AS alt, coalesce(pw.n, 0) AS n, coalesce(pw.um, 0) AS um,
                 coalesce(pw.un, 0) AS un, coalesce(n5.c, 0) AS c, n5.nombres, coalesce(fm.f, []) AS f, g.manhwa, g.novela, g.faltan
          FROM o_works o LEFT JOIN pw USING (work_id) LEFT JOIN n5 USING (work_id) LEFT JOIN en USING (work_id)
          LEFT JOIN fm USING (work_id) LEFT JOIN o_gap g USING (work_id)),
    x AS (SELECT *, concat_ws(' · ', CASE WHEN um > 0 THEN concat('manhwa cap. ', um) END, CASE WHEN un > 0 THEN concat('novela cap. ', un) END) AS suf,
                 CASE WHEN len(f) = 2 THEN 'manhwa y novela' ELSE coalesce(f[1], '') END AS ft,
                 concat(n, ' ', CASE WHEN n = 1 THEN 'fuente' ELSE 'fuentes' END) AS nt FROM w),
    y AS (SELECT *, concat(concat_ws(' / ', t, alt), CASE WHEN suf = '' THEN '' ELSE ' — ' || suf END) AS largo,
                 concat(t, CASE WHEN suf = '' THEN '' ELSE ' — ' || suf END) AS corto FROM x)
    SELECT work_id, CASE WHEN length(largo) <= 65 THEN largo ELSE corto END AS titulo_seo,
      CASE WHEN faltan > 0 THEN concat('El manhwa va por el capítulo ', manhwa, ' y la novela por el ', novela, ': te faltan ', faltan,
             ' capítulos de historia. Te decimos por cuál seguir y dónde leerla.')
           ELSE concat(t, ': ', ft, '. Dónde leerla en ', nt, ', el último capítulo de cada una y por cuál seguir.') END AS descripcion,
      CASE WHEN len(f) = 2 THEN 'CreativeWorkSeries' WHEN f[1] = 'novela' THEN 'BookSeries' ELSE 'ComicSeries' END AS tipo_serie,
      concat_ws(' ', concat(t, CASE WHEN alt IS NULL THEN '' ELSE concat(' (', alt, ')') END, ' está disponible como ',
                            CASE WHEN len(f) = 0 THEN tipo ELSE ft END, '.'),
                CASE WHEN n > 0 THEN concat('Está indexada en ', nt, ', cada una con enlace al sitio original.') END,
                CASE WHEN faltan IS NOT NULL THEN concat('La novela va por el capítulo ', novela, ' y el manhwa por el ', manhwa,
                     CASE WHEN faltan > 0 THEN concat(': ', faltan, ' capítulos por delante') ELSE '' END, '.') END) AS intro,
      concat('[', concat_ws(',',
        CASE WHEN c > 0 THEN concat('{"pregunta":"¿Dónde leer ', t, '?","respuesta":"Está indexada en ', c, CASE WHEN c = 1 THEN ' fuente' ELSE ' fuentes' END,
             ' (', nombres, '). Cada una enlaza al sitio original donde se lee gratis."}') END,
        CASE WHEN faltan IS NOT NULL THEN concat('{"pregunta":"¿Cuántos capítulos tiene ', t, '?","respuesta":"El manhwa lleva ', manhwa,
             ' capítulos indexados y la novela ', novela, CASE WHEN faltan > 0 THEN concat(', ', faltan, ' por delante del manhwa') ELSE '' END, '."}') END,
        CASE WHEN faltan IS NOT NULL THEN concat('{"pregunta":"¿Puedo leer la novela de ', t, ' sin spoilers del manhwa?","respuesta":"',
             'Sí: empieza por el capítulo de la novela que corresponde a donde dejaste el manhwa. Lo que la novela te adelanta es lo que el manhwa aún no ha dibujado, no lo que ya leíste."}') END,
        CASE WHEN estado <> '' THEN concat('{"pregunta":"¿', t, ' está terminada?","respuesta":"', CASE WHEN estado = 'Finalizado'
             THEN concat('Sí, ', t, ' está finalizada.') ELSE concat('No, ', t, ' sigue en emisión y recibe capítulos nuevos.') END, '"}') END),
        ']') AS preguntas
    FROM y""")
def _(t):
    return work_pages.page_meta(published(t), t.chapters, t.sources)


@query("p12_equivalence_meta", """
    SELECT work_id, concat(titulo, ': which novel chapter does the manhwa continue from? — Manhwa ', manhwa, ' → Novel ', novela) AS titulo_seo,
           concat('Which novel chapter should I continue ', titulo, ' from?') AS encabezado, r AS respuesta,
           concat('[{"pregunta":"Which novel chapter does the ', titulo, ' manhwa continue from?","respuesta":"', r, '"},{"pregunta":"How many chapters does the ',
             titulo, ' novel have?","respuesta":"The novel has ', novela, ' chapters indexed and the manhwa ', manhwa, '."},{"pregunta":"Does reading the ', titulo,
             ' novel spoil the manhwa?","respuesta":"Not if you start from the chapter that matches where you left the manhwa. What the manhwa skips is ahead of you, not behind: the novel only gets you ahead on what the manhwa has not drawn yet."}]') AS preguntas
    FROM (SELECT *, CASE WHEN faltan > 0 THEN concat('The ', titulo, ' manhwa is at chapter ', manhwa, ' and the novel at ', novela, ': ', faltan,
                                                    ' chapters of story the manhwa has not told yet.')
                    ELSE concat('The ', titulo, ' manhwa is at chapter ', manhwa, ' and the novel at ', novela,
                                ': the manhwa has practically caught up with the novel.') END AS r
          FROM o_works JOIN o_gap USING (work_id))""")
def _(t):
    from tandem.operators.gap import gap

    return work_pages.equivalence_meta(published(t), gap(t.chapters), "en")


check_view("o_linked", """
    SELECT c.work_id, c.numero, r.solo_enlace FROM o_chapters c JOIN o_rollup r USING (work_id, source_id) WHERE c.numero IS NOT NULL""")


@query("j17_chapter_pages", """
    WITH per AS (SELECT work_id, numero, count(*) FILTER (NOT solo_enlace) AS reales, count(*) AS todas FROM o_linked GROUP BY work_id, numero)
    SELECT p.work_id, p.numero, CASE WHEN p.numero = 1 THEN todas ELSE reales END AS filas,
           coalesce((SELECT max(q.numero) FROM per q WHERE q.work_id = p.work_id AND q.numero < p.numero AND (p.numero = 1 OR q.reales > 0)), -1) AS anterior,
           coalesce((SELECT min(q.numero) FROM per q WHERE q.work_id = p.work_id AND q.numero > p.numero AND (p.numero = 1 OR q.reales > 0)), -1) AS siguiente,
           i.en_novela
    FROM per p JOIN o_interpolated i USING (work_id, numero) WHERE p.numero BETWEEN 1 AND 99999 AND CASE WHEN p.numero = 1 THEN todas ELSE reales END > 0""")
def _(t):
    return work_pages.chapter_pages(t.chapters, t.anchors).fillna(-1, ["anterior", "siguiente", "en_novela"])
