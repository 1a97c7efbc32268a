"""Registered queries: provider records, translations, hubs, reading progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.text import text_key
from tandem.operators import enrichment
from tandem.operators.catalog_text import joined
from tandem.plans.rankings import published
from tandem.plans.registry import check_view, query
from tandem.plans.texts import sql_list

# up to four records per work: some match by title, some by another name, some only by the translated title
_RECORDS = """
SELECT work_id, proveedor, traducida, t1, t2, t3, sinopsis, g1, g2, e1, e2, estado, portada, demografia FROM (
  SELECT p_partkey AS work_id, 'anilist' AS proveedor, p_partkey % 7 = 3 AS traducida,
         CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' ', CAST(p_partkey % 97 AS VARCHAR(10))) WHEN p_partkey % 7 = 3
              THEN concat('English name ', CAST(p_partkey AS VARCHAR(10))) ELSE 'Other work' END AS t1,
         concat('Also ', p_name, ' ', CAST(p_partkey AS VARCHAR(10))) AS t2, 'Also known' AS t3,
         concat('Story of ', p_name, '.', chr(10), chr(10), '(Source: X)') AS sinopsis,
         'Action' AS g1, 'Mystery' AS g2, 'Male Protagonist' AS e1, 'Rebirth' AS e2,
         'Finalizado' AS estado, concat('https://img.example.org/a/', CAST(p_partkey AS VARCHAR(10))) AS portada,
         CASE WHEN p_partkey % 2 = 0 THEN 'Seinen' ELSE NULL END AS demografia FROM {part}
  UNION ALL
  SELECT p_partkey, 'mangabaka', false, CASE WHEN p_partkey % 5 < 3 THEN concat('¡', p_name, ' ', CAST(p_partkey % 97 AS VARCHAR(10)), '!') ELSE 'Nothing' END,
         concat('Baka ', p_name, ' ', CAST(p_partkey AS VARCHAR(10))), concat('또다른 ', CAST(p_partkey AS VARCHAR(10))),
         'Plain text', 'Comedia', 'Acción', 'Full Color', 'Game System', 'En emisión', NULL, 'Shounen' FROM {part} WHERE p_partkey % 4 <> 1
  UNION ALL
  SELECT p_partkey, 'mal', false, CASE WHEN p_partkey % 4 = 1 THEN concat('The ', p_name, ' ', CAST(p_partkey % 97 AS VARCHAR(10))) ELSE 'x' END,
         concat('Mal ', CAST(p_partkey AS VARCHAR(10))), NULL, '', 'Terror', NULL, NULL, 'Cooking', NULL,
         concat('https://img.example.org/m/', CAST(p_partkey AS VARCHAR(10))), NULL FROM {part} WHERE p_partkey % 2 = 1) r"""
check_view("o_records", _RECORDS.replace("{part}", "part"))


def records_of(t):
    present = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return t.sql(_RECORDS).select(
        "work_id", "proveedor", "traducida", present("t1", "t2", "t3").alias("titulos"), "sinopsis",
        present("g1", "g2").alias("generos"), present("e1", "e2").alias("etiquetas"), "estado", "portada", "demografia",
    )


def works_to_fill(t):
    written = F.when(F.col("lang").isin("es", "fr"), F.col("sinopsis")).otherwise(" ")
    story = t.synopses.select("work_id", written.alias("sinopsis"))
    return (
        published(t).join(story, "work_id", "left").fillna("", ["sinopsis"])
        .withColumn("titulo_traducido", F.when(F.col("work_id") % 7 == 3, F.concat(F.lit("English Name "), F.col("work_id").cast("string"))))
    )


# the matching rule is name_keys; here a title matches when it is the work's own title, with or without article and signs
check_view("o_accepted", f"""
    SELECT r.*, list_position({sql_list(fv.PROVIDER_ORDER)}, r.proveedor) AS orden FROM o_records r JOIN o_works w USING (work_id)
    WHERE EXISTS (SELECT 1 FROM o_keys k, o_record_keys q WHERE k.work_id = r.work_id AND q.work_id = r.work_id AND q.proveedor = r.proveedor
                  AND len(list_intersect(k.claves, q.claves)) > 0) OR (r.traducida AND r.work_id % 7 = 3 AND r.t1 LIKE 'English name %')""")
check_view("o_record_keys", f"""
    SELECT work_id, proveedor, list_filter(flatten(list_transform([n, regexp_replace(n, '^({"|".join(fv.LEADING_ARTICLES)})\\s+', '')],
             lambda c: CASE WHEN len(string_split(c, ' ')) >= 3 THEN [c, array_to_string(list_sort(string_split(c, ' ')), ' ')] ELSE [c] END)),
             lambda k: k <> '') AS claves
    FROM (SELECT work_id, proveedor, trim(regexp_replace(lower(strip_accents(x)), '[^\\pL\\pN]+', ' ', 'g')) AS n
          FROM (SELECT work_id, proveedor, unnest([t1, t2, t3]) AS x FROM o_records) WHERE x IS NOT NULL)""")
check_view("o_used", """
    SELECT a.* FROM o_accepted a JOIN (SELECT work_id, min(traducida) AS turn FROM o_accepted GROUP BY work_id) m
      ON a.work_id = m.work_id AND a.traducida = m.turn""")
check_view("o_first_record", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY orden) AS rn FROM o_used) WHERE rn = 1")


@query("j10_accepted_records", "SELECT work_id, proveedor, traducida, orden FROM o_used")
def _(t):
    return enrichment.accepted_records(works_to_fill(t), records_of(t)).select("work_id", "proveedor", "traducida", "orden")


def _genre_steps(all_providers: bool) -> str:
    base = "o_used" if all_providers else "o_first_record"
    return f"""
    x AS (SELECT work_id, 0 AS src, pos AS p, label FROM o_labels_raw
      UNION ALL SELECT work_id, orden, 0, g1 FROM {base} WHERE g1 IS NOT NULL UNION ALL SELECT work_id, orden, 1, g2 FROM {base} WHERE g2 IS NOT NULL
      UNION ALL SELECT work_id, orden, 2 + i, e FROM (SELECT work_id, orden, unnest([e1, e2]) AS e, unnest([0, 1]) AS i FROM {base})
                JOIN o_genres ON spelling = lower(e)),
    k AS (SELECT x.*, coalesce(g.clave, regexp_replace(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS clave
          FROM x LEFT JOIN o_genres g ON g.spelling = trim(regexp_replace(regexp_replace(lower(strip_accents(label)), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))),
    f AS (SELECT work_id, clave, arg_min(trim(label), (src, p)) AS label, min((src, p)) AS en FROM k GROUP BY work_id, clave),
    l AS (SELECT work_id, list(label ORDER BY en) AS cats,
             CASE WHEN bool_or(clave IN ({str(fv.ADULT_HINTS)[1:-1]})) THEN 'Seinen' WHEN bool_or(clave IN ({str(fv.ACTION_HINTS)[1:-1]})) THEN 'Shounen'
                  WHEN bool_or(clave IN ({str(fv.ROMANCE_HINTS)[1:-1]})) THEN 'Shoujo' END AS guess FROM f GROUP BY work_id)"""


@query("j10_enriched_genres", f"""
    WITH {_genre_steps(True)},
    d AS (SELECT work_id, arg_min(demografia, orden) FILTER (demografia IS NOT NULL) AS dem, string_agg(proveedor, '+' ORDER BY orden) AS fuente
          FROM o_used GROUP BY work_id)
    SELECT work_id, array_to_string(list_concat(CASE WHEN fuente IS NULL THEN list_filter([tag1, tag2, tag3], lambda x: x IS NOT NULL) ELSE cats END,
             CASE WHEN coalesce(d.dem, guess) IS NULL THEN [] ELSE [coalesce(d.dem, guess)] END), '|') AS categorias,
           coalesce(fuente, '') AS fuente
    FROM l JOIN o_works USING (work_id) LEFT JOIN d USING (work_id)""")
def _(t):
    works = works_to_fill(t)
    record = enrichment.combined_record(enrichment.accepted_records(works, records_of(t)), all_providers=True)
    rows = enrichment.enrich(works, record)
    return rows.select("work_id", joined("categorias").alias("categorias"), F.coalesce("metadatos_fuente", F.lit("")).alias("fuente"))


@query("j10_enriched_fields", """
    WITH nm AS (SELECT work_id, 0 AS src, i AS p, a AS nombre FROM (SELECT work_id, unnest([alt1, alt2, alt3]) AS a, unnest([0, 1, 2]) AS i FROM o_works)
        UNION ALL SELECT work_id, orden, i, a FROM (SELECT work_id, orden, unnest([t1, t2, t3]) AS a, unnest([0, 1, 2]) AS i FROM (
          SELECT * FROM o_first_record UNION ALL SELECT u.*, 2 AS rn FROM o_used u JOIN o_first_record r USING (work_id)
          WHERE u.proveedor = 'mangabaka' AND u.orden > r.orden))),
    nn AS (SELECT nm.work_id, nombre, min((src, p)) AS en FROM nm JOIN o_works w ON w.work_id = nm.work_id
           WHERE nombre IS NOT NULL AND nombre <> w.titulo GROUP BY nm.work_id, nombre),
    al AS (SELECT work_id, array_to_string(list(nombre ORDER BY en), '|') AS alt FROM nn GROUP BY work_id)
    SELECT w.work_id, CASE WHEN r.work_id IS NULL THEN concat_ws('|', alt1, alt2, alt3) ELSE al.alt END AS titulos_alternativos,
           md5(CASE WHEN trim(coalesce(d.text, '')) = '' AND coalesce(r.sinopsis, '') <> ''
                    THEN regexp_replace(r.sinopsis, '\\s*\\(Source: X\\)$', '') ELSE coalesce(d.text, '') END) AS sinopsis,
           CASE WHEN w.estado = '' AND r.estado IS NOT NULL THEN r.estado ELSE w.estado END AS estado,
           CASE WHEN (w.portada_url = '' OR regexp_matches(w.portada_url, '(?i)mangadex|imageshack')) AND r.portada IS NOT NULL
                THEN r.portada ELSE w.portada_url END AS portada_url, coalesce(r.proveedor, '') AS fuente
    FROM o_works w LEFT JOIN o_first_record r USING (work_id) LEFT JOIN al USING (work_id)
    LEFT JOIN (SELECT doc_id, CASE WHEN lang IN ('es', 'fr') THEN text ELSE ' ' END AS text FROM documents) d ON d.doc_id = w.work_id""")
def _(t):
    works = works_to_fill(t)
    record = enrichment.combined_record(enrichment.accepted_records(works, records_of(t)))
    rows = enrichment.enrich(works, record)
    return rows.select(
        "work_id", joined("titulos_alternativos").alias("titulos_alternativos"), F.md5("sinopsis").alias("sinopsis"),
        "estado", "portada_url", F.coalesce("metadatos_fuente", F.lit("")).alias("fuente"),
    )


# ---- translation: the cache holds the paragraphs of the documents that are not English -----

_PARAGRAPHS = """
SELECT doc_id AS work_id, lang, concat(text, chr(10), chr(10), 'Nota ', CAST(doc_id % 50 AS VARCHAR(10))) AS sinopsis FROM {documents}"""
check_view("o_paragraphs", """
    SELECT work_id, unnest(string_split(sinopsis, chr(10) || chr(10))) AS p,
           generate_subscripts(string_split(sinopsis, chr(10) || chr(10)), 1) AS pos
    FROM (SELECT doc_id AS work_id, concat(text, chr(10), chr(10), 'Nota ', CAST(doc_id % 50 AS VARCHAR(10))) AS sinopsis FROM documents)""")
check_view("o_cached", "SELECT DISTINCT p FROM o_paragraphs JOIN documents ON doc_id = work_id WHERE lang <> 'en'")


def cache_of(t):
    known = t.sql(_PARAGRAPHS).where("lang <> 'en'").select(F.explode(F.split("sinopsis", "\n\n")).alias("p")).distinct()
    return known.select(text_key("p").alias("clave"), F.lit("en").alias("idioma"), F.concat(F.lit("EN "), "p").alias("texto"))


@query("j11_translate_lookup", """
    SELECT work_id, md5(string_agg(CASE WHEN c.p IS NULL THEN o.p ELSE concat('EN ', o.p) END, chr(10) || chr(10) ORDER BY pos)) AS sinopsis,
           count(c.p) AS traducidos
    FROM o_paragraphs o LEFT JOIN o_cached c USING (p) GROUP BY work_id""")
def _(t):
    rows = enrichment.translate_lookup(t.sql(_PARAGRAPHS), cache_of(t), "en", "work_id", "sinopsis")
    return rows.withColumn("sinopsis", F.md5("sinopsis"))


@query("j12_localize", f"""
    WITH tr AS (SELECT work_id, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS raw,
                string_agg(CASE WHEN c.p IS NULL THEN o.p ELSE concat('EN ', o.p) END, chr(10) || chr(10) ORDER BY pos) AS shown, count(c.p) AS n
                FROM o_paragraphs o LEFT JOIN o_cached c USING (p) GROUP BY work_id),
    q AS (SELECT *, regexp_extract_all(lower(raw), '[a-záéíóúñü]+') AS ws FROM tr),
    en AS (SELECT work_id, arg_min(nombre, name_pos) AS t FROM o_name_language
           WHERE idioma = 'en' AND NOT regexp_matches(nombre, '(?i)\\s(novela|novel|manhwa|manga|webtoon)$') GROUP BY work_id),
    g AS (SELECT work_id, string_agg(en, '|' ORDER BY pos) AS gs FROM o_first_labels GROUP BY work_id)
    SELECT w.work_id, coalesce(en.t, w.titulo) AS titulo,
           md5(CASE WHEN q.n > 0 OR (len(ws) >= 12 AND len(list_filter(ws, lambda x: list_contains({sql_list(fv.PROSE_WORDS_EN)}, x)))
               > 2 * len(list_filter(ws, lambda x: list_contains({sql_list(fv.PROSE_WORDS_ES)}, x)))) THEN shown ELSE '' END) AS sinopsis,
           g.gs AS categorias,
           array_to_string(list_filter([w.titulo, alt1, alt2, alt3], lambda x: x IS NOT NULL AND x <> coalesce(en.t, w.titulo)), '|') AS titulos_alternativos
    FROM o_works w JOIN q USING (work_id) LEFT JOIN en USING (work_id) JOIN g USING (work_id)""")
def _(t):
    works = published(t).join(t.sql(_PARAGRAPHS), "work_id")
    rows = enrichment.localize(works, cache_of(t), "en")
    return rows.select(
        "work_id", "titulo", F.md5("sinopsis").alias("sinopsis"), joined("categorias").alias("categorias"),
        joined("titulos_alternativos").alias("titulos_alternativos"),
    )


@query("a12_coverage", """
    SELECT l.idioma, CASE l.idioma WHEN 'es' THEN 1.0::DOUBLE WHEN 'en' THEN avg(CAST(c.p IS NOT NULL AS INT)) ELSE 0.0 END AS cobertura,
           l.idioma = 'es' AS publicado
    FROM (SELECT DISTINCT p FROM o_paragraphs) x LEFT JOIN o_cached c USING (p), (VALUES ('es'), ('en'), ('pt')) l(idioma) GROUP BY l.idioma""")
def _(t):
    texts = t.sql(_PARAGRAPHS).select(F.explode(F.split("sinopsis", "\n\n")).alias("texto"))
    return enrichment.coverage(texts, cache_of(t), ["es", "en", "pt"], ["es", "en"])


check_view("o_missing", """
    SELECT x.p, x.origen, l.idioma FROM (SELECT p, max(lang) AS origen FROM o_paragraphs JOIN documents ON doc_id = work_id WHERE trim(p) <> '' GROUP BY p) x,
      (VALUES ('es'), ('en'), ('pt')) l(idioma)
    WHERE x.origen <> l.idioma AND NOT (l.idioma = 'en' AND x.p IN (SELECT p FROM o_cached))""")


def texts_of(t):
    return t.sql(_PARAGRAPHS).select(F.explode(F.split("sinopsis", "\n\n")).alias("texto"), F.col("lang").alias("origen"))


@query("a13_translation_backlog", """
    SELECT idioma, count(*) AS faltan, CAST(sum(length(p)) AS BIGINT) AS caracteres FROM o_missing GROUP BY idioma""")
def _(t):
    return enrichment.translation_backlog(texts_of(t), cache_of(t), ["es", "en", "pt"])


@query("t9_incremental_translate", """
    SELECT idioma, md5(concat(origen, '>', idioma, ' ', p)) AS huella FROM o_missing""")
def _(t):
    def stub(texts, source, target):
        return [f"{source}>{target} {x}" for x in texts]

    rows = enrichment.incremental_translate(texts_of(t), cache_of(t), ["es", "en", "pt"], stub)
    return rows.select("idioma", F.md5("texto").alias("huella"))


check_view("o_hubs", """
    SELECT clave AS slug, min(es) AS nombre, count(DISTINCT work_id) AS obras, count(DISTINCT work_id) >= 8 AS destacado
    FROM o_labels JOIN o_works USING (work_id) WHERE NOT adulta AND clave <> '' AND clave NOT IN ('adulto', 'hentai', 'smut', 'erotico', 'lolicon', 'shotacon')
    GROUP BY clave""")


@query("a11_genre_hubs", "SELECT * FROM o_hubs")
def _(t):
    return enrichment.genre_hubs(published(t))


@query("a11_featured_hubs", "SELECT slug, obras FROM o_hubs WHERE destacado ORDER BY obras DESC, slug LIMIT 24")
def _(t):
    return enrichment.featured_hubs(enrichment.genre_hubs(published(t))).select("slug", "obras")


@query("j18_sync_progress", """
    WITH s AS (SELECT user_id, work_id, es_local, list_sort(list_distinct(list(capitulo))) AS caps, bool_or(favorito) AS fav
               FROM f_progress GROUP BY user_id, work_id, es_local),
    x AS (SELECT coalesce(c.user_id, l.user_id) AS user_id, coalesce(c.work_id, l.work_id) AS work_id, c.caps AS c, c.fav AS cf,
                 list_sort(list_distinct(list_concat(coalesce(c.caps, []), coalesce(l.caps, [])))) AS u,
                 coalesce(c.fav, false) OR coalesce(l.fav, false) AS favorito
          FROM (SELECT * FROM s WHERE NOT es_local) c FULL JOIN (SELECT * FROM s WHERE es_local) l
            ON c.user_id = l.user_id AND c.work_id = l.work_id)
    SELECT user_id, work_id, array_to_string(u, ',') AS capitulos, favorito, NOT (c IS NOT NULL AND c = u AND cf = favorito) AS subir FROM x""")
def _(t):
    def side(condition):
        return t.progress.where(condition).groupBy("user_id", "work_id").agg(
            F.collect_set("capitulo").alias("capitulos"), F.bool_or("favorito").alias("favorito")
        )

    rows = enrichment.sync_progress(side("es_local"), side("NOT es_local"))
    return rows.withColumn("capitulos", F.array_join(F.col("capitulos").cast("array<string>"), ","))
