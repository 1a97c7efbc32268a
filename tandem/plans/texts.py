"""Registered queries: text, genre, URL and date columns over whole tables."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions import genres, text
from tandem.functions import prose
from tandem.functions.text import TITLE_PREFIX_SQL, text_hash
from tandem.operators import catalog_text as ct
from tandem.operators import rollup
from tandem.plans.registry import check_view, query
from tandem.plans.rankings import published
from datetime import datetime


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def fold(label: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", label) if not 0x300 <= ord(c) < 0x370).lower()


def genre_values() -> str:
    rows, seen = [], {}
    for es, en, aliases in fv.genre_rows():
        for spelling in (es, en, *aliases):
            seen[re.sub(r"\s+", " ", re.sub("[_-]+", " ", fold(spelling))).strip()] = (es, en)
    for spelling, (es, en) in seen.items():
        key = re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", fold(es)))
        rows.append("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (spelling, es, en, key)) + ")")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS g(spelling, es, en, clave)"


check_view("o_genres", genre_values())

_WORDS = "string_split(n, ' ')"
_ARTICLE = "regexp_replace({0}, '^(" + "|".join(fv.LEADING_ARTICLES) + ")\\s+', '')"
_SUFFIX = "regexp_replace({0}, '\\s+(" + "|".join(fv.TYPE_SUFFIXES) + ")$', '')"
check_view(
    "o_names",
    """SELECT work_id, pos AS name_pos, nombre,
              trim(regexp_replace(lower(strip_accents(nombre)), '[^\\pL\\pN]+', ' ', 'g')) AS n FROM (
         SELECT work_id, unnest(list_filter([titulo, alt1, alt2, alt3], lambda x: x IS NOT NULL)) AS nombre,
                generate_subscripts(list_filter([titulo, alt1, alt2, alt3], lambda x: x IS NOT NULL), 1) - 1 AS pos
         FROM o_works)""",
)
check_view(
    "o_keys",
    f"""SELECT work_id, name_pos, nombre, n, list_filter(flatten(list_transform(
              [n, {_ARTICLE.format('n')}, {_SUFFIX.format('n')}, {_ARTICLE.format(_SUFFIX.format('n'))}],
              lambda c: CASE WHEN len(string_split(c, ' ')) >= 3
                        THEN [c, array_to_string(list_sort(string_split(c, ' ')), ' ')] ELSE [c] END)),
              lambda k: k <> '') AS claves
        FROM o_names""",
)
check_view(
    "o_words",
    f"""SELECT work_id, name_pos, nombre, list_transform(list_filter({_WORDS},
              lambda w: w <> '' AND NOT list_contains({sql_list(fv.STOP_WORDS + fv.FILLER_WORDS)}, w)),
              lambda w: CASE WHEN length(w) > 3 THEN regexp_replace(w, '(es|s)$', '') ELSE w END) AS ws
        FROM o_names""",
)


@query("i1_normalize_name", "SELECT work_id, name_pos, n AS normal FROM o_names")
def _(t):
    return ct.name_keys_table(published(t)).select("work_id", F.col("name_pos").cast("bigint").alias("name_pos"), "normal")


@query("i1_normalize_documents", """
    SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^\\pL\\pN]+', ' ', 'g'))) AS huella FROM documents""")
def _(t):
    return t.base("documents").select("doc_id", F.md5(text.normalize_name("text")).alias("huella"))


@query("i2_name_keys", """
    SELECT DISTINCT work_id, name_pos, unnest(claves) AS clave FROM o_keys""")
def _(t):
    rows = ct.name_keys_table(published(t))
    return rows.select("work_id", F.col("name_pos").cast("bigint").alias("name_pos"), F.explode("claves").alias("clave"))


@query("i3_content_words", """
    SELECT work_id, name_pos, array_to_string(list_sort(list_distinct(ws)), ' ') AS palabras FROM o_words""")
def _(t):
    rows = ct.name_keys_table(published(t))
    return rows.select(
        "work_id", F.col("name_pos").cast("bigint").alias("name_pos"), ct.joined(F.array_sort("palabras"), " ").alias("palabras")
    )


@query("i4_slugify", """
    SELECT work_id, name_pos, substr(regexp_replace(regexp_replace(lower(strip_accents(nombre)), '[^a-z0-9]+', '-', 'g'),
           '^-|-$', '', 'g'), 1, 80) AS slug FROM o_names""")
def _(t):
    rows = ct.name_keys_table(published(t))
    return rows.select("work_id", F.col("name_pos").cast("bigint").alias("name_pos"), "slug")


@query("i5_chapter_number", """
    SELECT id, titulo, url, coalesce(TRY_CAST(coalesce(
             nullif(regexp_extract(titulo, '(?i)(?:cap[íi]tulo|chapter|cap|ch|episodio|ep)[\\s._-]*#?\\s*(\\d{1,5})', 1), ''),
             nullif(regexp_extract(titulo, '\\b(\\d{1,5})\\b', 1), ''),
             nullif(regexp_extract(url, '(?i)(?:cap[íi]tulo|chapter|cap|ch|episodio|ep)[\\s._-]*#?\\s*(\\d{1,5})', 1), ''))
           AS INT), -1) AS numero_leido
    FROM o_chapters""")
def _(t):
    rows = ct.number_chapters(t.chapters)
    return rows.select("id", "titulo", "url", F.coalesce("numero_leido", F.lit(-1)).alias("numero_leido"))


@query("i6_title_rest", f"""
    WITH p AS (SELECT id, titulo, numero, regexp_extract(titulo, '{TITLE_PREFIX_SQL}', 1) AS m FROM o_chapters)
    SELECT id, coalesce(numero, -1) AS numero,
           CASE WHEN TRY_CAST(replace(m, ',', '.') AS DOUBLE) = numero
                THEN trim(regexp_replace(titulo, '{TITLE_PREFIX_SQL}', '')) ELSE titulo END AS resto
    FROM p""")
def _(t):
    return t.chapters.select(
        "id", F.coalesce("numero", F.lit(-1)).alias("numero"), text.title_rest("titulo", "numero").alias("resto")
    )


_LABEL = """trim(regexp_replace(regexp_replace(lower(strip_accents(label)), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"""
check_view(
    "o_labels_raw",
    """SELECT work_id, pos, label FROM (
         SELECT work_id, unnest(list_filter([tag1, tag2, tag3], lambda x: x IS NOT NULL)) AS label,
                generate_subscripts(list_filter([tag1, tag2, tag3], lambda x: x IS NOT NULL), 1) AS pos FROM o_works)
       WHERE trim(label) <> ''""",
)
check_view(
    "o_labels",
    f"""SELECT r.work_id, r.pos, trim(r.label) AS label, coalesce(g.es, trim(r.label)) AS es, coalesce(g.en, trim(r.label)) AS en,
              coalesce(g.clave, regexp_replace(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'))
                AS clave
        FROM o_labels_raw r LEFT JOIN o_genres g ON g.spelling = {_LABEL}""",
)
check_view(
    "o_first_labels",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id, clave ORDER BY pos) AS rn FROM o_labels) WHERE rn = 1",
)


@query("i7_canonical_genre", """
    SELECT work_id, string_agg(es, '|' ORDER BY pos) AS generos_es, string_agg(en, '|' ORDER BY pos) AS generos_en,
           string_agg(clave, '|' ORDER BY pos) AS claves_genero
    FROM o_first_labels GROUP BY work_id""")
def _(t):
    rows = ct.canonicalize_genres(published(t))
    return rows.select("work_id", *[ct.joined(c).alias(c) for c in ("generos_es", "generos_en", "claves_genero")])


@query("i8_all_genres", """
    WITH l AS (SELECT o_custkey AS work_id, concat('Etiqueta ', o_orderkey % 60) AS label, min(o_orderkey) AS en FROM orders GROUP BY 1, 2)
    SELECT work_id, count(*) AS n, string_agg(label, '|' ORDER BY en) AS generos FROM l GROUP BY work_id""")
def _(t):
    label = F.concat(F.lit("Etiqueta "), (F.col("o_orderkey") % 60).cast("string"))
    rows = t.base("orders").select(F.col("o_custkey").alias("work_id"), F.struct("o_orderkey", label.alias("l")).alias("x"))
    lists = rows.groupBy("work_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]).alias("categorias"))
    merged = lists.withColumn("g", genres.merge_genres([F.col("categorias"), F.transform("categorias", F.upper)]))
    return merged.select("work_id", F.size("g").cast("bigint").alias("n"), ct.joined("g").alias("generos"))


@query("i8_merge_genres", """
    SELECT work_id, string_agg(label, '|' ORDER BY pos) AS generos FROM o_first_labels GROUP BY work_id""")
def _(t):
    return ct.canonicalize_genres(published(t)).select("work_id", ct.joined("generos").alias("generos"))


def title_language_sql(t: str) -> str:
    """The decision list over a column ``t`` with its words in ``ws``."""

    def count(words):
        return f"len(list_filter(ws, lambda w: list_contains({sql_list(words)}, w)))"

    def some(pattern, extra="true"):
        return f"len(list_filter(ws, lambda w: {extra} AND regexp_matches(w, '{pattern}'))) > 0"

    def n_long(pattern):
        return f"len(list_filter(ws, lambda w: length(w) >= 4 AND regexp_matches(w, '{pattern}')))"

    french = some(fv.ENDINGS_FR, "length(w) >= 4")
    latin = "'" + f"{fv.OTHER_LATIN}|{fv.ELISION}".replace("'", "''") + "'"
    pinyin = (
        f"len(list_filter(ws, lambda w: regexp_matches(w, '{fv.PINYIN}') "
        "AND (length(w) <= 4 OR regexp_matches(w, 'zh|x|q')))) = len(ws)"
    )
    return f"""CASE WHEN {t} = '' OR regexp_matches({t}, '[^\\x{{0}}-\\x{{24f}}\\x{{2000}}-\\x{{206f}}]') THEN 'otro'
      WHEN regexp_matches(lower({t}), {latin}) THEN 'otro'
      WHEN len(ws) = 0 THEN 'otro' WHEN len(ws) >= 2 AND {pinyin} THEN 'otro'
      WHEN {count(fv.TITLE_WORDS_OTHER)} > {count(fv.TITLE_WORDS_ES)}
           AND {count(fv.TITLE_WORDS_OTHER)} >= {count(fv.TITLE_WORDS_EN)} THEN 'otro'
      WHEN regexp_matches(lower({t}), '[ñ¿¡áíóú]') THEN 'es'
      WHEN regexp_matches(lower({t}), 'é') THEN CASE WHEN {count(fv.TITLE_WORDS_ES)} > 0 AND NOT ({french})
           AND NOT {some('ssion$', 'length(w) >= 4')} THEN 'es' ELSE 'otro' END
      WHEN {french} AND {n_long(fv.ENDINGS_EN)} = 0 THEN 'otro'
      WHEN {count(fv.TITLE_WORDS_ES)} > {count(fv.TITLE_WORDS_EN)} THEN 'es'
      WHEN {count(fv.TITLE_WORDS_EN)} > {count(fv.TITLE_WORDS_ES)} THEN 'en'
      WHEN {some(fv.KOREAN_CLUSTERS)} THEN 'otro'
      WHEN {n_long(fv.ENDINGS_ES)} > {n_long(fv.ENDINGS_EN)} THEN 'es'
      WHEN len(ws) <= 2 AND {some('ae([^l]|$)')} AND {n_long(fv.ENDINGS_EN)} = 0 THEN 'otro' ELSE 'en' END"""


check_view(
    "o_name_language",
    f"""SELECT work_id, name_pos, t AS nombre, {title_language_sql('t')} AS idioma FROM (
          SELECT work_id, name_pos, nombre AS t, regexp_extract_all(lower(strip_accents(nombre)), '[a-z]+') AS ws FROM o_names)""",
)


@query("i9_title_language", """
    SELECT work_id, nombre AS titulo, idioma AS idioma_titulo FROM o_name_language WHERE name_pos = 0""")
def _(t):
    rows = ct.tag_titles(published(t).select("work_id", "titulo", "titulos_alternativos"))
    return rows.select("work_id", "titulo", "idioma_titulo")


@query("i9_document_title_language", f"""
    SELECT doc_id, {title_language_sql('t')} AS idioma_titulo FROM (
      SELECT doc_id, text AS t, regexp_extract_all(lower(strip_accents(text)), '[a-z]+') AS ws FROM documents)""")
def _(t):
    return t.base("documents").select("doc_id", prose.title_language("text").alias("idioma_titulo"))


check_view("o_second_names", """
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY work_id, idioma ORDER BY name_pos) AS rn FROM o_name_language
               WHERE NOT regexp_matches(nombre, '(?i)\\s(novela|novel|manhwa|manga|webtoon)$')),
    m AS (SELECT n.work_id, n.nombre AS titulo, n.idioma, e.nombre AS en, s.nombre AS es
          FROM o_name_language n LEFT JOIN c e ON e.work_id = n.work_id AND e.idioma = 'en' AND e.rn = 1
          LEFT JOIN c s ON s.work_id = n.work_id AND s.idioma = 'es' AND s.rn = 1 WHERE n.name_pos = 0),
    k AS (SELECT *, CASE WHEN idioma <> 'en' THEN en ELSE coalesce(es, en) END AS pick FROM m)
    SELECT work_id, coalesce(en, '') AS titulo_en,
           CASE WHEN lower(strip_accents(pick)) <> lower(strip_accents(titulo)) THEN pick ELSE '' END AS segundo_nombre FROM k""")


@query("i11_pick_title", "SELECT * FROM o_second_names")
def _(t):
    rows = ct.tag_titles(published(t).select("work_id", "titulo", "titulos_alternativos"))
    return rows.select("work_id", "titulo_en", "segundo_nombre").fillna("")


@query("i10_is_english_text", f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-záéíóúñü]+') AS ws,
                      regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts, text FROM documents)
    SELECT doc_id, len(ws) >= 12 AND len(list_filter(ws, lambda x: list_contains({sql_list(fv.PROSE_WORDS_EN)}, x)))
             > 2 * len(list_filter(ws, lambda x: list_contains({sql_list(fv.PROSE_WORDS_ES)}, x))) AS en_ingles,
           CASE WHEN len(list_filter(ts, lambda x: list_contains({sql_list(fv.SOURCE_WORDS_EN)}, x)))
             > len(list_filter(ts, lambda x: list_contains({sql_list(fv.SOURCE_WORDS_ES)}, x)))
               + CASE WHEN regexp_matches(lower(text), '[ñáéíóú¿¡]') THEN 3 ELSE 0 END + 2 THEN 'en' ELSE 'es' END AS idioma_origen
    FROM w""")
def _(t):
    return ct.clean_texts(t.base("documents"), "text").select("doc_id", "en_ingles", "idioma_origen")


# texts with every part the cleaner handles, built around the whole documents
_RAW_SYNOPSES = """
SELECT doc_id, concat(
    CASE WHEN doc_id % 4 = 0 THEN concat('Note: formerly n. ', CAST(doc_id AS VARCHAR(12)), '.', chr(10), chr(10)) ELSE '' END,
    text,
    CASE doc_id % 5 WHEN 0 THEN concat(chr(10), '*(Source: SITE)*') WHEN 1 THEN ' (From [Page](https://x.example.com/g?id=1))'
         WHEN 2 THEN concat(' see https://y.example.com/a-b **now** [name](http://z.example.com)  .') ELSE '' END,
    CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), chr(10), '**Original Novel:**', chr(10), '[Raw](https://n.example.com/x)',
                                        chr(10), chr(10), 'After the card') ELSE '' END) AS sinopsis
FROM {documents}"""
check_view("o_raw_synopses", _RAW_SYNOPSES)
_BLANK = "[\\s\\x0b\\x{a0}\\x{2028}\\x{2029}\\x{3000}\\x{feff}]"


def trim_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_POLISH = [
    ("(?i)\\*?\\s*[(\\[]\\s*(?:source|from|fuente|desde)\\b\\s*:?(?:[^()\\[\\]]|\\[[^\\]]*\\]|\\([^)]*\\))*[)\\]]\\s*\\*?", " "),
    ("(?im)\\*?\\s*\\b(?:source|fuente)\\s*:[^*\\n]*\\*?\\s*$", ""),
    ("\\[([^\\]]+)\\]\\([^)]*\\)", "\\1"),
    ("https?://\\S+", ""),
    ("\\*\\*|__", ""),
    ("[ \\t]*\\n[ \\t]*", "\n"),
    ("[ \\t]{2,}", " "),
    (" +([.,;:!?])", "\\1"),
]


def _polished(expr: str) -> str:
    for pattern, replacement in _POLISH:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return trim_sql(expr)


_CARD = "(?i)" + fv.CARD_PARAGRAPH.replace("'", "''")


@query("i12_clean_synopsis", f"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(
                 regexp_replace(sinopsis, '\\r\\n?', '\n', 'g'), '\\n{{2,}}'), lambda x: {trim_sql('x')}),
                 lambda x: x <> '') AS ps FROM o_raw_synopses),
    q AS (SELECT doc_id, ps, list_position(list_transform(ps, lambda x: regexp_matches(x, '{_CARD}')), false) AS a FROM p),
    r AS (SELECT doc_id, CASE WHEN a > 0 THEN ps[a:] ELSE CAST([] AS VARCHAR[]) END AS ps FROM q),
    s AS (SELECT doc_id, ps, list_position(list_transform(ps, lambda x: regexp_matches(x, '{_CARD}')), true) AS z FROM r)
    SELECT doc_id, md5(array_to_string(list_filter(list_transform(CASE WHEN z > 0 THEN ps[1:z - 1] ELSE ps END,
             lambda x: {_polished('x')}), lambda x: x <> ''), '\n\n')) AS huella FROM s""")
def _(t):
    rows = ct.clean_texts(t.sql(_RAW_SYNOPSES), "sinopsis")
    return rows.select("doc_id", F.md5("limpio").alias("huella"))


@query("i13_strip_html", f"""
    SELECT page_id, md5({trim_sql(
        "regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace("
        "html, '(?i)<br\\s*/?>', '\n', 'g'), '(?i)</p>', '\n\n', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), "
        "'&#039;|&apos;', '''', 'g'), '&quot;', '\"'), '[ \\t]+\\n', '\n', 'g'), '\\n{{3,}}', '\n\n', 'g')"
    ).replace('{{3,}}', '{3,}')}) AS huella FROM pages""")
def _(t):
    return t.base("pages").select("page_id", F.md5(text.strip_html("html")).alias("huella"))


@query("i13_clean_title", """
    SELECT work_id, titulo AS limpio FROM o_works""")
def _(t):
    dirty = F.concat(F.lit(" ​"), F.regexp_replace("titulo", " ", " ㅤ "), F.lit("﻿ "))
    return published(t).select("work_id", text.clean_title(dirty).alias("limpio"))


@query("i14_status_of", """
    SELECT event_id, coalesce(CASE event_id % 7 WHEN 0 THEN 'Finalizado' WHEN 1 THEN 'En emisión' WHEN 2 THEN 'Finalizado'
           WHEN 3 THEN 'En emisión' WHEN 4 THEN 'En emisión' WHEN 5 THEN 'Finalizado' END, '') AS estado FROM events""")
def _(t):
    from tandem.functions import prose

    raw = F.element_at(
        F.array(*[F.lit(x) for x in ("FINISHED", "Releasing", "complete", "Ongoing", "On Hiatus", "Finalizada", "cancelled")]),
        (F.col("event_id") % 7 + 1).cast("int"),
    )
    return t.base("events").select("event_id", F.coalesce(prose.status_of(raw), F.lit("")).alias("estado"))


check_view(
    "o_demography",
    f"""SELECT work_id, CASE WHEN bool_or(clave IN ({str(fv.ADULT_HINTS)[1:-1]})) THEN 'Seinen'
                WHEN bool_or(clave IN ({str(fv.ACTION_HINTS)[1:-1]})) THEN 'Shounen'
                WHEN bool_or(clave IN ({str(fv.ROMANCE_HINTS)[1:-1]})) THEN 'Shoujo' ELSE '' END AS demografia
        FROM o_labels GROUP BY work_id""",
)


@query("i15_demography", "SELECT work_id, demografia FROM o_demography")
def _(t):
    return ct.tag_demography(published(t)).select("work_id", F.coalesce("demografia", F.lit("")).alias("demografia"))


@query("i16_url_facts", """
    SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS dominio,
           CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/'
                ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS ruta,
           lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origen FROM pages""")
def _(t):
    return ct.url_facts(t.base("pages")).select("page_id", "dominio", "ruta", "origen")


@query("i16_work_slug", """
    SELECT id, concat('w-', CAST(work_id AS VARCHAR)) AS slug FROM f_chapters""")
def _(t):
    from tandem.functions import urls

    link = F.concat(
        F.lit("https://catalogo.example.com/"), F.when(F.col("id") % 2 == 0, "en/").otherwise(""), F.lit("novela/W%2D"),
        F.col("work_id").cast("string"), F.lit("/capitulo-3"),
    )
    return t.all_chapters.select("id", urls.slug_in_url(link).alias("slug"))


@query("i17_text_hash", """
    WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS parrafo,
                      generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS pos FROM documents),
    u AS (SELECT doc_id, pos, list_concat([CAST(2166136261 AS HUGEINT)], flatten(list_transform(string_split(parrafo, ''),
            lambda c: CASE WHEN unicode(c) > 65535
              THEN [CAST(55296 + (unicode(c) - 65536) // 1024 AS HUGEINT), CAST(56320 + (unicode(c) - 65536) % 1024 AS HUGEINT)]
              ELSE [CAST(unicode(c) AS HUGEINT)] END))) AS us FROM p WHERE parrafo <> '')
    SELECT doc_id, pos, lower(to_base(CAST(list_reduce(us, lambda h, x: (xor(h, x) * 16777619) % 4294967296) AS BIGINT), 36)) AS hash
    FROM u""")
def _(t):
    rows = ct.translation_keys(t.base("documents"), "doc_id", "text").where("parrafo <> ''")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), text_hash("parrafo").alias("hash"))


@query("i18_sentences", """
    WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)),
                 '([.!?…])[\\s\\x0b\\x{a0}\\x{2028}\\x{2029}\\x{3000}\\x{feff}]+', '\\1' || chr(31), 'g'), chr(31)),
                 lambda x: trim(x) <> '') AS l FROM documents)
    SELECT doc_id, unnest(l) AS frase, generate_subscripts(l, 1) - 1 AS pos FROM s""")
def _(t):
    rows = ct.sentences_of(t.base("documents"), "doc_id", "text")
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("i18_rejoined_sentences", """
    SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)),
             '([.!?…])[\\s\\x0b\\x{a0}\\x{2028}\\x{2029}\\x{3000}\\x{feff}]+', '\\1' || chr(31), 'g'), chr(31)),
             lambda x: trim(x) <> ''), ' ')) AS huella FROM documents""")
def _(t):
    pieces = ct.sentences_of(t.base("documents"), "doc_id", "text")
    return ct.rejoin_sentences(pieces, "doc_id").select("doc_id", F.md5("texto").alias("huella"))


@query("i19_bucket_dates", """
    SELECT work_id, strftime(cuando, '%Y-%m-%d') AS dia,
           epoch(TIMESTAMP '2000-01-01 05:00:00') - epoch(cuando) < 6 * 3600 AS nuevo,
           epoch(TIMESTAMP '2000-01-01 05:00:00') - epoch(cuando) < 24 * 3600 AS hoy FROM o_activity""")
def _(t):
    rows = ct.bucket_dates(rollup.activity(t.sources), datetime(2000, 1, 1, 5))
    return rows.select("work_id", F.col("dia").cast("string").alias("dia"), "nuevo", "hoy")


@query("i19_formats", """
    SELECT o_orderkey, CASE WHEN n >= 10000 THEN regexp_replace(format('{:,}', n), ',', '.', 'g') ELSE CAST(n AS VARCHAR) END AS miles,
           CASE WHEN length(s) <= 20 THEN s ELSE concat(rtrim(substr(s, 1, 19)), '…') END AS corto
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, concat(o_orderpriority, ' orden ', CAST(o_custkey AS VARCHAR)) AS s
          FROM orders)""")
def _(t):
    label = F.concat(F.col("o_orderpriority"), F.lit(" orden "), F.col("o_custkey").cast("string"))
    return t.base("orders").select(
        "o_orderkey", text.thousands(F.floor("o_totalprice")).alias("miles"), text.ellipsis(label, 20).alias("corto")
    )


@query("i20_trim_type_marks", "SELECT work_id, titulo AS limpio FROM o_works")
def _(t):
    marked = F.concat(F.col("titulo"), F.when(F.col("work_id") % 2 == 0, " (Novela)").otherwise(" Manhwa Español "))
    return published(t).select("work_id", text.trim_type_marks(marked).alias("limpio"))
