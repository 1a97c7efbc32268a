"""Registered queries: everything that reads raw material.

The raw documents (JSON, XML, HTML, CSV lines, robots files) are built by Spark
from whole input tables, in documents of bounded size; the checking SQL computes
the expected rows from the same tables without any document in between.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions.text import text_hash, text_key
from tandem.operators import enrichment
from tandem.operators.catalog_text import joined
from tandem.plans.rankings import published
from tandem.plans.registry import check_view, query
from tandem.session import small_table
from tandem.streaming import streams
from tandem.sources import catalog, listings, markup, payloads, robots, sitemaps


def packed(rows: DataFrame, keys: list[str], order: str, item: str, sep: str = "") -> DataFrame:
    """Rows of one document joined in order. Documents hold a fixed number of rows by construction."""
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item]), sep).alias("body")
    )


@query("s1_read_catalog", """
    SELECT id, work_id, source_id, coalesce(numero, -1) AS numero, titulo, url, idioma, tipo FROM o_chapters""")
def _(t):
    return catalog.visible_chapters(t.all_chapters).fillna(-1, ["numero"])


@query("s1_read_works", "SELECT work_id, slug, titulo FROM o_works")
def _(t):
    return catalog.visible_works(t.works).select("work_id", "slug", "titulo")


# ---- S2 ---------------------------------------------------------------------------------

def snapshot_files(t) -> DataFrame:
    """JSON snapshot parts: the approved chapters of one order per file part."""
    cells = F.array(*[F.col(c).cast("string") for c in ("id", "work_id", "numero", "titulo", "url")])
    row = F.to_json(cells, {"ignoreNullFields": "false"})
    rows = t.chapters.select(F.floor(F.col("id") / 10).alias("doc"), "id", row.alias("r"))
    docs = packed(rows, ["doc"], "id", "r", ",")
    head = F.lit('{"hasta":"2026-11-04T10:00:00Z","cols":["id","work_id","numero","titulo","url"],"filas":[')
    return docs.select(F.concat(head, "body", F.lit("]}")).alias("value"))


_SNAP = ["id", "work_id", "numero", "titulo", "url"]


@query("s2_read_snapshot", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(work_id AS VARCHAR) AS work_id, coalesce(CAST(numero AS VARCHAR), '') AS numero, titulo, url FROM o_chapters""")
def _(t):
    rows = catalog.read_snapshot(snapshot_files(t), _SNAP, datetime(2026, 11, 5), t.chapters)
    return rows.fillna("", ["numero"])


def large_files(rows: DataFrame, order: list[str], line, end: str) -> str:
    """Rows (doc and more) as one file per doc. ``line`` makes the text of a row from the row, whether it is the first of its
    file and whether the last; ``end`` follows every row. A file is written in order, a row at a time, so it may be of any size.
    """
    folder = streams.run_folder(rows.sparkSession)
    w = Window.partitionBy("doc").orderBy(*order)
    placed = rows.repartitionByRange(16, "doc").withColumns({"_n": F.row_number().over(w), "_next": F.lead(F.lit(1)).over(w)})
    text = line(F.col("_n") == 1, F.col("_next").isNull())
    placed.select("doc", text.alias("value")).write.option("lineSep", end).partitionBy("doc").text(folder)
    return folder


@query("s2_large_snapshot_files", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(work_id AS VARCHAR) AS work_id, coalesce(CAST(numero AS VARCHAR), '') AS numero,
           CASE WHEN id % 7 = 0 THEN concat('"[', titulo, '],[\\', '"') ELSE titulo END AS titulo FROM o_chapters""")
def _(t):
    """Sixteen files whose size grows with the table, each one document; some titles hold what parts the rows."""
    title = F.when(F.col("id") % 7 == 0, F.concat(F.lit('"['), "titulo", F.lit('],[\\"'))).otherwise(F.col("titulo"))
    cells = F.array(F.col("id").cast("string"), F.col("work_id").cast("string"), F.col("numero").cast("string"), title)
    rows = t.chapters.select((F.col("work_id") % 16).alias("doc"), "id", F.to_json(cells, {"ignoreNullFields": "false"}).alias("r"))
    head = '{"hasta":"2026-11-04T10:00:00Z","completoEn":"x","cols":["id","work_id","numero","titulo"],"filas":[['
    inside = F.expr("substr(r, 2, length(r) - 2)")

    def line(first, last):  # a line ends behind the bracket that opens the next row
        return F.concat(F.when(first, head).otherwise(""), inside, F.when(last, "]]}").otherwise("],["))

    found = catalog.snapshot_rows(t.spark, large_files(rows, ["id", "r"], line, "\n"), ["id", "work_id", "numero", "titulo"])
    return found.drop("hasta").fillna("", ["numero"])


@query("s17_large_cache_files", """
    SELECT huella, idioma, md5(concat(idioma, ' ', text, '},')) AS texto FROM (
      SELECT DISTINCT md5(text) AS huella, text, unnest(['en', 'pt']) AS idioma FROM documents)""")
def _(t):
    texts = t.base("documents").select("text").distinct()
    by_lang = F.create_map(*[x for lang in ("en", "pt") for x in (F.lit(lang), F.concat(F.lit(f"{lang} "), "text", F.lit("},")))])
    entry = F.substr(F.to_json(F.create_map(F.md5("text"), by_lang)), F.lit(2))
    rows = texts.select(F.pmod(F.xxhash64("text"), F.lit(16)).alias("doc"), F.md5("text").alias("h"), "text")

    def line(first, last):  # the brace that closes an entry, and in the end the file, ends a line
        opened = F.concat(F.when(first, "{").otherwise(","), F.substr(entry, F.lit(1), F.length(entry) - 2))
        return F.when(last, F.concat(opened, F.lit("}"))).otherwise(opened)

    found = catalog.translation_rows(t.spark, large_files(rows, ["h"], line, "}"))
    return found.select(F.col("hash").alias("huella"), "idioma", F.md5("texto").alias("texto"))


@query("s2_stale_snapshot_falls_back", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(work_id AS VARCHAR) AS work_id FROM f_chapters""")
def _(t):
    return catalog.read_snapshot(snapshot_files(t), ["id", "work_id"], datetime(2026, 11, 9), t.all_chapters, timedelta(days=3))


# ---- S3, S4, S17 ------------------------------------------------------------------------

@query("s3_read_traffic_csv", """
    SELECT DISTINCT concat('w ', CAST(event_id % 700 AS VARCHAR)) AS slug FROM events WHERE event_id % 3 <> 0
    UNION SELECT slug FROM o_works WHERE con_trafico""")
def _(t):
    path = F.when(F.col("event_id") % 3 == 0, "/categoria/x").otherwise(
        F.concat(F.lit("/novela/w%20"), (F.col("event_id") % 700).cast("string"), F.lit("/capitulo-3?a=1"))
    )
    lines = t.base("events").select(
        F.concat(F.lit("https://catalogo.example.com"), path, F.lit(","), "user_id", F.lit(",/novela/no")).alias("value")
    )
    return catalog.merge_traffic(lines, published(t).where("con_trafico"))


@query("s4_sitemap_slugs", "SELECT slug FROM o_works")
def _(t):
    entry = F.concat(F.lit("<url><loc>https://catalogo.example.com/novela/"), "slug", F.lit("/</loc></url><url><loc>https://"
                     "catalogo.example.com/en/novela/"), F.col("slug"), F.lit("/equivalencia/</loc></url>"))
    rows = published(t).select(F.floor(F.col("work_id") / 50).alias("doc"), "work_id", entry.alias("e"))
    return sitemaps.sitemap_slugs(packed(rows, ["doc"], "work_id", "e").withColumnRenamed("body", "xml"))


@query("s17_read_translation_cache", """
    SELECT huella, idioma, md5(concat(idioma, ' ', text)) AS texto FROM (
      SELECT DISTINCT md5(text) AS huella, text, unnest(['en', 'pt']) AS idioma FROM documents)""")
def _(t):
    texts = t.base("documents").select("text").distinct()
    by_lang = F.create_map(F.lit("en"), F.concat(F.lit("en "), "text"), F.lit("pt"), F.concat(F.lit("pt "), "text"))
    files = texts.select(F.to_json(F.create_map(F.md5("text"), by_lang)).alias("value"))
    rows = catalog.read_translation_cache(files)
    return rows.select(F.col("hash").alias("huella"), "idioma", F.md5("texto").alias("texto"))


@query("s17_read_ledger", "SELECT slug FROM o_works")
def _(t):
    lines = published(t).select(F.explode(F.array("slug", F.lit(""), "slug")).alias("value"))
    return catalog.ledger_slugs(lines)


# ---- S5, S6 -----------------------------------------------------------------------------

_READER = "https://leer.example.net"


def chapter_sitemaps(t) -> DataFrame:
    slug = F.concat(F.lit("i&apos;m-obra-"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 3 == 0, "-novel").otherwise(""))
    number = F.concat((F.col("l_orderkey") % 500).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ".5").otherwise(""))
    entry = F.concat(
        F.lit(f"<url><loc>{_READER}/series/"), slug, F.lit("/chapter-"), number, F.lit("</loc>\n<lastmod>"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</lastmod></url>"),
    )
    rows = t.base("lineitem").select("l_orderkey", "l_linenumber", entry.alias("e"))
    return packed(rows, ["l_orderkey"], "l_linenumber", "e").withColumnRenamed("body", "xml")


@query("s5_sitemap_chapters", f"""
    SELECT slug, numero, concat('Chapter ', n) AS titulo, concat('{_READER}/series/', slug, '/chapter-', n) AS url, fecha_texto FROM (
      SELECT concat('i''m-obra-', CAST(l_partkey AS VARCHAR), CASE WHEN l_partkey % 3 = 0 THEN '-novel' ELSE '' END) AS slug,
             CAST(l_orderkey % 500 AS INT) AS numero, concat(CAST(l_orderkey % 500 AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN '.5' ELSE '' END) AS n,
             strftime(l_shipdate, '%Y-%m-%d') AS fecha_texto
      FROM lineitem)""")
def _(t):
    return sitemaps.sitemap_chapters(chapter_sitemaps(t), _READER)


@query("s5_sitemap_series", f"""
    SELECT slug, replace(slug, '-', ' ') AS titulo, concat('{_READER}/series/', slug) AS url FROM (
      SELECT concat('i''m-obra-', CAST(p_partkey AS VARCHAR)) AS slug FROM part
      WHERE p_partkey % 3 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem))""")
def _(t):
    loc = F.concat(F.lit(f"<url><loc>{_READER}/series/i&apos;m-obra-"), F.col("p_partkey").cast("string"),
                   F.when(F.col("p_partkey") % 3 == 0, "-novel").otherwise(""), F.lit("</loc></url>"),
                   F.lit(f"<url><loc>{_READER}/series/sin-capitulos-"), F.col("p_partkey").cast("string"), F.lit("</loc></url>"))
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 50).alias("doc"), "p_partkey", loc.alias("e"))
    documents = packed(rows, ["doc"], "p_partkey", "e").withColumnRenamed("body", "xml")
    return sitemaps.sitemap_series(documents, sitemaps.sitemap_chapters(chapter_sitemaps(t), _READER), _READER, "manhwa")


@query("s6_sitemap_works", """
    SELECT CAST(p_partkey AS VARCHAR) AS id, concat(p_name, ' libro ', p_partkey) AS titulo,
           concat('https://leer.example.net/en/novel/', p_partkey, '/', replace(p_name, ' ', '-'), '-libro-', p_partkey) AS url FROM part""")
def _(t):
    slug = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-libro-"), F.col("p_partkey").cast("string"))
    loc = F.concat(F.lit("<loc>https://leer.example.net/en/novel/"), F.col("p_partkey").cast("string"), F.lit("/"))
    entry = F.concat(loc, slug, F.lit("</loc>"), loc, F.lit("second-entry</loc>"))
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 50).alias("doc"), "p_partkey", entry.alias("e"))
    return sitemaps.sitemap_works(packed(rows, ["doc"], "p_partkey", "e").withColumnRenamed("body", "xml"), "https://leer.example.net")


# ---- S7, S8 -----------------------------------------------------------------------------

def _listing_sites(t) -> DataFrame:
    return small_table(
        t.spark, [("madara.example.com", "madara"), ("hija.example.com", "madara"), ("lector.example.com", "mangareader")], "host string, tema string"
    )


def listing_pages(t) -> DataFrame:
    """Listing pages of 24 series in three markups."""
    k, name = F.col("p_partkey").cast("string"), F.col("p_name")
    kind = F.floor(F.col("p_partkey") / 24) % 3
    classic = F.concat(
        F.lit('<div class="page-item-detail"><div class="item-thumb"><a href="/manga/'), k,
        F.lit('/"><img src="data:image/svg+xml,vacio" data-src="https://img.example.com/'), k,
        F.lit('.webp"></a></div><div class="post-title"><h3><a href="/manga/'), k, F.lit('/">\n '), name, F.lit(" &amp; "), k,
        F.lit(' </a></h3></div></div><a class="acard" href="/no/" title="no">x</a>'),
    )
    child = F.concat(
        F.lit('<a class="acard" href="/manga/'), k, F.lit('/" title="'), name, F.lit(" &amp; "), k,
        F.lit('"><img class="ac-cover" src="https://img.example.com/'), k, F.lit('.webp" alt="otra"></a>'),
    )
    reader = F.concat(
        F.lit('<div class="bs"><div class="bsx"><a href="https://lector.example.com/manga/'), k,
        F.lit('/"><div class="tt">'), name, F.lit(" &amp; "), k,
        F.lit('</div><img data-lazy-src="https://img.example.com/'), k, F.lit('.webp"></a></div></div>'),
    )
    card = F.when(kind == 0, classic).when(kind == 1, child).otherwise(reader)
    host = F.when(kind == 0, "madara").when(kind == 1, "hija").otherwise("lector")
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 24).alias("doc"), host.alias("h"), "p_partkey", card.alias("c"))
    pages = packed(rows, ["doc", "h"], "p_partkey", "c")
    return pages.select(
        F.concat(F.lit("https://"), "h", F.lit(".example.com/page/"), F.col("doc").cast("string"), F.lit("/")).alias("url"),
        F.concat(F.lit('<html><body><div class="listupd">'), "body", F.lit("</div></body></html>")).alias("html"),
    )


@query("s7_extract_series", """
    SELECT concat('https://', h, '.example.com/page/', CAST(doc AS VARCHAR), '/') AS url_pagina, CAST(p_partkey % 24 AS INT) AS pos,
           concat(p_name, ' & ', p_partkey) AS titulo, concat('https://', h, '.example.com/manga/', p_partkey, '/') AS url,
           concat('https://img.example.com/', p_partkey, '.webp') AS portada
    FROM (SELECT *, CAST(floor(p_partkey / 24) AS INT) AS doc, ['madara', 'hija', 'lector'][CAST(floor(p_partkey / 24) AS INT) % 3 + 1] AS h FROM part)""")
def _(t):
    return markup.extract_series(listing_pages(t), _listing_sites(t), markup.theme_rules(t.spark))


def series_pages(t) -> DataFrame:
    """Series pages: the lines of one order as chapter items, in two markups."""
    k = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    n = F.col("l_quantity").cast("int").cast("string")
    locked = F.col("l_linenumber") == 6
    classic = F.concat(
        F.lit('<li class="wp-manga-chapter"><a href="'), F.when(locked, "#").otherwise(F.concat(F.lit("/manga/"), k, F.lit("/capitulo-"), n, F.lit("/"))),
        F.lit('">Capítulo '), n, F.lit('.5</a> <span class="chapter-release-date"> '), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("</span></li>"),
    )
    reader = F.concat(
        F.lit('<li data-num="'), F.when(F.col("l_partkey") % 2 == 0, n).otherwise(""), F.lit('"><a href="https://lector.example.com/'), k,
        F.lit("-capitulo-"), n, F.lit('/" data-chapter-title="Cap. '), n, F.lit('">x</a></li>'),
    )
    kind = F.col("l_orderkey") % 2
    rows = t.base("lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias("o"),
        F.when(kind == 0, classic).otherwise(reader).alias("c"),
    )
    pages = packed(rows, ["l_orderkey"], "o", "c")
    host = F.when(F.col("l_orderkey") % 2 == 0, "madara").otherwise("lector")
    return pages.select(
        F.concat(F.lit("https://"), host, F.lit(".example.com/s/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.concat(F.lit('<div id="chapterlist"><ul>'), "body", F.lit("</ul></div>")).alias("html"),
    )


@query("s8_extract_chapters", """
    SELECT concat('https://', CASE WHEN l_orderkey % 2 = 0 THEN 'madara' ELSE 'lector' END, '.example.com/s/', l_orderkey) AS url_pagina,
           CAST(l_quantity AS INT) AS numero,
           CASE WHEN l_orderkey % 2 = 0 THEN concat('Capítulo ', CAST(l_quantity AS INT), '.5') ELSE concat('Cap. ', CAST(l_quantity AS INT)) END AS titulo,
           CASE WHEN l_orderkey % 2 = 0 THEN concat('https://madara.example.com/manga/', l_orderkey, '-', l_partkey, '/capitulo-', CAST(l_quantity AS INT), '/')
                ELSE concat('https://lector.example.com/', l_orderkey, '-', l_partkey, '-capitulo-', CAST(l_quantity AS INT), '/') END AS url,
           CASE WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS fecha_texto
    FROM lineitem WHERE NOT (l_orderkey % 2 = 0 AND l_linenumber = 6)""")
def _(t):
    rows = markup.extract_chapters(series_pages(t), _listing_sites(t), markup.theme_rules(t.spark))
    return rows.drop("pos").fillna("", ["fecha_texto"])


@query("s8_card_chapters", """
    SELECT concat('https://tarjetas.example.com/s/', l_orderkey) AS url_pagina, CAST(l_quantity AS INT) AS numero,
           concat('Chapter ', CAST(l_quantity AS INT), '.5') AS titulo, concat('https://tarjetas.example.com/reader/en/', l_orderkey, '-', l_partkey, '/') AS url,
           strftime(l_shipdate, '%Y-%m-%d') AS fecha_texto
    FROM lineitem""")
def _(t):
    n = F.col("l_quantity").cast("int").cast("string")
    item = F.concat(
        F.lit('<li data-orderno="1"><a href="/reader/en/'), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
        F.lit('/"><strong class="chapter-title">'), n, F.lit('.5-eng-li </strong><time datetime="'), F.date_format("l_shipdate", "MMMM d, yyyy"),
        F.lit(', noon">x</time></a><a href="/otro/">no</a></li>'),
    )
    rows = t.base("lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate").alias("o"), item.alias("c"))
    pages = packed(rows, ["l_orderkey"], "o", "c").select(
        F.concat(F.lit("https://tarjetas.example.com/s/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("<ul>"), "body", F.lit("</ul>")).alias("html"))
    sites = small_table(t.spark, [("tarjetas.example.com", "tarjetas")], "host string, tema string")
    return markup.extract_chapters(pages, sites, markup.theme_rules(t.spark)).drop("pos")


@query("s7_series_details", """
    SELECT concat('https://d.example.com/', p_partkey) AS url, concat(p_name, ' completo') AS titulo,
           CASE WHEN p_partkey % 2 = 0 THEN concat('Otro ', p_partkey, '|Más ', p_partkey) ELSE concat('이세계 ', p_partkey) END AS titulos_alternativos FROM part""")
def _(t):
    k, title = F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(" completo"))
    one = F.concat(F.lit('<h1 class="novel-title"> '), title, F.lit(' </h1><h2 class="alternative-title">Otro '), k, F.lit(" • Updating • "), title,
                   F.lit(" • Más "), k, F.lit(" • Otro "), k, F.lit("</h2>"))
    two = F.concat(F.lit('<div><div aria-hidden="true"><div>이세계 '), k, F.lit('</div></div><h1 itemprop="name">'), title, F.lit("</h1></div>"))
    pages = t.base("part").select(F.concat(F.lit("https://d.example.com/"), k).alias("url"), F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two).alias("html"))
    return markup.series_details(pages).withColumn("titulos_alternativos", joined("titulos_alternativos"))


@query("s8_page_anchors", r"""
    WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h,
                      regexp_extract_all(html, '(?is)<a\s[^>]*?href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS x FROM pages)
    SELECT page_id, unnest(h) AS href, trim(regexp_replace(regexp_replace(unnest(x), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS texto,
           generate_subscripts(h, 1) - 1 AS pos FROM a""")
def _(t):
    return markup.page_anchors(t.base("pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query("s8_blog_chapters", """
    SELECT DISTINCT l_orderkey AS page_id, concat('https://otro.example.com/c/', l_partkey) AS url
    FROM lineitem WHERE l_linenumber % 3 <> 0""")
def _(t):
    word = F.element_at(F.array(F.lit("Apóyanos "), F.lit("Capítulo "), F.lit("CHAPTER ")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    link = F.concat(F.lit('<p><a class="x" href="https://otro.example.com/c/'), F.col("l_partkey").cast("string"), F.lit('"><b>'), word,
                    F.col("l_quantity").cast("int").cast("string"), F.lit("</b></a></p>"))
    rows = t.base("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("o"), link.alias("c"))
    pages = packed(rows, ["l_orderkey"], "o", "c").select(F.col("l_orderkey").alias("page_id"), F.col("body").alias("html"))
    return markup.anchor_chapters(pages).select("page_id", "url")


# ---- S9, S10 ----------------------------------------------------------------------------

def localized_documents(t) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    title = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("ko-ro"), F.concat(F.lit("Jeon "), k))).otherwise(
        F.create_map(F.lit("en"), F.concat(F.lit("Main "), k))
    )
    alts = F.array(
        F.create_map(F.lit("en"), F.concat(F.lit("Reader "), k)), F.create_map(F.lit("es"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Lector "), k)).otherwise("")),
        F.create_map(F.lit("en"), F.concat(F.lit("Reader "), k)),
    )
    tag = lambda g, en, es: F.struct(F.struct(F.lit(g).alias("group"), F.create_map(F.lit("en"), F.lit(en), F.lit("es"), es).alias("name")).alias("attributes"))
    tags = F.array(tag("genre", "Action", F.when(F.col("p_size") % 2 == 0, "Acción")), tag("theme", "Ghosts", F.lit("Fantasmas")), tag("genre", "Drama", F.lit("Drama")))
    relation = F.when(F.col("p_partkey") % 4 == 0, F.array(F.struct(F.lit("author").alias("type"), F.struct(F.lit(None).cast("string").alias("fileName")).alias("attributes")))).otherwise(
        F.array(F.struct(F.lit("cover_art").alias("type"), F.struct(F.lit("tapa.jpg").alias("fileName")).alias("attributes")))
    )
    status = F.when(F.col("p_size") % 3 == 0, "ongoing").otherwise("completed")
    item = F.to_json(F.struct(
        F.concat(F.lit("id-"), k).alias("id"),
        F.struct(title.alias("title"), alts.alias("altTitles"), status.alias("status"), tags.alias("tags")).alias("attributes"),
        relation.alias("relationships"),
    ))
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 100).alias("doc"), "p_partkey", item.alias("i"))
    return packed(rows, ["doc"], "p_partkey", "i", ",").select(F.concat(F.lit('{"data":['), "body", F.lit("]}")).alias("json"))


@query("s9_localized_series", """
    SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('Lector ', p_partkey) WHEN p_partkey % 3 = 0 THEN concat('Reader ', p_partkey)
                ELSE concat('Main ', p_partkey) END AS titulo,
           CASE WHEN p_partkey % 3 = 0 THEN concat('Reader ', p_partkey) ELSE concat('Main ', p_partkey) END AS slug_base,
           concat('https://web.example.org/title/id-', p_partkey) AS url,
           CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('https://up.example.org/covers/id-', p_partkey, '/tapa.jpg.256.jpg') END AS portada,
           CASE WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0 THEN '' ELSE concat('Reader ', p_partkey) END AS titulos_alternativos,
           CASE WHEN p_size % 3 = 0 THEN 'En emisión' ELSE 'Finalizado' END AS estado,
           CASE WHEN p_size % 2 = 0 THEN 'Acción|Drama' ELSE 'Action|Drama' END AS categorias FROM part""")
def _(t):
    rows = payloads.localized_series(localized_documents(t), "es", "https://web.example.org", "https://up.example.org")
    return rows.withColumn("titulos_alternativos", joined("titulos_alternativos")).withColumn("categorias", joined("categorias"))


@query("s9_all_names_and_genres", """
    WITH n AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)
    SELECT concat('Main ', l_partkey) AS titulo, count(*) AS n_nombres, md5(string_agg(concat('Otro ', l_orderkey), '|' ORDER BY l_orderkey)) AS nombres,
           md5(string_agg(concat('Tema ', l_orderkey), '|' ORDER BY l_orderkey)) AS generos FROM n GROUP BY l_partkey""")
def _(t):
    """A series with a name and a genre of every order of its part: many more than a record shows."""
    order = F.col("l_orderkey").cast("string")
    rows = t.base("lineitem").select("l_partkey", "l_orderkey").distinct().select("l_partkey", F.struct("l_orderkey", order.alias("o")).alias("x"))
    lists = rows.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["o"]).alias("os"))
    name = lambda o: F.create_map(F.lit("es"), F.concat(F.lit("Otro "), o))
    genre = lambda o: F.struct(F.struct(F.lit("genre").alias("group"), F.create_map(F.lit("en"), F.concat(F.lit("Tema "), o)).alias("name")).alias("attributes"))
    k = F.col("l_partkey").cast("string")
    item = F.struct(k.alias("id"), F.struct(
        F.create_map(F.lit("en"), F.concat(F.lit("Main "), k)).alias("title"), F.transform("os", name).alias("altTitles"),
        F.lit("ongoing").alias("status"), F.transform("os", genre).alias("tags")).alias("attributes"))
    documents = lists.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("json"))
    found = payloads.localized_series(documents, "pt", "https://web.example.org", "https://up.example.org")
    return found.select("titulo", F.size("titulos_alternativos").cast("bigint").alias("n_nombres"), F.md5(joined("titulos_alternativos")).alias("nombres"),
                        F.md5(joined("categorias")).alias("generos"))


@query("s9_typed_series", """
    SELECT concat('Obra ', p_partkey) AS titulo, concat('https://w.example.org/series/comic-obra-', p_partkey, '#caps=',
             CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END) AS url, coalesce(CASE WHEN p_partkey % 2 = 0 THEN concat('https://c.example.org/', p_partkey) END, '') AS portada
    FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 10 <> 0""")
def _(t):
    k = F.col("p_partkey").cast("string")
    item = F.to_json(F.struct(
        F.concat(F.lit("Obra "), k).alias("name"), F.when(F.col("p_partkey") % 10 != 0, F.concat(F.lit("obra-"), k)).alias("slug"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://c.example.org/"), k)).alias("cover"),
        F.when(F.col("p_partkey") % 3 == 0, "comic").when(F.col("p_partkey") % 3 == 2, "novel").alias("type"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("chapter_count"),
    ))
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 50).alias("doc"), "p_partkey", item.alias("i"))
    docs = packed(rows, ["doc"], "p_partkey", "i", ",").select(F.concat(F.lit('{"data":{"series":{"data":['), "body", F.lit("]}}}")).alias("json"))
    return payloads.typed_series(docs, "manhwa", "https://w.example.org")


@query("s9_library_series", """
    SELECT CASE WHEN p_partkey % 4 = 0 THEN concat('Real ', p_partkey) ELSE concat('Obra ', p_partkey) END AS titulo,
           concat('https://w.example.org/manhwa/r_', p_partkey, '#caps=', p_size) AS url, '' AS portada FROM part WHERE p_partkey % 3 = 1""")
def _(t):
    k = F.col("p_partkey").cast("string")
    item = F.to_json(F.struct(
        F.concat(F.lit("r_"), k).alias("real_id"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("Obra "), k)).alias("name_esp"),
        F.concat(F.lit("Real "), k).alias("the_real_name"), F.when(F.col("p_partkey") % 3 == 1, "novela").when(F.col("p_partkey") % 3 == 2, "manhwa").alias("_tipo"),
        F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("_numero_cap"),
    ))
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 50).alias("doc"), "p_partkey", item.alias("i"))
    docs = packed(rows, ["doc"], "p_partkey", "i", ",").select(F.concat(F.lit('{"next":true,"data":['), "body", F.lit("]}")).alias("json"))
    return payloads.library_series(docs, "novela", "https://w.example.org")


@query("s9_comic_series", """
    SELECT concat('Obra ', p_partkey) AS titulo, concat('Obra ', p_partkey) AS slug_base, concat('https://w.example.org/comics/obra-', p_partkey) AS url,
           '' AS portada, concat('La Obra ', p_partkey) AS titulos_alternativos, CASE WHEN p_size % 2 = 0 THEN 'En emisión' ELSE 'Finalizado' END AS estado,
           p_brand AS categorias FROM part WHERE p_partkey % 6 <> 0""")
def _(t):
    k = F.col("p_partkey").cast("string")
    title = F.concat(F.lit("Obra "), k)
    item = F.to_json(F.struct(
        F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("obra-"), k)).alias("slug"), title.alias("title"),
        F.array(F.concat(F.lit("La Obra "), k), title, F.concat(F.lit("La Obra "), k)).alias("alt_titles"),
        F.when(F.col("p_size") % 2 == 0, "ongoing").otherwise("completed").alias("status"),
        F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit(None).cast("string").alias("name"))).alias("genres"),
    ))
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 50).alias("doc"), "p_partkey", item.alias("i"))
    docs = packed(rows, ["doc"], "p_partkey", "i", ",").select(F.concat(F.lit('{"data":['), "body", F.lit("]}")).alias("json"))
    rows = payloads.comic_series(docs, "https://w.example.org")
    return rows.withColumn("titulos_alternativos", joined("titulos_alternativos")).withColumn("categorias", joined("categorias"))


def blog_documents(t) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    mark = F.element_at(F.array(F.lit(" Novela"), F.lit(" Manhwa"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    item = F.concat(
        F.lit('{"title":{"$t":"Obra '), k, mark, F.lit('"},"published":{"$t":"2026-01-02T00:00:00Z"},"link":[{"rel":"self","href":"x"},{"rel":"alternate","href":"https://b.example.org/p/'),
        k, F.lit('.html"}]}'),
    )
    rows = t.base("part").select(F.floor(F.col("p_partkey") / 50).alias("serie"), "p_partkey", item.alias("i"))
    return packed(rows, ["serie"], "p_partkey", "i", ",").select("serie", F.concat(F.lit('{"feed":{"entry":['), "body", F.lit("]}}")).alias("json"))


@query("s9_blog_series", """
    SELECT concat('Obra ', p_partkey) AS titulo, concat('https://b.example.org/p/', p_partkey, '.html#etq=Obra%20', p_partkey, '%20%28Novela%29') AS url
    FROM part WHERE p_partkey % 3 = 0""")
def _(t):
    return payloads.blog_series(blog_documents(t), "novela")


@query("s10_blog_chapters", """
    SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS serie, CASE WHEN p_partkey > 99999 THEN -1 ELSE CAST(p_partkey AS INT) END AS numero,
           concat('Obra ', p_partkey, [' Novela', ' Manhwa', ''][p_partkey % 3 + 1]) AS titulo, concat('https://b.example.org/p/', p_partkey, '.html') AS url,
           '2026-01-02' AS fecha_texto FROM part""")
def _(t):
    return payloads.blog_chapters(blog_documents(t)).fillna(-1, ["numero"])


def feed_documents(t) -> DataFrame:
    """Feed pages: one order per page; a series has many pages."""
    chapter = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(
        F.concat((F.col("l_quantity").cast("int") - 1).cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".5").otherwise(""))
    )
    item = F.to_json(F.struct(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("id"),
        F.struct(chapter.alias("chapter"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("T "), F.col("l_suppkey").cast("string"))).alias("title"),
                 F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishAt")).alias("attributes"),
    ))
    lines = t.sql("""SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n
                     FROM {lineitem}""")
    rows = lines.select((F.col("l_orderkey") % 300).alias("serie"), F.col("l_orderkey").alias("doc"), "n", item.alias("i"))
    return packed(rows, ["serie", "doc"], "n", "i", ",").select("serie", "doc", F.concat(F.lit('{"data":['), "body", F.lit("]}")).alias("json"))


@query("s10_feed_chapters", """
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
    f AS (SELECT l_orderkey % 300 AS serie, l_orderkey AS doc, n, concat('c', l_orderkey, '-', n) AS id, l_suppkey, l_shipdate,
                 CASE WHEN l_linenumber = 7 THEN NULL ELSE concat(CAST(l_quantity AS INT) - 1, CASE WHEN l_partkey % 2 = 0 THEN '.5' ELSE '' END) END AS ch FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY serie, coalesce(ch, 'x-' || id) ORDER BY doc, n) AS rn FROM f)
    SELECT serie, coalesce(nullif(CAST(floor(CAST(ch AS DOUBLE)) AS INT), 0), -1) AS numero,
           CASE WHEN l_suppkey % 2 = 0 THEN concat('T ', l_suppkey) ELSE concat('Capítulo ', coalesce(ch, '?')) END AS titulo,
           concat('https://w.example.org/chapter/', id) AS url, strftime(l_shipdate, '%Y-%m-%d') AS fecha_texto FROM r WHERE rn = 1""")
def _(t):
    return payloads.feed_chapters(feed_documents(t), "https://w.example.org").fillna(-1, ["numero"])


@query("s10_numbered_chapters", """
    SELECT l_orderkey AS serie, CAST(l_quantity AS INT) AS numero, concat('Chapter ', CAST(l_quantity AS INT)) AS titulo,
           concat('https://w.example.org/comics/o-', l_orderkey, '/chapter/', CAST(l_quantity AS INT)) AS url, strftime(l_shipdate, '%Y-%m-%d') AS fecha_texto FROM lineitem""")
def _(t):
    item = F.concat(F.lit('{"number":'), F.col("l_quantity").cast("int").cast("string"), F.lit(',"published_at":"'),
                    F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('T12:28:39.325864Z"}'))
    rows = t.base("lineitem").select("l_orderkey", "l_linenumber", item.alias("i"))
    docs = packed(rows, ["l_orderkey"], "l_linenumber", "i", ",").select(
        F.col("l_orderkey").alias("serie"), F.concat(F.lit("https://w.example.org/comics/o-"), F.col("l_orderkey").cast("string")).alias("url"),
        F.concat(F.lit('{"data":['), "body", F.lit("]}")).alias("json"))
    return payloads.numbered_chapters(docs)


# ---- S11 to S16 -------------------------------------------------------------------------

@query("s11_explode_mirror_links", """
    SELECT concat('Obra ', page_id) AS serie, CAST(page_id % 300 AS INT) AS numero, concat('Capítulo ', page_id % 300, '.5 · ', h) AS titulo, u AS url FROM (
      SELECT page_id, u, regexp_replace(lower(regexp_extract(u, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS h
      FROM (SELECT page_id, unnest([url, concat('https://www.espejo', page_id % 5, '.example.com/a/', page_id)]) AS u FROM pages))""")
def _(t):
    k = F.col("page_id").cast("string")
    sheet = t.base("pages").select(
        F.concat(F.lit("Obra "), k, F.lit("\\nnotas")).alias("titulo"), F.concat((F.col("page_id") % 300).cast("string"), F.lit(".5")).alias("capitulo"),
        F.concat("url", F.lit(" , no es una url,, https://www.espejo"), (F.col("page_id") % 5).cast("string"), F.lit(".example.com/a/"), k).alias("enlaces"),
    )
    return listings.explode_mirror_links(sheet)


_LINKS = """
SELECT source_id, work_id, n_caps, concat('https://w.example.org/s/', CAST(source_id AS VARCHAR(20)), CASE WHEN source_id % 5 = 0 THEN ''
  WHEN source_id % 5 = 1 THEN '#caps=0' WHEN source_id % 5 = 2 THEN concat('#x=1&caps=', CAST(n_caps * 100 AS VARCHAR(10)), '.7')
  ELSE concat('#caps=', CAST(n_caps * 7 AS VARCHAR(10))) END) AS url FROM {f_sources}"""
check_view("o_links", _LINKS)


@query("s12_linkout_rows", """
    SELECT source_id, n AS numero, concat('Serie completa · ', n, ' capítulos') AS titulo, concat('https://w.example.org/s/', source_id) AS url
    FROM (SELECT source_id, CASE WHEN source_id % 5 = 2 THEN n_caps * 100 ELSE n_caps * 7 END AS n FROM o_links WHERE source_id % 5 >= 2)""")
def _(t):
    return listings.linkout_rows(t.sql(_LINKS))


@query("s12_total_only_rows", """
    SELECT page_id AS source_id, CASE page_id % 4 WHEN 3 THEN -1 ELSE CAST(page_id % 900 + 1 AS INT) END AS numero,
           CASE page_id % 4 WHEN 3 THEN 'Leer la serie' ELSE concat('Serie completa · ', page_id % 900 + 1, ' capítulos') END AS titulo, url FROM pages""")
def _(t):
    n = (F.col("page_id") % 900 + 1).cast("string")
    extra = F.element_at(F.array(
        F.concat(F.lit('<a href="/v?episode_no=1">1</a><a href="/v?x=1&episode_no='), n, F.lit('">n</a>')),
        F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"serie":{"serie_data":{"chapter_count":'), n, F.lit("}}}}}</script>")),
        F.concat(F.lit('<span>Total chapters</span>\n<span class="x">'), n, F.lit("</span>")),
        F.lit(""),
    ), (F.col("page_id") % 4 + 1).cast("int"))
    pages = t.base("pages").select(F.col("page_id").alias("source_id"), "url", F.concat("html", extra).alias("html"))
    return listings.total_only_rows(pages).fillna(-1, ["numero"])


@query("s13_synthesize_chapters", """
    SELECT p_partkey AS source_id, CAST(n AS INT) AS numero, concat('Chapter ', n) AS titulo, concat('https://w.example.org/s/', p_partkey, '/chapter-', n) AS url
    FROM (SELECT p_partkey, unnest(generate_series(1, p_size)) AS n FROM part WHERE p_size > 1)""")
def _(t):
    totals = t.base("part").select(
        F.col("p_partkey").alias("source_id"), F.concat(F.lit("https://w.example.org/s/"), F.col("p_partkey").cast("string"), F.lit("//")).alias("url"),
        F.when(F.col("p_size") > 1, F.col("p_size")).otherwise(0).alias("total"),
    )
    return listings.synthesize_chapters(totals)


@query("s14_robots_filter", """
    WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS o, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)
    SELECT page_id, url FROM u WHERE NOT (length(o) % 3 <> 0 AND (starts_with(p, '/en/1') OR (length(o) % 3 = 1 AND starts_with(p, '/de/'))))""")
def _(t):
    from tandem.functions.urls import origin_of

    pages = t.base("pages").select("page_id", "url")
    # one robots file per origin: a rule for all, one for our agent, one for somebody else
    origins = pages.select(origin_of("url").alias("origen")).distinct().where(F.length("origen") % 3 != 0)
    text = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /en/1 # old\nDisallow:\nUser-agent: other-bot\nDisallow: /\n"),
        F.when(F.length("origen") % 3 == 1, "User-agent: TandemBot\nAllow: /x\nDISALLOW : /de/\n").otherwise(""),
    )
    return robots.robots_filter(pages, origins.withColumn("robots_txt", text), "TandemBot/1.0 (+https://example.org)")


_LISTED = """
SELECT o_custkey % 60 AS sitio_id, CAST(floor(o_orderkey / 600) AS INT) + 1 AS pagina,
       concat('https://l.example.org/', CAST(o_orderkey % 400 AS VARCHAR(10))) AS url FROM {orders}"""
_LIST_PAGES = "SELECT DISTINCT sitio_id, pagina, CAST(5 + sitio_id % 20 AS INT) AS tope FROM (" + _LISTED + ") x"
check_view("o_listed_items", _LISTED.replace("{orders}", "orders"))
check_view("o_list_pages", _LIST_PAGES.replace("{orders}", "orders"))


@query("s15_consolidate_listing", """
    WITH f AS (SELECT i.sitio_id, i.url, min(i.pagina) AS pagina FROM o_listed_items i JOIN o_list_pages p USING (sitio_id, pagina)
               WHERE p.pagina <= p.tope GROUP BY i.sitio_id, i.url),
    z AS (SELECT sitio_id, min(pagina) AS fin FROM o_list_pages p WHERE pagina <= tope
          AND NOT EXISTS (SELECT 1 FROM f WHERE f.sitio_id = p.sitio_id AND f.pagina = p.pagina) GROUP BY sitio_id)
    SELECT f.sitio_id, f.url, f.pagina FROM f LEFT JOIN z USING (sitio_id) WHERE z.fin IS NULL OR f.pagina < z.fin""")
def _(t):
    return listings.consolidate_listing(t.sql(_LIST_PAGES), t.sql(_LISTED))


_SEG = "CASE page_id % 6 WHEN 0 THEN 'manga' WHEN 1 THEN 'son' WHEN 2 THEN 'Tag' WHEN 3 THEN 'obras' WHEN 4 THEN 'series' ELSE 'zeta' END"


@query("s16_listing_path_candidates", f"""
    WITH l AS (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, lower({_SEG}) AS segmento,
                      CAST(page_id % 4 + 1 AS INT) AS k FROM pages),
    c AS (SELECT host, segmento, CAST(sum(k) AS BIGINT) AS n FROM l WHERE segmento <> 'tag' GROUP BY host, segmento)
    SELECT host, segmento, n, CAST(puesto AS INT) AS puesto FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY
        coalesce(list_position(['manga', 'series', 'comic', 'comics', 'manhwa', 'novela', 'novel'], segmento), 8),
        CASE WHEN segmento IN ('manga', 'series') THEN 0 ELSE -n END, segmento) AS puesto FROM c) WHERE puesto <= 5""")
def _(t):
    from tandem.functions.urls import origin_of

    seg = F.expr(_SEG)
    link = F.concat(F.lit('<a href="'), F.when(F.col("page_id") % 2 == 0, origin_of("url")).otherwise(""), F.lit("/"), seg, F.lit("/obra-numero-1/\">x</a>"))
    many = F.array_join(F.array_repeat(link, (F.col("page_id") % 4 + 1).cast("int")), " ")
    pages = t.base("pages").select("url", F.concat("html", many, F.lit('<a href="/uno/">y</a>')).alias("html"))
    return listings.listing_path_candidates(pages)


@query("s16_theme", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'madara' WHEN 1 THEN 'mangareader' WHEN 2 THEN 'mangareader' ELSE '' END AS tema FROM pages""")
def _(t):
    name = F.element_at(F.array(F.lit("Madara-child"), F.lit("mangareader"), F.lit("mangastream"), F.lit("astra")), (F.col("page_id") % 4 + 1).cast("int"))
    html = F.concat("html", F.lit('<link href="/wp-content/themes/'), name, F.lit('/style.css">'))
    return t.base("pages").select("page_id", F.coalesce(listings.theme_of(html), F.lit("")).alias("tema"))


@query("s17_cache_by_hash", "SELECT doc_id, md5(text) AS huella FROM documents")
def _(t):
    docs = t.base("documents").select("doc_id", "text", text_hash("text").alias("hash"))
    files = docs.select(F.to_json(F.create_map("hash", F.create_map(F.lit("es"), "text"))).alias("value"))
    imported = catalog.read_translation_cache(files)
    cache = enrichment.unique_cache(enrichment.bind_cache(imported, docs.select(F.col("text").alias("texto"))))
    keyed = docs.select("doc_id", text_key("text").alias("clave"))
    return keyed.join(cache, "clave").select("doc_id", F.md5("texto").alias("huella"))
