"""Rows of every published file, and the writers that store them.

The functions that build rows return DataFrames; ``write_*`` store them from the
executors, one folder per file, and never pass rows through the driver.
"""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions import text
from tandem.functions.urls import host_of, is_http
from tandem.operators.distributed import global_position
from tandem.operators.gap import work_counts
from tandem.operators.ranking import catalog_order, top_list
from tandem.operators.rollup import linkout_sources
from tandem.session import cut_lineage, small_table


# ---- sitemaps ------------------------------------------------------------------------

def chapter_sitemap_shards(
    listed: DataFrame, works: DataFrame, levels: DataFrame, per_file: int = fv.URLS_PER_SHARD
) -> DataFrame:
    """Chapter pages of tier A works, cut into files of ``per_file`` URLs.

    Order: catalogue order of the works, newest chapter first. The works get
    running chapter counts, so a row's place is (chapters of earlier works) +
    (its place in its work); the chapter rows are never sorted as a whole.
    """
    tier_a = works.join(levels.where("nivel = 'A'"), "work_id", "left_semi")
    counts = listed.groupBy("work_id").agg(F.count("*").alias("_n"))
    ordered = global_position(
        tier_a.join(counts, "work_id").select("work_id", "slug", "titulo", "destacada", "_n"),
        catalog_order(), "_pos", running={"_upto": F.col("_n")},
    ).select("work_id", "slug", (F.col("_upto") - F.col("_n")).alias("_before"))
    newest = Window.partitionBy("work_id").orderBy(F.desc("numero"))
    rows = listed.join(ordered, "work_id").withColumn("_nth", F.row_number().over(newest))
    place = F.col("_before") + F.col("_nth")
    return rows.select(
        place.alias("puesto"),
        F.floor((place - 1) / per_file).cast("int").alias("shard"),
        F.format_string("/novela/%s/capitulo-%d", F.col("slug"), F.col("numero")).alias("ruta"),
    )


def work_sitemap_rows(
    works: DataFrame, levels: DataFrame, activity: DataFrame, english: DataFrame, covered: DataFrame, site: str
) -> DataFrame:
    """Sitemap entries of the hub pages, and of tier A and B works in each language they exist in."""
    w = (
        works.select("work_id", "slug")
        .join(levels.where("nivel IN ('A', 'B')"), "work_id")
        .join(activity.select("work_id", "cuando"), "work_id", "left")
        .join(english.select("work_id", F.lit(True).alias("_en")), "work_id", "left")
        .join(covered.select("work_id", F.lit(True).alias("_img")), "work_id", "left")
    )
    page = F.concat(F.lit("/novela/"), F.col("slug"), F.lit("/"))
    pages = F.when(F.col("nivel") == "A", F.array(page, F.concat(page, F.lit("equivalencia/")))).otherwise(F.array(page))
    w = w.withColumn("_page", F.explode(pages))
    both = F.col("_en").isNotNull()
    es, en = F.concat(F.lit(site), F.col("_page")), F.concat(F.lit(site + "/en"), F.col("_page"))
    w = w.withColumn("_lang", F.explode(F.when(both, F.array(F.lit("es"), F.lit("en"))).otherwise(F.array(F.lit("es")))))
    alternates = F.when(both, F.concat(F.lit("es="), es, F.lit("|en="), en, F.lit("|x-default="), en)).otherwise("")
    image = F.when(
        F.col("_img") & ~F.col("_page").endswith("equivalencia/"),
        F.concat(F.lit(site + "/portada/"), F.col("slug"), F.lit(".jpg")),
    ).otherwise("")
    entries = w.select(
        F.when(F.col("_lang") == "en", en).otherwise(es).alias("loc"),
        F.coalesce(F.date_format("cuando", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias("lastmod"),
        F.when(F.col("nivel") == "A", "1.0").otherwise("0.5").alias("prioridad"),
        alternates.alias("alternas"),
        F.coalesce(image, F.lit("")).alias("imagen"),
    )
    return hub_sitemap_rows(works.sparkSession, site).unionByName(entries)


def hub_sitemap_rows(spark: SparkSession, site: str) -> DataFrame:
    """Entries of the pages that list works: the home pages first, then the lists people look for."""
    path = F.regexp_replace("loc", f"^{re.escape(site)}", "")
    home, lists = path.rlike(r"^/([a-z]{2}/?)?$"), path.rlike(r"/(series|rankings|novedades|titulos)(/|$)")
    hubs = small_table(spark, [(site + p,) for p in fv.HUB_PAGES], "loc string")
    return hubs.select(
        "loc", F.lit("").alias("lastmod"), F.when(home, "1.0").when(lists, "0.8").otherwise("").alias("prioridad"),
        F.lit("").alias("alternas"), F.lit("").alias("imagen"),
    )


def xml_escape(c: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def _shards(rows: DataFrame) -> DataFrame:
    """The shards there are, and shard 0 even for an empty catalogue."""
    first = small_table(rows.sparkSession, [(0,)], "shard int")
    return rows.select("shard").union(first).distinct()


def sitemap_manifest(rows: DataFrame, site: str) -> DataFrame:
    """The ``Sitemap:`` lines of the robots file: the index, then one line per shard, in order."""
    index = small_table(rows.sparkSession, [(0, f"Sitemap: {site}/sitemap-index.xml")], "orden int, linea string")
    number = F.col("shard") + 1
    lines = F.concat(F.lit(f"Sitemap: {site}/sitemap-capitulos-"), number.cast("string"), F.lit(".xml"))
    return index.unionByName(_shards(rows).select(number.alias("orden"), lines.alias("linea")))


def sitemap_files(rows: DataFrame, site: str) -> DataFrame:
    """The text of each shard's file: its URLs in order, in one ``urlset``. A shard holds a fixed number of rows."""
    url = F.concat(F.lit("<url><loc>"), xml_escape(F.concat(F.lit(site), F.col("ruta"))), F.lit("</loc></url>"))
    listed = rows.select("shard", F.struct("puesto", url.alias("url")).alias("u")).groupBy("shard").agg(
        F.array_sort(F.collect_list("u")).alias("us")
    )
    urls = F.coalesce(F.transform("us", lambda u: u["url"]), F.array().cast("array<string>"))
    text_ = F.array_join(F.concat(F.array(F.lit(fv.URLSET_OPEN)), urls, F.array(F.lit(fv.URLSET_CLOSE))), "\n")
    return _shards(rows).join(listed, "shard", "left").select("shard", text_.alias("value"))


def write_sitemap_shards(rows: DataFrame, site: str, path: str) -> None:
    """One file per shard, in a folder of its own; an empty catalogue still gets shard 0."""
    sitemap_files(rows, site).write.mode("overwrite").partitionBy("shard").text(path)


def write_manifest(rows: DataFrame, site: str, path: str) -> None:
    """The lines of ``sitemap_manifest`` as one file: there are as many as files."""
    sitemap_manifest(rows, site).coalesce(1).sortWithinPartitions("orden").select("linea").write.mode("overwrite").text(path)


# ---- feed, search index, published maps -----------------------------------------------

def feed_items(activity: DataFrame, works: DataFrame, site: str, n: int = 100) -> DataFrame:
    """The ``n`` works that grew last, as feed items."""
    recent = (
        activity.join(works.select("work_id", "slug", "titulo", "titulos_alternativos"), "work_id")
        .orderBy(F.desc("cuando"), "work_id")
        .limit(n)
    )
    link = F.concat(F.lit(f"{site}/novela/"), F.col("slug"))
    also = F.array_join(F.slice("titulos_alternativos", 1, 3), " · ")
    description = F.concat(
        F.lit("Capítulo nuevo en "), F.array_join("fuentes", ", "), F.lit("."),
        F.when(also != "", F.concat(F.lit(" También conocida como "), also, F.lit("."))).otherwise(""),
    )
    return recent.select(
        F.col("titulo").alias("title"),
        link.alias("link"),
        F.concat(link, F.lit("#"), F.date_format("cuando", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("guid"),
        F.concat(F.date_format("cuando", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias("pub_date"),
        description.alias("description"),
    )


def feed_xml(items: DataFrame) -> DataFrame:
    part = lambda tag, c: F.concat(F.lit(f"<{tag}>"), xml_escape(F.col(c)), F.lit(f"</{tag}>"))
    return items.select(
        F.concat(F.lit("<item>"), part("title", "title"), part("link", "link"),
                 F.lit('<guid isPermaLink="false">'), xml_escape(F.col("guid")), F.lit("</guid>"),
                 part("pubDate", "pub_date"), part("description", "description"), F.lit("</item>")).alias("value")
    )


def search_index(works: DataFrame, formats: DataFrame, covered: DataFrame) -> DataFrame:
    """Slug, title, all other names, cover and formats of every work."""
    w = works.join(formats.select("work_id", "formatos"), "work_id", "left").join(
        covered.select("work_id", F.lit(True).alias("_img")), "work_id", "left"
    )
    stated = F.when(F.col("tipo") == "ambos", F.array(F.lit("manhwa"), F.lit("novela"))).otherwise(F.array("tipo"))
    cover = F.when(F.col("_img"), F.concat(F.lit("/portada/"), F.col("slug"), F.lit(".jpg"))).otherwise(fv.NO_COVER)
    return w.select(
        F.col("slug").alias("s"),
        F.col("titulo").alias("t"),
        F.col("titulos_alternativos").alias("a"),
        cover.alias("p"),
        F.coalesce("formatos", stated).alias("f"),
    )


def redirect_map(works: DataFrame) -> DataFrame:
    return works.select(F.explode("slugs_antiguos").alias("viejo"), F.col("slug").alias("nuevo"))


def level_a_slugs(works: DataFrame, levels: DataFrame) -> DataFrame:
    return works.join(levels.where("nivel = 'A'"), "work_id", "left_semi").select("slug")


def linkout_ids(chapters: DataFrame) -> DataFrame:
    """Ids of the sources that only link to a series, for the functions that serve pages."""
    return linkout_sources(chapters).select("source_id").distinct()


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


# ---- bulk export ----------------------------------------------------------------------

def board_of(categories: Column) -> Column:
    """Board of the first category that has one."""
    boards = F.create_map(*[F.lit(x) for pair in fv.board_rows() for x in pair])
    found = F.filter(
        F.transform(categories, lambda c: F.try_element_at(boards, F.lower(text.trim_ws(c)))), lambda b: b.isNotNull()
    )
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(fv.DEFAULT_BOARD))


def bulk_export(
    works: DataFrame, chapters: DataFrame, sources: DataFrame, ledger: DataFrame, site: str, first_day: date,
    batches: int = 1, per_day: int = 10,
) -> DataFrame:
    """Pins for works not sent yet: largest gap first, 200 rows per file, spread over days and hours."""
    last = work_counts(chapters).select("work_id", "manhwa", "novela")
    seen = sources.where("portada_vista IS NOT NULL AND portada_vista <> ''").select(
        "work_id", F.lit(True).alias("_seen")
    ).distinct()
    lead = F.when((F.col("manhwa") > 0) & (F.col("novela") > 0), F.greatest(F.lit(0), F.col("novela") - F.col("manhwa")))
    fresh = (
        works.join(ledger.select("slug").distinct(), "slug", "left_anti")
        .join(seen, "work_id", "left")
        .where(F.coalesce("_seen", F.lit(False)) | is_http("portada_url"))
        .join(last, "work_id")
        .withColumn("faltan", F.coalesce(lead, F.lit(0)))
        .withColumn("total", F.greatest("manhwa", "novela"))
        .where("total > 0")
    )
    # the size of one upload is the caller's choice, so the ranked part is bounded
    order = [F.desc("faltan"), F.desc("total"), F.col("work_id")]
    picked = top_list(fresh, order, batches * fv.PINS_PER_FILE, "_n").withColumn("_i", F.col("_n") - 1)
    t, ahead = F.col("titulo"), F.col("faltan") > 0
    num = lambda c: text.thousands(F.col(c))
    other = F.slice(F.filter("titulos_alternativos", lambda a: (a != "") & (a != t)), 1, 3)
    values = {"titulo": t, **{c: num(c) for c in ("faltan", "manhwa", "novela", "total")}, "otros": F.array_join(other, ", ")}
    title = F.when(ahead, text.filled(fv.PIN_TITLE_AHEAD, **values)).otherwise(text.filled(fv.PIN_TITLE, **values))
    body = F.when(ahead, text.filled(fv.PIN_BODY_AHEAD, **values)).otherwise(text.filled(fv.PIN_BODY, **values))
    known = F.when(F.size(other) > 0, text.filled(fv.PIN_ALSO, **values))
    link = F.concat(F.lit(f"{site}/novela/"), F.col("slug"))
    day = F.date_add(F.lit(first_day), F.floor(F.col("_i") / per_day).cast("int"))
    hour = 9 + F.floor((F.col("_i") % per_day) * 12 / per_day + 0.5)
    fixed = F.array(*[F.lit(w) for w in fv.PIN_KEYWORDS])
    return picked.select(
        "slug",
        F.floor(F.col("_i") / fv.PINS_PER_FILE).cast("int").alias("file"),
        text.ellipsis(title, 100).alias("title"),
        F.concat(F.lit(f"{site}/portada/"), F.col("slug"), F.lit(".jpg")).alias("media_url"),
        board_of(F.col("categorias")).alias("board"),
        text.ellipsis(F.concat_ws(" ", body, known), 500).alias("description"),
        F.when(ahead, F.concat(link, F.lit("/equivalencia"))).otherwise(link).alias("link"),
        F.concat(day.cast("string"), F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00")).alias("publish_date"),
        F.array_join(F.concat(F.slice("categorias", 1, 3), fixed), ", ").alias("keywords"),
    )


def board_counts(pins: DataFrame) -> DataFrame:
    return pins.groupBy("board").agg(F.count("*").alias("n"))


def write_pins(pins: DataFrame, path: str, ledger_path: str) -> None:
    """CSV with every field quoted, one folder per upload; the ledger grows by what was written."""
    columns = ["title", "media_url", "board", "description", "link", "publish_date", "keywords"]
    flat = [F.regexp_replace(c, r"\s*\n\s*", " ").alias(c) for c in columns]
    pins.select("file", *flat).write.mode("overwrite").partitionBy("file").option("header", True).option(
        "quoteAll", True
    ).option("escape", '"').csv(path)
    pins.select("slug").write.mode("append").parquet(ledger_path)


# ---- queues and notices ----------------------------------------------------------------

def editorial_queue(traffic: DataFrame, levels: DataFrame, works: DataFrame, blank: DataFrame, site: str) -> DataFrame:
    """Visited, indexable works without a synopsis: tier A first, then slug.

    ``traffic`` and ``blank``: work_id of visited works and of works with an empty synopsis.
    """
    queue = (
        works.select("work_id", "slug")
        .join(traffic.select("work_id"), "work_id", "left_semi")
        .join(blank.select("work_id"), "work_id", "left_semi")
        .join(levels.where("nivel IN ('A', 'B')"), "work_id")
    )
    return queue.select("slug", "nivel", F.concat(F.lit(f"{site}/novela/"), F.col("slug"), F.lit("/")).alias("url")).orderBy(
        "nivel", "slug"
    )


def notify_batches(
    works: DataFrame, levels: DataFrame, sources: DataFrame, chapters: DataFrame, since: datetime, site: str,
    per_batch: int = 10_000,
) -> DataFrame:
    """URLs to announce: hubs, pages of changed works, their new chapters; numbered batches."""
    changed = sources.where(F.col("ultimo_cambio") >= F.lit(since)).select("work_id").distinct()
    tiers = works.select("work_id", "slug").join(levels.where("nivel IN ('A', 'B')"), "work_id").join(
        changed, "work_id", "left_semi"
    )
    a, b = tiers.where("nivel = 'A'"), tiers.where("nivel = 'B'")
    es = F.concat(F.lit(f"{site}/novela/"), F.col("slug"), F.lit("/"))
    en = F.concat(F.lit(f"{site}/en/novela/"), F.col("slug"), F.lit("/"))
    pages = F.array(es, en, F.concat(es, F.lit("equivalencia/")), F.concat(en, F.lit("equivalencia/")))
    hubs = [f"{site}{p}" for p in ("/", "/en/", "/novelas/", "/series/", "/en/series/")]
    hub_rows = small_table(
        works.sparkSession, [(0, -1, i, u) for i, u in enumerate(hubs)], "parte int, work_id bigint, n bigint, url string"
    )
    a_rows = a.select(F.lit(1).alias("parte"), "work_id", F.posexplode(pages).alias("n", "url"))
    b_rows = b.select(F.lit(2).alias("parte"), "work_id", F.lit(0).alias("n"), es.alias("url"))
    new = (
        chapters.where((F.col("visto_en") >= F.lit(since)) & F.col("numero").isNotNull())
        .join(linkout_sources(chapters), ["work_id", "source_id"], "left_anti")
        .join(a, "work_id")
        .select("work_id", "slug", "numero")
        .distinct()
    )
    ch_rows = new.select(
        F.lit(3).alias("parte"), "work_id", F.col("numero").alias("n"),
        F.concat(F.lit(f"{site}/novela/"), F.col("slug"), F.lit("/capitulo-"), F.col("numero").cast("string")).alias("url"),
    )
    rows = hub_rows.unionByName(a_rows).unionByName(b_rows).unionByName(ch_rows)
    placed = global_position(rows, [F.col("parte"), F.col("work_id"), F.col("n")], "puesto")
    return placed.select("url", "puesto", F.floor((F.col("puesto") - 1) / per_batch).cast("int").alias("lote"))


def domain_report(chapters: DataFrame) -> DataFrame:
    """Chapters per host and their share in percent, one decimal."""
    hosts = chapters.select(host_of("url").alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    hosts = cut_lineage(hosts)
    total = hosts.agg(F.sum("n")).first()[0]
    return hosts.withColumn("pct", F.floor(F.col("n") * 1000 / F.lit(total) + 0.5) / 10)


# ---- snapshots --------------------------------------------------------------------------

def write_snapshot(state: DataFrame, path: str, hasta: datetime, completo_en: datetime) -> None:
    """A new snapshot version: the rows, and one meta row with the watermark, written last.

    Readers take the newest version that has a meta row, so a run that dies half
    way leaves nothing visible.
    """
    version = f"{path}/v={hasta:%Y%m%dT%H%M%S}"
    state.write.mode("overwrite").parquet(f"{version}/rows")
    meta = state.sparkSession.createDataFrame(
        [(hasta, completo_en, ",".join(state.columns))], "hasta timestamp, completo_en timestamp, columnas string"
    )
    meta.coalesce(1).write.mode("overwrite").parquet(f"{version}/meta")
