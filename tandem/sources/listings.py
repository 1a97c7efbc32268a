"""Listing pages: when to stop reading, which path holds the series, link-out and total-only pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.text import chapter_number
from tandem.functions.urls import host_of, origin_of
from tandem.operators.distributed import top_per_group


def consolidate_listing(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Series of each site up to the first page that adds nothing new, each URL where it first appears.

    ``pages``: sitio_id, pagina, tope (pages allowed). ``items``: sitio_id, pagina, url.
    """
    allowed = pages.where("pagina <= tope").select("sitio_id", "pagina")
    read = items.join(allowed, ["sitio_id", "pagina"], "left_semi")
    first = read.groupBy("sitio_id", "url").agg(F.min("pagina").alias("pagina"))
    fresh = first.groupBy("sitio_id", "pagina").agg(F.count("*").alias("nuevas"))
    stale = allowed.join(fresh, ["sitio_id", "pagina"], "left_anti")
    stop = stale.groupBy("sitio_id").agg(F.min("pagina").alias("fin"))
    return first.join(stop, "sitio_id", "left").where("fin IS NULL OR pagina < fin").select("sitio_id", "url", "pagina")


def listing_path_candidates(pages: DataFrame, n: int = 5) -> DataFrame:
    """Likely path of the series archive per host: usual names first, then by number of links.

    ``pages``: url, html.
    """
    links = pages.select(
        host_of("url").alias("host"), origin_of("url").alias("_o"),
        F.explode(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), F.lit(1))).alias("href"),
    )
    own = F.lower("href").startswith(F.col("_o"))
    local = links.withColumn("href", F.when(own, F.substr("href", F.length("_o") + 1)).otherwise(F.col("href")))
    segment = F.lower(F.regexp_extract("href", "(?i)^/([a-z0-9_-]+)/[a-z0-9][a-z0-9-]{3,}/?$", 1))
    counted = local.select("host", segment.alias("segmento")).where("segmento <> ''").where(
        ~F.col("segmento").isin(fv.SYSTEM_SEGMENTS)
    ).groupBy("host", "segmento").agg(F.count("*").alias("n"))
    usual = F.array(*[F.lit(s) for s in fv.PREFERRED_SEGMENTS])
    rank = F.coalesce(F.nullif(F.array_position(usual, F.col("segmento")), F.lit(0)), F.lit(len(fv.PREFERRED_SEGMENTS) + 1))
    tie = F.when(rank <= len(fv.PREFERRED_SEGMENTS), 0).otherwise(-F.col("n"))
    return top_per_group(counted, ["host"], [rank, tie, F.col("segmento")], n, name="puesto")


def theme_of(html: Column) -> Column:
    """Theme family named in the markup, NULL when it is another one."""
    name = F.lower(F.regexp_extract(html, "(?i)wp-content/themes/([a-z0-9_-]+)", 1))
    return F.when(name.contains("madara"), "madara").when(
        name.contains("mangareader") | name.contains("mangastream"), "mangareader"
    )


def _total(c: Column) -> Column:
    return F.coalesce(F.floor(c.try_cast("double")).cast("int"), F.lit(0))


def linkout_rows(sources: DataFrame) -> DataFrame:
    """One row per link-out source whose URL says how many chapters there are. ``sources``: source_id, url."""
    fragment = F.regexp_extract("url", "#(.*)$", 1)
    n = _total(F.regexp_extract(fragment, "(?:^|&)caps=([^&]*)", 1))
    rows = sources.withColumn("numero", n).where("numero <> 0")
    return rows.select(
        "source_id", "numero",
        F.concat(F.lit("Serie completa · "), F.col("numero").cast("string"), F.lit(" capítulos")).alias("titulo"),
        F.regexp_replace("url", "#.*$", "").alias("url"),
    )


def total_in_page(html: Column) -> Column:
    """Chapter total a page states: highest episode link, embedded data, or a labelled counter."""
    episodes = F.array_max(
        F.transform(F.regexp_extract_all(html, F.lit("episode_no=([0-9]+)"), F.lit(1)), lambda x: x.try_cast("int"))
    )
    data = F.regexp_extract(html, '(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    embedded = _total(F.get_json_object(data, "$.props.pageProps.serie.serie_data.chapter_count"))
    label = F.regexp_extract(html, r"(?is)<span[^>]*>\s*total chapters\s*</span>\s*<[^>]*>([^<]*)<", 1)
    counter = _total(F.regexp_replace(label, "[^0-9]", ""))
    return F.coalesce(F.nullif(episodes, F.lit(0)), F.nullif(embedded, F.lit(0)), F.nullif(counter, F.lit(0)))


def total_only_rows(pages: DataFrame) -> DataFrame:
    """One row per page that gives a total; number NULL when it gives none. ``pages``: source_id, url, html."""
    rows = pages.withColumn("numero", total_in_page(F.col("html")))
    title = F.when(F.col("numero").isNull(), F.lit("Leer la serie")).otherwise(
        F.concat(F.lit("Serie completa · "), F.col("numero").cast("string"), F.lit(" capítulos"))
    )
    return rows.select("source_id", "numero", title.alias("titulo"), "url")


def synthesize_chapters(totals: DataFrame) -> DataFrame:
    """Rows 1..total for series that only state how many chapters they have. ``totals``: source_id, url, total."""
    rows = totals.where("total >= 1").select(
        "source_id", F.regexp_replace("url", "/+$", "").alias("_b"), F.explode(F.sequence("total", F.lit(1), F.lit(-1))).alias("numero")
    )
    n = F.col("numero").cast("string")
    return rows.select(
        "source_id", "numero", F.concat(F.lit("Chapter "), n).alias("titulo"), F.concat("_b", F.lit("/chapter-"), n).alias("url")
    )


def explode_mirror_links(sheet: DataFrame) -> DataFrame:
    """One row per mirror link of a sheet line; links that are no URL are dropped. ``sheet``: titulo, capitulo, enlaces."""
    links = sheet.select("titulo", "capitulo", F.explode(F.split("enlaces", ",")).alias("url")).withColumn("url", F.trim("url"))
    rows = links.withColumn("host", host_of("url")).where("url <> '' AND host <> ''")
    title = F.concat(F.lit("Capítulo "), "capitulo", F.lit(" · "), "host")
    return rows.select(
        F.split_part(F.regexp_replace("titulo", r"\\n", "\n"), F.lit("\n"), F.lit(1)).alias("serie"),
        chapter_number("capitulo").alias("numero"), title.alias("titulo"), "url",
    )
