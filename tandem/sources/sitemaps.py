"""Rows out of sitemap XML: works, chapters, series. Input: a table of documents, column ``xml``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import chapter_number, trim_ws
from tandem.functions.urls import decode


def xml_unescape(c: Column) -> Column:
    for pattern, char in (
        ("&apos;|&#x27;|&#39;", "'"), ("&quot;|&#34;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")
    ):
        c = F.regexp_replace(c, pattern, char)
    return c


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("xml", F.lit(pattern), F.lit(group))


def sitemap_slugs(documents: DataFrame) -> DataFrame:
    """Distinct work slugs named anywhere in the documents."""
    return documents.select(F.explode(_all("/novela/([^/<]+)/", 1)).alias("slug")).distinct()


_CHAPTER = r"<loc>[^<]*/series/([^/<]+)/chapter-([0-9.]+)</loc>\s*<lastmod>([^<]*)</lastmod>"


def sitemap_chapters(documents: DataFrame, site: str) -> DataFrame:
    """One row per chapter entry: slug, number cut to an integer, title, URL, day."""
    found = F.arrays_zip(_all(_CHAPTER, 1).alias("s"), _all(_CHAPTER, 2).alias("n"), _all(_CHAPTER, 3).alias("d"))
    rows = documents.select(F.explode(found).alias("e")).select(xml_unescape(F.col("e.s")).alias("slug"), "e.n", "e.d")
    return rows.select(
        "slug",
        chapter_number("n").alias("numero"),
        F.concat(F.lit("Chapter "), "n").alias("titulo"),
        F.concat(F.lit(f"{site}/series/"), "slug", F.lit("/chapter-"), "n").alias("url"),
        F.nullif(F.substring("d", 1, 10), F.lit("")).alias("fecha_texto"),
    )


def sitemap_series(documents: DataFrame, chapters: DataFrame, site: str, tipo: str) -> DataFrame:
    """Series of one format that have at least one chapter; prose series end in ``-novel``."""
    slugs = documents.select(F.explode(_all("<loc>[^<]*/series/([^/<]+)</loc>", 1)).alias("raw"))
    slugs = slugs.select(xml_unescape(F.col("raw")).alias("slug")).distinct()
    wanted = F.col("slug").endswith("-novel") == F.lit(tipo == "novela")
    kept = slugs.where(wanted).join(chapters.select("slug").distinct(), "slug", "left_semi")
    return kept.select("slug", title_of_slug(F.col("slug")).alias("titulo"),
                       F.concat(F.lit(f"{site}/series/"), "slug").alias("url"))


def title_of_slug(slug: Column) -> Column:
    return trim_ws(F.regexp_replace(F.regexp_replace(decode(slug), "-", " "), r"\s+", " "))


_WORK = r"<loc>https?://[^<]*/novel/([0-9]+)/([^<]+)</loc>"


def sitemap_works(documents: DataFrame, site: str) -> DataFrame:
    """Works listed by id, the first entry of each id kept. ``documents``: doc, xml."""
    found = F.arrays_zip(_all(_WORK, 1).alias("id"), _all(_WORK, 2).alias("slug"))
    rows = documents.select("doc", F.posexplode(found).alias("pos", "e")).select("doc", "pos", "e.id", "e.slug")
    once = rows.groupBy("id").agg(F.min_by("slug", F.struct("doc", "pos")).alias("slug"))
    return once.select(
        "id", title_of_slug(F.col("slug")).alias("titulo"),
        F.concat(F.lit(f"{site}/en/novel/"), "id", F.lit("/"), "slug").alias("url"),
    )
