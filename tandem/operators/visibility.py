"""What may be shown: useful rows, prefixes, blocked and adult works, allowed URLs, withdrawals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import genres
from tandem.functions.urls import host_of, host_suffixes, is_http


def useful(items: DataFrame) -> DataFrame:
    """Rows with a title and a URL."""
    return items.where("titulo IS NOT NULL AND titulo <> '' AND url IS NOT NULL AND url <> ''")


def prefix_filter(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """Chapters whose title starts with the prefix their source asks for; no prefix keeps all."""
    asked = sources.select("source_id", "titulo_prefijo")
    return chapters.join(asked, "source_id").where(
        F.col("titulo_prefijo").isNull() | F.col("titulo").startswith(F.col("titulo_prefijo"))
    )


def takedown_slugs(takedown: DataFrame) -> DataFrame:
    return takedown.select(F.lower(F.trim("slug")).alias("slug")).distinct()


def drop_blocked(works: DataFrame, takedown: DataFrame) -> DataFrame:
    """Works without a blocked genre that nobody asked to take down."""
    kept = works.where(~genres.is_blocked(F.col("categorias")))
    gone = takedown_slugs(takedown).withColumnRenamed("slug", "_gone")
    return kept.join(gone, F.lower(F.trim("slug")) == F.col("_gone"), "left_anti")


def flag_adult(works: DataFrame) -> DataFrame:
    return works.withColumn("es_adulta", genres.is_adult(F.col("titulo"), F.col("categorias")))


def _on_domain(url: Column, domains: Sequence[str]) -> Column:
    return F.arrays_overlap(host_suffixes(host_of(url)), F.array(*[F.lit(d) for d in domains]))


def allowed_url(urls: DataFrame, domains: Sequence[str], not_embeddable: Sequence[str] = ()) -> DataFrame:
    """Flag URLs on an allowed domain or below it, and those that may be opened in the viewer.

    The lists are configuration, so they are literals and the job has no shuffle.
    """
    ok = is_http("url") & _on_domain(F.col("url"), domains)
    viewer = ok & ~_on_domain(F.col("url"), not_embeddable) if not_embeddable else ok
    return urls.withColumns({"permitida": ok, "en_visor": viewer})


def with_content(works: DataFrame, chapters: DataFrame, synopses: DataFrame) -> DataFrame:
    """Works with any approved chapter or a synopsis that is not blank."""
    has_text = synopses.where(F.trim("sinopsis") != "").select("work_id")
    content = chapters.select("work_id").union(has_text).distinct()
    return works.join(content, "work_id", "left_semi")


def withdraw(tables: dict[str, DataFrame], slugs: DataFrame) -> dict[str, DataFrame]:
    """Remove works from every table. ``slugs``: work_id and slug to take out.

    Tables keyed by work_id or by slug are both handled; the list is distinct
    and small next to the tables, so Spark can broadcast it when its size allows.
    """
    ids, names = slugs.select("work_id").distinct(), takedown_slugs(slugs)
    out = {}
    for name, table in tables.items():
        if "work_id" in table.columns:
            out[name] = table.join(ids, "work_id", "left_anti")
        else:
            out[name] = table.join(names, "slug", "left_anti")
    return out
