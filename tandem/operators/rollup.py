"""Chapters grouped by the source that publishes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.urls import host_of
from tandem.operators.distributed import order_number, position_in_group, top_per_group


def attach_source_names(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """Source name of each chapter; the host of its URL when the source is unknown or nameless."""
    names = sources.select("source_id", F.col("nombre").alias("_n"))
    return (
        chapters.join(names, "source_id", "left")
        .withColumn("fuente_nombre", F.coalesce(F.nullif("_n", F.lit("")), host_of("url")))
        .drop("_n")
    )


def source_facts(chapters: DataFrame) -> DataFrame:
    """One row per work and source: counts, last number, and the id of the newest chapter.

    All of them are numbers of fixed width, so rows combine by hash before the one shuffle.
    """
    grouped = chapters.groupBy("work_id", "source_id").agg(
        F.count("*").alias("filas"), F.coalesce(F.max("numero"), F.lit(0)).alias("ultimo"),
        F.max_by("id", order_number(F.coalesce("numero", F.lit(-1)), -F.col("id"))).alias("id_nuevo"),
    )
    return grouped.select(
        "work_id",
        "source_id",
        "id_nuevo",
        "ultimo",
        F.greatest(F.col("filas"), F.col("ultimo")).alias("total"),
        ((F.col("filas") == 1) & (F.col("ultimo") > 1)).alias("solo_enlace"),
        (F.col("filas") > fv.MAX_LISTED_CHAPTERS).alias("recortada"),
    )


def work_summary(chapters: DataFrame) -> DataFrame:
    """Per work: chapters, last number per format, longest source. The chapters are read once.

    Rows shrink to one per (work, source, format), then to one per source, then
    to one per work, each step combined before its shuffle.
    """
    positive = F.max(F.when(F.col("numero") > 0, F.col("numero")))
    fine = chapters.groupBy("work_id", "source_id", "tipo").agg(
        F.count("*").alias("n"), F.max("numero").alias("m"), positive.alias("p")
    )
    last = lambda tipo: F.max(F.when(F.col("tipo") == tipo, F.col("p")))
    per_source = fine.groupBy("work_id", "source_id").agg(
        F.sum("n").alias("n"), F.max("m").alias("m"), last("manhwa").alias("manhwa"), last("novela").alias("novela")
    )
    total = F.greatest(F.col("n"), F.coalesce("m", F.lit(0)))
    return per_source.groupBy("work_id").agg(
        F.sum("n").alias("caps"), F.max(total).alias("ultimo"),
        F.coalesce(F.max("manhwa"), F.lit(0)).alias("manhwa"), F.coalesce(F.max("novela"), F.lit(0)).alias("novela"),
    )


def source_rollup(chapters: DataFrame, sources: DataFrame) -> DataFrame:
    """The card of each source: name, format, language, host, last chapter, total, link-out flag."""
    newest = chapters.select("work_id", "source_id", F.col("id").alias("id_nuevo"), "tipo", "idioma", "url")
    facts = source_facts(chapters).join(newest, ["work_id", "source_id", "id_nuevo"]).drop("id_nuevo").distinct()
    named = attach_source_names(facts, sources)
    return named.withColumn("dominio", host_of("url")).withColumnRenamed("fuente_nombre", "nombre").drop("url")


def listed_chapters(chapters: DataFrame, limit: int | None = None) -> DataFrame:
    """Chapters of each source with their place on its card, newest first, numberless ones last.

    All of them, or the first ``limit`` of each card.
    """
    order = [F.col("numero").desc_nulls_last(), F.col("id"), F.col("visto_en")]
    if limit is None:
        return position_in_group(chapters, ["work_id", "source_id"], order, "puesto")
    return top_per_group(chapters, ["work_id", "source_id"], order, limit, name="puesto")


def linkout_sources(chapters: DataFrame) -> DataFrame:
    """Sources that only link to the series: a single row whose number is a total."""
    return source_facts(chapters).where("solo_enlace").select("work_id", "source_id")


def without_linkout(chapters: DataFrame) -> DataFrame:
    return chapters.join(linkout_sources(chapters), ["work_id", "source_id"], "left_anti")


def activity(sources: DataFrame) -> DataFrame:
    """When each work last grew and on which sources."""
    named = sources.where("ultimo_cambio IS NOT NULL").groupBy("work_id", "nombre").agg(
        F.max("ultimo_cambio").alias("c")
    )
    return named.groupBy("work_id").agg(
        F.max("c").alias("cuando"), F.array_sort(F.collect_list("nombre")).alias("fuentes")
    )


def work_weight(sources: DataFrame) -> DataFrame:
    return sources.groupBy("work_id").agg(
        F.count("*").alias("n_fuentes"), F.sum(F.coalesce("n_caps", F.lit(0))).alias("suma_caps")
    )


def listed_numbers(chapters: DataFrame) -> DataFrame:
    """Distinct positive chapter numbers of each work that a source really lists."""
    return without_linkout(chapters).where("numero > 0").select("work_id", "numero").distinct()


def home_cards(chapters: DataFrame, newest: int = 2, page: int = 6) -> DataFrame:
    """Last chapter per format, newest listed numbers for the home card and for the work page."""
    top = top_per_group(listed_numbers(chapters), ["work_id"], [F.col("numero").desc()], page)
    lists = top.groupBy("work_id").agg(
        F.array_sort(F.collect_list("numero"), lambda a, b: b - a).alias("ultimos")
    )
    best = F.max(F.when(F.col("numero") > 0, F.col("numero")))
    per_work = chapters.groupBy("work_id").agg(
        F.coalesce(F.max(F.when(F.col("tipo") == "manhwa", F.greatest("numero", F.lit(0)))), F.lit(0)).alias("manhwa"),
        F.coalesce(F.max(F.when(F.col("tipo") == "novela", F.greatest("numero", F.lit(0)))), F.lit(0)).alias("novela"),
        F.coalesce(best, F.lit(0)).alias("tope"),
    )
    fallback = F.filter(F.array(F.col("tope"), F.col("tope") - 1), lambda n: n > 0)
    none = F.array().cast("array<int>")
    return per_work.join(lists, "work_id", "left").select(
        "work_id",
        "manhwa",
        "novela",
        F.coalesce(F.slice("ultimos", 1, newest), fallback).alias("tarjeta"),
        F.coalesce("ultimos", none).alias("ultimos"),
    )
