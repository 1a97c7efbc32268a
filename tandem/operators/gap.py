"""How far each format has got, and how far the novel is ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANHWA, NOVELA = "manhwa", "novela"


def _last(tipo: str) -> Column:
    return F.coalesce(F.max(F.when((F.col("tipo") == tipo) & (F.col("numero") > 0), F.col("numero"))), F.lit(0))


def last_chapter(chapters: DataFrame) -> DataFrame:
    """Highest positive chapter number per work and format, 0 when there is none."""
    best = F.max(F.when(F.col("numero") > 0, F.col("numero")))
    return chapters.groupBy("work_id", "tipo").agg(F.coalesce(best, F.lit(0)).alias("ultimo"))


def gap(chapters: DataFrame) -> DataFrame:
    """Works with numbered chapters in both formats and the chapters the novel leads by."""
    both = chapters.groupBy("work_id").agg(_last(MANHWA).alias("manhwa"), _last(NOVELA).alias("novela"))
    return both.where("manhwa > 0 AND novela > 0").withColumn(
        "faltan", F.greatest(F.lit(0), F.col("novela") - F.col("manhwa"))
    )


def formats(chapters: DataFrame) -> DataFrame:
    """Sorted formats per work and the adaptation state they mean."""
    flags = chapters.groupBy("work_id").agg(
        F.bool_or(F.col("tipo") == MANHWA).alias("m"), F.bool_or(F.col("tipo") == NOVELA).alias("n")
    )
    return flags.select(
        "work_id",
        F.filter(
            F.array(F.when(F.col("m"), MANHWA), F.when(F.col("n"), NOVELA)), lambda f: f.isNotNull()
        ).alias("formatos"),
        adaptation(F.col("m"), F.col("n")).alias("adaptacion"),
    )


def adaptation(manhwa: Column, novela: Column) -> Column:
    return (
        F.when(manhwa & novela, "ambos")
        .when(manhwa, "solo_manhwa")
        .when(novela, "solo_novela")
        .otherwise("desconocido")
    )


def work_counts(chapters: DataFrame) -> DataFrame:
    """Chapters and last number of each format per work: one pass, numbers only, one shuffle."""
    return chapters.groupBy("work_id").agg(
        F.count("*").alias("caps"),
        _last(MANHWA).alias("manhwa"),
        _last(NOVELA).alias("novela"),
        F.bool_or(F.col("tipo") == MANHWA).alias("tiene_manhwa"),
        F.bool_or(F.col("tipo") == NOVELA).alias("tiene_novela"),
    )


def popularity(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("work_id").agg(F.count("*").alias("caps"))


def series_both(chapters: DataFrame) -> DataFrame:
    """Works that have both formats, with their gap (zeros when a format has no numbers)."""
    per_work = chapters.groupBy("work_id").agg(
        F.bool_or(F.col("tipo") == MANHWA).alias("m"),
        F.bool_or(F.col("tipo") == NOVELA).alias("n"),
        _last(MANHWA).alias("lm"),
        _last(NOVELA).alias("ln"),
    )
    numbered = (F.col("lm") > 0) & (F.col("ln") > 0)
    return per_work.where("m AND n").select(
        "work_id",
        F.when(numbered, F.col("lm")).otherwise(0).alias("manhwa"),
        F.when(numbered, F.col("ln")).otherwise(0).alias("novela"),
        F.when(numbered, F.greatest(F.lit(0), F.col("ln") - F.col("lm"))).otherwise(0).alias("faltan"),
    )
