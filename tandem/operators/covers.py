"""Cover images: candidates per work, the first that loads, works that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.urls import is_http
from tandem.operators.distributed import top_per_group

_DEAD = f"(?i){fv.LAST_RESORT_HOSTS}"


def cover_options(works: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct http covers of each work with the struct that orders them.

    The work's own cover comes first, then those seen by its sources; hosts that
    block or have died come after all others.
    """
    own = works.select("work_id", F.col("portada_url").alias("url"), F.lit(-1).cast("bigint").alias("ord"))
    seen = sources.join(works.select("work_id"), "work_id", "left_semi").select(
        "work_id", F.col("portada_vista").alias("url"), F.col("source_id").alias("ord")
    )
    once = own.union(seen).where(is_http("url")).groupBy("work_id", "url").agg(F.min("ord").alias("ord"))
    return once.withColumn("orden", F.struct(F.col("url").rlike(_DEAD).alias("ultimo_recurso"), F.col("ord"))).drop("ord")


def cover_candidates(works: DataFrame, sources: DataFrame) -> DataFrame:
    """Covers of each work in the order to try them, one row each; a work has at most one per source."""
    order = Window.partitionBy("work_id").orderBy("orden", "url")
    return cover_options(works, sources).select("work_id", "url", F.row_number().over(order).alias("puesto"))


def cover_map(works: DataFrame, sources: DataFrame, n: int = 3) -> DataFrame:
    return top_per_group(cover_options(works, sources), ["work_id"], [F.col("orden")], n, name="puesto").drop("orden")


def pick_live_cover(options: DataFrame, probes: DataFrame, works: DataFrame) -> DataFrame:
    """First cover whose probe answered with an image, else the placeholder."""
    live = probes.where("status BETWEEN 200 AND 299 AND content_type LIKE 'image/%'").select("url").distinct()
    best = options.join(live, "url", "left_semi").groupBy("work_id").agg(F.min_by("url", "orden").alias("url"))
    return works.select("work_id").join(best, "work_id", "left").fillna(fv.NO_COVER, ["url"])


def works_missing_cover(works: DataFrame, sources: DataFrame) -> DataFrame:
    """Works without a cover of their own or of any source that is not on a dead host."""
    good = sources.where(F.col("portada_vista").isNotNull() & ~F.col("portada_vista").rlike(_DEAD))
    own = F.coalesce(F.col("portada_url"), F.lit(""))
    return works.where((own == "") | own.rlike(_DEAD)).join(good.select("work_id"), "work_id", "left_anti")


def works_with_cover(works: DataFrame, sources: DataFrame) -> DataFrame:
    return cover_options(works, sources).select("work_id").distinct()
