"""Indexing tiers, the weekly release of cold works and the budget for a second language."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.operators.gap import work_counts
from tandem.operators.rollup import work_summary
from tandem.session import cut_lineage


def release_size(now: datetime) -> int:
    """How many cold works may be indexed by ``now``; the catalogue size caps it further."""
    start = datetime.combine(date.fromisoformat(fv.RELEASE_START), datetime.min.time())
    weeks = (now - start) / timedelta(weeks=1)
    return max(0, math.floor(weeks * fv.RELEASE_PER_WEEK))


def work_facts(works: DataFrame, chapters: DataFrame, traffic: DataFrame | None = None) -> DataFrame:
    """What the tier of a work depends on. ``works``: work_id, adulta, creada_ord and con_trafico,
    or a ``traffic`` table of work_id in place of the flag."""
    if traffic is not None:
        seen = traffic.select("work_id").distinct().withColumn("con_trafico", F.lit(True))
        works = works.drop("con_trafico").join(seen, "work_id", "left").fillna(False, ["con_trafico"])
    summary = work_summary(chapters).select(
        "work_id", "ultimo", ((F.col("manhwa") > 0) & (F.col("novela") > 0)).alias("ambos")
    )
    return (
        works.select("work_id", "adulta", "con_trafico", "creada_ord")
        .join(summary, "work_id", "left")
        .fillna(False, ["ambos"])
        .fillna(0, ["ultimo"])
    )


def cold_release(facts: DataFrame, now: datetime) -> DataFrame:
    """Cold works released so far: oldest first, as many as the weekly pace allows."""
    cold = facts.where(f"NOT adulta AND NOT ambos AND NOT con_trafico AND ultimo >= {fv.MIN_CHAPTERS}")
    order = [F.col("creada_ord").asc_nulls_last(), F.col("work_id")]
    return cold.orderBy(*order).limit(release_size(now)).select("work_id")


def index_levels(facts: DataFrame, now: datetime) -> DataFrame:
    """Tier A, B or C of every work."""
    facts = cut_lineage(facts)  # read twice below: one row per work in place of two passes over the chapters
    released = cold_release(facts, now).withColumn("liberada", F.lit(True))
    level = (
        F.when(F.col("adulta"), F.when(F.col("con_trafico"), "B").otherwise("C"))
        .when(F.col("ambos"), "A")
        .when(F.col("con_trafico"), "B")
        .when((F.col("ultimo") >= fv.MIN_CHAPTERS) & F.col("liberada").isNotNull(), "B")
        .otherwise("C")
    )
    return facts.join(released, "work_id", "left").select("work_id", level.alias("nivel"))


def level_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("nivel").agg(F.count("*").alias("n"))


def english_budget(works: DataFrame, chapters: DataFrame) -> DataFrame:
    """Non-adult works with a gap that get English pages: most chapters first, two files each.

    The file limit bounds the answer to a few thousand rows, so a top-k is enough.
    """
    counts = work_counts(chapters).where("manhwa > 0 AND novela > 0").select("work_id", "caps")
    marked = cut_lineage(works.select("work_id", "adulta").join(counts, "work_id", "left"))
    totals = marked.agg(F.count("*").alias("works"), F.count("caps").alias("gaps")).first()
    budget = max(0, fv.FILE_LIMIT - fv.OTHER_FILES - totals["works"] - totals["gaps"])
    ranked = marked.where("caps IS NOT NULL AND NOT adulta")
    return ranked.orderBy(F.desc("caps"), "work_id").limit(budget // 2).select("work_id", "caps")
