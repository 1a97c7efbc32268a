"""Request logs: which answer each path gets, redirects of merged works, dead slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions import genres
from tandem.functions.text import slugify
from tandem.functions.urls import decode, slug_in_path
from tandem.operators.distributed import follow_chains
from tandem.session import cut_lineage

_WORK = r"^(/(?:[a-z]{2}/)?novela/)([^/]+)(/.*)?$"
_CHAPTER = r"^(/novela/[^/]+)/capitulo-([0-9]+)/?$"


def site_path(path: Column) -> Column:
    """Path without its final slash, so both spellings of a page are one key."""
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))


def repaired(path: Column) -> Column:
    """Where a broken path most likely wanted to go; NULL when nothing is known."""
    others = "|".join(fv.PATH_LANGUAGES)
    without = F.regexp_extract(path, rf"^/(?:{others})(/.*)?$", 1)
    glued = r"^/novela/(.+)-capitulo-([0-9]+)/?$"
    genre = F.nullif(F.regexp_extract(path, "^/categoria/([^/]+)/?$", 1), F.lit(""))
    target = genres.legacy_slug_target(genre)
    return (
        F.when(path.rlike(rf"^/(?:{others})(?:/.*)?$"), F.when(without == "", "/").otherwise(without))
        .when(path.rlike(glued), F.regexp_replace(path, glued, "/novela/$1/capitulo-$2"))
        .when(target.isNotNull(), F.concat(F.lit("/categoria/"), target, F.lit("/")))
    )


def resolve_redirects(requests: DataFrame, redirects: DataFrame) -> DataFrame:
    """Paths of merged works moved to the surviving work, the tail of the path kept.

    ``redirects``: slug, nuevo (one merge each); repeated merges are followed to the end.
    """
    final = follow_chains(redirects, "slug", "nuevo")
    # paths that name no work get keys of their own, which no slug has, so they do not meet in one task
    other = F.concat(F.lit("/"), F.pmod(F.xxhash64("path"), F.lit(1 << 16)).cast("string"))
    slug = F.coalesce(F.nullif(F.regexp_extract("path", _WORK, 2), F.lit("")), other)
    asked = requests.withColumn("_slug", slug)
    targets = asked.select("_slug").distinct().join(final.withColumnRenamed("slug", "_slug"), "_slug")
    moved = asked.join(targets, "_slug", "left")
    head, tail = F.regexp_extract("path", _WORK, 1), F.regexp_extract("path", _WORK, 3)
    target = F.concat(head, F.col("nuevo"), F.when(tail == "", "/").otherwise(tail))
    return moved.withColumn("destino", target).drop("_slug", "nuevo")


def classify_requests(
    requests: DataFrame, existing: DataFrame, redirects: DataFrame, takedown: DataFrame
) -> DataFrame:
    """Status and target of every distinct requested path.

    ``requests``: path. ``existing``: path of every page (no final slash).
    The log is first reduced to distinct paths with their hits, so a path that
    makes up a third of the log is one row in every later join.
    """
    paths = requests.groupBy("path").agg(F.count("*").alias("hits"))
    cover = F.nullif(F.regexp_extract("path", r"^/portada/([^/.]+)", 1), F.lit(""))
    paths = paths.withColumn("_slug", F.coalesce(slug_in_path("path"), F.lower(F.trim(decode(cover)))))
    gone = takedown.select(F.lower(F.trim("slug")).alias("_slug")).distinct().withColumn("_gone", F.lit(True))
    paths = paths.join(gone, "_slug", "left").drop("_slug")

    number = F.regexp_extract("path", _CHAPTER, 2).try_cast("bigint")
    chapter = (number > 0) & (number <= fv.MAX_CHAPTER_NUMBER)
    plain = F.concat(F.regexp_extract("path", _CHAPTER, 1), F.lit("/capitulo-"), number.cast("string"))
    paths = paths.withColumn("_plain", F.when(chapter & F.col("path").rlike("/capitulo-0"), plain))

    paths = paths.withColumn("_fixed", F.coalesce(repaired(F.col("path")), F.col("path")))
    moved = resolve_redirects(
        paths.withColumnRenamed("path", "_asked").withColumnRenamed("_fixed", "path"), redirects
    ).withColumnRenamed("path", "_fixed").withColumnRenamed("_asked", "path")
    wanted = F.coalesce("destino", F.when(F.col("_fixed") != F.col("path"), F.col("_fixed")))
    moved = moved.withColumn("_to", wanted)
    work_page = F.when(
        F.col("_to").rlike(r"/capitulo-[0-9]+/?$"), F.regexp_replace("_to", r"/capitulo-[0-9]+/?$", "/")
    )
    moved = cut_lineage(moved.withColumn("_work", work_page))
    # up to three pages are looked up per path, in one join
    flags = {"_here": "path", "_there": "_to", "_work_there": "_work"}
    asked = F.array(*[F.struct(F.lit(k).alias("flag"), site_path(F.col(c)).alias("_page")) for k, c in flags.items()])
    lookups = moved.select("path", F.explode(asked).alias("q")).select("path", "q.flag", "q._page").where("_page IS NOT NULL")
    hits = lookups.join(existing.select(F.col("path").alias("_page")).distinct(), "_page")
    found = hits.groupBy("path").agg(*[F.bool_or(F.col("flag") == k).alias(k) for k in flags])
    moved = moved.join(found, "path", "left").fillna(False, list(flags))
    status = (
        F.when(F.col("_gone"), 410)
        .when(F.col("_plain").isNotNull(), 301)
        .when(F.col("_here"), 200)
        .when(F.col("_there") | F.col("_work_there"), 301)
        .otherwise(404)
    )
    target = F.coalesce("_plain", F.when(F.col("_there"), F.col("_to")), F.when(F.col("_work_there"), F.col("_work")))
    return moved.withColumn("status", status).select(
        "path", "hits", "status", F.when(F.col("status") == 301, target).alias("destino")
    )


def recover_dead_slugs(asked: DataFrame, works: DataFrame) -> DataFrame:
    """Old slugs that match a former title of a living work and are not recorded yet.

    ``asked``: url (URL, path or slug). ``works``: work_id, slug, titulos_alternativos, slugs_antiguos.
    Of several works with the title the last one (by work_id) is taken.
    """
    tail = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+", ""), r"^/(?:[a-z]{2}/)?novela/", "")
    old = F.regexp_replace(F.split_part(tail, F.lit("/"), F.lit(1)), "-capitulo-[0-9]+$", "")
    dead = asked.select(old.alias("viejo")).where("viejo <> ''").distinct()
    dead = dead.join(works.select(F.col("slug").alias("viejo")), "viejo", "left_anti")
    named = (
        works.select("work_id", "slug", "slugs_antiguos", F.explode("titulos_alternativos").alias("nombre"))
        .withColumn("viejo", slugify("nombre"))
        .groupBy("viejo")
        .agg(F.max_by(F.struct("slug", "slugs_antiguos"), "work_id").alias("w"))
    )
    return (
        dead.join(named, "viejo")
        .where(~F.array_contains("w.slugs_antiguos", F.col("viejo")))
        .select("viejo", F.col("w.slug").alias("slug"))
    )
