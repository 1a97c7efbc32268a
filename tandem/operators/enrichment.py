"""Metadata from provider records, translated texts, genre hubs, reading progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions import genres, prose
from tandem.functions.text import name_keys, text_hash, text_key
from tandem.operators.catalog_text import translation_keys
from tandem.operators.distributed import one_per_key

_NONE = "array<string>"


def _keys(names: Column) -> Column:
    return F.flatten(F.transform(names, lambda n: name_keys(n)))


def _with_known_tags(labels: Column, tags: Column) -> Column:
    """Genres of a record and those of its tags that are genres."""
    known = F.filter(F.coalesce(tags, F.array().cast(_NONE)), lambda c: genres.is_known_genre(c))
    return F.concat(F.coalesce(labels, F.array().cast(_NONE)), known)


def accepted_records(works: DataFrame, records: DataFrame) -> DataFrame:
    """Provider records whose titles share a name key with their work, in provider order.

    ``works``: work_id, titulo, titulos_alternativos, titulo_traducido (NULL when none).
    ``records``: work_id, proveedor, traducida (asked by the translated title), titulos,
    sinopsis, generos, etiquetas, estado, portada, demografia; one per work, provider and query.
    Records for the translated title count only when none for the title itself is accepted.
    """
    names = F.concat(F.array("titulo"), F.col("titulos_alternativos"))
    extra = F.when(F.col("titulo_traducido").isNotNull(), F.array("titulo_traducido")).otherwise(F.array().cast(_NONE))
    own = works.select("work_id", _keys(names).alias("_k"), _keys(extra).alias("_x"))
    order = F.array_position(F.array(*[F.lit(p) for p in fv.PROVIDER_ORDER]), F.col("proveedor")).cast("int")
    joined = records.join(own, "work_id").withColumn("_valid", F.when(F.col("traducida"), F.concat("_k", "_x")).otherwise(F.col("_k")))
    fits = joined.where(F.arrays_overlap("_valid", _keys(F.col("titulos")))).withColumn("orden", order)
    direct = fits.groupBy("work_id").agg(F.min("traducida").alias("_turn"))
    return fits.join(direct, "work_id").where(F.col("traducida") == F.col("_turn")).drop("_k", "_x", "_valid", "_turn")


def combined_record(accepted: DataFrame, all_providers: bool = False) -> DataFrame:
    """One record per work: the first accepted one, completed by the others.

    By default only names are added, from the provider that knows the most of
    them. ``all_providers`` also joins genres, reader group and provider names.
    """
    rec = F.struct(
        "orden", "proveedor", "titulos", "sinopsis", "estado", "portada", "demografia",
        _with_known_tags(F.col("generos"), F.col("etiquetas")).alias("generos"),
    )
    # at most one record per provider, so the group has four entries
    grouped = accepted.groupBy("work_id").agg(F.array_sort(F.collect_list(rec)).alias("rs"))
    first = F.element_at("rs", 1)
    used = F.col("rs") if all_providers else F.slice("rs", 1, 1)
    names_from = F.col("rs") if all_providers else F.concat(
        F.slice("rs", 1, 1), F.filter("rs", lambda r: (r["proveedor"] == fv.NAMES_PROVIDER) & (r["orden"] > first["orden"]))
    )
    stated = F.filter(F.transform(used, lambda r: r["demografia"]), lambda d: d.isNotNull())
    return grouped.select(
        "work_id",
        F.array_join(F.transform(used, lambda r: r["proveedor"]), "+").alias("fuente"),
        F.array_distinct(F.flatten(F.transform(names_from, lambda r: r["titulos"]))).alias("titulos"),
        first["sinopsis"].alias("r_sinopsis"),
        first["estado"].alias("r_estado"),
        first["portada"].alias("r_portada"),
        F.try_element_at(stated, F.lit(1)).alias("r_demografia"),
        genres.merge_genres([F.flatten(F.transform(used, lambda r: r["generos"]))], None).alias("r_generos"),
    )


def enrich(works: DataFrame, record: DataFrame, max_names: int | None = None, max_story: int | None = None) -> DataFrame:
    """Works with their gaps filled from their record; good values are never replaced.

    All names and the whole synopsis are taken, or the first ``max_names`` and ``max_story`` characters
    (``fixed_values.MAX_ALTERNATIVES`` and ``MAX_SYNOPSIS`` in the source).

    ``works``: work_id, titulo, titulos_alternativos, sinopsis, categorias, estado, portada_url.
    """
    w = works.join(record, "work_id", "left")
    matched = F.col("fuente").isNotNull()
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    w = w.withColumn("_story", F.when(matched, prose.clean_synopsis("r_sinopsis")))
    before = F.coalesce("categorias", F.array().cast(_NONE))
    w = w.withColumn("_cats", F.when(matched, genres.merge_genres([before, F.col("r_generos")])).otherwise(before))
    w = w.withColumn("_group", F.when(
        genres.stated_demography(F.col("_cats")).isNull(),
        F.coalesce("r_demografia", genres.demography(F.col("_cats"))),
    ))
    w = w.withColumn("_cats", F.when(F.col("_group").isNotNull(), F.array_append("_cats", F.col("_group"))).otherwise(F.col("_cats")))
    alternatives = F.coalesce("titulos_alternativos", F.array().cast(_NONE))
    named = F.array_distinct(F.filter(F.concat(alternatives, "titulos"), lambda n: n.isNotNull() & (n != "")))
    named = F.filter(named, lambda n: n != F.col("titulo"))
    named = named if max_names is None else F.slice(named, 1, max_names)
    story = F.col("_story") if max_story is None else F.substring("_story", 1, max_story)
    dead = blank("portada_url") | F.col("portada_url").rlike(f"(?i){fv.LAST_RESORT_HOSTS}")
    return w.select(
        "work_id",
        "titulo",
        F.when(matched & (F.size(named) > 0), named).otherwise(alternatives).alias("titulos_alternativos"),
        F.when(blank("sinopsis") & (F.coalesce("_story", F.lit("")) != ""), story)
        .otherwise(F.col("sinopsis")).alias("sinopsis"),
        F.when(F.size("_cats") != F.size(before), F.col("_cats")).otherwise(before).alias("categorias"),
        F.when(blank("estado") & F.col("r_estado").isNotNull(), F.col("r_estado")).otherwise(F.col("estado")).alias("estado"),
        F.when(dead & F.col("r_portada").isNotNull(), F.col("r_portada")).otherwise(F.col("portada_url")).alias("portada_url"),
        F.col("fuente").alias("metadatos_fuente"),
    )


def works_to_enrich(
    works: DataFrame, retry: bool = False, merged_genres: bool = False, limit: int | None = None
) -> DataFrame:
    """Works to ask about: never asked, asked without success, or without merged genres.

    All of them, or the first ``limit`` by slug.
    """
    if merged_genres:
        rows = works.where("NOT categorias_fusionadas AND metadatos_fuente IS NOT NULL")
    elif retry:
        rows = works.where("enriquecida AND metadatos_fuente IS NULL")
    else:
        rows = works.where("NOT enriquecida")
    return rows if limit is None else rows.orderBy("slug").limit(limit)


# ---- translation ------------------------------------------------------------------------

def bind_cache(imported: DataFrame, texts: DataFrame) -> DataFrame:
    """Imported cache rows (hash, idioma, texto) with the key of the text they translate.

    Imported files name a text by a 32-bit hash. A hash that two of the ``texts`` (texto) have says nothing about
    either, so its rows are left out and both texts count as missing.
    """
    known = texts.select("texto").distinct().select(text_hash("texto").alias("hash"), text_key("texto").alias("clave"))
    alone = known.groupBy("hash").agg(F.count("*").alias("_n")).where("_n = 1").select("hash")
    return imported.join(known.join(alone, "hash"), "hash")


def unique_cache(cache: DataFrame) -> DataFrame:
    """One translation per text and language: of several the longest, then by a hash."""
    return one_per_key(cache.select("clave", "idioma", "texto"), ["clave", "idioma"], F.length("texto"))


def translate_lookup(texts: DataFrame, cache: DataFrame, lang: str, key: str, column: str) -> DataFrame:
    """Each paragraph replaced by its cached translation, or kept when there is none.

    ``cache``: clave (``text_key`` of the text), idioma, texto.
    """
    parts = translation_keys(texts, key, column)
    known = unique_cache(cache.where(F.col("idioma") == lang)).select("clave", F.col("texto").alias("_t"))
    done = parts.join(known, "clave", "left").withColumn("p", F.coalesce("_t", "parrafo"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "p")))  # the paragraphs of one text
    return done.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n").alias(column),
        F.count_if(F.col("_t").isNotNull()).alias("traducidos"),
    )


def localize(works: DataFrame, cache: DataFrame, lang: str) -> DataFrame:
    """Title, synopsis, genres and other names of each work in a language.

    ``works``: work_id, titulo, titulos_alternativos, sinopsis, categorias.
    """
    shown = translate_lookup(works.select("work_id", "sinopsis"), cache, lang, "work_id", "sinopsis")
    w = works.withColumnRenamed("sinopsis", "_raw").join(shown.drop("traducidos"), "work_id")
    title = F.col("titulo")
    if lang == "en":
        title = F.coalesce(prose.title_in(F.col("titulo"), F.col("titulos_alternativos"), "en"), F.col("titulo"))
        keep = (F.col("sinopsis") != F.col("_raw")) | prose.is_english_text("_raw")
        story = F.when(keep, F.col("sinopsis")).otherwise("")
    else:
        story = F.col("sinopsis")
    w = w.withColumn("_title", title)
    others = F.filter(F.concat(F.array("titulo"), "titulos_alternativos"), lambda n: n != F.col("_title"))
    return w.select(
        "work_id",
        F.col("_title").alias("titulo"),
        story.alias("sinopsis"),
        genres.genres_in(F.col("categorias"), lang).alias("categorias"),
        others.alias("titulos_alternativos"),
    )


def coverage(texts: DataFrame, cache: DataFrame, langs: Sequence[str], active: Sequence[str]) -> DataFrame:
    """Share of distinct texts translated into each language, and whether it may be published.

    ``texts``: texto.
    """
    keyed = texts.select(text_key("texto").alias("clave")).distinct()
    asked = keyed.withColumn("idioma", F.explode(F.array(*[F.lit(x) for x in langs])))
    done = cache.where("texto <> ''").select("clave", "idioma", F.lit(1).alias("_t")).distinct()
    share = asked.join(done, ["clave", "idioma"], "left").groupBy("idioma").agg(
        F.avg(F.coalesce("_t", F.lit(0))).alias("cobertura")
    )
    base = F.col("idioma") == fv.BASE_LANGUAGE
    value = F.when(base, 1.0).otherwise(F.col("cobertura"))
    return share.select(
        "idioma", value.alias("cobertura"),
        (F.col("idioma").isin(list(active)) & (base | (value >= fv.PUBLISH_COVERAGE))).alias("publicado"),
    )


def missing_translations(texts: DataFrame, cache: DataFrame, langs: Sequence[str]) -> DataFrame:
    """Distinct texts still to translate, per target language. ``texts``: texto, origen."""
    once = texts.where(F.trim("texto") != "").groupBy("texto").agg(F.max("origen").alias("origen"))
    asked = once.withColumn("idioma", F.explode(F.array(*[F.lit(x) for x in langs]))).where("origen <> idioma")
    keyed = asked.withColumn("clave", text_key("texto"))
    return keyed.join(cache.where("texto <> ''").select("clave", "idioma"), ["clave", "idioma"], "left_anti")


def translation_backlog(texts: DataFrame, cache: DataFrame, langs: Sequence[str]) -> DataFrame:
    return missing_translations(texts, cache, langs).groupBy("idioma").agg(
        F.count("*").alias("faltan"), F.sum(F.length("texto")).alias("caracteres")
    )


Translator = Callable[[list[str], str, str], list[str]]


def incremental_translate(
    texts: DataFrame, cache: DataFrame, langs: Sequence[str], translate: Translator, batch: int = 10
) -> DataFrame:
    """New cache rows (clave, hash, idioma, texto) for the texts that have none yet; hash names them in exported files.

    ``translate(texts, source, target)`` is called with batches of one language
    pair. A batch that raises is left out, so the next run finds it missing
    again. Work is spread by text, so a language that holds most of the texts
    still uses every task.
    """
    missing = missing_translations(texts, cache, langs)
    spread = missing.repartition("clave").sortWithinPartitions("origen", "idioma")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (source, target), group in frame.groupby(["origen", "idioma"]):
                for start in range(0, len(group), batch):
                    part = group.iloc[start : start + batch]
                    try:
                        done = translate(list(part["texto"]), source, target)
                    except Exception:  # noqa: BLE001  the batch stays missing and is asked again
                        continue
                    out = pd.DataFrame({
                        "clave": list(part["clave"]), "hash": list(part["hash"]), "idioma": target, "texto": done
                    })
                    yield out[out["texto"].astype(bool)]

    asked = spread.select("clave", text_hash("texto").alias("hash"), "origen", "idioma", "texto")
    return asked.mapInPandas(run, "clave string, hash string, idioma string, texto string")


# ---- hubs and progress ------------------------------------------------------------------

def genre_hubs(works: DataFrame, minimum: int = 8) -> DataFrame:
    """Non-adult works by genre, adult genres left out; hubs of at least ``minimum`` works are featured."""
    labels = works.where("NOT adulta").select("work_id", F.explode(F.array_distinct(genres.genres_in(F.col("categorias")))).alias("nombre"))
    keyed = labels.withColumn("slug", genres.genre_key(F.col("nombre"))).where("slug <> ''")
    shown = keyed.where(~F.col("slug").isin(fv.EXPLICIT_GENRES + fv.BLOCKED_GENRES))
    return shown.groupBy("slug").agg(F.min("nombre").alias("nombre"), F.count_distinct("work_id").alias("obras")).withColumn(
        "destacado", F.col("obras") >= minimum
    )


def featured_hubs(hubs: DataFrame, n: int = 24) -> DataFrame:
    return hubs.where("destacado").orderBy(F.desc("obras"), "slug").limit(n)


def sync_progress(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Reading progress of both sides joined: chapters united, favourite kept; push = cloud must be updated.

    Both: user_id, work_id, capitulos (array), favorito.
    """
    none = F.array().cast("array<int>")
    a = local.select("user_id", "work_id", F.col("capitulos").alias("l"), F.col("favorito").alias("lf"))
    b = cloud.select("user_id", "work_id", F.col("capitulos").alias("c"), F.col("favorito").alias("cf"))
    both = a.join(b, ["user_id", "work_id"], "full_outer")
    united = F.array_sort(F.array_union(F.coalesce("c", none), F.coalesce("l", none)))
    favourite = F.coalesce("cf", F.lit(False)) | F.coalesce("lf", F.lit(False))
    same = F.col("c").isNotNull() & (F.array_sort("c") == united) & (F.coalesce("cf", F.lit(False)) == favourite)
    return both.select(
        "user_id", "work_id", united.alias("capitulos"), favourite.alias("favorito"), (~same).alias("subir")
    )

