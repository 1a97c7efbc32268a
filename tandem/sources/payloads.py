"""Series and chapters out of JSON answers. Input: a table of documents, column ``json``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.text import chapter_number, trim_type_marks
from tandem.operators.distributed import one_per_key

LOCALIZED = """data array<struct<id:string, attributes:struct<title:map<string,string>, altTitles:array<map<string,string>>,
  status:string, tags:array<struct<attributes:struct<`group`:string, name:map<string,string>>>>>,
  relationships:array<struct<type:string, attributes:struct<fileName:string>>>>>"""
TYPED = "data struct<series:struct<data:array<struct<name:string, slug:string, cover:string, type:string, chapter_count:int>>>>"
LIBRARY = "data array<struct<real_id:string, name_esp:string, the_real_name:string, _imagen:string, _tipo:string, _numero_cap:string>>"
COMICS = """data array<struct<slug:string, title:string, alt_titles:array<string>, cover:string, status:string,
  genres:array<struct<name:string>>>>"""
BLOG = "feed struct<entry:array<struct<title:struct<`$t`:string>, published:struct<`$t`:string>, link:array<struct<rel:string, href:string>>>>>"
FEED = "data array<struct<id:string, attributes:struct<chapter:string, title:string, publishAt:string>>>"
NUMBERED = "data array<struct<number:string, published_at:string>>"

_NO_TEXT = "array<string>"


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _status(c: Column) -> Column:
    return F.when(c == "ongoing", fv.ONGOING).otherwise(fv.FINISHED)


def _none() -> Column:
    return F.array().cast(_NO_TEXT)


def _first(texts: Column, most: int | None) -> Column:
    whole = F.coalesce(texts, _none())
    return whole if most is None else F.slice(whole, 1, most)


def _rows(documents: DataFrame, schema: str, path: str) -> DataFrame:
    parsed = documents.withColumn("_p", F.from_json("json", schema))
    return parsed.select(*documents.drop("json").columns, F.posexplode(f"_p.{path}").alias("pos", "e"))


def localized_title(title: Column, alternatives: Column, lang: str) -> Column:
    """Title in a language, else its regional code, else English, else the first one."""
    code = {"pt": "pt-br"}.get(lang, lang)

    def alternative(key: str) -> Column:
        with_key = F.filter(F.coalesce(alternatives, F.array().cast("array<map<string,string>>")),
                            lambda m: F.map_contains_key(m, key))
        return F.try_element_at(with_key, F.lit(-1))[key]

    asked = [x for key in dict.fromkeys([lang, code, "en"]) for x in (title[key], alternative(key))]
    first = F.try_element_at(F.map_values(title), F.lit(1))
    return F.coalesce(*[_text(x) for x in asked], _text(first), F.lit(""))


def localized_series(
    documents: DataFrame, lang: str, web: str, images: str, max_names: int | None = None, max_genres: int | None = None
) -> DataFrame:
    """Catalogue with titles per language; the identity of a work is its English title. All names and genres, or the first so many."""
    rows = _rows(documents, LOCALIZED, "data")
    a = F.col("e.attributes")
    cover = F.try_element_at(F.filter("e.relationships", lambda r: r["type"] == "cover_art"), F.lit(1))["attributes"]["fileName"]
    named = rows.withColumn("titulo", localized_title(a["title"], a["altTitles"], lang)).withColumn(
        "_en", localized_title(a["title"], a["altTitles"], "en")
    )
    others = F.flatten(F.transform(a["altTitles"], lambda m: F.map_values(m)))
    alternatives = F.array_distinct(F.filter(others, lambda t: (t != "") & (t != F.col("titulo"))))
    tags = F.filter(a["tags"], lambda t: t["attributes"]["group"] == "genre")
    names = F.transform(tags, lambda t: F.coalesce(_text(t["attributes"]["name"]["es"]), t["attributes"]["name"]["en"]))
    return named.select(
        "titulo",
        F.coalesce(_text(F.col("_en")), F.col("titulo")).alias("slug_base"),
        F.concat(F.lit(f"{web}/title/"), "e.id").alias("url"),
        F.when(cover.isNotNull(), F.concat(F.lit(f"{images}/covers/"), "e.id", F.lit("/"), cover, F.lit(".256.jpg")))
        .otherwise("").alias("portada"),
        _first(alternatives, max_names).alias("titulos_alternativos"),
        _status(a["status"]).alias("estado"),
        _first(names, max_genres).alias("categorias"),
    )


def typed_series(documents: DataFrame, tipo: str, web: str) -> DataFrame:
    """Catalogue that tells comics from novels and states chapter totals."""
    rows = _rows(documents, TYPED, "data.series.data")
    kind = "novel" if tipo == "novela" else "comic"
    kept = rows.where((F.coalesce("e.type", F.lit("comic")) == kind) & (F.coalesce("e.slug", F.lit("")) != ""))
    total = F.coalesce("e.chapter_count", F.lit(0)).cast("string")
    return kept.select(
        F.col("e.name").alias("titulo"),
        F.concat(F.lit(f"{web}/series/comic-"), "e.slug", F.lit("#caps="), total).alias("url"),
        F.coalesce("e.cover", F.lit("")).alias("portada"),
    )


def library_series(documents: DataFrame, tipo: str, web: str) -> DataFrame:
    rows = _rows(documents, LIBRARY, "data")
    is_prose = F.coalesce(F.col("e._tipo") == "novela", F.lit(False))
    kept = rows.where((is_prose == F.lit(tipo == "novela")) & (F.coalesce("e.real_id", F.lit("")) != ""))
    total = F.coalesce(F.floor(F.col("e._numero_cap").try_cast("double")).cast("int"), F.lit(0)).cast("string")
    return kept.select(
        F.coalesce(_text(F.col("e.name_esp")), _text(F.col("e.the_real_name")), F.lit("")).alias("titulo"),
        F.concat(F.lit(f"{web}/manhwa/"), "e.real_id", F.lit("#caps="), total).alias("url"),
        F.coalesce("e._imagen", F.lit("")).alias("portada"),
    )


def comic_series(documents: DataFrame, web: str, max_names: int | None = None, max_genres: int | None = None) -> DataFrame:
    """Catalogue of comics with their names and genres: all of them, or the first so many."""
    rows = _rows(documents, COMICS, "data").where("e.title <> '' AND e.slug <> ''")
    title = F.col("e.title")
    others = F.array_distinct(F.filter(F.coalesce("e.alt_titles", _none()), lambda t: (t != "") & (t != title)))
    names = F.filter(F.transform("e.genres", lambda g: g["name"]), lambda n: n.isNotNull() & (n != ""))
    return rows.select(
        title.alias("titulo"),
        title.alias("slug_base"),
        F.concat(F.lit(f"{web}/comics/"), "e.slug").alias("url"),
        F.coalesce("e.cover", F.lit("")).alias("portada"),
        _first(others, max_names).alias("titulos_alternativos"),
        _status(F.col("e.status")).alias("estado"),
        _first(names, max_genres).alias("categorias"),
    )


def _alternate_link() -> Column:
    return F.try_element_at(F.filter("e.link", lambda x: x["rel"] == "alternate"), F.lit(1))["href"]


def blog_series(documents: DataFrame, tipo: str) -> DataFrame:
    """Blog pages whose title carries the mark of the format."""
    rows = _rows(documents, BLOG, "feed.entry")
    raw = F.trim(F.coalesce(F.col("e.title")["$t"], F.lit("")))
    mark = "(?i)manhwa|manhua|manga" if tipo == "manhwa" else "(?i)novela|novel"
    named = rows.select(raw.alias("raw"), _alternate_link().alias("href")).withColumn("titulo", trim_type_marks("raw"))
    kept = named.where((F.col("href") != "") & (F.col("titulo") != "") & F.col("raw").rlike(mark))
    label = F.concat("titulo", F.lit(f" ({'Manhwa' if tipo == 'manhwa' else 'Novela'})"))
    tag = F.regexp_replace(F.url_encode(label), r"\+", "%20")
    return kept.select("titulo", F.concat("href", F.lit("#etq="), tag).alias("url"))


def blog_chapters(documents: DataFrame) -> DataFrame:
    """Posts of a label feed as chapters. ``documents``: serie, json."""
    rows = _rows(documents, BLOG, "feed.entry").withColumn("url", _alternate_link()).where("url <> ''")
    title = F.coalesce(F.col("e.title")["$t"], F.lit(""))
    return rows.select(
        "serie", chapter_number(title).alias("numero"), title.alias("titulo"), "url",
        F.substring(F.col("e.published")["$t"], 1, 10).alias("fecha_texto"),
    )


def feed_chapters(documents: DataFrame, web: str) -> DataFrame:
    """One row per chapter number of each series: the first (most recent) entry wins.

    ``documents``: serie, doc (page of the feed), json. Entries without a number keep their own key.
    """
    rows = _rows(documents, FEED, "data").select("serie", "doc", "pos", "e.id", "e.attributes")
    keyed = rows.withColumn("clave", F.coalesce("attributes.chapter", F.concat(F.lit("x-"), "id")))
    first = one_per_key(keyed, ["serie", "clave"], F.col("doc").cast("bigint") * 2**32 + F.col("pos"), largest=False)
    a = F.col("attributes")
    number = F.nullif(F.floor(a["chapter"].try_cast("double")).cast("int"), F.lit(0))
    fallback = F.concat(F.lit("Capítulo "), F.coalesce(a["chapter"], F.lit("?")))
    return first.select(
        "serie", number.alias("numero"), F.coalesce(_text(a["title"]), fallback).alias("titulo"),
        F.concat(F.lit(f"{web}/chapter/"), "id").alias("url"), F.substring(a["publishAt"], 1, 10).alias("fecha_texto"),
    )


def numbered_chapters(documents: DataFrame) -> DataFrame:
    """Chapters addressed by their number. ``documents``: serie, url (of the series), json."""
    rows = _rows(documents, NUMBERED, "data")
    n = F.col("e.number")
    return rows.select(
        "serie", F.floor(n.try_cast("double")).cast("int").alias("numero"), F.concat(F.lit("Chapter "), n).alias("titulo"),
        F.concat("url", F.lit("/chapter/"), n).alias("url"), F.substring("e.published_at", 1, 10).alias("fecha_texto"),
    )
