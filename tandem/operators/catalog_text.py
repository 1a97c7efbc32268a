"""Table jobs that apply the text rules: name keys, numbers, genres, titles, texts, URLs, dates.

Each job adds columns to a table that Spark has partitioned; nothing is collected.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import genres, prose, text, urls


def work_names(works: DataFrame) -> DataFrame:
    """One row per name: title at position 0, then the alternatives."""
    names = F.concat(F.array("titulo"), F.col("titulos_alternativos"))
    return works.select("work_id", F.posexplode(names).alias("name_pos", "nombre"))


def name_keys_table(works: DataFrame) -> DataFrame:
    """Names of each work with normalized form, slug and the words that carry them."""
    normalized = work_names(works).withColumn("normal", text.normalize_name("nombre"))
    return normalized.select(
        "work_id",
        "name_pos",
        "nombre",
        "normal",
        text.slugify("nombre").alias("slug"),
        text.keys_of_normalized("normal").alias("claves"),
        text.words_of_normalized("normal").alias("palabras"),
    )


def number_chapters(chapters: DataFrame) -> DataFrame:
    """Chapter number from the title, else from the URL; what the title says besides; title without marks."""
    number = F.coalesce(text.chapter_number("titulo"), text.chapter_number("url"))
    return chapters.withColumn("numero_leido", number).withColumn(
        "resto", text.title_rest("titulo", "numero_leido")
    ).withColumn("titulo_limpio", text.trim_type_marks("titulo"))


def canonicalize_genres(works: DataFrame, cap: int | None = None) -> DataFrame:
    """Genre labels of each work named in both languages, keyed and merged; ``generos`` are all of them, or the first ``cap``."""
    first = works.withColumn("_pairs", genres.first_per_key(genres.keyed(F.col("categorias"))))
    pairs = F.col("_pairs")
    return first.withColumns(
        {
            "generos_es": F.transform(pairs, lambda p: genres.canonical_genre(p["label"], "es")),
            "generos_en": F.transform(pairs, lambda p: genres.canonical_genre(p["label"], "en")),
            "claves_genero": F.transform(pairs, lambda p: p["key"]),
            "generos": F.transform(pairs if cap is None else F.slice(pairs, 1, cap), lambda p: p["label"]),
        }
    ).drop("_pairs")


def tag_titles(works: DataFrame) -> DataFrame:
    """Language of the title, the English title and the second name to show."""
    tagged = works.withColumn("_names", prose.tagged_names(F.col("titulo"), F.col("titulos_alternativos")))
    tagged = tagged.withColumn("idioma_titulo", prose.title_language("titulo"))
    tagged = tagged.withColumn("titulo_en", prose.first_in(F.col("_names"), "en"))
    tagged = tagged.withColumn("_es", prose.first_in(F.col("_names"), "es"))
    second = prose.second_of(F.col("titulo"), F.col("idioma_titulo"), F.col("titulo_en"), F.col("_es"), "es")
    return tagged.withColumn("segundo_nombre", second).drop("_names", "_es")


def clean_texts(texts: DataFrame, column: str) -> DataFrame:
    """Whole texts: cleaned synopsis, English or not, source language."""
    return texts.withColumns(
        {
            "limpio": prose.clean_synopsis(column),
            "en_ingles": prose.is_english_text(column),
            "idioma_origen": prose.source_language(column),
        }
    )


def sentences_of(texts: DataFrame, key: str, column: str) -> DataFrame:
    return texts.select(key, F.posexplode(text.sentences(column)).alias("pos", "frase"))


def rejoin_sentences(pieces: DataFrame, key: str) -> DataFrame:
    """Sentences of a text put back in order. A group is one input text."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "frase")))
    return pieces.groupBy(key).agg(
        text.trim_ws(F.array_join(F.transform(ordered, lambda p: p["frase"]), " ")).alias("texto")
    )


def tag_demography(works: DataFrame) -> DataFrame:
    """Works that state no reader group and get one from their genres."""
    labels = F.col("categorias")
    found = F.when(genres.stated_demography(labels).isNull(), genres.demography(labels))
    return works.withColumn("demografia", found)


def url_facts(table: DataFrame, column: str = "url") -> DataFrame:
    return table.withColumns(
        {"dominio": urls.host_of(column), "ruta": urls.path_of(column), "origen": urls.origin_of(column)}
    )


def bucket_dates(activity: DataFrame, now: datetime) -> DataFrame:
    """Day of each change and how fresh it is at ``now``."""
    at = F.lit(now).cast("timestamp").cast("double")
    age = at - F.col("cuando").cast("timestamp").cast("double")
    return activity.withColumns(
        {"dia": F.to_date("cuando"), "nuevo": age < 6 * 3600, "hoy": age < 24 * 3600}
    )


def translation_keys(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Paragraphs of each text with the key that identifies them in the translation cache."""
    parts = texts.select(key, F.posexplode(F.split(column, "\n\n")).alias("pos", "parrafo"))
    return parts.withColumn("clave", text.text_key("parrafo"))


def joined(c: Column | str, sep: str = "|") -> Column:
    """An array as one string, for output."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)
