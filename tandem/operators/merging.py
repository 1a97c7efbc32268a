"""Duplicate works: candidate pairs, the merge plan, the merged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.text import normalize_name
from tandem.operators.catalog_text import work_names
from tandem.operators.distributed import components
from tandem.operators.matching import similar_sets, title_sets, word_postings
from tandem.operators.rollup import work_weight
from tandem.session import cut_lineage


def dup_pairs_by_name(works: DataFrame) -> DataFrame:
    """Works that share a normalized name, each paired with the lowest work of that name.

    A name shared by n works gives n - 1 pairs: enough to connect them, and
    linear in the size of the group.
    """
    names = work_names(works).select("work_id", normalize_name("nombre").alias("n"))
    names = names.where(F.length("n") >= fv.MIN_DUPLICATE_NAME).distinct()
    lowest = names.groupBy("n").agg(F.min("work_id").alias("a"))
    return (
        names.join(lowest, "n").where("a <> work_id").select("a", F.col("work_id").alias("b")).distinct()
        .withColumn("similitud", F.lit(1.0))
    )


def dup_pairs_by_words(titles: DataFrame, max_postings: int | None = None) -> DataFrame:
    """Works with similar titles: Jaccard >= 0.8 over content words, equal numbers, four words or more.

    ``titles``: work_id, nombre (one row per title or translated title). All
    pairs are found; with ``max_postings`` (``fixed_values.MAX_POSTINGS`` is the
    usual number) only a word in at most that many titles brings two titles
    together. Titles with the same words form a group that is linked to
    its lowest work; groups are compared once, through their lowest works.
    """
    sets = cut_lineage(title_sets(titles, "work_id"))  # read five times below
    postings = cut_lineage(word_postings(sets))
    member = titles.select("work_id", F.array_sort(_words("nombre")).alias("words")).join(
        sets.select("words", "low"), "words"
    )
    same = member.where("work_id <> low")
    if max_postings is not None:
        telling = (
            sets.where("names > 1").select("words", F.explode("words").alias("word"))
            .join(postings.where(F.col("df") <= max_postings), "word", "left_semi")
            .select("words").distinct()
        )
        same = same.join(telling, "words", "left_semi")
    same = same.select(F.col("low").alias("a"), F.col("work_id").alias("b"), F.lit(1.0).alias("similitud"))

    pairs = similar_sets(sets.select("words"), sets.select("words"), fv.SIMILAR_ENOUGH, postings, max_postings)
    numbers = lambda c: F.filter(c, lambda w: w.rlike("^[0-9]+$"))  # noqa: E731  (word arrays are sorted)
    pairs = pairs.where("words_l < words_r").where(
        F.concat_ws(",", numbers("words_l")) == F.concat_ws(",", numbers("words_r"))
    )
    low = sets.select("words", "low")
    named = pairs.join(low.select(F.col("words").alias("words_l"), F.col("low").alias("x")), "words_l").join(
        low.select(F.col("words").alias("words_r"), F.col("low").alias("y")), "words_r"
    ).where("x <> y")
    other = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similitud")
    return same.union(other).groupBy("a", "b").agg(F.max("similitud").alias("similitud"))


def _words(c: str) -> Column:
    from tandem.functions.text import content_words

    return content_words(c)


def merge_weights(works: DataFrame, sources: DataFrame) -> DataFrame:
    """What decides which of two works stays: more sources, chapters, names, synopsis, cover, smaller slug.

    ``works``: work_id, slug, titulos_alternativos, sinopsis, portada_url. The
    result orders best first when sorted ascending by ``peso``.
    """
    w = works.join(work_weight(sources), "work_id", "left").fillna(0, ["n_fuentes", "suma_caps"])
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", -1).otherwise(0)
    order = F.struct(
        (-F.col("n_fuentes")).alias("f"), (-F.col("suma_caps")).alias("c"), (-F.size("titulos_alternativos")).alias("t"),
        filled("sinopsis").alias("s"), filled("portada_url").alias("p"), F.col("slug"),
    )
    return w.select("work_id", order.alias("peso"))


def merge_plan(pairs: DataFrame, weights: DataFrame, alone: float = fv.MERGE_ALONE) -> DataFrame:
    """dst, src, similitud, modo: 'auto' for merges to do, 'manual' for pairs to look at.

    Pairs of at least ``alone`` are followed through: a connected group keeps
    its heaviest work, and ``similitud`` is the highest that links ``src`` to the
    group. Weaker pairs are reported between the works that remain.
    """
    pairs, weights = cut_lineage(pairs), cut_lineage(weights)  # both are read three times
    strong = pairs.where(F.col("similitud") >= alone)
    groups = cut_lineage(components(strong).join(weights.withColumnRenamed("work_id", "node"), "node"))
    keep = groups.groupBy("root").agg(F.min_by("node", "peso").alias("dst"))
    member = groups.join(keep, "root").select(F.col("node").alias("src"), "dst")
    ends = strong.select(F.col("a").alias("src"), "similitud").union(strong.select("b", "similitud"))
    linked = ends.groupBy("src").agg(F.max("similitud").alias("similitud"))
    auto = member.where("src <> dst").join(linked, "src").select("dst", "src", "similitud", F.lit("auto").alias("modo"))

    weak = pairs.where(F.col("similitud") < alone)
    for side in ("a", "b"):
        live = member.select(F.col("src").alias(side), F.col("dst").alias(f"_{side}"))
        weak = weak.join(live, side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
        weak = weak.join(weights.select(F.col("work_id").alias(side), F.col("peso").alias(f"p_{side}")), side)
    first = F.col("p_a") < F.col("p_b")
    manual = weak.where("a <> b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("dst"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("src"),
        "similitud",
    )
    manual = manual.groupBy("dst", "src").agg(F.max("similitud").alias("similitud"))
    return auto.unionByName(manual.withColumn("modo", F.lit("manual")))


def apply_merge(
    works: DataFrame, weights: DataFrame, plan: DataFrame, sources: DataFrame, chapters: DataFrame, anchors: DataFrame
) -> dict[str, DataFrame]:
    """The catalogue after the automatic merges of a plan.

    Scalar fields come out as one row per surviving work; names and old slugs as
    tall tables, because a survivor may absorb any number of works. Inside a
    group the survivor comes first, then the others by weight.
    """
    moves = cut_lineage(plan.where("modo = 'auto'").select(F.col("src").alias("work_id"), "dst"))
    members = (
        works.join(moves, "work_id", "left")
        .join(weights, "work_id")
        .withColumn("raiz", F.coalesce("dst", "work_id"))
        .withColumn("orden", F.struct((F.col("raiz") != F.col("work_id")).alias("ajena"), F.col("peso")))
    )
    own = lambda c: F.max(F.when(~F.col("orden.ajena"), F.col(c)))
    some = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("orden")))
    has_tags = F.size("categorias") > 0
    merged = members.groupBy("raiz").agg(
        own("slug").alias("slug"),
        own("titulo").alias("titulo"),
        F.when(F.min("tipo") == F.max("tipo"), F.min("tipo")).otherwise("ambos").alias("tipo"),
        F.coalesce(some("sinopsis"), F.lit("")).alias("sinopsis"),
        F.coalesce(some("portada_url"), F.lit("")).alias("portada_url"),
        F.min_by(F.when(has_tags, F.col("categorias")), F.when(has_tags, F.col("orden"))).alias("categorias"),
        F.when(F.bool_or(F.col("estado") == fv.FINISHED), fv.FINISHED).otherwise(own("estado")).alias("estado"),
        F.bool_or("publicada").alias("publicada"),
    ).withColumnRenamed("raiz", "work_id")

    alternatives = F.col("titulos_alternativos")
    listed = F.when(F.col("orden.ajena"), F.concat(F.array("titulo"), alternatives)).otherwise(alternatives)
    names = members.select("raiz", "orden", F.posexplode(listed).alias("pos", "nombre")).where("nombre <> ''")
    names = names.groupBy("raiz", "nombre").agg(F.min(F.struct("orden", "pos")).alias("en"))
    titles = merged.select(F.col("work_id").alias("raiz"), F.col("titulo").alias("nombre"))
    names = names.join(titles, ["raiz", "nombre"], "left_anti")
    order = Window.partitionBy("raiz").orderBy("en", "nombre")  # the names of one group of works
    names = names.select(F.col("raiz").alias("work_id"), "nombre", F.row_number().over(order).alias("puesto"))

    old = members.where("orden.ajena").select(F.col("raiz").alias("work_id"), F.col("slug").alias("viejo"))
    if "slugs_antiguos" in works.columns:
        old = old.union(members.select(F.col("raiz"), F.explode("slugs_antiguos"))).distinct()

    def repoint(table: DataFrame) -> DataFrame:
        return table.join(moves, "work_id", "left").withColumn("work_id", F.coalesce("dst", "work_id")).drop("dst")

    moved = anchors.join(moves, "work_id", "left").withColumn("_from", F.col("work_id")).withColumn(
        "work_id", F.coalesce("dst", "work_id")
    )
    # the survivor's own anchor wins; the reference key (work, chapter) stays unique
    kept = moved.groupBy("work_id", "capitulo_manhwa").agg(
        F.min_by("capitulo_novela", F.struct(F.col("dst").isNotNull(), F.col("_from"))).alias("capitulo_novela")
    )
    return {
        "works": merged, "names": names, "old_slugs": old, "sources": repoint(sources), "chapters": repoint(chapters),
        "anchors": kept,
    }
