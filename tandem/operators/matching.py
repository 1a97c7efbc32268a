"""The same work under different names: exact name keys, similar titles, the resolving cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.text import content_words, name_keys, slugify
from tandem.operators.catalog_text import work_names
from tandem.operators.distributed import components, spread
from tandem.session import cut_lineage


def build_name_index(works: DataFrame) -> DataFrame:
    """Name key -> the first work that claimed it (lowest work_id)."""
    keys = work_names(works).select("work_id", F.explode(name_keys("nombre")).alias("clave"))
    usable = keys.where(F.length("clave") >= fv.MIN_INDEX_KEY)
    return usable.groupBy("clave").agg(F.min("work_id").alias("work_id"))


def match_by_name(series: DataFrame, index: DataFrame, names: str = "nombres") -> DataFrame:
    """serie_id -> work_id of the first hit, names in order, keys in order."""
    named = series.select("serie_id", F.posexplode(names).alias("np", "nombre"))
    keyed = named.select("serie_id", "np", F.posexplode(name_keys("nombre")).alias("kp", "clave"))
    hits = keyed.join(index, "clave")
    return hits.groupBy("serie_id").agg(F.min_by("work_id", F.struct("np", "kp")).alias("work_id"))


# ---- similar titles --------------------------------------------------------------------

def title_sets(names: DataFrame, owner: str, min_words: int = fv.MIN_CONTENT_WORDS) -> DataFrame:
    """Distinct word sets of titles with the lowest and highest owner that has them.

    Copies of a title become one row here, so however many owners share a title,
    similarity is worked out once.
    """
    words = names.select(F.col(owner).alias("_o"), F.array_sort(content_words("nombre")).alias("words"))
    return words.where(F.size("words") >= min_words).groupBy("words").agg(
        F.min("_o").alias("low"), F.max("_o").alias("high"), F.count("*").alias("names")
    )


def word_postings(sets: DataFrame) -> DataFrame:
    """How many titles hold each word (copies counted)."""
    return sets.select(F.explode("words").alias("word"), "names").groupBy("word").agg(F.sum("names").alias("df"))


def _rarest_first(sets: DataFrame, postings: DataFrame) -> DataFrame:
    tagged = sets.select("words", F.explode("words").alias("word")).join(postings, "word", "left")
    rare = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")))  # the words of one title
    return tagged.groupBy("words").agg(rare.alias("by_df"))


def _capped_keys(sets: DataFrame, postings: DataFrame, threshold: float, max_postings: int) -> DataFrame:
    """Single words as join keys, only those in at most ``max_postings`` titles.

    Two sets with Jaccard >= t share at least ceil(t * size) words, so their
    rarest common word is among the first size - ceil(t * size) + 1 of both.
    """
    size = F.size("words")
    length = (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int")
    prefix = F.filter(F.slice("by_df", 1, length), lambda p: p["df"] <= max_postings)
    return _rarest_first(sets, postings).select("words", F.explode(prefix).alias("p")).select("words", F.col("p.word").alias("key"))


# words in a key, by the size of the larger set: beyond 12 and 40 words keys of four and of two words would be too many
_KEY_WORDS = ((12, 4), (40, 2))


def _exact_keys(sets: DataFrame, postings: DataFrame, threshold: float) -> DataFrame:
    """Join keys for all pairs: k words together, for each size the partner may have.

    Sets of n and s words with Jaccard >= t share at least
    o = ceil(t / (1 + t) * (n + s)) words, so among the first n - o + k in
    rarest-first order (and s - o + k of the other) they share k of them. Keys
    of four words stay selective when every single word is common: titles that
    differ in one word meet only if their sizes allow the similarity. k depends
    on the larger size only, so both sets use the same one; long sets, whose
    rarest words tell enough, use one word, and their number of keys grows
    with their size, not with a power of it.
    """
    n = F.size("by_df")

    def subsets(prefix: Column, k: Column) -> Column:
        def grow(found: Column, word: Column) -> Column:
            longer = F.transform(F.filter(found, lambda f: F.size(f) < k), lambda f: F.array_append(f, word))
            return F.concat(found, longer)

        none = F.array(F.array().cast("array<string>"))
        return F.filter(F.aggregate(prefix, none, grow), lambda f: F.size(f) == k)

    def keys_for(s: Column) -> Column:
        common = F.ceil((n + s) * F.lit(threshold / (1 + threshold)) - 1e-9).cast("int")
        larger = F.greatest(n, s)
        words = F.lit(1)
        for most, k in reversed(_KEY_WORDS):
            words = F.when(larger <= most, k).otherwise(words)
        k = F.least(common, words)
        prefix = F.transform(F.slice("by_df", 1, n - common + k), lambda p: p["word"])
        sizes = F.concat_ws("-", F.least(n, s).cast("string"), larger.cast("string"))
        label = F.when(words == _KEY_WORDS[0][1], sizes).otherwise(words.cast("string"))
        return F.transform(subsets(prefix, k), lambda f: F.concat_ws(" ", label, F.concat_ws(" ", f)))

    low, high = F.ceil(n * F.lit(threshold) - 1e-9).cast("int"), F.floor(n / F.lit(threshold) + 1e-9).cast("int")
    sizes = F.sequence(F.greatest(low, F.lit(1)), high)
    return _rarest_first(sets, postings).select("words", F.explode(F.array_distinct(F.flatten(F.transform(sizes, keys_for)))).alias("key"))


_HOT_KEY = 1000  # sets under a key that one task compares with; a key with more is dealt over several tasks


def _meet(lk: DataFrame, rk: DataFrame) -> DataFrame:
    """Join on ``key``; a key with many sets on the right is salted: each left row meets every slice of it."""
    sizes = rk.groupBy("key").agg(F.ceil(F.count("*") / _HOT_KEY).cast("int").alias("slices")).where("slices > 1")
    sizes = cut_lineage(sizes)
    salted = rk.join(sizes, "key", "left").withColumn(
        "salt", F.pmod(F.xxhash64("words_r"), F.coalesce("slices", F.lit(1))).cast("int")
    ).drop("slices")
    spread = lk.join(sizes, "key", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    ).drop("slices")
    return spread.join(salted, ["key", "salt"])


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common).cast("double")


def similar_sets(
    left: DataFrame, right: DataFrame, threshold: float, postings: DataFrame, max_postings: int | None = None
) -> DataFrame:
    """Pairs of word sets with Jaccard >= threshold: words_l, words_r, similitud.

    With ``max_postings`` only words in at most that many titles may bring a
    pair together, and each key group is that small.
    """
    if max_postings is None:
        lk, rk = (_exact_keys(x, postings, threshold) for x in (left, right))
    else:
        lk, rk = (_capped_keys(x, postings, threshold, max_postings) for x in (left, right))
    lk, rk = lk.withColumnRenamed("words", "words_l"), rk.withColumnRenamed("words", "words_r")
    size_l, size_r = F.size("words_l"), F.size("words_r")
    close = (size_l >= size_r * threshold - 1e-9) & (size_r >= size_l * threshold - 1e-9)
    pairs = _meet(lk, rk).where(close).select("words_l", "words_r").distinct()
    return pairs.withColumn("similitud", jaccard(F.col("words_l"), F.col("words_r"))).where(
        F.col("similitud") >= threshold
    )


def title_catalog(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word sets of all names of the works and how many names hold each word, written once for all who compare with them."""
    catalog = cut_lineage(title_sets(work_names(works), "work_id"))
    return catalog, cut_lineage(word_postings(catalog))


def match_by_similarity(
    series: DataFrame, works: DataFrame, threshold: float, names: str = "nombres",
    compared: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """serie_id -> work_id of the most similar title; none when two works tie at the top. ``compared``: their ``title_catalog``."""
    named = spread(series.select("serie_id", F.explode(names).alias("nombre")))
    own = named.select("serie_id", F.array_sort(content_words("nombre")).alias("words_l"))
    own = cut_lineage(own.where(F.size("words_l") >= fv.MIN_CONTENT_WORDS))
    catalog, postings = compared or title_catalog(spread(works))
    found = similar_sets(own.select(F.col("words_l").alias("words")).distinct(), catalog.select("words"), threshold, postings)
    with_owner = found.join(catalog.select(F.col("words").alias("words_r"), "low", "high"), "words_r")
    per_set = with_owner.groupBy("words_l", "similitud").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hits = own.join(per_set, "words_l").groupBy("serie_id", "similitud").agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    best = hits.groupBy("serie_id").agg(F.max(F.struct("similitud", "low", "high")).alias("b"))
    return best.where("b.low = b.high").select(
        "serie_id", F.col("b.low").alias("work_id"), F.col("b.similitud").alias("similitud")
    )


# ---- the cascade -----------------------------------------------------------------------

def cluster_new(series: DataFrame) -> DataFrame:
    """Groups unmatched series that share a name key, directly or through others: serie_id, raiz.

    Each key links its series to the lowest one, so a key with n series gives
    n - 1 edges.
    """
    names = series.select("serie_id", F.explode("nombres").alias("nombre"))
    keys = names.select("serie_id", F.explode(name_keys("nombre")).alias("clave")).where(
        F.length("clave") >= fv.MIN_INDEX_KEY
    ).distinct()
    lowest = keys.groupBy("clave").agg(F.min("serie_id").alias("raiz"))
    edges = keys.join(lowest, "clave").where("serie_id <> raiz").select(F.col("serie_id").alias("a"), F.col("raiz").alias("b"))
    return components(edges).select(F.col("node").alias("serie_id"), F.col("root").alias("raiz"))


def resolve_series(
    series: DataFrame, works: DataFrame, bound: DataFrame, withdrawn: DataFrame, similar: bool = False,
    cluster: bool = True,
) -> DataFrame:
    """Slug of every listed series and how it was found.

    ``series``: serie_id, sitio_id, url, titulo, titulo_es, slug_base, nombres, solo_match.
    ``bound``: sitio_id, url, work_id of earlier runs. Order of evidence: bound
    URL, exact name, exact translated name, similar translated title (0.8),
    similar title (0.9). The rest become new works; series that share a name key
    become one work named by the lowest serie_id. Per site a slug is kept once.
    """
    series, names = spread(series), spread(works)
    index = cut_lineage(build_name_index(names))
    ids = works.select("work_id", "slug")
    by_url = bound.select("sitio_id", "url", F.col("work_id").alias("w_url"))
    by_name = match_by_name(series, index).select("serie_id", F.col("work_id").alias("w_name"))
    translated = series.where("titulo_es IS NOT NULL").withColumn("_es", F.array("titulo_es"))
    by_es = match_by_name(translated, index, "_es").select("serie_id", F.col("work_id").alias("w_es"))
    found = (
        series.join(by_url, ["sitio_id", "url"], "left").join(by_name, "serie_id", "left").join(by_es, "serie_id", "left")
    )
    steps = [("url", "w_url"), ("nombre", "w_name"), ("traducido", "w_es")]
    if similar:
        compared = title_catalog(names)
        sim_es = match_by_similarity(translated, works, fv.SIMILAR_ENOUGH, "_es", compared)
        sim = match_by_similarity(series, works, fv.SIMILAR_ORIGINAL, compared=compared)
        found = found.join(sim_es.select("serie_id", F.col("work_id").alias("w_sim_es")), "serie_id", "left")
        found = found.join(sim.select("serie_id", F.col("work_id").alias("w_sim")), "serie_id", "left")
        steps += [("parecido_es", "w_sim_es"), ("parecido", "w_sim")]
    found = found.withColumn("work_id", F.coalesce(*[F.col(c) for _, c in steps])).withColumn(
        "via", F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(v)) for v, c in steps])
    )
    found = found.where("work_id IS NOT NULL OR NOT solo_match").join(ids, "work_id", "left")
    found = cut_lineage(found.withColumn("_own", slugify(F.coalesce("slug_base", "titulo"))))
    if cluster:
        fresh = found.where("work_id IS NULL")
        groups = cluster_new(fresh).join(
            fresh.select(F.col("serie_id").alias("raiz"), F.col("_own").alias("_root_slug")), "raiz"
        ).select("serie_id", "_root_slug")
        found = found.join(groups, "serie_id", "left")
        own = F.coalesce("_root_slug", "_own")
    else:
        own = F.col("_own")
    named = found.withColumn("slug", F.coalesce("slug", own)).where("slug <> ''")
    kept = named.join(withdrawn.select("slug").distinct(), "slug", "left_anti")
    first = kept.groupBy("sitio_id", "slug").agg(F.min("serie_id").alias("serie_id"))
    return kept.join(first, ["sitio_id", "slug", "serie_id"], "left_semi").select(
        "serie_id", "sitio_id", "slug", F.coalesce("via", F.lit("nueva")).alias("via")
    )


def genre_of_series(works: DataFrame, series: DataFrame) -> DataFrame:
    """Works whose genres grow by what their sites report. ``series``: work_id, sitio_id, categorias (one row each)."""
    from tandem.functions import genres

    # one label list per work: labels are first reduced to distinct ones
    labels = series.select("work_id", F.posexplode("categorias").alias("pos", "label"), "sitio_id")
    keyed = labels.where(F.trim("label") != "").withColumn("key", genres.genre_key(F.col("label")))
    once = keyed.groupBy("work_id", "key").agg(F.min_by("label", F.struct("sitio_id", "pos")).alias("label"),
                                               F.min(F.struct("sitio_id", "pos")).alias("at"))
    extra = once.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("s")).select(
        "work_id", F.transform("s", lambda x: x["label"]).alias("_extra")
    )
    merged = works.select("work_id", "categorias").join(extra, "work_id").withColumn(
        "unidas", genres.merge_genres([F.col("categorias"), F.col("_extra")])
    )
    return merged.where(F.size("unidas") != F.size("categorias")).select("work_id", F.col("unidas").alias("categorias"))
