"""Top lists, pages of the catalogue, related works, due sources, libraries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.text import fold_accents, trim_ws
from tandem.operators.distributed import global_position, top_per_group
from tandem.operators.gap import work_counts
from tandem.session import cut_lineage


def spanish_order(c: str = "titulo") -> Column:
    return F.collate(F.col(c), "es")


def top_list(df: DataFrame, order: list[Column], n: int, rank: str = "puesto") -> DataFrame:
    """First ``n`` rows with their rank. The window sees at most ``n`` rows."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def ranking_lists(chapters: DataFrame, works: DataFrame, n: int = 50) -> DataFrame:
    """Popular, gap, caught up, longest novel: four lists of ``n``."""
    # one row per work, written once: four lists would otherwise be four passes over the chapters
    popular = cut_lineage(work_counts(chapters).join(works.select("work_id"), "work_id", "left_semi"))
    lead = F.greatest(F.lit(0), F.col("novela") - F.col("manhwa"))
    gaps = popular.where("manhwa > 0 AND novela > 0").withColumn("faltan", lead)
    by_id = F.col("work_id")

    def listed(name: str, df: DataFrame, value: str, *order: Column) -> DataFrame:
        top = top_list(df, [*order, by_id], n)
        return top.select(F.lit(name).alias("lista"), "puesto", "work_id", F.col(value).cast("bigint").alias("valor"))

    return (
        listed("populares", popular, "caps", F.desc("caps"))
        .union(listed("adelantadas", gaps, "faltan", F.desc("faltan")))
        .union(listed("al-dia", gaps.where("faltan <= 5"), "faltan", F.asc("faltan"), F.desc("manhwa")))
        .union(listed("largas", gaps, "novela", F.desc("novela")))
    )


def catalog_order() -> list[Column]:
    return [F.desc("destacada"), spanish_order(), F.col("work_id")]


def catalog_sort(works: DataFrame) -> DataFrame:
    """Position of every work in the catalogue: featured first, then title in Spanish order."""
    return global_position(works.select("work_id", "titulo", "destacada"), catalog_order(), "puesto")


def paginate(works: DataFrame, per_page: int = fv.WORKS_PER_PAGE) -> DataFrame:
    """Alphabetical pages. Page 1 is the cover page, so numbering starts at 2."""
    placed = global_position(works.select("work_id", "titulo"), [spanish_order(), F.col("work_id")], "puesto")
    return placed.withColumn("pagina", (F.floor((F.col("puesto") - 1) / per_page) + 2).cast("int"))


def page_windows(pages: DataFrame) -> DataFrame:
    """Links shown on each page: first two, the neighbours, last two."""
    last = pages.agg(F.max("pagina")).first()[0]
    p, z = F.col("pagina"), F.lit(last)
    around = F.array(F.lit(1), F.lit(2), p - 1, p, p + 1, z - 1, z)
    shown = F.array_sort(F.array_distinct(F.filter(around, lambda x: (x >= 1) & (x <= z))))
    return pages.select("pagina").distinct().select("pagina", shown.alias("ventana"))


def related_works(works: DataFrame, levels: DataFrame, k: int = fv.RELATED_WORKS) -> DataFrame:
    """``k`` related works for every work: those of tier A first, then by genres shared, then by id; none is adult.

    Works with the same genres are one kind, and of each kind and tier only the first k + 1 works can be chosen by
    anybody. Every combination of genres lists its first k + 1 works of each tier; a kind looks its own combinations
    up. A work that shares the combination S with a kind and is not on the list of S has k + 1 works before it that share as
    many genres, so nothing is lost, and the work grows with the number of kinds and not with its square. Kinds of more
    than ``COMBINED`` genres have too many combinations and are compared genre by genre instead.
    Works that stay short are filled with their neighbours in the circular alphabetical order, tier A first.
    """
    # one row per work, read six times below
    facts = cut_lineage(works.join(levels, "work_id").select(
        "work_id", "titulo", "adulta", "categorias", (F.col("nivel") == "A").alias("a")
    ))
    kinds = facts.withColumn("clase", F.array_sort(F.array_distinct("categorias"))).where(F.size("clase") > 0)
    offered = top_per_group(kinds.where("NOT adulta").select("clase", "a", "work_id"), ["clase", "a"], [F.col("work_id")], k + 1)
    offered = cut_lineage(offered.select(F.col("clase").alias("otra_clase"), F.col("a").alias("otra_a"), F.col("work_id").alias("otra")))
    alike = _alike(kinds.select("clase").distinct(), offered, k)
    order = [F.desc("otra_a"), F.desc("comunes"), F.col("otra")]
    # a work may find itself among the first, so one more is kept
    first = top_per_group(alike, ["clase"], order, k + 1).select("clase", "otra", "otra_a", "comunes")
    best = Window.partitionBy("work_id").orderBy(*order)
    chosen = kinds.select("work_id", "clase").join(first, "clase").where("work_id <> otra")
    chosen = chosen.withColumn("puesto", F.row_number().over(best)).where(F.col("puesto") <= k)
    chosen = cut_lineage(chosen.select("work_id", "otra", "puesto", F.lit("genero").alias("origen")))
    filled = _fill_from_neighbours(facts, chosen, k)
    return chosen.unionByName(filled)


COMBINED = 10  # genres of a kind whose combinations are listed


def _combinations(c: str) -> Column:
    """All combinations of the genres of a sorted list, but the empty one."""
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate(F.col(c), none, lambda found, g: F.concat(found, F.transform(found, lambda s: F.array_append(s, g))))
    return F.filter(every, lambda s: F.size(s) > 0)


def _alike(kinds: DataFrame, offered: DataFrame, k: int) -> DataFrame:
    """clase, otra, otra_a, comunes: works that can be among the first of a kind. ``offered``: otra_clase, otra_a, otra."""
    few, many = F.size("clase") <= COMBINED, F.size("otra_clase") <= COMBINED
    listed = offered.where(many).select("otra_a", "otra", F.explode(_combinations("otra_clase")).alias("juego"))
    listed = top_per_group(listed, ["juego", "otra_a"], [F.col("otra")], k + 1).drop("rank")
    asked = kinds.where(few).select("clase", F.explode(_combinations("clase")).alias("juego"))
    found = asked.join(listed, "juego").groupBy("clase", "otra", "otra_a").agg(F.max(F.size("juego")).alias("comunes"))
    by_genre = lambda df, c: df.withColumn("genero", F.explode(c))
    long_ = [
        by_genre(a, "clase").join(by_genre(b, "otra_clase"), "genero").groupBy("clase", "otra", "otra_a").agg(
            F.count("*").cast("int").alias("comunes"))
        for a, b in ((kinds.where(~few), offered), (kinds.where(few), offered.where(~many)))
    ]
    return found.unionByName(long_[0]).unionByName(long_[1])


def _fill_from_neighbours(facts: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    fit, fit_a = ~F.col("adulta"), ~F.col("adulta") & F.col("a")
    ring = global_position(
        facts.select("work_id", "titulo", "adulta", "a"),
        [F.col("titulo"), F.col("work_id")],
        "pos",
        running={"n_fit": fit.cast("int"), "n_fit_a": fit_a.cast("int")},
    ).drop("titulo", "pos")
    have = chosen.groupBy("work_id").agg(F.count("*").alias("tiene"))
    short = ring.join(have, "work_id", "left").fillna(0, ["tiene"]).where(F.col("tiene") < k)
    totals = ring.agg(F.max("n_fit").alias("f"), F.max("n_fit_a").alias("a")).first()
    reach = 2 * k  # k - 1 already chosen, the work itself and k more

    def neighbours(counter: str, condition: Column, total: int, turn: int) -> DataFrame:
        steps = F.sequence(F.lit(1), F.lit(min(reach, total)))
        asked = short.select("work_id", "tiene", counter, F.explode(steps).alias("paso"))
        place = F.pmod(F.col(counter) + F.col("paso") - 1, F.lit(total)) + 1
        members = ring.where(condition).select(F.col("work_id").alias("otra"), F.col(counter).alias("lugar"))
        return asked.withColumn("lugar", place).join(members, "lugar").select(
            "work_id", "tiene", "otra", F.struct(F.lit(turn).alias("vuelta"), "paso").alias("orden")
        )

    passes = []
    if totals["a"]:
        passes.append(neighbours("n_fit_a", fit_a, totals["a"], 1))
    if totals["f"]:
        passes.append(neighbours("n_fit", fit, totals["f"], 2))
    if not passes:
        return chosen.limit(0)
    found = passes[0] if len(passes) == 1 else passes[0].unionByName(passes[1])
    fresh = (
        found.where("work_id <> otra")
        .groupBy("work_id", "tiene", "otra")
        .agg(F.min("orden").alias("orden"))
        .join(chosen.select("work_id", "otra"), ["work_id", "otra"], "left_anti")
    )
    nth = Window.partitionBy("work_id").orderBy("orden")  # at most 4k rows per work
    return (
        fresh.withColumn("n", F.row_number().over(nth))
        .where(F.col("n") + F.col("tiene") <= k)
        .select("work_id", "otra", (F.col("n") + F.col("tiene")).cast("int").alias("puesto"), F.lit("vecina").alias("origen"))
    )


def news(activity: DataFrame, works: DataFrame, listed: DataFrame, n: int = 240) -> DataFrame:
    """Most recent published works with their day and last listed chapter."""
    recent = activity.join(works.select("work_id", "titulo"), "work_id").orderBy(F.desc("cuando"), "work_id").limit(n)
    last = listed.groupBy("work_id").agg(F.max("numero").alias("ultimo_cap"))
    return recent.join(last, "work_id", "left").withColumn("dia", F.to_date("cuando"))


def new_releases(works: DataFrame, chapters: DataFrame, n: int = 12) -> DataFrame:
    both = work_counts(chapters).where("tiene_manhwa AND tiene_novela").select("work_id")
    dated = works.where("creada_en IS NOT NULL").join(both, "work_id", "left_semi")
    return top_list(dated.select("work_id", "creada_en"), [F.desc("creada_en"), F.col("work_id")], n)


def carousel(works: DataFrame, chapters: DataFrame, furthest: DataFrame, n: int = 10) -> DataFrame:
    """Most indexed works of both formats (of any format when none has both), with the furthest anchor."""
    counted = works.select("work_id").join(work_counts(chapters), "work_id")
    has_both = F.col("tiene_manhwa") & F.col("tiene_novela")
    base = counted.where(has_both) if counted.where(has_both).limit(1).count() else counted
    best = top_list(base.select("work_id", "caps"), [F.desc("caps"), F.col("work_id")], n)
    return best.join(furthest, "work_id", "left")


def catalogue_grid(works: DataFrame, chapters: DataFrame, covered: DataFrame, n: int = 120) -> DataFrame:
    """Most indexed works of both formats that have a cover."""
    both = work_counts(chapters).where("tiene_manhwa AND tiene_novela").select("work_id", "caps")
    ranked = works.select("work_id").join(covered, "work_id", "left_semi").join(both, "work_id")
    return top_list(ranked, [F.desc("caps"), F.col("work_id")], n)


def latest_grid(
    activity: DataFrame, works: DataFrame, cards: DataFrame, covered: DataFrame, n: int = 72
) -> DataFrame:
    """Works that just grew, with a cover and at least one chapter to show."""
    shown = (
        activity.select("work_id", "cuando")
        .join(works.select("work_id"), "work_id", "left_semi")
        .join(covered, "work_id", "left_semi")
        .join(cards.where(F.size("tarjeta") > 0).select("work_id", "tarjeta"), "work_id")
    )
    return top_list(shown, [F.desc("cuando"), F.col("work_id")], n)


def title_index(works: DataFrame) -> DataFrame:
    """One row per name of a work, filed under A-Z or #."""
    names = F.array_distinct(F.concat(F.array("titulo"), F.col("titulos_alternativos")))
    rows = works.select("work_id", F.explode(names).alias("nombre")).where("nombre <> ''")
    first = F.upper(F.substring(trim_ws(fold_accents("nombre")), 1, 1))
    return rows.withColumn("inicial", F.when(first.rlike("^[A-Z]$"), first).otherwise("#"))


def due_sources(
    sources: DataFrame, now: datetime, withdrawn: DataFrame | None = None, limit: int | None = None, targeted: bool = False
) -> DataFrame:
    """Sources whose interval since the last visit has passed: of all, or of the ``limit`` least recently visited."""
    queue = sources.where("activa")
    if limit is not None:
        queue = queue.orderBy(F.col("ultimo_scrape").asc_nulls_first(), "source_id").limit(limit)
    if withdrawn is not None:
        queue = queue.join(withdrawn.select("work_id"), "work_id", "left_anti")
    at = F.lit(now).cast("timestamp").cast("double")
    visited, changed = (F.col(c).cast("timestamp").cast("double") for c in ("ultimo_scrape", "ultimo_cambio"))
    day = 86_400
    age = at - changed
    interval = F.when(age < 7 * day, day).when(age < 30 * day, 3 * day).otherwise(7 * day)
    due = F.col("ultimo_scrape").isNull() | F.lit(targeted) | (at - visited >= interval - 2 * 3600)
    return queue.where(due)


def library(read: DataFrame, totals: DataFrame) -> DataFrame:
    """Reading list: works a reader has started or marked, with progress and next chapter.

    ``read``: user_id, work_id, leidos (chapter array), favorito. ``totals``: work_id, total.
    """
    n, total, last = F.size("leidos"), F.col("total"), F.array_max("leidos")
    return (
        read.where((n > 0) | F.col("favorito"))
        .join(totals.select("work_id", "total"), "work_id")
        .select(
            "user_id",
            "work_id",
            n.alias("n_leidos"),
            F.floor(n * 100 / total + 0.5).cast("int").alias("pct"),
            last.alias("ultimo"),
            F.when(last.isNull(), F.lit(1)).otherwise(F.least(last + 1, total)).cast("int").alias("siguiente"),
        )
    )


def suggest_rank(suggestions: DataFrame, n: int = 24) -> DataFrame:
    """Distinct (language, query) per title, those that ask for the novel first.

    ``suggestions``: titulo, idioma, consulta, orden.
    """
    once = suggestions.groupBy("titulo", "idioma", "consulta").agg(F.min("orden").alias("orden"))
    wanted = F.lower("consulta").contains("novel")
    order = [wanted.desc(), F.col("orden"), F.col("idioma"), F.col("consulta")]
    return top_per_group(once, ["titulo"], order, n, name="puesto")
