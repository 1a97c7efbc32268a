"""Data of the work, chapter and search pages, built as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions import prose
from tandem.functions.text import normalize_name
from tandem.operators.distributed import shuffled, small_side, spread, top_per_group
from tandem.operators.gap import work_counts
from tandem.operators.ranking import spanish_order, top_list
from tandem.operators.rollup import source_facts, source_rollup
from tandem.operators.votes import manhwa_to_novel
from tandem.session import cut_lineage


def search_titles(works: DataFrame, q: str, n: int = 8) -> DataFrame:
    """Site search: names that start with the text first, then names that contain it."""
    haystack = normalize_name(F.concat_ws(" ", F.array("titulo"), F.col("titulos_alternativos")))
    wanted = normalize_name(F.lit(q))
    hits = works.withColumn("_at", F.instr(haystack, wanted)).where("_at > 0")
    order = [(F.col("_at") == 1).desc(), F.desc("destacada"), spanish_order(), F.col("work_id")]
    return top_list(hits, order, n).select("work_id", "titulo", "puesto")


def _grams(c: Column, size: Column | int) -> Column:
    """Different runs of ``size`` signs of a text; none of a shorter one."""
    starts = F.sequence(F.lit(1), F.length(c) - size + 1)
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(c, i, size)))).otherwise(F.array().cast("array<string>"))


def search_titles_of(works: DataFrame, questions: DataFrame, n: int = 8) -> DataFrame:
    """``search_titles`` for many questions at once: q, work_id, titulo, puesto. ``questions``: q.

    Names are listed under their runs of three signs (one or two for shorter questions). A question is looked up by its
    rarest run only, and the names found are compared in full, so no question reads all names. A question without
    letters or digits fits all names, as there.
    """
    haystack = normalize_name(F.concat_ws(" ", F.array("titulo"), F.col("titulos_alternativos")))
    names = cut_lineage(works.select("work_id", "titulo", "destacada", haystack.alias("_names")))
    asked = questions.select("q").distinct().withColumn("_wanted", normalize_name("q"))
    texts = asked.select("_wanted").distinct()
    size = F.least(F.length("_wanted"), F.lit(3))
    wanted = cut_lineage(texts.where("_wanted <> ''").select("_wanted", F.explode(_grams(F.col("_wanted"), size)).alias("_gram")))
    sizes = [r[0] for r in wanted.select(F.length("_gram")).distinct().collect()]  # of 1, 2 and 3
    every = F.concat(*[_grams(F.col("_names"), k) for k in sizes]) if sizes else F.array().cast("array<string>")
    listed = names.select("work_id", F.explode(every).alias("_gram")).join(small_side(wanted.select("_gram").distinct()), "_gram")
    listed = cut_lineage(listed)
    counted = wanted.join(shuffled(listed.groupBy("_gram").agg(F.count("*").alias("_n"))), "_gram", "left")
    rarest = counted.groupBy("_wanted").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("r"))
    sought = cut_lineage(rarest.select("_wanted", F.col("r.g").alias("_gram")))
    # the lists hold a row per name and run and stay where they are while the questions are few
    likely = shuffled(listed).join(small_side(sought), "_gram").join(shuffled(names), "work_id")
    hits = likely.withColumn("_at", F.expr("instr(_names, _wanted)")).where("_at > 0")
    order = [(F.col("_at") == 1).desc(), F.desc("destacada"), spanish_order(), F.col("work_id")]
    first = top_per_group(hits.select("_wanted", "work_id", "titulo", "destacada", "_at"), ["_wanted"], order, n, name="puesto")
    anything = top_list(names.withColumn("_at", F.lit(1)), order, n).withColumn("_wanted", F.lit(""))
    found = first.select("_wanted", "work_id", "titulo", "puesto").unionByName(anything.select("_wanted", "work_id", "titulo", "puesto"))
    return shuffled(asked).join(found, "_wanted").select("q", "work_id", "titulo", "puesto")


def search_admin(works: DataFrame, q: str, n: int = 8) -> DataFrame:
    return works.where(F.col("titulo").ilike(f"%{q}%")).orderBy("titulo", "work_id").limit(n).select("work_id", "titulo")


def chapter_pages(chapters: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per chapter page that exists: neighbours, number of sources, novel chapter.

    Numbers of link-out sources do not count, except for the page of chapter 1.
    Chapters are reduced to distinct (work, number) before the window, so a
    work adds at most one row per chapter number.
    """
    link = source_facts(chapters).select("work_id", "source_id", "solo_enlace")
    numbered = chapters.where("numero IS NOT NULL").join(link, ["work_id", "source_id"])
    per_number = numbered.groupBy("work_id", "numero").agg(
        F.count_if(~F.col("solo_enlace")).alias("reales"), F.count("*").alias("todas")
    )
    real = F.when(F.col("reales") > 0, F.col("numero"))
    # both frames only grow, so each row is added once
    before = Window.partitionBy("work_id").orderBy("numero").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("work_id").orderBy(F.desc("numero")).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("numero") == 1
    placed = per_number.withColumns(
        {
            "anterior": F.when(first, F.max("numero").over(before)).otherwise(F.max(real).over(before)),
            "siguiente": F.when(first, F.min("numero").over(after)).otherwise(F.min(real).over(after)),
            "filas": F.when(first, F.col("todas")).otherwise(F.col("reales")),
        }
    )
    pages = placed.where(f"numero BETWEEN 1 AND {fv.MAX_CHAPTER_NUMBER} AND filas > 0")
    return pages.select("work_id", "numero", "filas", "anterior", "siguiente").join(
        manhwa_to_novel(chapters, anchors), ["work_id", "numero"], "left"
    )


def fill(template: str, **values: Column) -> Column:
    """A text with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def _questions(pairs: list[tuple[Column, Column, Column]]) -> Column:
    """JSON list of the (question, answer) pairs whose condition holds."""
    rows = [F.when(c, F.struct(q.alias("pregunta"), a.alias("respuesta"))) for c, q, a in pairs]
    return F.to_json(F.filter(F.array(*rows), lambda x: x.isNotNull()))


def page_meta(works: DataFrame, chapters: DataFrame, sources: DataFrame, lang: str = "es") -> DataFrame:
    """Title, description, series type, introduction and questions of each work page.

    ``works``: work_id, titulo, titulos_alternativos, tipo, estado.
    """
    tx = fv.PAGE_TEXTS[lang if lang == "es" else "en"]
    rollup = cut_lineage(source_rollup(chapters, sources).select("work_id", "nombre", "tipo", "ultimo", "total"))
    per_work = rollup.groupBy("work_id").agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("tipo") == "manhwa", F.col("ultimo"))).alias("um"),
        F.max(F.when(F.col("tipo") == "novela", F.col("ultimo"))).alias("un"),
    )
    by_name = rollup.where("nombre <> ''").groupBy("work_id", "nombre").agg(F.max("total").alias("total"))
    n_names = by_name.groupBy("work_id").agg(F.count("*").alias("n_nombres"))
    best = top_per_group(by_name, ["work_id"], [F.desc("total"), F.col("nombre")], 5)
    names = best.groupBy("work_id").agg(F.sort_array(F.collect_list(F.struct("rank", "nombre"))).alias("s")).select(
        "work_id", F.array_join(F.transform("s", lambda x: x["nombre"]), ", ").alias("nombres")
    )
    w = (
        spread(works).withColumn("_alt", prose.second_name(F.col("titulo"), F.col("titulos_alternativos"), lang))
        .join(per_work, "work_id", "left")
        .join(n_names, "work_id", "left")
        .join(names, "work_id", "left")
        .join(work_counts(chapters).drop("caps"), "work_id", "left")
        .fillna(0, ["n", "um", "un", "n_nombres", "manhwa", "novela"])
        .fillna("", ["nombres"])
        .fillna(False, ["tiene_manhwa", "tiene_novela"])
    )
    t, alt, empty = F.col("titulo"), F.when(F.col("_alt") != F.col("titulo"), F.col("_alt")), F.lit("")
    text = {c: F.col(c).cast("string") for c in ("um", "un", "n", "n_nombres")}
    both = F.col("tiene_manhwa") & F.col("tiene_novela")
    has_gap = (F.col("manhwa") > 0) & (F.col("novela") > 0)
    ahead = has_gap & (F.col("novela") > F.col("manhwa"))
    numbers = {"m": F.col("manhwa").cast("string"), "n": F.col("novela").cast("string"),
               "lead": (F.col("novela") - F.col("manhwa")).cast("string")}

    def counted(n: str) -> Column:
        return F.concat(text[n], F.lit(" "), F.when(F.col(n) == 1, tx["one"]).otherwise(tx["many"]))

    suffix = F.concat_ws(
        " · ", F.when(F.col("um") > 0, fill(tx["caps_manhwa"], um=text["um"])),
        F.when(F.col("un") > 0, fill(tx["caps_novela"], un=text["un"])),
    )
    with_suffix = lambda a: F.when(suffix == "", a).otherwise(F.concat(a, F.lit(" — "), suffix))
    full = with_suffix(F.concat_ws(" / ", t, alt))
    single = F.when(F.col("tiene_novela"), "novela").when(F.col("tiene_manhwa"), "manhwa")
    shown = F.when(both, tx["both"]).when(F.col("tiene_novela"), tx["novela"]).otherwise(F.coalesce(single, empty))
    kind = F.when(both, tx["both"]).otherwise(F.coalesce(single, F.col("tipo")))
    other = F.when(alt.isNotNull(), F.concat(F.lit(" ("), alt, F.lit(")"))).otherwise(empty)
    intro_ahead = F.when(ahead, fill(tx["intro_ahead"], **numbers)).otherwise(empty)
    count_ahead = F.when(ahead, fill(tx["count_ahead"], **numbers)).otherwise(empty)
    questions = _questions([
        (F.col("n_nombres") > 0, fill(tx["q_where"], t=t), fill(tx["a_where"], s=counted("n_nombres"), names=F.col("nombres"))),
        (has_gap, fill(tx["q_count"], t=t), fill(tx["a_count"], ahead=count_ahead, **numbers)),
        (has_gap, fill(tx["q_spoil"], t=t), F.lit(tx["a_spoil"])),
        (F.col("estado") != "", fill(tx["q_done"], t=t),
         F.when(F.col("estado") == fv.FINISHED, fill(tx["a_done"], t=t)).otherwise(fill(tx["a_open"], t=t))),
    ])
    return w.select(
        "work_id",
        F.when(F.length(full) <= 65, full).otherwise(with_suffix(t)).alias("titulo_seo"),
        F.when(ahead, fill(tx["gap"], **numbers)).otherwise(fill(tx["about"], t=t, fmt=shown, s=counted("n"))).alias("descripcion"),
        F.when(both, "CreativeWorkSeries").when(F.col("tiene_novela"), "BookSeries").otherwise("ComicSeries").alias("tipo_serie"),
        F.concat_ws(
            " ", fill(tx["intro"], t=t, other=other, kind=kind), F.when(F.col("n") > 0, fill(tx["intro_sources"], s=counted("n"))),
            F.when(has_gap, fill(tx["intro_gap"], ahead=intro_ahead, **numbers)),
        ).alias("intro"),
        questions.alias("preguntas"),
    )


def equivalence_meta(works: DataFrame, gaps: DataFrame, lang: str = "es") -> DataFrame:
    """Title, heading, answer and questions of the equivalence page of every work with a gap."""
    tx = fv.PAGE_TEXTS[lang if lang == "es" else "en"]
    w = works.select("work_id", "titulo").join(gaps, "work_id")
    values = {"t": F.col("titulo"), "m": F.col("manhwa").cast("string"), "n": F.col("novela").cast("string"),
              "lead": F.col("faltan").cast("string")}
    answer = F.when(F.col("faltan") > 0, fill(tx["eq_ahead"], **values)).otherwise(fill(tx["eq_level"], **values))
    always = F.lit(True)
    return w.select(
        "work_id", fill(tx["eq_title"], **values).alias("titulo_seo"), fill(tx["eq_heading"], **values).alias("encabezado"),
        answer.alias("respuesta"),
        _questions([
            (always, fill(tx["eq_q_next"], **values), answer),
            (always, fill(tx["eq_q_count"], **values), fill(tx["eq_a_count"], **values)),
            (always, fill(tx["eq_q_spoil"], **values), F.lit(tx["eq_a_spoil"])),
        ]).alias("preguntas"),
    )
