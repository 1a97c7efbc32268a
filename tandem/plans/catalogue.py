"""Registered queries: aggregation family and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import gap as gap_ops
from tandem.operators import rollup, votes
from tandem.plans.registry import check_view, query
from tandem.streaming import streams

check_view("o_chapters", "SELECT * FROM f_chapters WHERE aprobado")
check_view(
    "o_gap",
    """SELECT work_id, manhwa, novela, greatest(0, novela - manhwa) AS faltan FROM (
         SELECT work_id, max(numero) FILTER (tipo = 'manhwa') AS manhwa, max(numero) FILTER (tipo = 'novela') AS novela
         FROM o_chapters WHERE numero > 0 GROUP BY work_id) WHERE manhwa > 0 AND novela > 0""",
)
check_view(
    "o_rollup",
    """SELECT work_id, source_id, coalesce(max(numero), 0) AS ultimo, greatest(count(*), coalesce(max(numero), 0)) AS total,
              count(*) = 1 AND coalesce(max(numero), 0) > 1 AS solo_enlace, count(*) > 3000 AS recortada,
              arg_max(tipo, coalesce(numero, -1)) AS tipo, arg_max(idioma, coalesce(numero, -1)) AS idioma,
              arg_max(url, (coalesce(numero, -1), -id)) AS url
       FROM o_chapters GROUP BY work_id, source_id""",
)
check_view(
    "o_listed",
    """SELECT DISTINCT c.work_id, c.numero FROM o_chapters c JOIN o_rollup r USING (work_id, source_id)
       WHERE NOT r.solo_enlace AND c.numero > 0""",
)
check_view(
    "o_activity",
    """SELECT work_id, max(ultimo_cambio) AS cuando,
              array_to_string(list_sort(list_distinct(list(nombre))), ', ') AS fuentes
       FROM f_sources WHERE ultimo_cambio IS NOT NULL GROUP BY work_id""",
)


def gap_top_list(t):
    return gap_ops.gap(t.chapters).orderBy(F.desc("faltan"), "work_id").limit(50)


@query("a1_last_chapter", """SELECT work_id, tipo, coalesce(max(numero) FILTER (numero > 0), 0) AS ultimo
                             FROM o_chapters GROUP BY work_id, tipo""")
def _(t):
    return gap_ops.last_chapter(t.chapters)


@query("a2_gap", "SELECT work_id, manhwa, novela, faltan FROM o_gap")
def _(t):
    return gap_ops.gap(t.chapters)


@query("a3_source_rollup", """
    SELECT r.work_id, r.source_id, s.nombre, r.tipo, r.idioma, r.ultimo, r.total, r.solo_enlace, r.recortada,
           regexp_replace(regexp_extract(r.url, '^https?://([^/?#:]+)', 1), '^www\\.', '') AS dominio
    FROM o_rollup r JOIN f_sources s USING (source_id)""")
def _(t):
    return rollup.source_rollup(t.chapters, t.sources)


@query("a3_listed_chapters", """
    SELECT work_id, source_id, id, coalesce(numero, -1) AS numero, puesto FROM (
      SELECT *, row_number() OVER (PARTITION BY work_id, source_id ORDER BY numero DESC NULLS LAST, id, visto_en) AS puesto
      FROM o_chapters)""")
def _(t):
    return rollup.listed_chapters(t.chapters).select(
        "work_id", "source_id", "id", F.coalesce("numero", F.lit(-1)).alias("numero"), "puesto"
    )


@query("a4_linkout_sources", "SELECT work_id, source_id FROM o_rollup WHERE solo_enlace")
def _(t):
    return rollup.linkout_sources(t.chapters)


@query("a5_formats", """
    SELECT work_id, array_to_string(list_sort(list_distinct(list(tipo))), ',') AS formatos,
           CASE WHEN count(DISTINCT tipo) = 2 THEN 'ambos' WHEN min(tipo) = 'manhwa' THEN 'solo_manhwa'
                ELSE 'solo_novela' END AS adaptacion
    FROM o_chapters GROUP BY work_id""")
def _(t):
    return gap_ops.formats(t.chapters).withColumn("formatos", F.array_join("formatos", ","))


@query("a6_activity", "SELECT work_id, strftime(cuando, '%Y-%m-%d') AS cuando, fuentes FROM o_activity")
def _(t):
    return rollup.activity(t.sources).select(
        "work_id", F.date_format("cuando", "yyyy-MM-dd").alias("cuando"), F.array_join("fuentes", ", ").alias("fuentes")
    )


@query("a7_popularity", "SELECT work_id, count(*) AS caps FROM o_chapters GROUP BY work_id")
def _(t):
    return gap_ops.popularity(t.chapters)


check_view(
    "o_consensus",
    """SELECT work_id, capitulo_manhwa, capitulo_novela, n AS votos FROM (
         SELECT work_id, capitulo_manhwa, capitulo_novela, count(*) AS n,
                row_number() OVER (PARTITION BY work_id, capitulo_manhwa
                                   ORDER BY count(*) DESC, capitulo_novela) AS rn
         FROM f_votes GROUP BY work_id, capitulo_manhwa, capitulo_novela) WHERE rn = 1""",
)
check_view(
    "o_combined",
    """SELECT coalesce(a.work_id, c.work_id) AS work_id, coalesce(a.capitulo_manhwa, c.capitulo_manhwa) AS capitulo_manhwa,
              coalesce(a.capitulo_novela, c.capitulo_novela) AS capitulo_novela, a.work_id IS NOT NULL AS oficial
       FROM o_consensus c FULL JOIN f_anchors a
         ON a.work_id = c.work_id AND a.capitulo_manhwa = c.capitulo_manhwa""",
)


@query("a8_consensus", "SELECT * FROM o_consensus")
def _(t):
    return votes.consensus(t.votes)


_VOTE_CHANGES = """
SELECT event_id AS id, CAST(event_id % 40 AS BIGINT) AS work_id, CAST(floor(abs(value)) AS INT) % 4 + 1 AS capitulo_manhwa, user_id,
       CAST(event_id % 5 AS INT) + 1 AS capitulo_novela, ts AS creada_en, event_type = 'purchase' AS borrado FROM {events}"""
check_view("o_vote_changes", _VOTE_CHANGES.replace("{events}", "events"))


@query("a8_consensus_stream", """
    WITH v AS (SELECT work_id, capitulo_manhwa, user_id, arg_max(capitulo_novela, (creada_en, id)) AS c, arg_max(borrado, (creada_en, id)) AS b
               FROM o_vote_changes GROUP BY 1, 2, 3),
    n AS (SELECT work_id, capitulo_manhwa, c, count(*) AS n FROM v WHERE NOT b GROUP BY 1, 2, 3)
    SELECT work_id, capitulo_manhwa, arg_max(c, (n, -c)) AS capitulo_novela, max(n) AS votos FROM n GROUP BY 1, 2""")
def _(t):
    """Votes arrive in four batches, in no order of time; a purchase stands for a withdrawn vote."""
    folder = streams.run_folder(t.spark)
    changes = t.sql(_VOTE_CHANGES).withColumn("creada_en", F.col("creada_en").cast("timestamp"))
    changes.repartition(4, "id").write.parquet(f"{folder}/changes.parquet")
    arriving = streams.folder_stream(t.spark, f"{folder}/changes.parquet", files_per_batch=1)
    return streams.consensus_stream(arriving, folder).read()


@query("a9_combined_equivalences", "SELECT * FROM o_combined")
def _(t):
    return votes.combined_equivalences(t.votes, t.anchors)


@query("a9_furthest_equivalence", """
    SELECT work_id, max(capitulo_manhwa) AS capitulo_manhwa, arg_max(capitulo_novela, capitulo_manhwa) AS capitulo_novela
    FROM o_combined GROUP BY work_id""")
def _(t):
    return votes.furthest_equivalence(votes.combined_equivalences(t.votes, t.anchors))


@query("a10_work_weight", """SELECT work_id, count(*) AS n_fuentes, CAST(sum(n_caps) AS BIGINT) AS suma_caps
                             FROM f_sources GROUP BY work_id""")
def _(t):
    return rollup.work_weight(t.sources)


check_view(
    "o_cards",
    """SELECT p.work_id, p.manhwa, p.novela, p.tope, coalesce(l.nums, []) AS nums
       FROM (SELECT work_id, coalesce(max(greatest(numero, 0)) FILTER (tipo = 'manhwa' AND numero IS NOT NULL), 0) AS manhwa,
                    coalesce(max(greatest(numero, 0)) FILTER (tipo = 'novela' AND numero IS NOT NULL), 0) AS novela,
                    coalesce(max(numero) FILTER (numero > 0), 0) AS tope
             FROM o_chapters GROUP BY work_id) p
       LEFT JOIN (SELECT work_id, list_reverse_sort(list(numero))[1:6] AS nums FROM o_listed GROUP BY work_id) l
       USING (work_id)""",
)


@query("a15_home_cards", """
    SELECT work_id, manhwa, novela, array_to_string(nums, ',') AS ultimos,
           array_to_string(CASE WHEN len(nums) > 0 THEN nums[1:2]
                                ELSE list_filter([tope, tope - 1], lambda n: n > 0) END, ',') AS tarjeta
    FROM o_cards""")
def _(t):
    cards = rollup.home_cards(t.chapters)
    return cards.withColumn("ultimos", F.array_join(F.col("ultimos").cast("array<string>"), ",")).withColumn(
        "tarjeta", F.array_join(F.col("tarjeta").cast("array<string>"), ",")
    )


@query("t6_upsert_votes", """
    SELECT work_id, capitulo_manhwa, user_id, arg_max(capitulo_novela, (creada_en, id)) AS capitulo_novela,
           strftime(max(creada_en), '%Y-%m-%d %H:%M:%S') AS creada_en
    FROM f_votes GROUP BY work_id, capitulo_manhwa, user_id""")
def _(t):
    return votes.upsert_votes(t.votes).withColumn("creada_en", F.date_format("creada_en", "yyyy-MM-dd HH:mm:ss"))


check_view("o_interpolated", """
    WITH d AS (SELECT DISTINCT work_id, numero FROM o_chapters WHERE numero IS NOT NULL),
    a AS (SELECT work_id, capitulo_manhwa AS x, capitulo_novela AS y,
                 lead(capitulo_manhwa) OVER w AS nx, lead(capitulo_novela) OVER w AS ny,
                 lag(capitulo_manhwa) OVER w AS px, lag(capitulo_novela) OVER w AS py,
                 row_number() OVER w AS rn
          FROM f_anchors WINDOW w AS (PARTITION BY work_id ORDER BY capitulo_manhwa))
    SELECT d.work_id, d.numero, coalesce(
           CASE WHEN d.numero < 1 THEN NULL
                WHEN a.x IS NULL THEN f.y
                WHEN d.numero = a.x THEN a.y
                WHEN a.nx IS NOT NULL
                  THEN CAST(floor(a.y + (d.numero - a.x) / CAST(a.nx - a.x AS DOUBLE) * (a.ny - a.y) + 0.5) AS INT)
                WHEN a.px IS NULL THEN a.y
                ELSE CAST(floor(a.y + (d.numero - a.x) * ((a.y - a.py) / CAST(a.x - a.px AS DOUBLE)) + 0.5) AS INT)
           END, -1) AS en_novela
    FROM d LEFT JOIN a ON a.work_id = d.work_id AND a.x <= d.numero AND (a.nx IS NULL OR a.nx > d.numero)
           LEFT JOIN a f ON f.work_id = d.work_id AND f.rn = 1""")


@query("j15_manhwa_to_novel", "SELECT * FROM o_interpolated")
def _(t):
    return votes.manhwa_to_novel(t.chapters, t.anchors).fillna(-1, ["en_novela"])


@query("j5_attach_source_names", """
    SELECT c.id, c.source_id, coalesce(c.numero, -1) AS numero, s.nombre AS fuente_nombre
    FROM o_chapters c LEFT JOIN f_sources s USING (source_id)""")
def _(t):
    return rollup.attach_source_names(t.chapters, t.sources).select(
        "id", "source_id", F.coalesce("numero", F.lit(-1)).alias("numero"), "fuente_nombre"
    )


@query("j16_series_both", """
    SELECT b.work_id, coalesce(g.manhwa, 0) AS manhwa, coalesce(g.novela, 0) AS novela, coalesce(g.faltan, 0) AS faltan
    FROM (SELECT work_id FROM o_chapters GROUP BY work_id HAVING count(DISTINCT tipo) = 2) b
    LEFT JOIN o_gap g USING (work_id)""")
def _(t):
    return gap_ops.series_both(t.chapters)
