"""Registered queries: name matching, similar titles, duplicates and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.operators import matching, merging
from tandem.operators.catalog_text import joined, work_names
from tandem.operators.distributed import grow_components, put_in_place
from tandem.plans.rankings import published
from tandem.plans.registry import check_view, query
from tandem.plans.texts import sql_list
from tandem.session import cut_lineage

check_view("o_index", "SELECT clave, min(work_id) AS work_id FROM (SELECT work_id, unnest(claves) AS clave FROM o_keys) WHERE length(clave) >= 3 GROUP BY clave")

_SERIES = """
SELECT p_partkey AS serie_id, p_size % 20 AS sitio_id, concat('https://lista.example.com/s/', CAST(p_partkey AS VARCHAR(10))) AS url,
       CASE p_partkey % 6 WHEN 0 THEN concat('¡', upper(p_name), ' ', CAST(p_partkey % 97 AS VARCHAR(10)), '!')
            WHEN 1 THEN concat('Nueva obra larga número ', CAST(CAST(floor(p_partkey / 12) AS INT) AS VARCHAR(10)))
            WHEN 2 THEN concat('Of the ', lower(p_type), ' ', CAST(p_size AS VARCHAR(10)), ' the ', p_name)
            WHEN 3 THEN concat('Título extraño ', CAST(p_partkey AS VARCHAR(10)))
            WHEN 4 THEN concat('Enlace conocido ', CAST(p_partkey AS VARCHAR(10)))
            ELSE concat('The ', p_name, ' of the ', lower(p_type), ' ', CAST(p_size AS VARCHAR(10)), ' resurrected') END AS titulo,
       CASE WHEN p_partkey % 6 = 3 THEN concat('The ', p_name, ' of the ', lower(p_type), ' ', CAST(p_size AS VARCHAR(10)))
            WHEN p_partkey % 12 = 5 THEN concat(p_name, ' ', lower(p_type), 's ', CAST(p_size AS VARCHAR(10))) ELSE NULL END AS titulo_es,
       p_size % 20 = 7 AS solo_match
FROM {part}"""
check_view("o_series", _SERIES)
check_view("o_series_names", """
    SELECT serie_id, 0 AS np, 'o' AS kind, titulo AS nombre FROM o_series
    UNION ALL SELECT serie_id, 1, 'o', concat('Serie ', CAST(serie_id AS VARCHAR), ' de la lista') FROM o_series
    UNION ALL SELECT serie_id, 0, 'es', titulo_es FROM o_series WHERE titulo_es IS NOT NULL""")
_ART = "regexp_replace({0}, '^(" + "|".join(fv.LEADING_ARTICLES) + ")\\s+', '')"
_SUF = "regexp_replace({0}, '\\s+(" + "|".join(fv.TYPE_SUFFIXES) + ")$', '')"
check_view("o_series_keys", f"""
    SELECT serie_id, np, kind, nombre, n, unnest(ks) AS clave, generate_subscripts(ks, 1) AS kp FROM (
      SELECT *, list_filter(flatten(list_transform([n, {_ART.format('n')}, {_SUF.format('n')}, {_ART.format(_SUF.format('n'))}],
              lambda c: CASE WHEN len(string_split(c, ' ')) >= 3
                        THEN [c, array_to_string(list_sort(string_split(c, ' ')), ' ')] ELSE [c] END)), lambda k: k <> '') AS ks
      FROM (SELECT *, trim(regexp_replace(lower(strip_accents(nombre)), '[^\\pL\\pN]+', ' ', 'g')) AS n FROM o_series_names))""")
check_view("o_match_name", """
    SELECT kind, serie_id, arg_min(work_id, (np, kp)) AS work_id FROM o_series_keys JOIN o_index USING (clave) GROUP BY kind, serie_id""")
_WS = ("list_sort(list_distinct(list_transform(list_filter(string_split(n, ' '), lambda w: w <> '' AND NOT list_contains("
       + sql_list(fv.STOP_WORDS + fv.FILLER_WORDS)
       + ", w)), lambda w: CASE WHEN length(w) > 3 THEN regexp_replace(w, '(es|s)$', '') ELSE w END)))")
check_view("o_series_sets", f"SELECT DISTINCT kind, serie_id, nombre, {_WS} AS ws FROM (SELECT DISTINCT kind, serie_id, nombre, n FROM o_series_keys)")
check_view("o_work_sets", f"SELECT DISTINCT work_id, {_WS} AS ws FROM o_names")
check_view("o_similar", """
    WITH p AS (SELECT DISTINCT s.kind, s.serie_id, s.ws AS a, w.work_id, w.ws AS b
               FROM (SELECT *, unnest(ws) AS word FROM o_series_sets WHERE len(ws) >= 4) s
               JOIN (SELECT *, unnest(ws) AS word FROM o_work_sets WHERE len(ws) >= 4) w USING (word)),
    j AS (SELECT kind, serie_id, work_id, len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) AS s FROM p)
    SELECT kind, serie_id, s, min(work_id) AS lo, max(work_id) AS hi,
           row_number() OVER (PARTITION BY kind, serie_id ORDER BY s DESC) AS rn
    FROM j WHERE s >= 0.8 GROUP BY kind, serie_id, s""")


def series_of(t):
    names = F.array(F.col("titulo"), F.concat(F.lit("Serie "), F.col("serie_id").cast("string"), F.lit(" de la lista")))
    return t.sql(_SERIES).withColumn("nombres", names).withColumn("slug_base", F.lit(None).cast("string"))


@query("j1_build_name_index", "SELECT clave, work_id FROM o_index")
def _(t):
    return matching.build_name_index(published(t))


@query("j2_match_by_name", "SELECT serie_id, work_id FROM o_match_name WHERE kind = 'o'")
def _(t):
    return matching.match_by_name(series_of(t), matching.build_name_index(published(t)))


@query("j3_match_by_similarity", """
    SELECT serie_id, lo AS work_id, s AS similitud FROM o_similar WHERE kind = 'o' AND rn = 1 AND lo = hi""")
def _(t):
    return matching.match_by_similarity(series_of(t), published(t), fv.SIMILAR_ENOUGH)


check_view("o_bound", "SELECT serie_id, serie_id * 7 % 100 AS work_id FROM o_series WHERE serie_id % 6 = 4 AND serie_id % 5 = 0")
check_view("o_gone", "SELECT DISTINCT concat('w-', CAST(serie_id % 40 AS VARCHAR)) AS slug FROM o_series WHERE serie_id % 40 = 3")


@query("j4_resolve_series", """
    WITH RECURSIVE f AS (SELECT s.*, coalesce(b.work_id, n.work_id, e.work_id, se.lo, so.lo) AS w,
           CASE WHEN b.work_id IS NOT NULL THEN 'url' WHEN n.work_id IS NOT NULL THEN 'nombre' WHEN e.work_id IS NOT NULL THEN 'traducido'
                WHEN se.lo IS NOT NULL THEN 'parecido_es' WHEN so.lo IS NOT NULL THEN 'parecido' ELSE 'nueva' END AS via
         FROM o_series s LEFT JOIN o_bound b USING (serie_id)
         LEFT JOIN o_match_name n ON n.serie_id = s.serie_id AND n.kind = 'o'
         LEFT JOIN o_match_name e ON e.serie_id = s.serie_id AND e.kind = 'es'
         LEFT JOIN o_similar se ON se.serie_id = s.serie_id AND se.kind = 'es' AND se.rn = 1 AND se.lo = se.hi
         LEFT JOIN o_similar so ON so.serie_id = s.serie_id AND so.kind = 'o' AND so.rn = 1 AND so.lo = so.hi AND so.s >= 0.9),
    u AS (SELECT * FROM f WHERE w IS NULL AND NOT solo_match),
    k AS (SELECT DISTINCT serie_id, clave FROM o_series_keys WHERE kind = 'o' AND length(clave) >= 3 AND serie_id IN (SELECT serie_id FROM u)),
    ed AS (SELECT DISTINCT a.serie_id AS a, b.serie_id AS b FROM k a JOIN k b USING (clave)),
    r(node, label) AS (SELECT serie_id, serie_id FROM u UNION SELECT ed.b, r.label FROM r JOIN ed ON ed.a = r.node),
    root AS (SELECT node, min(label) AS root FROM r GROUP BY node),
    sl AS (SELECT serie_id, substr(regexp_replace(regexp_replace(lower(strip_accents(titulo)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS own FROM o_series),
    z AS (SELECT f.serie_id, f.sitio_id, f.via, CASE WHEN f.w IS NOT NULL THEN concat('w-', CAST(f.w AS VARCHAR)) ELSE sl.own END AS slug
          FROM f LEFT JOIN root ON root.node = f.serie_id LEFT JOIN sl ON sl.serie_id = coalesce(root.root, f.serie_id)
          WHERE f.w IS NOT NULL OR NOT f.solo_match)
    SELECT min(serie_id) AS serie_id, sitio_id, slug, arg_min(via, serie_id) AS via FROM z
    WHERE slug <> '' AND slug NOT IN (SELECT slug FROM o_gone) GROUP BY sitio_id, slug""")
def _(t):
    series = series_of(t)
    bound = series.where("serie_id % 6 = 4 AND serie_id % 5 = 0").select(
        "sitio_id", "url", (F.col("serie_id") * 7 % 100).alias("work_id")
    )
    gone = series.where("serie_id % 40 = 3").select(F.concat(F.lit("w-"), (F.col("serie_id") % 40).cast("string")).alias("slug"))
    return matching.resolve_series(series, published(t), bound, gone, similar=True)


@query("j6_dup_pairs_by_name", """
    WITH g AS (SELECT DISTINCT work_id, n FROM o_names WHERE length(n) >= 4),
    l AS (SELECT n, min(work_id) AS a FROM g GROUP BY n)
    SELECT DISTINCT l.a, g.work_id AS b, 1.0::DOUBLE AS similitud FROM g JOIN l USING (n) WHERE l.a <> g.work_id""")
def _(t):
    return merging.dup_pairs_by_name(published(t))


check_view("o_title_sets", f"SELECT work_id, {_WS} AS ws FROM o_names")
check_view("o_item_sets", f"""
    SELECT item_id AS work_id, {_WS} AS ws
    FROM (SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^\\pL\\pN]+', ' ', 'g')) AS n FROM benchmark)""")


def _dup_sql(sets: str) -> str:
    return f"""
    WITH s AS (SELECT ws, min(work_id) AS low FROM {sets} WHERE len(ws) >= 4 GROUP BY ws),
    rare AS (SELECT ws, low, unnest(ws) AS word FROM s),
    same AS (SELECT s.low AS a, d.work_id AS b, 1.0::DOUBLE AS similitud FROM {sets} d JOIN s USING (ws) WHERE d.work_id <> s.low),
    c AS (SELECT DISTINCT x.ws AS p, y.ws AS q, x.low AS a, y.low AS b FROM rare x JOIN rare y USING (word) WHERE x.low < y.low),
    j AS (SELECT a, b, len(list_intersect(p, q)) / CAST(len(p) + len(q) - len(list_intersect(p, q)) AS DOUBLE) AS similitud FROM c
          WHERE list_sort(list_filter(p, lambda w: regexp_matches(w, '^[0-9]+$'))) = list_sort(list_filter(q, lambda w: regexp_matches(w, '^[0-9]+$'))))
    SELECT a, b, max(similitud) AS similitud FROM (SELECT * FROM same UNION ALL SELECT * FROM j WHERE similitud >= 0.8) GROUP BY a, b"""


@query("j7_dup_pairs_by_words", _dup_sql("o_title_sets"))
def _(t):
    return merging.dup_pairs_by_words(work_names(published(t)))


@query("j7_dup_pairs_without_word_limit", f"""
    SELECT 0 AS parte, * FROM ({_dup_sql("o_title_sets")}) UNION ALL SELECT 1, * FROM ({_dup_sql("o_item_sets")})""")
def _(t):
    items = t.base("benchmark").select(F.col("item_id").alias("work_id"), F.col("text").alias("nombre"))
    titles, texts = merging.dup_pairs_by_words(work_names(published(t)), None), merging.dup_pairs_by_words(items, None)
    return titles.select(F.lit(0).alias("parte"), "*").unionByName(texts.select(F.lit(1).alias("parte"), "*"))


_PAIRS = """
SELECT o_custkey AS a, o_custkey + o_orderkey % 7 + 1 AS b,
       min(CASE WHEN o_orderkey % 31 = 0 THEN 0.97 ELSE CAST(0.8 + (o_orderkey % 14) / 100.0 AS DOUBLE) END) AS similitud
FROM {orders} GROUP BY o_custkey, o_custkey + o_orderkey % 7 + 1"""
check_view("o_pairs", _PAIRS.replace("{orders}", "orders"))
check_view("o_weights", """
    SELECT w.work_id, w.slug, (-coalesce(s.n, 0), -coalesce(s.c, 0), -(CAST(alt1 IS NOT NULL AS INT) + CAST(alt2 IS NOT NULL AS INT) + CAST(alt3 IS NOT NULL AS INT)),
           -CAST(coalesce(d.text, '') <> '' AS INT), -CAST(w.portada_url <> '' AS INT), w.slug) AS peso
    FROM f_works w LEFT JOIN (SELECT work_id, count(*) AS n, sum(n_caps) AS c FROM f_sources GROUP BY work_id) s USING (work_id)
    LEFT JOIN documents d ON d.doc_id = w.work_id""")
check_view("o_strong", "SELECT a, b FROM o_pairs WHERE similitud >= 0.95 UNION ALL SELECT b, a FROM o_pairs WHERE similitud >= 0.95")
_RECURSE = "r(node, label) AS (SELECT DISTINCT a, a FROM o_strong UNION SELECT e.b, r.label FROM r JOIN o_strong e ON e.a = r.node)"
_PLAN = f"""
    {_RECURSE},
    root AS (SELECT node, min(label) AS root FROM r GROUP BY node),
    keep AS (SELECT root, arg_min(work_id, peso) AS dst FROM root JOIN o_weights ON work_id = node GROUP BY root),
    mem AS (SELECT node AS src, dst FROM root JOIN keep USING (root)),
    lnk AS (SELECT n, max(similitud) AS similitud FROM (SELECT a AS n, similitud FROM o_pairs UNION ALL SELECT b, similitud FROM o_pairs)
            WHERE similitud >= 0.95 GROUP BY n),
    plan AS (SELECT dst, src, similitud, 'auto' AS modo FROM mem JOIN lnk ON n = src WHERE src <> dst)"""


def merge_inputs(t):
    works = t.works.join(t.synopses.select("work_id", "sinopsis"), "work_id", "left").fillna("", ["sinopsis"])
    weights = merging.merge_weights(works, t.sources)
    plan = merging.merge_plan(t.sql(_PAIRS), weights)
    return works, weights, plan


@query("j8_merge_plan", f"""
    WITH RECURSIVE {_PLAN},
    weak AS (SELECT coalesce(x.dst, p.a) AS a, coalesce(y.dst, p.b) AS b, p.similitud FROM o_pairs p
             LEFT JOIN mem x ON x.src = p.a LEFT JOIN mem y ON y.src = p.b WHERE p.similitud < 0.95),
    man AS (SELECT CASE WHEN v.peso < w.peso THEN a ELSE b END AS dst, CASE WHEN v.peso < w.peso THEN b ELSE a END AS src, similitud
            FROM weak JOIN o_weights v ON v.work_id = a JOIN o_weights w ON w.work_id = b WHERE a <> b)
    SELECT * FROM plan UNION ALL SELECT dst, src, max(similitud), 'manual' FROM man GROUP BY dst, src""")
def _(t):
    return merge_inputs(t)[2]


def merged(t, chapters=None):
    works, weights, plan = merge_inputs(t)
    old = F.when(F.col("work_id") % 6 == 0, F.array(F.concat(F.lit("vieja-"), F.col("work_id").cast("string"))))
    works = works.withColumn("slugs_antiguos", F.coalesce(old, F.array().cast("array<string>")))
    return merging.apply_merge(works, weights, plan, t.sources, t.chapters if chapters is None else chapters, t.anchors)


_MEMBERS = f"""
    {_PLAN},
    m AS (SELECT w.*, coalesce(d.text, '') AS sinopsis, coalesce(p.dst, w.work_id) AS raiz, p.dst IS NOT NULL AS ajena,
                 (p.dst IS NOT NULL, x.peso) AS orden
          FROM f_works w LEFT JOIN plan p ON p.src = w.work_id JOIN o_weights x USING (work_id) LEFT JOIN documents d ON d.doc_id = w.work_id)"""


@query("j9_merged_works", f"""
    WITH RECURSIVE {_MEMBERS}
    SELECT raiz AS work_id, max(slug) FILTER (NOT ajena) AS slug, max(titulo) FILTER (NOT ajena) AS titulo,
           CASE WHEN min(tipo) = max(tipo) THEN min(tipo) ELSE 'ambos' END AS tipo,
           md5(coalesce(arg_min(sinopsis, orden) FILTER (sinopsis <> ''), '')) AS sinopsis,
           coalesce(arg_min(portada_url, orden) FILTER (portada_url <> ''), '') AS portada_url,
           arg_min(concat_ws('|', tag1, tag2, tag3), orden) AS categorias,
           CASE WHEN bool_or(estado = 'Finalizado') THEN 'Finalizado' ELSE max(estado) FILTER (NOT ajena) END AS estado,
           bool_or(publicada) AS publicada
    FROM m GROUP BY raiz""")
def _(t):
    rows = merged(t)["works"]
    return rows.withColumn("categorias", joined("categorias")).withColumn("sinopsis", F.md5("sinopsis"))


@query("j9_merged_names", f"""
    WITH RECURSIVE {_MEMBERS},
    nm AS (SELECT raiz, orden, unnest(l) AS nombre, generate_subscripts(l, 1) AS pos FROM (
             SELECT raiz, orden, list_filter(CASE WHEN ajena THEN [titulo, alt1, alt2, alt3] ELSE [alt1, alt2, alt3] END, lambda x: x IS NOT NULL) AS l FROM m)),
    d AS (SELECT raiz, nombre, min((orden, pos)) AS en FROM nm GROUP BY raiz, nombre)
    SELECT raiz AS work_id, nombre, row_number() OVER (PARTITION BY raiz ORDER BY en, nombre) AS puesto FROM d
    WHERE nombre NOT IN (SELECT titulo FROM m WHERE NOT ajena AND m.raiz = d.raiz)""")
def _(t):
    return merged(t)["names"]


@query("j9_merged_anchors", f"""
    WITH RECURSIVE {_PLAN}
    SELECT coalesce(p.dst, a.work_id) AS work_id, a.capitulo_manhwa, arg_min(a.capitulo_novela, (p.dst IS NOT NULL, a.work_id)) AS capitulo_novela
    FROM f_anchors a LEFT JOIN plan p ON p.src = a.work_id GROUP BY 1, 2""")
def _(t):
    return merged(t)["anchors"]


@query("j9_merged_children", f"""
    WITH RECURSIVE {_PLAN}
    SELECT coalesce(p.dst, s.work_id) AS work_id, count(*) AS n_fuentes, CAST(sum(n_caps) AS BIGINT) AS caps
    FROM f_sources s LEFT JOIN plan p ON p.src = s.work_id GROUP BY 1""")
def _(t):
    return merged(t)["sources"].groupBy("work_id").agg(F.count("*").alias("n_fuentes"), F.sum("n_caps").alias("caps"))


_LINKS = "SELECT p_partkey AS a, p_partkey - p_size % 7 - 1 AS b FROM {part} WHERE p_size > 20 AND p_partkey > 7"
check_view("o_linked_works", _LINKS.replace("{part}", "part"))


@query("j8_groups_kept_current", """
    WITH RECURSIVE e AS (SELECT a, b FROM o_linked_works UNION SELECT b, a FROM o_linked_works),
    r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
    SELECT node, min(label) AS root FROM r GROUP BY node""")
def _(t):
    """Links of works arrive in three batches; groups that are there grow together."""
    links = cut_lineage(t.sql(_LINKS).withColumn("_lote", F.pmod(F.xxhash64("a", "b"), F.lit(3))))
    kind = links.schema["a"].dataType.simpleString()
    members = t.spark.createDataFrame([], f"node {kind}, grupo {kind}")
    roots = t.spark.createDataFrame([], f"grupo {kind}, root {kind}")
    for batch in range(3):
        new, changed = grow_components(members, roots, links.where(F.col("_lote") == batch))
        members = cut_lineage(members.unionByName(new))
        roots = cut_lineage(put_in_place(roots, changed, "grupo"))
    return members.join(roots, "grupo").select("node", "root")


@query("j9_merged_chapters", f"""
    WITH RECURSIVE {_PLAN}
    SELECT c.id, c.source_id, c.numero, c.titulo, c.url, coalesce(p.dst, c.work_id) AS work_id, p.dst IS NOT NULL AS movido
    FROM o_chapters c LEFT JOIN plan p ON p.src = c.work_id""")
def _(t):
    moved = merged(t, t.chapters.withColumn("_de", F.col("work_id")))["chapters"]
    return moved.select("id", "source_id", "numero", "titulo", "url", "work_id", (F.col("work_id") != F.col("_de")).alias("movido"))


@query("j9_old_slugs", f"""
    WITH RECURSIVE {_MEMBERS}
    SELECT raiz AS work_id, slug AS viejo FROM m WHERE ajena
    UNION SELECT raiz, concat('vieja-', CAST(work_id AS VARCHAR)) FROM m WHERE work_id % 6 = 0""")
def _(t):
    return merged(t)["old_slugs"]


check_view("o_site_tags", """
    SELECT o_custkey AS work_id, o_orderkey % 5 AS sitio_id,
           CASE o_orderkey % 4 WHEN 0 THEN 'Action' WHEN 1 THEN 'Comedia' WHEN 2 THEN 'Returner' ELSE 'Etiqueta propia' END AS t1,
           CASE WHEN o_orderkey % 3 = 0 THEN 'Mystery' ELSE '' END AS t2, o_orderkey FROM orders""")


@query("j19_genre_of_series", f"""
    WITH x AS (SELECT work_id, 0 AS src, 0 AS sitio, pos, label FROM o_labels_raw
      UNION ALL SELECT work_id, 1, sitio_id, 0, t1 FROM o_site_tags JOIN o_works USING (work_id)
      UNION ALL SELECT work_id, 1, sitio_id, 1, t2 FROM o_site_tags JOIN o_works USING (work_id) WHERE t2 <> ''),
    k AS (SELECT x.*, coalesce(g.clave, regexp_replace(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS clave
          FROM x LEFT JOIN o_genres g ON g.spelling = trim(regexp_replace(regexp_replace(lower(strip_accents(label)), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))),
    f AS (SELECT work_id, clave, arg_min(trim(label), (src, sitio, pos)) AS label, min((src, sitio, pos)) AS en FROM k GROUP BY work_id, clave)
    SELECT f.work_id, string_agg(label, '|' ORDER BY en, label) AS categorias FROM f
    JOIN (SELECT work_id, CAST(tag1 IS NOT NULL AS INT) + CAST(tag2 IS NOT NULL AS INT) + CAST(tag3 IS NOT NULL AS INT) AS antes FROM o_works) w USING (work_id)
    WHERE f.work_id IN (SELECT work_id FROM o_site_tags) GROUP BY f.work_id, w.antes HAVING count(*) <> w.antes""")
def _(t):
    tags = t.sql("""
        SELECT o_custkey AS work_id, o_orderkey % 5 AS sitio_id, array(
                 CASE o_orderkey % 4 WHEN 0 THEN 'Action' WHEN 1 THEN 'Comedia' WHEN 2 THEN 'Returner' ELSE 'Etiqueta propia' END,
                 CASE WHEN o_orderkey % 3 = 0 THEN 'Mystery' ELSE '' END) AS categorias
        FROM {orders}""")
    return matching.genre_of_series(published(t), tags).withColumn("categorias", joined("categorias"))
