"""Operator cases: interpolation, tiers, matching, merging, extraction, requests, covers, enrichment."""

import random
from datetime import datetime
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tandem.functions import text
from tandem.operators import covers, enrichment, gap, levels, matching, merging, requests, visibility, votes, work_pages
from tandem.sinks import exports
from tandem.sources import listings, markup, payloads, robots, sitemaps


def col(df, name):
    return [r[name] for r in df.collect()]


# ---- interpolation, formats, tiers ------------------------------------------------------

@pytest.mark.parametrize("anchors, asked, expected", [
    ([(1, 1), (20, 28), (86, 123)], {86: 123, 1: 1, 53: 76, 0: None, 100: 143}, None),
    ([(3, 9)], {99: 9, 1: 9, 3: 9}, None),
    ([], {5: None}, None),
    ([(10, 40), (20, 60)], {4: 40, 15: 50, 30: 80}, None),
])
def test_interpolation(spark, anchors, asked, expected):
    a = spark.createDataFrame([(1, m, n) for m, n in anchors], "work_id bigint, capitulo_manhwa int, capitulo_novela int")
    c = spark.createDataFrame([(1, n) for n in asked], "work_id bigint, numero int")
    got = {r.numero: r.en_novela for r in votes.manhwa_to_novel(c, a).collect()}
    assert got == asked


def test_adaptation_states(spark):
    rows = [(1, "manhwa"), (1, "novela"), (2, "manhwa"), (3, "novela"), (3, "novela")]
    got = {r.work_id: (r.formatos, r.adaptacion) for r in gap.formats(spark.createDataFrame(rows, "work_id int, tipo string")).collect()}
    assert got == {1: (["manhwa", "novela"], "ambos"), 2: (["manhwa"], "solo_manhwa"), 3: (["novela"], "solo_novela")}


def test_tiers(spark):
    # work_id, adulta, ambos, con_trafico, ultimo, creada_ord
    rows = [(1, False, True, False, 1, 1.0), (2, False, False, False, 5, 1.0), (3, False, False, False, 5, 2.0),
            (4, False, False, False, 4, 1.0), (5, False, False, True, 1, 1.0), (6, True, True, False, 300, 1.0),
            (7, True, True, True, 300, 1.0)]
    facts = spark.createDataFrame(rows, "work_id int, adulta boolean, ambos boolean, con_trafico boolean, ultimo int, creada_ord double")
    early = dict(levels.index_levels(facts, datetime(2026, 10, 20)).collect())
    later = dict(levels.index_levels(facts, datetime(2030, 1, 1)).collect())
    assert early == {1: "A", 2: "C", 3: "C", 4: "C", 5: "B", 6: "C", 7: "B"}
    assert later == {1: "A", 2: "B", 3: "B", 4: "C", 5: "B", 6: "C", 7: "B"}
    assert levels.release_size(datetime(2026, 10, 20)) == 0
    assert 0 < levels.release_size(datetime(2026, 12, 1)) < levels.release_size(datetime(2027, 1, 1))


def test_allowed_urls(spark):
    ok = ["https://lectura.example/x-capitulo-1/", "https://www.lectura.example/x", "https://cdn.lectura.example/x", "https://LECTURA.example/x"]
    bad = ["https://example.com/", "https://nolectura.example/x", "https://lectura.example.evil.test/x", "file:///etc/passwd",
           "data:text/html,<h1>hola", "http://169.254.169.254/", "", "no-es-una-url"]
    df = spark.createDataFrame([(u,) for u in ok + bad], "url string")
    got = {r.url: (r.permitida, r.en_visor) for r in visibility.allowed_url(df, ["lectura.example"], ["cdn.lectura.example"]).collect()}
    assert all(got[u][0] for u in ok) and not any(got[u][0] for u in bad)
    assert got["https://cdn.lectura.example/x"][1] is False and got[ok[0]][1] is True


# ---- matching ---------------------------------------------------------------------------

def works_of(spark, rows):
    return spark.createDataFrame(
        [(i, f"w-{i}", names[0], names[1:]) for i, names in enumerate(rows)],
        "work_id int, slug string, titulo string, titulos_alternativos array<string>",
    )


def series_of(spark, titles):
    return spark.createDataFrame([(i, [t]) for i, t in enumerate(titles)], "serie_id int, nombres array<string>")


def by_name(spark, works, titles):
    found = dict(matching.match_by_name(series_of(spark, titles), matching.build_name_index(works_of(spark, works))).collect())
    return [found.get(i) for i in range(len(titles))]


def similar(spark, works, title, threshold=0.8):
    rows = matching.match_by_similarity(series_of(spark, [title]), works_of(spark, works), threshold).collect()
    return rows[0].work_id if rows else None


def test_exact_names(spark):
    works = [
        ["Return of the Mount Hua Sect", "Regreso de la Secta del Monte Hua", "화산귀환", "RotMH"], ["La Villana Rica"],
        ["El genio lancero inmortal", "The Immortal Genius Spearman"], ["Rey Demonio"], ["Go"], ["Tower of God"], ["Tower of God"],
    ]
    titles = ["¡Regreso de la Secta del Monte Huá!", "화산귀환", "Solo Leveling", "El Regreso de la Secta del Monte Hua", "Villana Rica",
              "El Lancero Genio Inmortal", "The Immortal Genius Spearman", "Demonio Rey", "Go", "tower of god"]
    assert by_name(spark, works, titles) == [0, 0, None, 0, 1, 2, 2, None, None, 5]


def test_similar_titles(spark):
    clan = [["El hijo menor del clan de asesinos regresa con los poderes de cinco reyes demonio"], ["El hijo menor del clan de espadachines regresa"]]
    assert similar(spark, clan, "El hijo menor del clan Asesino regresa con el poder de los cinco reyes demonios") == 0
    assert similar(spark, clan, "El hijo menor del clan de magos regresa") is None
    assert similar(spark, [["Don't Look for the Villainess Who Left"]], "Don't Look for the Resurrected Villainess", 0.9) is None
    assert similar(spark, [["El séptimo héroe es el rey demonio"]], "El Rey Demonio es un héroe") is None
    assert similar(spark, [["Mago infinito"]], "Mago infinita") is None
    tie = [["uno dos tres cuatro cinco"], ["uno dos tres cuatro seis"]]
    assert similar(spark, tie, "uno dos tres cuatro cinco seis", 0.6) is None


def brute_similar(sets, threshold):
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:]
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_prefix_keys_lose_no_pair(spark):
    import random

    rng = random.Random(9)
    words = [f"palabra{chr(97 + i)}x" for i in range(26)]
    titles = {}
    for i in range(300):
        base = rng.sample(words, rng.randrange(4, 12))
        titles[2 * i] = base
        near = list(base)
        near[0] = rng.choice(words)
        titles[2 * i + 1] = near
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in titles.items()], "work_id int, nombre string")
    sets = matching.title_sets(df, "work_id")
    for limit in (None, 10_000):
        rows = matching.similar_sets(sets.select("words"), sets.select("words"), 0.8, matching.word_postings(sets), limit)
        got = {(tuple(r.words_l), tuple(r.words_r)) for r in rows.where("words_l < words_r").collect()}
        unique = {tuple(sorted(set(v))): set(v) for v in titles.values() if len(set(v)) >= 4}
        assert got == brute_similar(unique, 0.8)


def test_duplicate_titles(spark):
    titles = [
        "Cómo me convertí en un hombre casado en otro mundo", "Me converti en un hombre casado en otro mundo.",
        "La villana rica se casa dos veces 2", "La villana rica se casa dos veces", "El rey demonio", "El rey demonio negro",
        "The Gangster Baby of the Duke’s Family", "The Gangster Baby of the Duke's Family (Promo)",
        "Shin Elf-san wa Yaserarenai", "Elf-san wa Yaserarenai",
    ]
    df = spark.createDataFrame(list(enumerate(titles)), "work_id int, nombre string")
    got = {(r.a, r.b): r.similitud for r in merging.dup_pairs_by_words(df).collect()}
    assert got == {(0, 1): 1.0, (6, 7): 1.0, (8, 9): 0.8}


def test_hot_titles_give_linear_pairs(spark):
    df = spark.range(400).select(F.col("id").alias("work_id"), F.lit("Cuatro palabras bien distintas").alias("nombre"))
    works = df.select("work_id", F.col("nombre").alias("titulo"), F.array().cast("array<string>").alias("titulos_alternativos"))
    assert merging.dup_pairs_by_name(works).count() == 399
    assert merging.dup_pairs_by_words(df, max_postings=None).count() == 399


def test_merge_types_and_fields(spark):
    schema = ("work_id int, slug string, tipo string, titulo string, titulos_alternativos array<string>, sinopsis string, "
              "portada_url string, categorias array<string>, estado string, publicada boolean, slugs_antiguos array<string>")
    works = spark.createDataFrame([
        (1, "dst", "manhwa", "Uno", ["Alt"], "", "https://a/1", [], "En emisión", False, ["viejo"]),
        (2, "src", "novela", "Dos", ["Alt", "Uno", "Tres"], "historia", "https://a/2", ["Drama"], "Finalizado", True, ["mas-viejo"]),
        (3, "otro", "manhwa", "Otro", [], "s", "", ["X"], "En emisión", True, []),
    ], schema)
    sources = spark.createDataFrame([(1, 10), (1, 5), (2, 3)], "work_id int, n_caps int")
    anchors = spark.createDataFrame([(1, 5, 50), (2, 5, 99), (2, 6, 60)], "work_id int, capitulo_manhwa int, capitulo_novela int")
    chapters = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "work_id int, url string")
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.9)], "a int, b int, similitud double")
    weights = merging.merge_weights(works, sources)
    plan = merging.merge_plan(pairs, weights)
    assert {(r.dst, r.src, r.modo) for r in plan.collect()} == {(1, 2, "auto"), (1, 3, "manual")}
    out = merging.apply_merge(works, weights, plan, sources, chapters, anchors)
    one = out["works"].where("work_id = 1").first()
    assert (one.slug, one.tipo, one.sinopsis, one.portada_url, one.categorias, one.estado, one.publicada) == (
        "dst", "ambos", "historia", "https://a/1", ["Drama"], "Finalizado", True)
    names = [r.nombre for r in out["names"].where("work_id = 1").orderBy("puesto").collect()]
    assert names == ["Alt", "Dos", "Tres"]
    assert {(r.work_id, r.viejo) for r in out["old_slugs"].collect()} == {(1, "src"), (1, "viejo"), (1, "mas-viejo")}
    assert {tuple(r) for r in out["anchors"].collect()} == {(1, 5, 50), (1, 6, 60)}
    assert {tuple(r) for r in out["chapters"].collect()} == {(1, "a"), (1, "b"), (3, "c")}


# ---- extraction -------------------------------------------------------------------------

PAGES = [
    ("https://x.test/manga/page/1/", """<div class="page-item-detail"><div class="item-thumb"><a href="/manga/obra-uno/"><img
        src="data:image/svg+xml,vacio" data-src="https://x.test/portada.webp"></a></div>
      <div class="post-title"><h3><a href="/manga/obra-uno/">Obra Uno</a></h3></div></div>"""),
    ("https://x.test/manga/page/2/", """<div class="agrid"><a class="acard" href="/manga/obra-hija/" title="Obra Hija">
        <img class="ac-cover" src="https://x.test/hija.webp" alt="Obra Hija"></a></div>"""),
    ("https://y.test/lista/", """<div class="listupd"><div class="bs"><div class="bsx"><a href="https://y.test/manga/dos/" title="Obra Dos">
        <img data-lazy-src="https://y.test/2.webp"></a></div></div></div>"""),
]
CHAPTER_PAGES = [
    ("https://x.test/manga/obra-uno/", """<ul><li class="wp-manga-chapter"><a href="/manga/obra-uno/capitulo-2/">Capítulo 2</a>
        <span class="chapter-release-date">21 agosto, 2026</span></li>
      <li class="wp-manga-chapter"><a href="/manga/obra-uno/capitulo-1/">Capítulo 1</a></li>
      <li class="wp-manga-chapter"><a href="#">Capítulo 3</a></li></ul>"""),
    ("https://y.test/manga/dos/", """<div id="chapterlist"><ul><li data-num="33"><a href="https://y.test/dos-capitulo-33/" data-chapter-title="Capítulo 33"></a>
        <span class="chapterdate">1 enero, 2026</span></li></ul></div>"""),
]


def test_themes(spark):
    sites = spark.createDataFrame([("x.test", "madara"), ("y.test", "mangareader")], "host string, tema string")
    rules = markup.theme_rules(spark)
    series = markup.extract_series(spark.createDataFrame(PAGES, "url string, html string"), sites, rules)
    assert {(r.titulo, r.url, r.portada) for r in series.collect()} == {
        ("Obra Uno", "https://x.test/manga/obra-uno/", "https://x.test/portada.webp"),
        ("Obra Hija", "https://x.test/manga/obra-hija/", "https://x.test/hija.webp"),
        ("Obra Dos", "https://y.test/manga/dos/", "https://y.test/2.webp"),
    }
    chapters = markup.extract_chapters(spark.createDataFrame(CHAPTER_PAGES, "url string, html string"), sites, rules)
    assert {(r.numero, r.titulo, r.url, r.fecha_texto) for r in chapters.collect()} == {
        (2, "Capítulo 2", "https://x.test/manga/obra-uno/capitulo-2/", "21 agosto, 2026"),
        (1, "Capítulo 1", "https://x.test/manga/obra-uno/capitulo-1/", None),
        (33, "Capítulo 33", "https://y.test/dos-capitulo-33/", "1 enero, 2026"),
    }


def test_own_selectors(spark):
    page = [("https://z.test/l/", '<div class="card"><h2 class="t">Una</h2><a class="go" href="una">ver</a><img src="/c.jpg"></div>')]
    rules = spark.createDataFrame([("css:z", "series", ".card", "a.go", ".t", "", "", "", 0)], markup.RULE_COLUMNS)
    sites = spark.createDataFrame([("z.test", "css:z")], "host string, tema string")
    row = markup.extract_series(spark.createDataFrame(page, "url string, html string"), sites, rules).first()
    assert (row.titulo, row.url, row.portada) == ("Una", "https://z.test/l/una", "/c.jpg")


def test_cards_and_details(spark):
    page = [("https://www.g.test/manga/obra/all-chapters/", """<ul><li data-chapterno="1" data-orderno="9"><a href="/reader/en/obra-chapter-12.5-eng-li/">
        <strong class="chapter-title">12.5-eng-li </strong><time class="chapter-update" datetime="Sept. 15, 2026, 3:02 a.m.">1 hour</time></a></li>
        <li data-orderno="8"><a href="/reader/en/obra-chapter-12-eng-li/"><strong class="chapter-title">12-eng-li</strong>
        <time datetime="May 3, 2026, noon">x</time></a></li></ul>""")]
    cards = [("https://www.g.test/browse/", """<article class="comic-card"><div class="comic-card__cover"><a href="/manga/obra/"><img src="https://i.test/tapa.jpg"
        alt="x"></a></div><h3 class="comic-card__title"><a href="/manga/obra/">
          Obra Geko
      </a></h3></article>""")]
    sites = spark.createDataFrame([("g.test", "tarjetas")], "host string, tema string")
    rules, schema = markup.theme_rules(spark), "url string, html string"
    rows = markup.extract_chapters(spark.createDataFrame(page, schema), sites, rules)
    assert {(r.numero, r.titulo, r.url, r.fecha_texto) for r in rows.collect()} == {
        (12, "Chapter 12.5", "https://www.g.test/reader/en/obra-chapter-12.5-eng-li/", "2026-09-15"),
        (12, "Chapter 12", "https://www.g.test/reader/en/obra-chapter-12-eng-li/", "2026-05-03")}
    series = markup.extract_series(spark.createDataFrame(cards, schema), sites, rules).first()
    assert (series.titulo, series.url, series.portada) == ("Obra Geko", "https://www.g.test/manga/obra/", "https://i.test/tapa.jpg")
    details = markup.series_details(spark.createDataFrame([("u", """<div><div><div aria-hidden="true"><div>이세계 오브라</div></div>
        <h1 itemprop="name">Obra Eco</h1></div></div>""")], schema))
    listed = spark.createDataFrame([("u", "Obra E…", ["Alt"]), ("v", "Otra", [])], "url string, titulo string, titulos_alternativos array<string>")
    done = {r.url: (r.titulo, r.titulos_alternativos) for r in markup.complete_series(listed, details).collect()}
    assert done == {"u": ("Obra Eco", ["Alt", "이세계 오브라"]), "v": ("Otra", [])}


def test_page_titles(spark):
    works = spark.createDataFrame([
        (1, "El Jefe", ["Boss"], "manhwa", ""), (2, "Regreso de la Secta del Monte Hua", ["Return of the Mount Hua Sect Extraordinary"], "manhwa", ""),
        (3, "Solo", [], "ambos", "Finalizado")], "work_id int, titulo string, titulos_alternativos array<string>, tipo string, estado string")
    chapters = spark.createDataFrame([(i, w, w, 79, "manhwa", "es", "u") for i, w in ((1, 1), (2, 2))] + [(3, 1, 1, 78, "manhwa", "es", "u")],
                                     "id int, work_id int, source_id int, numero int, tipo string, idioma string, url string")
    sources = spark.createDataFrame([(1, "Scan A"), (2, "Scan B")], "source_id int, nombre string")
    rows = {r.work_id: r for r in work_pages.page_meta(works, chapters, sources).collect()}
    assert rows[1].titulo_seo == "El Jefe / Boss — manhwa cap. 79"
    assert rows[2].titulo_seo == "Regreso de la Secta del Monte Hua — manhwa cap. 79"
    assert rows[3].titulo_seo == "Solo" and rows[3].tipo_serie == "ComicSeries" and "finalizada" in rows[3].preguntas
    english = {r.work_id: r for r in work_pages.page_meta(works, chapters, sources, "en").collect()}
    assert english[1].descripcion == "El Jefe: manhwa. Where to read it across 1 source, the latest chapter on each and where to continue."


def test_localized_catalogue(spark):
    doc = """{"data":[{"id":"1111","attributes":{"title":{"ko-ro":"Jeonjijeok"},"altTitles":[{"en":"Omniscient Reader's Viewpoint"},{"es":"Lector omnisciente"}],
      "status":"ongoing","tags":[{"attributes":{"group":"genre","name":{"en":"Action","es":"Acción"}}}]},
      "relationships":[{"type":"cover_art","attributes":{"fileName":"tapa.jpg"}}]}]}"""
    df = spark.createDataFrame([(doc,)], "json string")
    row = payloads.localized_series(df, "es", "https://w", "https://u").first()
    assert (row.titulo, row.slug_base, row.estado, row.categorias) == (
        "Lector omnisciente", "Omniscient Reader's Viewpoint", "En emisión", ["Acción"])
    assert row.portada == "https://u/covers/1111/tapa.jpg.256.jpg"


def test_feed_keeps_the_first_group(spark):
    doc = """{"data":[{"id":"c1","attributes":{"chapter":"12","title":"Doce","publishAt":"2026-01-02T00:00:00Z"}},
      {"id":"c2","attributes":{"chapter":"12","title":"Doce (otro grupo)","publishAt":"2026-01-01T00:00:00Z"}},
      {"id":"c3","attributes":{"chapter":"11.5","title":null,"publishAt":"2025-12-30T00:00:00Z"}}]}"""
    rows = payloads.feed_chapters(spark.createDataFrame([(1, 1, doc)], "serie int, doc int, json string"), "https://w")
    assert {(r.numero, r.titulo, r.fecha_texto) for r in rows.collect()} == {(12, "Doce", "2026-01-02"), (11, "Capítulo 11.5", "2025-12-30")}


def test_sitemap_entries(spark):
    xml = """<urlset><url><loc>https://n.test/series/obra-eco/chapter-2</loc><lastmod>2026-09-21T17:10:21.961Z</lastmod></url>
      <url><loc>https://n.test/series/i&apos;m-obra/chapter-3</loc><lastmod>2026-09-02T10:00:00.000Z</lastmod></url></urlset>"""
    listed = """<urlset><url><loc>https://n.test/series/obra-eco</loc></url><url><loc>https://n.test/series/obra-eco-novel</loc></url>
      <url><loc>https://n.test/series/i&apos;m-obra</loc></url><url><loc>https://n.test/series/ficha-muerta</loc></url></urlset>"""
    chapters = sitemaps.sitemap_chapters(spark.createDataFrame([(xml,)], "xml string"), "https://n.test")
    assert {(r.slug, r.numero, r.fecha_texto) for r in chapters.collect()} == {("obra-eco", 2, "2026-09-21"), ("i'm-obra", 3, "2026-09-02")}
    series = sitemaps.sitemap_series(spark.createDataFrame([(listed,)], "xml string"), chapters, "https://n.test", "manhwa")
    assert set(col(series, "url")) == {"https://n.test/series/obra-eco", "https://n.test/series/i'm-obra"}


def test_totals(spark):
    one = lambda html: spark.createDataFrame([(html,)], "h string").select(listings.total_in_page(F.col("h"))).first()[0]
    assert one('<span>Total chapters</span><span class="x">43</span>') == 43
    assert one('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"serie":{"serie_data":{"chapter_count":812}}}}}</script>') == 812
    assert one('<a href="?episode_no=3">x</a><a href="?a=1&episode_no=21">y</a>') == 21
    assert one("<p>nada</p>") is None
    links = spark.createDataFrame([(1, "https://o/series/x#caps=417"), (2, "https://o/series/y#caps=0")], "source_id int, url string")
    assert [(r.numero, r.url) for r in listings.linkout_rows(links).collect()] == [(417, "https://o/series/x")]


def test_robots(spark):
    files = spark.createDataFrame([("https://x.test", "User-agent: *\nDisallow: /wp-admin/"), ("https://y.test", "User-agent: bad\nDisallow: /")],
                                  "origen string, robots_txt string")
    urls = ["https://x.test/wp-admin/algo", "https://x.test/manga/", "https://y.test/a", "https://z.test/wp-admin/"]
    kept = robots.robots_filter(spark.createDataFrame([(u,) for u in urls], "url string"), files, "TandemBot/1.0")
    assert set(col(kept, "url")) == set(urls[1:])


# ---- requests, covers, pages, enrichment ------------------------------------------------

def test_repairs(one):
    cases = {
        "/pt/novela/return-of-the-mount-hua/capitulo-1": "/novela/return-of-the-mount-hua/capitulo-1",
        "/de/novela/release-that-witch/equivalencia/": "/novela/release-that-witch/equivalencia/",
        "/en/novela/que-alguien-detenga-al-papa/": "/novela/que-alguien-detenga-al-papa/", "/fr": "/",
        "/novela/the-great-mage-returns-after-4000-years-capitulo-86": "/novela/the-great-mage-returns-after-4000-years/capitulo-86",
        "/categoria/martial-arts/": "/categoria/artes-marciales/", "/categoria/inventada/": None, "/novela/no-existe/": None, "/entrevista/": None,
    }
    assert one([(p,) for p in cases], "path string", requests.repaired(F.col("path"))) == list(cases.values())


def test_request_status(spark):
    asked = ["/novela/x/", "/novela/gone/", "/en/novela/gone/capitulo-1", "/portada/gone.jpg", "/pt/novela/x/", "/novela/nada/",
             "/novela/contra-los-dioses-capitulo-1481", "/novela/contra-los-dioses/capitulo-9", "/categoria/erotica/", "/novela/x/capitulo-007"]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = requests.classify_requests(
        made([(p,) for p in asked], "path string"),
        made([("/novela/x",), ("/novela/against-the-gods",), ("/novela/against-the-gods/capitulo-1481",)], "path string"),
        made([("contra-los-dioses", "against-the-gods")], "slug string, nuevo string"), made([("gone",)], "slug string"),
    )
    found = {r.path: (r.status, r.destino) for r in got.collect()}
    assert found == {
        "/novela/x/": (200, None), "/novela/gone/": (410, None), "/en/novela/gone/capitulo-1": (410, None), "/portada/gone.jpg": (410, None),
        "/pt/novela/x/": (301, "/novela/x/"), "/novela/nada/": (404, None),
        "/novela/contra-los-dioses-capitulo-1481": (301, "/novela/against-the-gods/capitulo-1481"),
        "/novela/contra-los-dioses/capitulo-9": (301, "/novela/against-the-gods/"), "/categoria/erotica/": (404, None),
        "/novela/x/capitulo-007": (301, "/novela/x/capitulo-7"),
    }


def test_live_covers(spark):
    works = spark.createDataFrame([(1, "https://a.test/ok.jpg"), (2, "https://a.test/rota.jpg"), (3, "https://a.test/rota.jpg"), (4, "")],
                                  "work_id int, portada_url string")
    sources = spark.createDataFrame([(2, 1, "https://b.test/ok.jpg"), (3, 2, "https://a.test/cartel.html"), (2, 0, "https://x.mangadex.org/1.jpg")],
                                    "work_id int, source_id int, portada_vista string")
    probes = spark.createDataFrame([("https://a.test/ok.jpg", 200, "image/jpeg"), ("https://b.test/ok.jpg", 200, "image/webp"),
                                    ("https://a.test/rota.jpg", 404, ""), ("https://a.test/cartel.html", 200, "text/html"),
                                    ("https://x.mangadex.org/1.jpg", 200, "image/jpeg")], "url string, status int, content_type string")
    got = dict(covers.pick_live_cover(covers.cover_options(works, sources), probes, works).collect())
    assert got == {1: "https://a.test/ok.jpg", 2: "https://b.test/ok.jpg", 3: "/portadas/sin-portada.svg", 4: "/portadas/sin-portada.svg"}


def test_chapter_pages_skip_link_out(spark):
    schema = "id int, work_id int, source_id int, numero int, tipo string, idioma string, url string, visto_en timestamp"
    now = datetime(2026, 1, 1)
    rows = [(1, 1, 1, 1, "manhwa", "es", "u", now), (2, 1, 1, 20, "manhwa", "es", "u", now), (3, 1, 2, 20, "novela", "en", "u", now),
            (4, 1, 2, 25, "novela", "en", "u", now), (5, 1, 3, 18, "manhwa", "es", "u", now)]
    anchors = spark.createDataFrame([(1, 1, 1), (1, 20, 28)], "work_id int, capitulo_manhwa int, capitulo_novela int")
    chapters = spark.createDataFrame(rows, schema)
    got = {r.numero: (r.filas, r.anterior, r.siguiente, r.en_novela) for r in work_pages.chapter_pages(chapters, anchors).collect()}
    assert got == {1: (1, None, 18, 1), 20: (2, 1, 25, 28), 25: (1, 20, None, 35)}


def test_sitemap_chapters_are_pages(spark, sf_dir):
    from tandem.operators import rollup
    from tandem.plans.fixtures import Tables

    t = Tables(spark, sf_dir)
    listed = rollup.listed_numbers(t.chapters)
    pages = work_pages.chapter_pages(t.chapters, t.anchors)
    assert listed.join(pages, ["work_id", "numero"], "left_anti").count() == 0


def record(spark, **fields):
    base = dict(work_id=1, proveedor="anilist", traducida=False, titulos=["t"], sinopsis="", generos=[], etiquetas=[], estado=None, portada=None, demografia=None)
    schema = ("work_id int, proveedor string, traducida boolean, titulos array<string>, sinopsis string, generos array<string>, "
              "etiquetas array<string>, estado string, portada string, demografia string")
    return spark.createDataFrame([tuple({**base, **fields}.values())], schema)


def enriched(spark, categories, rec=None, **work):
    schema = ("work_id int, titulo string, titulos_alternativos array<string>, titulo_traducido string, sinopsis string, categorias array<string>, "
              "estado string, portada_url string")
    base = dict(work_id=1, titulo="t", titulos_alternativos=[], titulo_traducido=None, sinopsis="x", categorias=categories, estado="", portada_url="")
    works = spark.createDataFrame([tuple({**base, **work}.values())], schema)
    records = rec if rec is not None else record(spark, titulos=["otra obra"])
    combined = enrichment.combined_record(enrichment.accepted_records(works, records))
    return enrichment.enrich(works, combined).first()


def test_enrichment_patch(spark):
    assert enriched(spark, ["Romance", "Drama"]).categorias == ["Romance", "Drama", "Shoujo"]
    assert enriched(spark, ["Seinen"]).categorias == ["Seinen"]
    assert enriched(spark, [], record(spark, generos=["Action"], demografia="Seinen")).categorias == ["Action", "Seinen"]
    assert enriched(spark, ["Acción", "Fantasía"], record(spark, generos=["Action", "Isekai"], etiquetas=["Reincarnation", "Male Protagonist"])
                    ).categorias == ["Acción", "Fantasía", "Isekai", "Reincarnation", "Shounen"]
    row = enriched(spark, ["Seinen"], record(spark, sinopsis="Historia.\n\n(Source: X)", estado="Finalizado", portada="https://i/1.jpg", titulos=["t", "Otro", "Más"]),
                   sinopsis=" ", portada_url="https://uploads.mangadex.org/1.jpg")
    assert (row.sinopsis, row.estado, row.portada_url, row.titulos_alternativos) == ("Historia.", "Finalizado", "https://i/1.jpg", ["Otro", "Más"])


def test_translated_title_counts_only_when_the_title_fails(spark):
    rec = record(spark, traducida=True, titulos=["Magic Emperor"], estado="Finalizado")
    assert enriched(spark, ["Seinen"], rec, titulo="Emperador Mágico", titulo_traducido="Magic Emperor").estado == "Finalizado"
    assert enriched(spark, ["Seinen"], rec, titulo="Emperador Mágico").metadatos_fuente is None


def test_failed_translation_batches_stay_missing(spark):
    texts = spark.createDataFrame([(f"texto {i}", "es") for i in range(30)] + [("roto", "es")], "texto string, origen string")
    cache = spark.createDataFrame([], "clave string, idioma string, texto string")

    def translate(batch, source, target):
        if "roto" in batch:
            raise RuntimeError("model down")
        return [f"{target}:{x}" for x in batch]

    done = enrichment.incremental_translate(texts.repartition(1), cache, ["es", "en"], translate, batch=5)
    rows = done.collect()
    assert 0 < len(rows) < 31 and all(r.idioma == "en" and r.texto.startswith("en:") for r in rows)
    kept = spark.createDataFrame(rows, "clave string, hash string, idioma string, texto string")
    left = enrichment.missing_translations(texts, kept, ["es", "en"])
    assert left.count() == 31 - len(rows) and left.where("texto = 'roto'").count() == 1


def colliding():
    """Two short texts with one 32-bit hash, found by trying."""
    seen = {}
    for i in range(400_000):
        text = f"texto {i} de {i * 7919 % 1000003}"
        h = 0x811C9DC5
        for c in text.encode():
            h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
        if h in seen:
            return seen[h], text
        seen[h] = text
    raise AssertionError("no pair found")


def test_texts_of_one_hash_are_told_apart(spark):
    a, b = colliding()
    pair = spark.createDataFrame([(a,), (b,)], "texto string").withColumn("hash", text.text_hash("texto"))
    assert pair.select("hash").distinct().count() == 1
    works = spark.createDataFrame([(1, f"{a}\n\n{b}"), (2, b)], "work_id bigint, sinopsis string")
    only_a = pair.where(F.col("texto") == a).select(text.text_key("texto").alias("clave"), F.lit("en").alias("idioma"), F.lit("A").alias("texto"))
    twice = only_a.union(only_a.withColumn("texto", F.lit("")))
    got = {r.work_id: (r.sinopsis, r.traducidos) for r in enrichment.translate_lookup(works, twice, "en", "work_id", "sinopsis").collect()}
    assert got == {1: (f"A\n\n{b}", 1), 2: (b, 0)}
    texts = pair.select("texto", F.lit("es").alias("origen"))
    assert [r.texto for r in enrichment.missing_translations(texts, only_a, ["es", "en"]).collect()] == [b]
    share = {r.idioma: r.cobertura for r in enrichment.coverage(texts, only_a, ["es", "en"], ["es"]).collect()}
    assert share == {"es": 1.0, "en": 0.5}
    # an imported row does not say which of the two it translates
    imported = pair.limit(1).select("hash", F.lit("en").alias("idioma"), F.lit("X").alias("texto"))
    assert enrichment.bind_cache(imported, texts).count() == 0
    assert enrichment.bind_cache(imported, texts.where(F.col("texto") == a)).count() == 1


def test_long_titles_are_compared_exactly(spark):
    """Against all pairs, at 5, 30 and 200 words; the number of join keys stays in proportion."""
    rng = random.Random(9)
    titles = []
    for size in (5, 30, 200):
        for g in range(6):
            base = [f"palabra{rng.randrange(10**6)}x" for _ in range(size)]
            for c in range(5):
                ws = list(base)
                ws[c] = f"nueva{g}{size}{c}x"  # no two titles have the same words
                for _ in range(rng.randrange(size // 6 + 1)):
                    ws[rng.randrange(size)] = f"otra{rng.randrange(10**6)}x"
                titles.append((len(titles), " ".join(ws)))
    sets = [(i, set(t.split())) for i, t in titles]
    want = {(i, j) for i, x in sets for j, y in sets if i < j and len(x & y) >= 0.8 * len(x | y)}
    names = spark.createDataFrame(titles, "work_id bigint, nombre string")
    got = {(r.a, r.b) for r in merging.dup_pairs_by_words(names).collect()}
    assert got == want
    words = matching.title_sets(names, "work_id")
    keys = matching._exact_keys(words, matching.word_postings(words), 0.8).groupBy("words").count()
    assert keys.where(F.col("count") > 4 * F.size("words")).count() == 0


def test_keys_that_many_titles_share_are_salted(spark, monkeypatch):
    monkeypatch.setattr(matching, "_HOT_KEY", 3)
    titles = [(i, f"alpha beta gamma delta epsilon zeta theta kappa word{i}") for i in range(40)]
    got = merging.dup_pairs_by_words(spark.createDataFrame(titles, "work_id bigint, nombre string"))
    assert got.count() == 40 * 39 // 2


def test_merges_state_their_similarity(spark):
    pairs = spark.createDataFrame([(1, 2, 0.97), (2, 3, 0.99), (4, 5, 0.9)], "a bigint, b bigint, similitud double")
    weights = spark.createDataFrame([(i, i) for i in range(1, 6)], "work_id bigint, peso int")
    got = {(r.dst, r.src): (r.similitud, r.modo) for r in merging.merge_plan(pairs, weights).collect()}
    assert got == {(1, 2): (0.99, "auto"), (1, 3): (0.99, "auto"), (4, 5): (0.9, "manual")}


def test_sitemap_files_and_pins_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "/novela/a&b/capitulo-2"), (2, 1, "/novela/x/capitulo-1")], "puesto int, shard int, ruta string")
    exports.write_sitemap_shards(rows, "https://s.test", f"{tmp_path}/map")
    exports.write_manifest(rows, "https://s.test", f"{tmp_path}/robots")
    files = {p.parent.name: p for p in (tmp_path / "map").glob("shard=*/*.txt")}
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    locs = {k: [u.find(f"{space}loc").text for u in ElementTree.parse(p).getroot().iter(f"{space}url")] for k, p in files.items()}
    assert len(list((tmp_path / "map").glob("shard=*/*.txt"))) == 2
    assert locs == {"shard=0": ["https://s.test/novela/a&b/capitulo-2"], "shard=1": ["https://s.test/novela/x/capitulo-1"]}
    assert [r.value for r in spark.read.text(f"{tmp_path}/robots").collect()] == [
        "Sitemap: https://s.test/sitemap-index.xml", "Sitemap: https://s.test/sitemap-capitulos-1.xml",
        "Sitemap: https://s.test/sitemap-capitulos-2.xml",
    ]
    many = spark.createDataFrame([(i, 0, f"/n/{i}") for i in range(1, 400)], "puesto int, shard int, ruta string").repartition(9)
    exports.write_sitemap_shards(many, "", f"{tmp_path}/many")
    (only,) = (tmp_path / "many").glob("shard=0/*.txt")
    assert [u.find(f"{space}loc").text for u in ElementTree.parse(only).getroot()] == [f"/n/{i}" for i in range(1, 400)]
    exports.write_sitemap_shards(rows.limit(0), "https://s.test", f"{tmp_path}/empty")
    (empty,) = (tmp_path / "empty").glob("shard=0/*.txt")
    assert len(ElementTree.parse(empty).getroot()) == 0
    pin = spark.createDataFrame([("s", 0, 'Dice "hola", x', "m", "b", "d\nd", "l", "p", "k")],
                                "slug string, file int, title string, media_url string, board string, description string, link string, publish_date string, keywords string")
    exports.write_pins(pin, f"{tmp_path}/pins", f"{tmp_path}/ledger")
    row = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/pins/file=0").first()
    assert row.title == 'Dice "hola", x' and row.description == "d d"
    assert spark.read.parquet(f"{tmp_path}/ledger").first().slug == "s"
