import random
import re

import pytest
from pyspark.sql import functions as F

from tandem.sources import markup
from tests.plain_markup import tree

CLASSES = "page-item-detail post-title acard wp-manga-chapter chapter-release-date listupd bs utao tt comic-card comic-card__title eplister chapternum".split()


def themes():
    found = {}
    for line in markup.THEME_RULES.strip().splitlines():
        cells = [c.strip() for c in line.split("|")]
        names = "tema para elemento enlace titulo atributos fecha numero reserva".split()
        found.setdefault((cells[0], cells[1]), []).append(dict(zip(names, cells)) | {"reserva": int(cells[8])})
    return found


def page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        tag, a = rng.choice("div li a span h3 h5 img article ul time br strong".split()), ""
        for chance, text in (
            (0.7, f' class="{" ".join(rng.sample(CLASSES, 2))}"'), (0.2, " id=chapterlist"), (0.2, " data-orderno='3'"),
            (0.4, f' href="{rng.choice(["/reader/x", "/a/b.c/", "#", "https://q.test/a?b=1&amp;c", "../up", "x y"])}"'),
            (0.2, f' title="T &amp; {rng.randrange(9)}" alt=alt'), (0.2, ' data-src="https://i/1.jpg" data-num="7" datetime="May 1"'),
        ):
            a += text if rng.random() < chance else ""
        out.append(rng.choice(["", "", "", "<!-- <a href=no> -->", "a < b &lt; c", "<!doctype html>"]))
        inside = "" if depth > 3 or tag in ("img", "br") else rng.choice(["", " text &eacute; ", "x\ny"]) + page(rng, depth + 1)
        out.append(f"<{tag}{a}>{inside}" + (f"</{tag}>" if tag not in ("img", "br") and rng.random() < 0.9 else ""))
    return "".join(out)


def found(html, rules):
    """Items of a page with the first match of each selector, by the tag machine."""
    reader = markup.Page(markup.Theme(rules))
    for _ in reader.read(html):
        pass
    return sorted(
        (i.rule["reserva"], i.pos, i.tag, sorted(i.attrs.items()), sorted((t, sorted(c.attrs.items()), c.text()) for t, c in i.found.items()))
        for i in reader.done
    )


def test_tag_machine_finds_what_a_tree_finds():
    rng, items = random.Random(4), 0
    for _ in range(400):
        html = page(rng)
        root = tree(html)
        for rules in themes().values():
            want = []
            for rule in markup.Theme(rules).rules:
                for pos, node in enumerate(root.select(rule["elemento"])):
                    first = {t: node.first(t) for t in rule["wanted"]}
                    want.append((rule["reserva"], pos, node.tag, sorted(node.attrs.items()), sorted(
                        (t, sorted(n.attrs.items()), n.text().strip()) for t, n in first.items() if n is not None)))
            assert found(html, rules) == sorted(want), html
            items += len(want)
    assert items > 3000


def test_scripts_and_odd_tags():
    rules = [dict(elemento=".c", enlace="a", titulo="", atributos="", fecha="", numero="", reserva=0)]
    html = """<script>var x = '<div class="c"><a href="no">'</script><STYLE>.c{}</STYLE><DIV CLASS="c"><A HREF='/x'>y<br/></A></DIV><div class="c" """
    (item,) = found(html, rules)
    assert item[3:] == ([("class", "c")], [("a", [("href", "/x")], "y")])
    assert found("", rules) == found("<", rules) == found("</div></a>plain", rules) == []


@pytest.mark.parametrize("href", ["/a/b", "/a.b/c~d/", "/../a", "/./a", "//other/x", "a", "?q", "#", "/a?b", "/a b", "", "http://z/..", "/a/.hidden"])
@pytest.mark.parametrize("url", ["https://h.test/x/y", "https://h.test", "h.test/x"])
def test_links_are_resolved(url, href):
    from urllib.parse import urljoin

    assert markup.absolute(url, href) == (urljoin(url, href) if href else "")


def test_plain_addresses_are_not_taken_apart(monkeypatch):
    from urllib.parse import urljoin

    hosts, paths = ["https://h.test", "http://a-b.c.test"], ["", "/", "/a", "/a/b.c/", "/a%20b/~c-d", "/año/1"]
    plain = [h + p for h in hosts for p in paths]
    odd = ["HTTP://h.test/a", "https://h.test//a", "https://h.test/a/../b", "https://h.test/a?", "https://h.test/a#", "https://h.test:80/a;b"]
    for url in ("https://h.test/x/y", "http://other.test"):
        assert [markup.absolute(url, h) for h in plain + odd] == [urljoin(url, h) for h in plain + odd]
    monkeypatch.setattr(markup, "urljoin", lambda *_: pytest.fail("taken apart"))
    assert [markup.absolute("https://h.test/x", h) for h in plain] == plain


def test_a_long_page_is_read_in_bounded_memory():
    """100 MB of chapters: what is held does not grow with the page."""
    import tracemalloc

    rules = themes()["madara", "capitulos"]
    item = '<li class="wp-manga-chapter"><a href="/c/1/">Capítulo 1</a><span class="x">' + "z" * 900 + "</span></li>"
    html = "<ul>" + item * (100_000_000 // len(item)) + "</ul>"
    reader, n = markup.Page(markup.Theme(rules)), 0
    tracemalloc.start()
    for _ in reader.read(html):
        n += len(reader.done)
        reader.done.clear()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000_000 // len(item) and peak < 64 << 20


def test_rules_in_reserve_count_where_the_first_find_nothing(spark):
    rules = spark.createDataFrame(
        [("t", "series", ".one", "a", "", "", "", "", 0), ("t", "series", ".two", "a", "", "", "", "", 1), ("t", "series", ".three", "a", "", "", "", "", 2)],
        markup.RULE_COLUMNS)
    item = lambda c, t: f'<div class="{c}"><a href="/{t}">{t}</a></div>'
    pages = [("https://h.test/1", item("two", "a") + item("one", "b") + item("two", "c")), ("https://h.test/2", item("three", "d") + item("two", "e")),
             ("https://h.test/3", item("three", "f")), ("https://h.test/4", ""), ("https://h.test/5", None), ("https://other.test/6", item("one", "g"))]
    sites = spark.createDataFrame([("h.test", "t"), ("other.test", "no rules")], "host string, tema string")
    rows = markup.extract_series(spark.createDataFrame(pages, "url string, html string"), sites, rules).collect()
    assert sorted((r.url_pagina[-1], r.pos, r.titulo) for r in rows) == [("1", 0, "b"), ("2", 0, "e"), ("3", 0, "f")]


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_never_broadcast_and_read_by_all_tasks(spark, tmp_path):
    """Of the join with the themes the sites are the broadcast side, also when pages come out of a shuffle."""
    sites = spark.createDataFrame([(f"h{i}.test", "madara") for i in range(40)], "host string, tema string")
    html = '<ul><li class="wp-manga-chapter"><a href="/c-1/">Capítulo 1</a></li></ul>'
    rows = spark.range(400).select(F.concat(F.lit("https://h"), (F.col("id") % 40).cast("string"), F.lit(".test/"), "id").alias("url"),
        F.concat(F.lit(html), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "")).alias("html"))
    rows.repartition(6).write.parquet(str(tmp_path / "pages"))
    files = spark.read.parquet(str(tmp_path / "pages"))
    shuffled = files.groupBy("url").agg(F.max("html").alias("html"))
    rules = markup.theme_rules(spark)
    for pages, tasks in ((files, files.rdd.getNumPartitions()), (shuffled, None)):
        found = markup.extract_chapters(pages, sites, rules)
        plan = _final_plan(found)
        final = plan.split("== Initial Plan ==")[0]
        assert re.search(r"BroadcastHashJoin \[host#\d+\], \[host#\d+\], Inner, BuildRight", final), final
        assert found.count() == 400
        if tasks:
            assert found.rdd.getNumPartitions() == tasks > 1
            assert "Exchange hashpartitioning" not in final
        else:
            assert len({r.p for r in found.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 1
