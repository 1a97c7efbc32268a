"""Series and chapters out of crawled HTML.

Pages are joined with the theme of their host; each task reads its own pages as
a stream of tags and returns raw fields, and Spark does the numbers, the filters
and the choice between rules. No tree is built: the selectors of a theme are
steps that open tags complete, so a page needs memory for its open tags and open
items only, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.text import chapter_number, trim_ws
from tandem.functions.urls import host_of
from tandem.operators.distributed import small_side
from tandem.session import small_table

# ---- Fixed values: selectors of the two common themes ----------------------------------
# tema | para | elemento | enlace | titulo | atributos del titulo | fecha | numero | reserva (only when nothing else fits)

THEME_RULES = """
tarjetas | series | article.comic-card | .comic-card__title a | | | | | 0
tarjetas | capitulos | li[data-orderno] a[href*=/reader/] | | .chapter-title | | time:datetime | | 0
generos | series | a._genre_title_a | | .info_text .subj, .info_text strong | | | | 0
madara | series | .page-item-detail | .post-title h3 a, .post-title h5 a | | | | | 0
madara | series | a.acard | | | title, img:alt | | | 1
madara | capitulos | li.wp-manga-chapter | a | | | .chapter-release-date | | 0
mangareader | series | .listupd .bs, .listupd .utao | a | .tt | title | | | 0
mangareader | capitulos | #chapterlist li, .eplister li | a | .chapternum | data-chapter-title, data-chapter-label | .chapterdate | data-num | 0
"""
# ----------------------------------------------------------------------------------------

RULE_COLUMNS = "tema string, para string, elemento string, enlace string, titulo string, atributos string, fecha string, numero string, reserva int"


def theme_rules(spark) -> DataFrame:
    rows = []
    for line in THEME_RULES.strip().splitlines():
        cells = [c.strip() for c in line.split("|")]
        rows.append((*cells[:8], int(cells[8])))
    return small_table(spark, rows, RULE_COLUMNS)


def steps_of(selectors: str) -> list[tuple]:
    """``a b.c, #d[e*=f]`` as paths of (tag, id, classes, attribute conditions), each step inside the one before."""
    paths = []
    for selector in filter(None, (s.strip() for s in selectors.split(","))):
        path = []
        for simple in selector.split():
            conditions = tuple(re.findall(r"\[([\w-]+)(\*?=)?([^\]]*)\]", simple))
            parts = re.findall(r"([.#]?)([\w-]+)", re.sub(r"\[[^\]]*\]", "", simple))
            named = {kind: name for kind, name in parts if kind != "."}
            path.append((named.get("", ""), named.get("#", ""), tuple(n for k, n in parts if k == "."), conditions))
        paths.append(tuple(path))
    return paths


def fits(step: tuple, tag: str, attrs: dict[str, str]) -> bool:
    name, ident, classes, conditions = step
    if name and tag != name or ident and attrs.get("id") != ident:
        return False
    for attribute, operator, value in conditions:
        own = attrs.get(attribute)
        if own is None or operator == "=" and own != value or operator == "*=" and value not in own:
            return False
    if classes:
        own = attrs.get("class", "").split()
        return all(c in own for c in classes)
    return True


class Selectors:
    """All selectors of a theme as one machine. Its state, one number per path, says how many steps the open tags have
    completed; a tag matches a path when it fits the last step and all steps before are complete."""

    _KEPT = 4096  # tags whose steps are remembered

    def __init__(self, texts: set[str]):
        self.paths = {text: steps_of(text) for text in texts}
        self.long = list(dict.fromkeys(p for paths in self.paths.values() for p in paths if len(p) > 1))
        self.steps = list(dict.fromkeys(step for paths in self.paths.values() for p in paths for step in p))
        self.asked = sorted({"class", "id", *(c[0] for step in self.steps for c in step[3])})
        self.place = {p: i for i, p in enumerate(self.long)}
        self.start = (0,) * len(self.long)
        self.known: dict[tuple, frozenset] = {}
        self.hits: dict[tuple, frozenset] = {}

    def fitting(self, tag: str, attrs: dict[str, str]) -> frozenset:
        """The steps that the tag fits."""
        key = (tag, *map(attrs.get, self.asked))
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self._KEPT:
                self.known.clear()
            found = self.known[key] = frozenset(s for s in self.steps if fits(s, tag, attrs))
        return found

    def inside(self, state: tuple, own: frozenset) -> tuple:
        """The state inside a tag."""
        if not own or not state:
            return state
        return tuple(n + 1 if n < len(p) - 1 and p[n] in own else n for n, p in zip(state, self.long))

    def matched(self, state: tuple, own: frozenset) -> frozenset:
        """The selectors that a tag with these steps matches in this state; both have few different values."""
        found = self.hits.get((state, own))
        if found is None:
            found = self.hits[state, own] = frozenset(
                text for text, paths in self.paths.items()
                if any(p[-1] in own and (len(p) == 1 or state[self.place[p]] == len(p) - 1) for p in paths)
            )
        return found


#: comments and declarations, the insides of scripts, tags
_MARK = re.compile(
    r"""<!--.*?-->|<[!?][^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Tags:
    """The open tags of a page, read from its text one after the other."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    STEP = 1 << 14  # tags between two stops

    def __init__(self):
        self.tags: list[str] = []
        self.texts: list[tuple[int, Captured]] = []  # what gathers text, with the number of tags around it

    def _leave(self, left: int) -> None:
        del self.tags[left:]
        if self.texts:
            self.texts = [t for t in self.texts if t[0] < left]
        self.closed(left)

    def opened(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        """A tag begins; one that is not empty is pushed on ``tags``."""

    def closed(self, left: int) -> None:
        """Only the first ``left`` tags are open any more."""

    def _text(self, text: str) -> None:
        text = unescape(text)
        for _, captured in self.texts:
            captured.parts.append(text)

    def read(self, html: str) -> Iterator[None]:
        """Reads the page; stops now and then, and at its end."""
        at = 0
        for n, mark in enumerate(_MARK.finditer(html), 1):
            if self.texts and mark.start() > at:
                self._text(html[at : mark.start()])
            at = mark.end()
            _, closes, tag, inside = mark.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if closes:
                for place in range(len(self.tags) - 1, -1, -1):
                    if self.tags[place] == tag:
                        self._leave(place)
                        break
                continue
            if tag == "li" and self.tags and self.tags[-1] == "li":
                self._leave(len(self.tags) - 1)
            attrs = {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(inside)} if inside else {}
            if "&" in inside:
                attrs = {k: unescape(v) for k, v in attrs.items()}
            self.opened(tag, attrs, tag in self.VOID or inside.endswith("/"))
            if n % self.STEP == 0:
                yield
        if self.texts:
            self._text(html[at:])
        self._leave(0)
        yield


class Captured:
    """A matched tag: its attributes and the text inside."""

    __slots__ = ("attrs", "parts")

    def __init__(self, attrs: dict[str, str]):
        self.attrs, self.parts = attrs, []

    def text(self) -> str:
        return "".join(self.parts).strip()


class Item(Captured):
    """An item of a rule, with the first match of each of the rule's selectors inside it."""

    __slots__ = ("rule", "tag", "depth", "pos", "states", "pending", "found")

    def __init__(self, rule: dict, tag: str, attrs: dict[str, str], depth: int, pos: int, state: tuple):
        super().__init__(attrs)
        self.rule, self.tag, self.depth, self.pos = rule, tag, depth, pos
        self.states, self.pending, self.found = [state], set(rule["wanted"]), {}


class Theme:
    """The rules of a theme, with the selectors that each looks for inside an item."""

    def __init__(self, rules: list[dict]):
        self.rules, texts = [], set()
        for rule in rules:
            places = [s.strip().partition(":")[0] for s in (*rule["titulo"].split(","), rule["fecha"])]
            holders = [a.strip().rpartition(":")[0] for a in rule["atributos"].split(",")]
            wanted = list(dict.fromkeys(filter(None, (rule["enlace"], *places, *holders, "img"))))
            self.rules.append({**rule, "wanted": wanted})
            texts |= {rule["elemento"], *wanted}
        self.selectors = Selectors(texts)

    def starting(self, matched: frozenset) -> list[int]:
        """The rules of which a tag with these matches is an item."""
        return [r for r, rule in enumerate(self.rules) if rule["elemento"] in matched] if matched else []


class Page(Tags):
    """Items of a page by all rules of its theme."""

    def __init__(self, theme: Theme):
        super().__init__()
        self.theme, self.states = theme, [theme.selectors.start]
        self.items: list[Item] = []
        self.counts = [0] * len(theme.rules)
        self.done: list[Item] = []

    def opened(self, tag, attrs, empty):
        selectors, depth = self.theme.selectors, len(self.tags)
        own = selectors.fitting(tag, attrs)
        for item in self.items:
            if own:
                for text in selectors.matched(item.states[-1], own) & item.pending:
                    item.pending.remove(text)
                    item.found[text] = captured = Captured(attrs)
                    if not empty:
                        self.texts.append((depth, captured))
            if not empty:
                item.states.append(selectors.inside(item.states[-1], own))
        if own:
            for r in self.theme.starting(selectors.matched(self.states[-1], own)):
                item = Item(self.theme.rules[r], tag, attrs, depth, self.counts[r], selectors.inside(selectors.start, own))
                self.counts[r] += 1
                (self.done if empty else self.items).append(item)
        if not empty:
            self.states.append(selectors.inside(self.states[-1], own))
            self.tags.append(tag)

    def closed(self, left):
        del self.states[left + 1 :]
        if self.items:
            self.done += [i for i in self.items if i.depth >= left]
            self.items = [i for i in self.items if i.depth < left]
            for item in self.items:
                del item.states[left - item.depth :]


def cover_of(item: Item) -> str:
    """Cover behind lazy loading; inline placeholders do not count."""
    img = item if item.tag == "img" else item.found.get("img")
    if img is None:
        return ""
    last_of_set = img.attrs.get("srcset", "").split(",")[-1].strip().split(" ")[0]
    src = img.attrs.get("data-src") or img.attrs.get("data-lazy-src") or last_of_set or img.attrs.get("src") or ""
    return "" if src.startswith("data:") else src


FOUND = "url_pagina string, tema string, reserva int, pos int, titulo string, href string, url string, portada string, fecha_texto string, numero_texto string"


def text_at(item: Item, place: str) -> str:
    """Text of the first match of a selector, or of its attribute after a colon."""
    selector, _, attribute = place.strip().partition(":")
    captured = item.found.get(selector)
    if captured is None:
        return ""
    return captured.attrs.get(attribute, "").strip() if attribute else captured.text()


def _title(item: Item, link: Captured | None, rule: dict, para: str) -> str:
    """The first title that the rule's places give."""
    own = next((t for t in (text_at(item, s) for s in rule["titulo"].split(",")) if t), "")
    candidates = []
    for name in filter(None, (a.strip() for a in rule["atributos"].split(","))):
        tag, _, attribute = name.rpartition(":")
        holder = item.found.get(tag) if tag else link
        candidates.append(holder.attrs.get(attribute, "") if holder is not None else "")
    text = link.text() if link is not None and rule["enlace"] else ""
    if para == "series":
        order = [*candidates, own, text if not rule["atributos"] else ""]
    else:
        order = [own, *candidates, text.split("\n")[0].strip() if rule["atributos"] else text]
    return next((t.strip() for t in order if t.strip()), "")


_PLAIN_PATH = re.compile(r"/(?:[\w%~-][\w%~.-]*/?)+")
_PLAIN_URL = re.compile(r"https?://[a-z0-9.-]+(?:/[\w%~-][\w%~.-]*)*/?")


def absolute(url: str, href: str) -> str:
    """The address that a link on a page leads to."""
    if _PLAIN_PATH.fullmatch(href):  # most links: nothing to resolve
        at = url.find("/", url.find("://") + 3) if "://" in url else 0
        if at:
            return (url[:at] if at > 0 else url) + href
    elif _PLAIN_URL.fullmatch(href):
        return href
    return urljoin(url, href) if href else ""


def _row(item: Item, url: str, theme: str, para: str) -> tuple:
    rule = item.rule
    link = item.found.get(rule["enlace"]) if rule["enlace"] else item
    href = link.attrs.get("href", "") if link is not None else ""
    return (
        url, theme, rule["reserva"], item.pos, _title(item, link, rule, para), href, absolute(url, href),
        cover_of(item), text_at(item, rule["fecha"]), item.attrs.get(rule["numero"], "") if rule["numero"] else "",
    )


_ROWS = 4096  # items that are handed on together


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_FOUND = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in FOUND.split(", ")])


def _items(themes: dict[str, list[dict]], para: str):
    """Items of each page by all rules of its theme; a page is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, rows = {t: Theme(rules) for t, rules in themes.items()}, []
        for batch in batches:
            for url, html, theme in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "tema"))):
                page, kept = Page(made[theme]), Kept(made[theme], para == "series")
                for _ in page.read(html or ""):
                    rows += [_row(item, url, theme, para) for item in kept.add(page.done)]
                    page.done.clear()
                    if len(rows) >= _ROWS:
                        yield _batch(rows, _FOUND)
                        rows = []
                rows += [_row(item, url, theme, para) for item in kept.rest()]
        yield _batch(rows, _FOUND)

    return run


class Kept:
    """Items of a page that count: all, or those of the first rules in reserve that find any."""

    def __init__(self, theme: Theme, choose: bool):
        self.first = min(rule["reserva"] for rule in theme.rules) if choose else None
        self.waiting: list[Item] | None = [] if choose else None

    def add(self, items: list[Item]) -> list[Item]:
        if self.first is None:
            return list(items)
        sure = [i for i in items if i.rule["reserva"] == self.first]
        if sure:
            self.waiting = None
        elif self.waiting is not None:
            self.waiting += items
        return sure

    def rest(self) -> list[Item]:
        least = min((i.rule["reserva"] for i in self.waiting or []), default=0)
        return [i for i in self.waiting or [] if i.rule["reserva"] == least]


def _extract(pages: DataFrame, sites: DataFrame, rules: DataFrame, para: str) -> DataFrame:
    """Raw items of each page. ``pages``: url, html. ``sites``: host, tema (one row per host)."""
    themes: dict[str, list[dict]] = {}
    for rule in rules.where(F.col("para") == para).collect():  # written by hand, a line per theme and markup
        themes.setdefault(rule.tema, []).append({k: v or "" for k, v in rule.asDict().items()} | {"reserva": int(rule.reserva)})
    known = small_side(sites.where(F.col("tema").isin(list(themes))).select("host", "tema"))
    ruled = pages.select("url", "html", host_of("url").alias("host")).join(known, "host")
    return ruled.select("url", "html", "tema").mapInArrow(_items(themes, para), FOUND)


def extract_series(pages: DataFrame, sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Series of listing pages; rules in reserve count only on pages where the first ones find nothing."""
    kept = _extract(pages, sites, rules, "series")
    return kept.where("titulo <> '' AND url <> ''").select("url_pagina", "pos", "titulo", "url", "portada")


def extract_chapters(pages: DataFrame, sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Chapters of series pages; locked ones (no link) are dropped."""
    found = _extract(pages, sites, rules, "capitulos").where("href <> '' AND href <> '#'")
    # card lists put the number first in the title and the date in words
    cards = F.col("tema") == "tarjetas"
    leading = F.nullif(F.regexp_extract("titulo", r"^[0-9]+(?:\.[0-9]+)?", 0), F.lit(""))
    found = found.withColumn("titulo", F.when(cards & leading.isNotNull(), F.concat(F.lit("Chapter "), leading)).otherwise(F.col("titulo")))
    found = found.withColumn("fecha_texto", F.when(cards, worded_day(F.col("fecha_texto"))).otherwise(F.col("fecha_texto")))
    stated = F.nullif(F.floor(F.col("numero_texto").try_cast("double")).cast("int"), F.lit(0))
    number = F.coalesce(stated, chapter_number("titulo"), chapter_number("href"))
    return found.select(
        "url_pagina", "pos", number.alias("numero"), "titulo", "url",
        F.nullif("fecha_texto", F.lit("")).alias("fecha_texto"),
    )


def worded_day(c: Column) -> Column:
    """Day of ``Sept. 15, 2026, 3:04 p.m.`` as yyyy-MM-dd; NULL when there is none."""
    parts = [F.regexp_extract(c, r"^([A-Za-z]{3})[a-z]*\.? +([0-9]{1,2}), *([0-9]{4})", i) for i in (1, 2, 3)]
    return F.date_format(F.try_to_timestamp(F.concat_ws(" ", *parts), F.lit("MMM d yyyy")), "yyyy-MM-dd")


DETAILS = "url string, titulo string, titulos_alternativos array<string>"
_DETAILS = pa.schema([("url", pa.string()), ("titulo", pa.string()), ("titulos_alternativos", pa.list_(pa.string()))])


class Details(Tags):
    """Title and other names of a series on its own page."""

    HEADS, OTHERS = ("h1.novel-title", "h1[itemprop=name]"), "h2.alternative-title"
    HIDDEN = "div[aria-hidden=true]"
    SELECTORS = Selectors({*HEADS, OTHERS, HIDDEN})

    def __init__(self):
        super().__init__()
        self.found: dict[str, Captured] = {}
        self.around: dict[str, dict] = {}  # what holds a title
        self.holders: list[dict] = [{}]  # per open tag, the first hidden name inside

    def opened(self, tag, attrs, empty):
        own = self.SELECTORS.fitting(tag, attrs)
        for text in self.SELECTORS.matched((), own) if own else ():
            captured = Captured(attrs)
            if not empty:
                self.texts.append((len(self.tags), captured))
            if text == self.HIDDEN:
                for holder in self.holders:
                    holder.setdefault("name", captured)
            elif text not in self.found:
                self.found[text], self.around[text] = captured, self.holders[-1]
        if not empty:
            self.tags.append(tag)
            self.holders.append({})

    def closed(self, left):
        del self.holders[left + 1 :]

    def names(self) -> tuple[str, list[str]]:
        head = next((h for h in self.HEADS if h in self.found), None)
        title = self.found[head].text() if head else ""
        others = [t.strip() for t in self.found[self.OTHERS].text().split("•")] if self.OTHERS in self.found else []
        if head and "name" in self.around[head]:
            others.append(self.around[head]["name"].text())
        return title, list(dict.fromkeys(t for t in others if t and t != title and t.lower() != "updating"))


def _details(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, html in zip(batch.column("url"), batch.column("html")):
            page = Details()
            for _ in page.read(html.as_py() or ""):
                pass
            rows.append((url.as_py(), *page.names()))
        yield _batch(rows, _DETAILS)


def series_details(pages: DataFrame) -> DataFrame:
    """Full title and other names from the page of a series, for listings that cut titles. ``pages``: url, html."""
    return pages.select("url", "html").mapInArrow(_details, DETAILS)


def complete_series(series: DataFrame, details: DataFrame) -> DataFrame:
    """Series with the title and names their own page gives. ``series``: url, titulo, titulos_alternativos."""
    d = details.select("url", F.col("titulo").alias("_t"), F.col("titulos_alternativos").alias("_a"))
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("titulos_alternativos", none), F.coalesce("_a", none)))
    return series.join(d, "url", "left").withColumns(
        {"titulo": F.coalesce(F.nullif("_t", F.lit("")), F.col("titulo")), "titulos_alternativos": both}
    ).drop("_t", "_a")


_ANCHOR = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""


def page_anchors(pages: DataFrame) -> DataFrame:
    """Every link of every page with its visible text: page_id, pos, href, texto. No Python involved."""
    both = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1)).alias("h"),
        F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2)).alias("t"),
    )
    rows = pages.select("page_id", F.posexplode(both).alias("pos", "a"))
    text = F.regexp_replace(F.regexp_replace("a.t", "<[^>]+>", ""), r"\s+", " ")
    return rows.select("page_id", "pos", F.col("a.h").alias("href"), trim_ws(text).alias("texto"))


def anchor_chapters(pages: DataFrame) -> DataFrame:
    """Links whose text names a chapter, each target once per page."""
    marked = page_anchors(pages).where(F.col("href").startswith("http") & F.col("texto").rlike("(?iu)cap[íi]tulo|chapter"))
    once = marked.groupBy("page_id", "href").agg(F.min_by("texto", "pos").alias("titulo"))
    return once.select(
        "page_id", "titulo", F.col("href").alias("url"),
        F.coalesce(chapter_number("titulo"), chapter_number("href")).alias("numero"),
    )
