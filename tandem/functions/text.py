"""Column expressions for names, slugs, chapter numbers and cleaning.

All of them stay on the JVM. Accent folding uses one ``translate`` whose table is
derived from Unicode data: every character that decomposes to a base character
and marks in U+0300-U+036F maps to that base, and the marks are deleted.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tandem.functions import fixed_values as fv

# white space as web scripts define it; Java's \s is ASCII only
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BEFORE_WORD, AFTER_WORD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def ascii_borders(pattern: str) -> str:
    """The pattern with every ``\\b`` a border between ASCII word signs and others, whatever the flags."""
    w = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")


def filled(template: str, **values: Column) -> Column:
    """A text with columns in place of ``{names}``."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


@cache
def _accent_table() -> tuple[str, str]:
    marks = [chr(c) for c in range(0x300, 0x370)]
    source, target = [], []
    for code in range(0xC0, 0xFFFF):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x300 <= code < 0x370:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = unicodedata.normalize("NFC", "".join(p for p in parts if p not in marks))
        if base != char and len(base) == 1 and len(parts) > 1:
            source.append(char)
            target.append(base)
    return "".join(source) + "".join(marks), "".join(target)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WS_CHARS = " \t\n\x0b\f\r\xa0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def trim_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(_WS_CHARS))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def fold_accents(c: Column | str) -> Column:
    source, target = _accent_table()
    return F.translate(_col(c), source, target)


def normalize_name(c: Column | str) -> Column:
    """Lower case, no accents, letters and digits only, single spaces."""
    folded = F.lower(fold_accents(F.coalesce(_col(c), F.lit(""))))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def _with_sorted_words(keys: Column) -> Column:
    """Each key, and from three words on also the key with its words in order."""

    def expand(key: Column) -> Column:
        words = F.split(key, " ")
        return F.when(F.size(words) >= 3, F.array(key, F.array_join(F.array_sort(words), " "))).otherwise(F.array(key))

    return F.flatten(F.transform(keys, expand))


def keys_of_normalized(n: Column | str) -> Column:
    n = _col(n)
    article = "^(?:" + "|".join(fv.LEADING_ARTICLES) + ") "
    suffix = " (?:" + "|".join(fv.TYPE_SUFFIXES) + ")$"
    bare = F.regexp_replace(n, suffix, "")
    keys = F.array(n, F.regexp_replace(n, article, ""), bare, F.regexp_replace(bare, article, ""))
    return F.array_remove(F.array_distinct(_with_sorted_words(keys)), "")


def name_keys(c: Column | str) -> Column:
    """Ordered keys under which a name is indexed and looked up."""
    return let(normalize_name(c), keys_of_normalized)


def words_of_normalized(n: Column | str) -> Column:
    dropped = F.array(*[F.lit(w) for w in [*fv.STOP_WORDS, *fv.FILLER_WORDS, ""]])
    kept = F.array_except(F.split(_col(n), " "), dropped)
    singular = F.transform(kept, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "(es|s)$", "")).otherwise(w))
    return F.array_distinct(singular)


def content_words(c: Column | str) -> Column:
    """Distinct words that carry a title, plural endings removed."""
    return words_of_normalized(normalize_name(c))


def slugify(c: Column | str, limit: int | None = 80) -> Column:
    dashed = F.regexp_replace(F.lower(fold_accents(_col(c))), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-|-$", "")
    return slug if limit is None else F.substring(slug, 1, limit)


def chapter_number(c: Column | str) -> Column:
    """Chapter number after a chapter word, else the first free-standing number, else NULL."""
    c = _col(c)
    named = F.regexp_extract(c, rf"(?iu)(?:{fv.CHAPTER_WORDS})(?:{WS}|[._-])*#?{WS}*([0-9]{{1,5}})", 1)
    plain = F.regexp_extract(c, BEFORE_WORD + "([0-9]{1,5})" + AFTER_WORD, 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(plain, F.lit(""))).try_cast("int")


TITLE_PREFIX_SQL = (
    rf"(?i)^\s*(?:{fv.TITLE_PREFIX_WORDS})?\s*[-–—:.]?\s*0*([0-9]+(?:[.,][0-9]+)?)\s*[-–—:·.|]?\s*"
)
_TITLE_PREFIX = TITLE_PREFIX_SQL.replace("(?i)", "(?iu)", 1)


def title_rest(title: Column | str, number: Column | str) -> Column:
    """What a chapter title says beyond its own number."""
    t = trim_ws(F.coalesce(_col(title), F.lit("")))
    found = F.regexp_replace(F.regexp_extract(t, _TITLE_PREFIX, 1), ",", ".").try_cast("double")
    rest = trim_ws(F.regexp_replace(t, _TITLE_PREFIX, ""))
    return F.when(found == _col(number), rest).otherwise(t)


def trim_type_marks(c: Column | str) -> Column:
    marks = rf"(?iu)(?:\s*\(?{BEFORE_WORD}(?:{fv.TRAILING_MARKS}){AFTER_WORD}\)?)+\s*$"
    return trim_ws(F.regexp_replace(_col(c), marks, ""))


def clean_title(c: Column | str) -> Column:
    visible = F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[\\x{3164}\\x{200b}-\\x{200d}\\x{feff}]", "")
    return trim_ws(F.regexp_replace(visible, f"{WS}+", " "))


def strip_html(c: Column | str) -> Column:
    """Tags to text: breaks and paragraph ends become newlines, entities are decoded."""
    t = F.coalesce(_col(c), F.lit(""))
    for pattern, replacement in (
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</p>", "\n\n"),
        (r"<[^>]+>", ""),
        ("&nbsp;", " "),
        ("&amp;", "&"),
        ("&#039;|&apos;", "'"),
        ("&quot;", '"'),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, replacement)
    return trim_ws(t)


def sentences(c: Column | str) -> Column:
    """Pieces after ``. ! ? …`` and white space, never an empty list."""
    t = trim_ws(F.coalesce(_col(c), F.lit("")))
    pieces = F.filter(F.split(t, rf"(?<=[.!?…]){WS}+"), lambda s: trim_ws(s) != "")
    return let(pieces, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.lit(""))))


def ellipsis(c: Column, limit: int) -> Column:
    cut = F.concat(F.regexp_replace(F.substring(c, 1, limit - 1), r"\s+$", ""), F.lit("…"))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def thousands(c: Column | str) -> Column:
    """Spanish grouping: dots from five digits on."""
    c = _col(c)
    return F.when(F.abs(c) >= 10_000, F.translate(F.format_number(c, 0), ",", ".")).otherwise(c.cast("string"))


_FNV_PRIME, _FNV_START, _U32 = 0x01000193, 0x811C9DC5, 0xFFFFFFFF
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _base36(h: int) -> str:
    out = ""
    while True:
        h, r = divmod(h, 36)
        out = _DIGITS[r] + out
        if not h:
            return out


def _fnv_of_all(texts: list[str]) -> list[str]:
    """All hashes of a batch: position by position over many texts, then text by text for the long tails."""
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    state = np.full(len(units), _FNV_START, dtype=np.uint64)
    lengths = np.array([len(units[i]) for i in order])
    at, few = 0, 48
    if len(units) >= few:
        shared = int(lengths[few - 1])
        block = 512
        for start in range(0, shared, block):
            live = int((lengths > start).sum())
            wide = np.zeros((live, block), dtype=np.uint64)
            for row in range(live):
                part = units[order[row]][start : start + block]
                wide[row, : len(part)] = part
            for column in range(min(block, shared - start)):
                n = int(np.searchsorted(-lengths, -(start + column), side="left"))
                state[:n] = ((state[:n] ^ wide[:n, column]) * _FNV_PRIME) & _U32
        at = shared
    out = [""] * len(units)
    for row, i in enumerate(order):
        h = int(state[row])
        for u in units[i][at:].tolist():
            h = ((h ^ u) * _FNV_PRIME) & _U32
        out[i] = _base36(h)
    return out


@F.pandas_udf(StringType())
def _fnv_udf(texts: pd.Series) -> pd.Series:
    known = texts.notna()
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    out[known] = _fnv_of_all(list(texts[known]))
    return out


def text_hash(c: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 code units, in base 36.

    Spark has no such hash, and a fold over characters in SQL is far slower
    than this batch function. Several texts can have one hash: it names entries
    of imported and exported cache files, and ``text_key`` tells texts apart.
    """
    return _fnv_udf(_col(c))


def text_key(c: Column | str) -> Column:
    """What identifies a text in joins: SHA-256, in hex."""
    return F.sha2(_col(c), 256)
