"""Genre labels: canonical names, stable keys, merged lists."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions import text


def _fold(label: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", label) if not 0x300 <= ord(c) < 0x370).lower()
    return re.sub(r"\s+", " ", re.sub("[_-]+", " ", plain)).strip()


def _slug(label: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", label) if not 0x300 <= ord(c) < 0x370).lower()
    return re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", plain))


@cache
def lookup(value: str) -> dict[str, str]:
    """Folded spelling -> 'es' name, 'en' name or 'key'. The genre table is a fixed 73 rows."""
    found: dict[str, str] = {}
    for es, en, aliases in fv.genre_rows():
        for spelling in (es, en, *aliases):
            found[_fold(spelling)] = {"es": es, "en": en, "key": _slug(es)}[value]
    return found


def _literal_map(value: str) -> Column:
    # parsed from one literal and folded to a constant: a few plan nodes in place of hundreds
    return F.from_json(F.lit(json.dumps(lookup(value), ensure_ascii=False)), "map<string,string>")


def folded_label(c: Column) -> Column:
    return text.trim_ws(F.regexp_replace(F.regexp_replace(F.lower(text.fold_accents(c)), "[_-]+", " "), r"\s+", " "))


def canonical_genre(c: Column, lang: str = "es") -> Column:
    """Name of a label in a language; unknown labels stay as they are."""
    known = F.try_element_at(_literal_map("es" if lang == "es" else "en"), folded_label(c))
    return F.coalesce(known, text.trim_ws(c))


def genre_key(c: Column) -> Column:
    """Stable key of a label, the same for every language and spelling."""
    return F.coalesce(F.try_element_at(_literal_map("key"), folded_label(c)), text.slugify(c, None))


def is_known_genre(c: Column) -> Column:
    return F.try_element_at(_literal_map("key"), folded_label(c)).isNotNull()


def keyed(labels: Column) -> Column:
    """Non-blank labels as (key, label) structs, in order."""
    present = F.filter(labels, lambda c: c.isNotNull() & (F.length(text.trim_ws(c)) > 0))
    return F.transform(present, lambda c: F.struct(genre_key(c).alias("key"), text.trim_ws(c).alias("label")))


def first_per_key(pairs: Column) -> Column:
    """Keep the first struct of each key."""

    def add(kept: Column, pair: Column) -> Column:
        known = F.array_contains(F.transform(kept, lambda p: p["key"]), pair["key"])
        return F.when(known, kept).otherwise(F.array_append(kept, pair))

    return F.aggregate(pairs, F.array().cast("array<struct<key:string,label:string>>"), add)


def merge_genres(lists: list[Column], cap: int | None = None) -> Column:
    """One list without repeats (by key), first spelling kept; all labels, or the first ``cap`` (``fixed_values.MAX_GENRES`` in the source)."""
    joined = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    labels = F.transform(first_per_key(keyed(joined)), lambda p: p["label"])
    return labels if cap is None else F.slice(labels, 1, cap)


def genres_in(labels: Column, lang: str = "es") -> Column:
    """Distinct genres named in a language."""
    return F.transform(first_per_key(keyed(labels)), lambda p: canonical_genre(p["label"], lang))


def genre_keys(labels: Column) -> Column:
    return F.transform(F.coalesce(labels, F.array().cast("array<string>")), genre_key)


def has_any(labels: Column, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(genre_keys(labels), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def legacy_slug_target(slug: Column) -> Column:
    """Canonical slug for an old genre slug; NULL when unknown or already canonical."""
    good = F.try_element_at(_literal_map("key"), folded_label(slug))
    return F.when(good != slug, good)


def is_blocked(labels: Column) -> Column:
    return has_any(labels, fv.BLOCKED_GENRES)


def is_adult(title: Column, labels: Column) -> Column:
    words = (
        f"(?iu){text.BEFORE_WORD}uncensored{text.AFTER_WORD}|\\+18|{text.BEFORE_WORD}er[oó]tic"
        f"|{text.BEFORE_WORD}hentai{text.AFTER_WORD}"
    )
    return has_any(labels, fv.BLOCKED_GENRES + fv.EXPLICIT_GENRES) | title.rlike(words)


def stated_demography(labels: Column) -> Column:
    letters = F.transform(
        F.coalesce(labels, F.array().cast("array<string>")),
        lambda c: F.regexp_replace(
            F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]", ""), "^shonen$", "shounen"), "^shojo$", "shoujo"
        ),
    )
    result = F.lit(None).cast("string")
    for name in reversed(fv.DEMOGRAPHIES):
        result = F.when(F.array_contains(letters, name.lower()), name).otherwise(result)
    return result


def demography(labels: Column) -> Column:
    """Stated reader group, else one inferred from the genres, else NULL."""
    inferred = (
        F.when(has_any(labels, fv.ADULT_HINTS), "Seinen")
        .when(has_any(labels, fv.ACTION_HINTS), "Shounen")
        .when(has_any(labels, fv.ROMANCE_HINTS), "Shoujo")
    )
    return F.coalesce(stated_demography(labels), inferred)
