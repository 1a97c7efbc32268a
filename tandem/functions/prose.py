"""Language of titles and prose, synopsis cleaning, status words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions import fixed_values as fv
from tandem.functions.text import ascii_borders, fold_accents, let, trim_ws

_EMPTY = "array<string>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _count_in(words: Column, vocabulary: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(vocabulary)))


def title_facts(c: Column | str) -> Column:
    """What the language rules look at, worked out once per title."""
    t = trim_ws(F.regexp_replace(_col(c), "[\\x{3164}\\x{200b}-\\x{200d}\\x{feff}]", ""))
    words = F.regexp_extract_all(F.lower(fold_accents(t)), F.lit("([a-z]+)"), F.lit(1))
    return F.struct(t.alias("t"), words.alias("words"))


def language_of_facts(facts: Column) -> Column:
    """Decision list: es, en or otro."""
    words = facts["words"]
    long_words = F.filter(words, lambda w: F.length(w) >= 4)
    counts = F.struct(
        facts["t"].alias("t"),
        words.alias("words"),
        _count_in(words, fv.TITLE_WORDS_EN).alias("en"),
        _count_in(words, fv.TITLE_WORDS_ES).alias("es"),
        _count_in(words, fv.TITLE_WORDS_OTHER).alias("other"),
        F.size(F.filter(long_words, lambda w: w.rlike(fv.ENDINGS_ES))).alias("ends_es"),
        F.size(F.filter(long_words, lambda w: w.rlike(fv.ENDINGS_EN))).alias("ends_en"),
        F.exists(long_words, lambda w: w.rlike(fv.ENDINGS_FR)).alias("french"),
    )
    return let(counts, _decide_language)


def _decide_language(c: Column) -> Column:
    t, words, en, es, other = (c[f] for f in ("t", "words", "en", "es", "other"))
    ends_es, ends_en, french = (c[f] for f in ("ends_es", "ends_en", "french"))
    all_pinyin = (F.size(words) >= 2) & F.forall(
        words, lambda w: w.rlike(fv.PINYIN) & ((F.length(w) <= 4) | w.rlike("zh|x|q"))
    )
    french_accent = french | F.exists(words, lambda w: (F.length(w) >= 4) & w.endswith("ssion"))
    return (
        F.when((t == "") | t.rlike("[^\\x{0}-\\x{24f}\\x{2000}-\\x{206f}]"), "otro")
        # lower case first: with (?iu) Java would let the dotless i match a plain one
        .when(F.lower(t).rlike(ascii_borders(f"{fv.OTHER_LATIN}|{fv.ELISION}")), "otro")
        .when(F.size(words) == 0, "otro")
        .when(all_pinyin, "otro")
        .when((other > es) & (other >= en), "otro")
        .when(t.rlike("(?iu)[ñ¿¡áíóú]"), "es")
        .when(t.rlike("(?iu)é"), F.when((es > 0) & ~french_accent, "es").otherwise("otro"))
        .when(french & (ends_en == 0), "otro")
        .when(es > en, "es")
        .when(en > es, "en")
        .when(F.exists(words, lambda w: w.rlike(fv.KOREAN_CLUSTERS)), "otro")
        .when(ends_es > ends_en, "es")
        .when((F.size(words) <= 2) & F.exists(words, lambda w: w.rlike("ae(?!l)")) & (ends_en == 0), "otro")
        .otherwise("en")
    )


def title_language(c: Column | str) -> Column:
    return let(title_facts(c), language_of_facts)


def _candidates(title: Column, alternatives: Column) -> Column:
    names = F.concat(F.array(title), F.coalesce(alternatives, F.array().cast(_EMPTY)))
    format_word = r"(?i)\s(" + "|".join(fv.FORMAT_WORDS) + ")$"
    return F.array_distinct(
        F.filter(names, lambda n: n.isNotNull() & (n != "") & ~trim_ws(n).rlike(format_word))
    )


def tagged_names(title: Column, alternatives: Column) -> Column:
    """Usable names in order, each with its language."""
    return F.transform(
        _candidates(title, alternatives), lambda n: F.struct(n.alias("name"), title_language(n).alias("lang"))
    )


def first_in(names: Column, lang: str) -> Column:
    return F.try_element_at(F.filter(names, lambda n: n["lang"] == lang), F.lit(1))["name"]


def title_in(title: Column, alternatives: Column, lang: str) -> Column:
    """First name in that language, or NULL."""
    return first_in(tagged_names(title, alternatives), lang)


def second_of(title: Column, title_lang: Column, english: Column, spanish: Column, lang: str) -> Column:
    either = F.coalesce(spanish, english)
    pick = F.when(title_lang != "en", english).otherwise(either) if lang == "es" else either
    return let(pick, lambda p: F.when(F.lower(fold_accents(p)) != F.lower(fold_accents(title)), p))


def second_name(title: Column, alternatives: Column, lang: str) -> Column:
    """The name shown beside the title, never the same name again."""

    def choose(names: Column) -> Column:
        return second_of(title, title_language(title), first_in(names, "en"), first_in(names, "es"), lang)

    return let(tagged_names(title, alternatives), choose)


def prose_words(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-záéíóúñü]+)"), F.lit(1))


def is_english_text(c: Column | str) -> Column:

    def decide(words: Column) -> Column:
        enough = F.size(words) >= fv.MIN_PROSE_WORDS
        return enough & (_count_in(words, fv.PROSE_WORDS_EN) > 2 * _count_in(words, fv.PROSE_WORDS_ES))

    return let(prose_words(F.coalesce(_col(c), F.lit(""))), decide)


def source_language(c: Column | str) -> Column:
    """Language a text is translated from: English only with a clear lead, else the base language."""
    c = _col(c)
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), F.lit(1))
    accents = F.when(c.rlike("(?iu)[ñáéíóú¿¡]"), 3).otherwise(0)

    def decide(ws: Column) -> Column:
        return _count_in(ws, fv.SOURCE_WORDS_EN) - _count_in(ws, fv.SOURCE_WORDS_ES)

    return F.when(let(words, decide) > accents + 2, "en").otherwise(fv.BASE_LANGUAGE)


def clean_synopsis(c: Column | str) -> Column:
    """The story paragraphs only: no fact card, no source notes, no links."""
    raw = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\r\n?", "\n")
    paragraphs = F.filter(F.transform(F.split(raw, r"\n{2,}"), trim_ws), lambda p: p != "")
    card = ascii_borders(rf"(?iu){fv.CARD_PARAGRAPH}")

    def from_first_story(ps: Column) -> Column:
        start = F.array_position(F.transform(ps, lambda p: p.rlike(card)), False).cast("int")
        return F.when(start > 0, F.slice(ps, start, F.size(ps))).otherwise(F.array().cast(_EMPTY))

    def up_to_card(ps: Column) -> Column:
        stop = F.array_position(F.transform(ps, lambda p: p.rlike(card)), True).cast("int")
        return F.when(stop > 0, F.slice(ps, 1, stop - 1)).otherwise(ps)

    def polish(p: Column) -> Column:
        for pattern, replacement in fv.PROSE_CLEANING:
            p = F.regexp_replace(p, ascii_borders(pattern), replacement)
        return trim_ws(p)

    story = let(let(paragraphs, from_first_story), up_to_card)
    return F.array_join(F.filter(F.transform(story, polish), lambda p: p != ""), "\n\n")


def status_of(c: Column | str) -> Column:
    raw = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.when(raw.rlike(fv.FINISHED_WORDS), fv.FINISHED).when(raw.rlike(fv.ONGOING_WORDS), fv.ONGOING)
