"""Text expressions that stay in the JVM, and the few Arrow functions they need."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MARK = "▁"

# Letters without a decomposition.
PLAIN_LETTERS = {"œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "ß": "ss", "ẞ": "SS", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "th", "ł": "l", "Ł": "L"}


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if t else t)


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKD", t) if t else t)


def without_asides(c: Column) -> Column:
    """Without ``<...>``, ``[...]`` and ``(...)``."""
    return F.regexp_replace(F.regexp_replace(c, r"[<\[].*?[>\]]", ""), r"\([^)]+?\)", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\s ]+", " "), r"^ +| +$", "")


def basic_normalize(c: Column, drop_diacritics: bool = False) -> Column:
    """Lower case, no asides, compatibility form, marks, symbols and punctuation as blanks; with ``drop_diacritics`` accents vanish instead."""
    c = without_asides(F.lower(c))
    if drop_diacritics:
        c = nfkd(c)
        for letter, plain in PLAIN_LETTERS.items():
            c = F.replace(c, F.lit(letter), F.lit(plain))
        c = F.regexp_replace(c, r"\p{Mn}", "")
    else:
        c = nfkc(c)
    return squeezed(F.regexp_replace(c, r"[\p{M}\p{S}\p{P}]", " "))


# Code points by script; ASCII is neutral but for its letters.
SCRIPTS = {
    "latin": r"[\x{20}-\x{7F}\x{A0}-\x{24F}\x{300}-\x{36F}\x{1E00}-\x{1EFF}]",
    "cyrillic": r"[\x{20}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}\x{400}-\x{4FF}]",
    "greek": r"[\x{20}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}\x{300}-\x{36F}\x{370}-\x{3FF}\x{1F00}-\x{1FFF}]",
}


def in_script(c: Column, script: str) -> Column:
    """All characters fit the script; word marks are ignored, an empty piece fits any."""
    return F.replace(c, F.lit(MARK), F.lit("")).rlike(rf"\A{SCRIPTS[script]}*\z")


def is_cjk(lang: Column) -> Column:
    return F.lower(lang).rlike(r"^(ja|ko|cmn|yue|zh|th|lo)")


def cjk_rate(hyp: Column, ref: Column) -> Column:
    """Character error rate without blanks; 0 for an empty reference."""
    h, r = F.regexp_replace(hyp, r"\s+", ""), F.regexp_replace(ref, r"\s+", "")
    return F.when(F.length(r) > 0, F.levenshtein(h, r) / F.length(r)).otherwise(F.lit(0.0))


def looks_like_html(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?is)\A\s*<(!doctype|html)"), F.lit(False))


def for_similarity(c: Column) -> Column:
    """Lower case letters, digits, blanks, apostrophes and hyphens."""
    return squeezed(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s'-]", " "))


def like_case(original: Column, new: Column) -> Column:
    """``new`` with a capital if ``original`` begins with one."""
    return F.when(original.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 20))).otherwise(new)


def required_similarity(least: Column, words: Column, floor: float = 0.55) -> Column:
    return F.when(words >= 2, F.greatest(least, F.lit(floor))).otherwise(least)


# Function words, which raise the floor of a span; with the common words they are never replaced alone.
FUNCTION_WORDS = """a an the some any no every each all and or but so if then than as
in on at to for of with by from up down out about into over after before between under
is are was were be been being am have has had do does did will would can could
i you he she it we they me him her us them my your his its our their this that these those
who what which where when how why""".split()
COMMON_WORDS = """go goes went come comes came get got take took make made say said see saw know knew think thought
just also only even still now here there very well back way own new old good great first last""".split()


def replacement_floor(word: Column, term: Column, words: Column, least: Column) -> Column:
    """Similarity a replacement must reach; null where all words are function or common words. Spans with function words need 0.85, words much shorter than the term 0.80."""
    floor = required_similarity(least, words)
    floor = F.when(F.arrays_overlap(F.split(word, " "), F.array(*[F.lit(w) for w in FUNCTION_WORDS])) & (words >= 2), F.greatest(floor, F.lit(0.85))).otherwise(floor)
    floor = F.when((F.length(word) / F.length(term) < 0.75) & (F.length(word) <= 4), F.greatest(floor, F.lit(0.80))).otherwise(floor)
    return F.when(F.forall(F.split(word, " "), lambda w: w.isin(*FUNCTION_WORDS, *COMMON_WORDS)), None).otherwise(floor)


def term_warnings(c: Column) -> Column:
    """What is unusual about a vocabulary term."""
    return F.array_compact(F.array(
        F.when(c.rlike(r"\p{Cc}"), F.lit("control")), F.when(nfkd(c).rlike(r"\p{Mn}"), F.lit("diacritics")),
        F.when(c.rlike(r"[0-9]"), F.lit("digits")), F.when(c.rlike(r"[^\p{L}\p{N}\s'.-]"), F.lit("unusual"))))


def clean_term(c: Column) -> Column:
    """Terms with control characters lose line breaks and tabs; others stay."""
    return F.when(c.rlike(r"\p{Cc}"), F.regexp_replace(c, r"[\r\n\t]", "")).otherwise(c)


def normalize_japanese(c: Column) -> Column:
    """Full-width and kanji numbers below a hundred as digits, larger units as their powers, no punctuation or white space, lower case."""
    one, more = "一二三四五六七八九", "二三四五六七八九"
    for pattern, to in ((f"([{more}])十([{one}])", "$1$2"), (f"十([{one}])", "一$1"), (f"([{more}])十", "$1〇"), ("百", "100"), ("千", "1000"), ("万", "10000"), ("十", "10")):
        c = F.regexp_replace(c, pattern, to)
    c = F.translate(c, "０１２３４５６７８９〇零一二三四五六七八九", "012345678900123456789")
    # fixed values: Japanese and ASCII punctuation that is dropped
    return F.lower(F.regexp_replace(c, r"[、。！？・…「」『』（）［］｛｝【】,.!?;:'\"()\[\]{}\-\s\x{3000}]", ""))


def pieces_to_text(pieces: Column) -> Column:
    """Joined pieces, unknown ones (null) left out, word marks as blanks."""
    return F.trim(F.replace(F.array_join(F.filter(pieces, lambda p: p.isNotNull()), ""), F.lit(MARK), F.lit(" ")))


def is_initialism(c: Column) -> Column:
    """Two to five capitals, or capitals with dots."""
    return c.rlike(r"^(?:[A-Z]{2,5}|(?:[A-Z]\.){2,})$")


def spelled(c: Column) -> Column:
    """Letters of an initialism apart."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("."), F.lit("")), r"(.)", "$1 "))


def tags(c: Column) -> Column:
    """Opening tags as ``(name, attributes)``."""
    found = F.regexp_extract_all(c, F.lit(r"<([A-Za-z][A-Za-z0-9-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*/?>"), 1)
    return F.transform(found, lambda t: F.struct(
        F.lower(F.regexp_extract(t, r"^([\w-]+)", 1)).alias("name"),
        F.map_from_arrays(F.array_distinct(F.regexp_extract_all(t, F.lit(r"([\w:-]+)\s*=\s*[\"']"), 1)),
                          F.slice(F.regexp_extract_all(t, F.lit(r"=\s*[\"']([^\"']*)[\"']"), 1), F.lit(1), F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"([\w:-]+)\s*=\s*[\"']"), 1))))).alias("attributes")))
