"""Text functions: Column in, Column out, all inside whole-stage codegen unless stated."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters stripped from both ends of a token.
TOKEN_EDGES = ".,;:!?\"'()…»«/\\"
#: Substrings that mark routine health news, and the whole terms one of which must stand beside them.
HEALTH_MARKERS = ("covid", "coronavirus", "vaccin", "carantin", "pcr")
ROUTINE_HEALTH_TERMS = (
    "cazuri", "decese", "decedat", "bilant", "infectari", "infectare", "internati", "pacienti", "respiratie asistata", "stare grava", "donat plasma", "doneze plasma",
    "donare", "plasma", "doze", "lot", "punctele mobile", "amplasate", "programate", "prezentat pentru vaccinare", "campania de vaccinare", "maratonul de vaccinare",
    "test pcr", "diamond princess", "nava", "croaziera", "pasagerii",
)


@lru_cache(1)
def accent_table() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks that are one letter with marks, and those letters."""
    pairs = []
    for c in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(c):
            pairs.append((chr(c), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def clean_text(c: Column) -> Column:
    """Null to empty; lower case; symbols of category So out; white space to single spaces; trimmed."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{So}", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def strip_diacritics(c: Column) -> Column:
    """Marks off letters, precomposed or not. Compatibility forms (ligatures, full width) stay: see strip_diacritics_exact."""
    return F.regexp_replace(F.translate(c, *accent_table()), r"\p{M}+", "")


def strip_diacritics_exact(c: Column) -> Column:
    """NFKD without combining marks, for every script (an Arrow function: Catalyst has no normalisation)."""
    import pandas as pd

    def stripped(s):  # noqa: ANN001, ANN202
        return pd.Series([None if not isinstance(x, str) else "".join(y for y in unicodedata.normalize("NFKD", x) if not unicodedata.combining(y)) for x in s])

    return F.pandas_udf(stripped, "string", F.PandasUDFType.SCALAR)(c)


def deep_clean(c: Column) -> Column:
    """clean_text that also drops tags, entities, links and every character but words, spaces, apostrophes and hyphens."""
    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{So}", "")
    for pattern in (r"<[^>]+>", r"(?U)&\w+;", r"(?U)https?://\S+", r"(?U)[^\w\s'-]"):
        x = F.regexp_replace(x, pattern, " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Tokens of a text: hyphens and dashes split, edges stripped, marks off, short and numeric ones out.

    All of it is done on the whole text, where one pass of a pattern costs less than a call for every token.
    """
    edge = "[" + "".join(f"\\{x}" for x in TOKEN_EDGES if x not in "…»«") + "…»«]+"
    plain = F.concat(F.lit(" "), F.regexp_replace(strip_diacritics(F.coalesce(c, F.lit(""))), r"(?U)[\s\-–—]+", " "), F.lit(" "))
    bare = F.regexp_replace(F.regexp_replace(plain, f"(?<= ){edge}|{edge}(?= )", ""), "(?<= )[0-9]+(?= )", "")
    return F.filter(F.split(bare, " "), lambda w: F.length(w) > 2)


def remove_stopwords(c: Column, stopwords: list[str]) -> Column:
    """The tokens of a text that are not among the stopwords, joined by spaces. `stopwords` is a bounded list (hundreds)."""
    words = sorted(set(stopwords))
    return F.array_join(F.filter(tokens(c), lambda w: ~w.isin(words)), " ")  # isin becomes a hash set


def document_nostop(c: Column, stopwords: list[str]) -> Column:
    """A whole document, cleaned, without its stopwords."""
    return remove_stopwords(clean_text(c), stopwords)


def normalize_text(c: Column) -> Column:
    """Lower case, marks off, every run of other characters one space, trimmed: the form in which terms are looked up."""
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def contains_any(normalized: Column, terms: tuple[str, ...]) -> Column:
    """Whether one of the terms stands in a normalised text as a whole token or phrase."""
    return normalized.rlike("(^| )(" + "|".join(terms) + ")( |$)")


def contains_substring(normalized: Column, needles: tuple[str, ...]) -> Column:
    return normalized.rlike("|".join(needles))


def routine_health(normalized: Column) -> Column:
    return contains_substring(normalized, HEALTH_MARKERS) & contains_any(normalized, ROUTINE_HEALTH_TERMS)


def safe_name(c: Column) -> Column:
    """A label as a file name: runs of other characters become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), F.lit("_"))


def shorten(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def fix_link(c: Column) -> Column:
    """https:// in front of links without a scheme."""
    return F.when(F.trim(c) == "", F.lit("")).when(c.rlike("^https?://"), c).otherwise(F.concat(F.lit("https://"), c))


def label(c: Column, names: dict[str, str]) -> Column:
    """A display label: from the map, else the value with underscores as spaces and initials capital."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, c), F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def fingerprint(texts: Column) -> Column:
    """SHA-256 of an array of texts in its order, joined by NUL characters."""
    return F.sha2(F.array_join(texts, "\u0000"), 256)
