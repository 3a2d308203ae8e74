"""Residential-complex names: transliteration, tokens, match key, extraction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelflow.functions import vocabulary as V
from parcelflow.functions.text import collapse, let

# Letters of words, codes that name nothing, and the words that announce a complex.
_SPLIT = "[^0-9A-Za-zА-Яа-яЁёЎўҚқҒғҲҳ]+"
_NOISE = "^(?:" + "|".join(V.COMPLEX_NOISE) + r"|\d+|.|u\d?k\d?|id\d*|[abr]\d+)$"
_DISTRICT = "^(?:" + "|".join(V.DISTRICT_TOKENS) + ")$|(?:" + "|".join(V.DISTRICT_ENDINGS) + ")$"
_NAMED = (
    r"(?U)(?iu:(?<![A-Za-zА-Яа-яЁё0-9])(?:жк|ж/к|ж\.\s?к|жилой\s+комплекс|residential\s+complex))"
    "[\\s:«»“”‘’„‟\"'`\\-–—]*"
    r"([A-Za-zА-ЯЁ][\w&.\-]*(?:\s+[A-Za-zА-Яа-яЁё][\w&.\-]*){0,5})"
)


def transliterate(text: Column) -> Column:
    """B10."""
    out = F.translate(F.lower(text), "".join(V.TRANSLIT_SINGLE), "".join(V.TRANSLIT_SINGLE.values()))
    for letter, latin in V.TRANSLIT_MULTI.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def slug_text(text: Column) -> Column:
    """B10 for slugs: a Latin lower-case form; other letters and signs become dashes."""
    out = F.lower(text)
    for letter, latin in V.SLUG_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    for letter in V.SLUG_UNKNOWN:
        out = F.replace(out, F.lit(letter), F.lit("-"))
    return F.trim(F.regexp_replace(transliterate(out), "[^a-z0-9]+", "-"), F.lit("-"))


def _tokens(name: Column) -> Column:
    """Array of (raw, canon, noise, place) for the words that leave any Latin letter or digit."""
    words = F.transform(
        F.split(F.coalesce(name, F.lit("")), _SPLIT),
        lambda raw: F.struct(raw.alias("raw"), F.regexp_replace(transliterate(raw), "[^a-z0-9]+", "").alias("canon")))
    return F.transform(
        F.filter(words, lambda w: w["canon"] != ""),
        lambda w: F.struct(w["raw"].alias("raw"), w["canon"].alias("canon"), w["canon"].rlike(_NOISE).alias("noise"),
                           w["canon"].rlike(_DISTRICT).alias("place")))


def _branded(tokens: Column) -> Column:
    """Place words count only when nothing else is left to name the complex."""
    has_brand = F.exists(tokens, lambda t: ~t["place"])
    return F.filter(tokens, lambda t: ~t["place"] | ~has_brand)


def name_tokens(name: Column) -> Column:
    """B12."""
    return let(F.filter(_tokens(name), lambda t: ~t["noise"]), _branded)


def match_key(name: Column) -> Column:
    """Spellings of one complex share this key."""
    canon = F.create_map(*[F.lit(x) for pair in V.PHONETIC.items() for x in pair])
    return F.array_join(
        F.transform(name_tokens(name), lambda t: F.coalesce(F.try_element_at(canon, t["canon"]), t["canon"])), "")


def clean_name(name: Column) -> Column:
    """Up to four tokens as written."""
    return collapse(F.array_join(F.slice(F.transform(name_tokens(name), lambda t: t["raw"]), 1, 4), " "))


def extract_name(text: Column) -> Column:
    """The words behind a complex keyword up to the first noise word; NULL without a usable name."""
    def leading(tokens: Column) -> Column:
        stop = F.array_position(F.transform(tokens, lambda t: t["noise"]), True)
        return F.slice(F.when(stop > 0, F.slice(tokens, F.lit(1), (stop - 1).cast("int"))).otherwise(tokens), 1, 6)

    def joined(tokens: Column) -> Column:
        return collapse(F.array_join(F.slice(F.transform(_branded(tokens), lambda t: t["raw"]), 1, 4), " "))

    tokens = _tokens(F.regexp_extract(F.coalesce(text, F.lit("")), _NAMED, 1))
    name = let(let(tokens, leading), joined)
    return let(name, lambda n: F.when(F.length(match_key(n)) >= 2, n))
