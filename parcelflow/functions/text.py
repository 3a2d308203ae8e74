"""Text and number steps of the normalise job, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from parcelflow import constants as K
from parcelflow.functions import vocabulary as V


def collapse(text: Column) -> Column:
    """B1: runs of white space become one space, NULL becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def number(text: Column) -> Column:
    """B2: the digits and dots of a text as a double; a comma is a decimal point."""
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^\d.]", "").try_cast("double")


def json_number(text: Column) -> Column:
    """B2 for a JSON scalar read as text: a plain number keeps its sign."""
    return F.coalesce(text.try_cast("double"), number(text))


def currency(text: Column) -> Column:
    """First marker wins, dollars by default."""
    t = F.lower(F.coalesce(text, F.lit("")))
    usd = t.contains("$") | t.contains("у.е") | t.contains("usd")
    return F.when(~usd & (t.contains("сум") | t.contains("uzs")), "UZS").otherwise("USD")


def to_usd(price: Column, code: Column, rate: float = K.UZS_PER_USD) -> Column:
    """B4."""
    return F.round(F.when(F.upper(code) == "UZS", price / rate).otherwise(price), 2)


def price_per_m2(price_usd: Column, area: Column) -> Column:
    """NULL for an area that is not positive; such rows go to quarantine."""
    return F.when(area > 0, F.round(price_usd / area, 2))


def floor_pair(text: Column) -> tuple[Column, Column]:
    """B6: "4/9" gives floor and height, a lone number the floor."""
    t = collapse(text)
    pair = r"(\d+)\s*/\s*(\d+)"
    first = F.coalesce(F.regexp_extract(t, pair, 1).try_cast("int"), F.regexp_extract(t, r"(\d+)", 1).try_cast("int"))
    return first, F.regexp_extract(t, pair, 2).try_cast("int")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def first_listed(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Value of the first listed marker that occurs in the text."""
    table = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(v).alias("value")) for m, v in pairs])
    return let(text, lambda t: F.try_element_at(
        F.filter(table, lambda s: t.contains(s["marker"])), F.lit(1))["value"])


def district(text: Column, aliases: list[tuple[str, str]] = V.DISTRICT_ALIASES) -> Column:
    """B7/L8."""
    t = F.replace(F.replace(collapse(text), F.lit("р-н"), F.lit("район")), F.lit("рн"), F.lit("район"))
    return F.coalesce(first_listed(F.lower(t), aliases), F.lit(K.UNSPECIFIED_DISTRICT))


def building_key(district_name: Column, address: Column) -> Column:
    """The address without punctuation and stop words, behind its district."""
    words = F.regexp_replace(F.lower(collapse(address)), r"(?U)[^\w]+", " ")
    kept = collapse(F.regexp_replace(words, rf"(?U)\b(?:{'|'.join(V.ADDRESS_STOP_WORDS)})\b", " "))
    return F.when(F.length(kept) >= 5, F.concat(F.lower(district_name), F.lit("::"), F.substring(kept, 1, 180)))


def localized(value: Column) -> Column:
    """Russian, then Uzbek, then English text of a struct."""
    return collapse(F.coalesce(*[F.nullif(value[k], F.lit("")) for k in ("ru", "uz", "en")]))


def instant(text: Column) -> Column:
    """ISO date-time as written, without its offset."""
    bare = F.regexp_replace(text, r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    return bare.try_cast("timestamp_ntz")


# How adverts deny and mention furniture, and how API titles write rooms and area.
UNFURNISHED = r"(?iuU)без\s+мебел|не\s*-?\s*меблир"
FURNISHED = r"(?iuU)меблир|с\s+мебел|вся\s+мебел|есть\s+мебел|мебел\w*\s+есть"
ROOMS_IN_TITLE = [r"(?iu)(\d+)\s*[- ]?комн", r"(?iu)\b([1-8])\s*xon"]
AREA_IN_TITLE = r"(?iu)(\d+(?:[.,]\d+)?)\s*(?:м2|м²|m²|m2)"


def furnished(text: Column) -> Column:
    """A denial wins over a mention; silence is unknown."""
    t = F.coalesce(text, F.lit(""))
    return F.when(t.rlike(UNFURNISHED), False).when(t.rlike(FURNISHED), True)


def yes_no(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t == "yes", True).when(t == "no", False)


def rooms_code(text: Column) -> Column:
    """Studios are one room, "more" five, else 1 to 8."""
    t = F.lower(collapse(text))
    n = json_number(t).cast("int")
    return (F.when(t.isin("studio", "free_layout", "freelayout"), 1).when(n.between(1, 8), n)
            .when(t.contains("more"), 5))


def rooms_in_title(title: Column) -> Column:
    n = F.coalesce(*[F.regexp_extract(title, p, 1).try_cast("int") for p in ROOMS_IN_TITLE])
    return let(n, lambda x: F.when(x.between(1, 8), x))


def area_in_title(title: Column) -> Column:
    n = F.replace(F.regexp_extract(title, AREA_IN_TITLE, 1), F.lit(","), F.lit(".")).try_cast("double")
    return let(n, lambda x: F.when(x.between(10, 500), x))


# How free-form advert titles write rooms and area, in order of trust.
TITLE_ROOMS = [r"(\d+)\s*[- ]?х\s*ком", r"(\d+)\s*[- ]?комнат", r"(\d+)\s*хона", r"(\d+)\s*xon",
               r"\b([1-5])\s*/\s*\d+\s*/\s*\d+\b", r"\b([1-5])в[2-5]\b"]
TITLE_AREA = [r"(\d+(?:[.,]\d+)?)\s*(?:м2|м²|кв\.?\s*м|квадрат)", r"(?:квадрат|квадратов|кв\.?\s*м)\s*(\d+(?:[.,]\d+)?)",
              r"\b\d+\s*/\s*\d+\s*/\s*\d+\s+(\d+(?:[.,]\d+)?)\b"]

TITLE_FIGURES = [r"\b\d+\s*/\s*\d+\s*/\s*\d+\b", r"\d+(?:[.,]\d+)?\s*(?:м2|м²|кв\.?\s*м|квадрат)"]


def first_in_range(text: Column, patterns: list[str], low: float, high: float) -> Column:
    """Number of the first pattern whose capture lies in the range."""
    tries = []
    for pattern in patterns:
        n = F.replace(F.regexp_extract(text, "(?iuU)" + pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        # the pattern runs once for the test and the value
        tries.append(let(n, lambda x: F.when(x.between(low, high), x)))
    return F.coalesce(*tries)


def source_token(text: Column, size: int = 64) -> Column:
    """An acquisition label reduced to safe characters."""
    return F.nullif(F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_\-]", ""), 1, size), F.lit(""))


def language(code: Column) -> Column:
    return F.when(F.lower(F.coalesce(code, F.lit(""))).startswith("uz"), "uz").otherwise("ru")


def any_of(text: Column, words: list[str]) -> Column:
    """Plain substring tests; far cheaper on long texts than one alternation."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])
