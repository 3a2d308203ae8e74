"""Segment, material, year and micro-location of a listing's text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelflow import constants as K
from parcelflow.functions import vocabulary as V
from parcelflow.functions.text import any_of, first_listed, let


def blob(*texts: Column) -> Column:
    """Lower-case concatenation of the non-empty texts."""
    return F.lower(F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts]))


def year_after(text: Column, hints: list[str], reach: int = 16) -> Column:
    """The first four digits within ``reach`` characters behind the first hint that yields a year."""
    def year_behind(t: Column, hint: str) -> Column:
        at = F.instr(t, hint)
        near = F.substr(t, at + F.lit(len(hint)), F.lit(reach))
        year = F.regexp_extract(near, r"(\d{4})", 1).try_cast("int")
        return F.when((at > 0) & year.between(1900, 2099), year)

    return let(text, lambda t: F.coalesce(*[year_behind(t, hint) for hint in hints]))


def segment(text: Column) -> Column:
    """Markers, then brands, then the building year."""
    return let(text, lambda t: F.when(
        any_of(t, V.NEW_BUILD_MARKERS + V.NEW_BUILD_BRANDS)
        | F.coalesce(year_after(t, V.SEGMENT_YEAR_HINTS) >= K.NEW_BUILD_YEAR, F.lit(False)), "new").otherwise("secondary"))


def material(text: Column) -> Column:
    """B22."""
    return first_listed(text, V.MATERIAL_MARKERS)


def micro_location(text: Column) -> Column:
    """Named massiv, then quarter, then block code, then a known place."""
    name = r"([\w\-]{2,30})"
    block = r"(?U)\b(ттз|ц|с|q)[\s\-]?(\d{1,2})\b"

    def place(t: Column) -> Column:
        quarter = F.nullif(F.regexp_extract(t, rf"(?U)квартал\s+{name}", 1), F.lit(""))
        code = F.nullif(F.regexp_extract(t, block, 1), F.lit(""))
        return F.coalesce(
            F.nullif(F.regexp_extract(t, rf"(?U)масс?ив\s+{name}", 1), F.lit("")),
            F.concat(F.lit("квартал-"), quarter),
            F.concat(code, F.lit("-"), F.regexp_extract(t, block, 2)),
            first_listed(t, [(p, p.replace(" ", "-")) for p in V.KNOWN_LOCATIONS]),
        )

    return let(text, place)
