"""Which input columns an operator hands on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def carried(df: DataFrame, carry: list[str] | None, made: list[str], *, drop: tuple[str, ...] = ()) -> list[str]:
    """The columns named in ``carry`` (default: all but ``drop``), without those that the operator makes itself.

    Names compare without regard to case, as Spark compares them; an operator's own column wins a clash.
    """
    own = {c.lower() for c in made}
    names = [c for c in df.columns if c not in drop] if carry is None else carry
    return [c for c in names if c.lower() not in own]


def named_apart(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, dict[str, str]]:
    """The rows with all columns but those to ``keep`` under plain names, and those names by the given ones.

    An operator's internal columns then clash with no input column, whatever that is called.
    """
    plain = {c: c if c in keep else f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*plain.values()), plain


def named_back(df: DataFrame, plain: dict[str, str]) -> DataFrame:
    """The rows with their given names again; the columns that an operator made stay as they are."""
    given = {p: c for c, p in plain.items()}
    return df.select(*[F.col(c).alias(given.get(c, c)) for c in df.columns])
