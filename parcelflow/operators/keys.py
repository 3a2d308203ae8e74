"""Null-safe equi-join helper: NULL keys form a group of their own, as in GROUP BY."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
            residual=None) -> DataFrame:
    """Join on ``keys`` with ``<=>`` and keep the left key columns only.

    ``residual`` is an extra boolean Column over the other columns of both sides.
    """
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    if residual is not None:
        cond = cond & residual
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def group_key(*columns: Column | str) -> Column:
    """One non-NULL string that is equal exactly when all columns are equal, NULLs included.

    The values themselves are in it; the hash in front only lets sorts and joins tell two
    keys apart by their first bytes.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]
    return F.concat_ws("\u0001", F.hex(F.xxhash64(*cols)), *parts)


def digest(key: Column) -> Column:
    """16 bytes in place of a long key, for keys that travel with many rows."""
    return F.unhex(F.md5(key))
