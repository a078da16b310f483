"""Filters of catalog searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like_literal(text: str) -> str:
    """``text`` with the wildcards of LIKE made ordinary."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains(col: str, text: str) -> Column:
    """Case-insensitive substring match."""
    return F.col(col).ilike(f"%{like_literal(text)}%")


def prefix_any(cols: list[str], text: str) -> Column:
    """Case-insensitive prefix match on any of the columns."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"{like_literal(text)}%") for c in cols])


def same_name(a: Column, b: Column) -> Column:
    """Equality after lower-casing both sides."""
    return F.lower(a) == F.lower(b)


def at_least(col: str, floor: float, missing: float = 0.0) -> Column:
    """Threshold with a value for null."""
    return F.coalesce(F.col(col), F.lit(missing)) >= floor


def missing_or_equal(col: str, value) -> Column:
    """Rows without a version stay visible under a version filter."""
    return F.col(col).isNull() | (F.col(col) == F.lit(value))


def where_given(df: DataFrame, **values) -> DataFrame:
    """Equality filters for the arguments that are not None; no predicate is planned for the others."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def having_ids(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among ``ids``; the set may be of any size."""
    keys = [on] if isinstance(on, str) else on
    return df.join(ids.select(*keys), keys, "left_semi")


def lacking(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows without a partner in ``other``."""
    keys = [on] if isinstance(on, str) else on
    return df.join(other.select(*keys), keys, "left_anti")
