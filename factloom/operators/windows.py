"""Window-shaped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: str | list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in a total order. Spark cuts to n before the shuffle too."""
    keys = [by] if isinstance(by, str) else by
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def duplicate_ordinal(df: DataFrame, by: list[str], order: list[Column], name: str = "ordinal") -> DataFrame:
    """0 for the first row of an identity, 1 for the next, and so on."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def first_seen(df: DataFrame, by: str | list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``."""
    return top_n(df, by, order, 1, "_rank").drop("_rank")


def following(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """Edges from each step to the next of its group; last steps have none."""
    nxt = F.lead(value).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn(name, nxt).where(F.col(name).isNotNull())


def carried(df: DataFrame, by: str, order: list[Column], value: str, name: str) -> DataFrame:
    """The last value that is not null, up to and including the row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def nearest_before(points: DataFrame, marks: DataFrame, by: str, at: str, value: str, name: str) -> DataFrame:
    """As-of join: each point with the ``value`` of the last mark of its group at or before it.

    Both sides are put in one sorted run per group, so no pair of a point and a mark is formed;
    ``marks`` with equal place are decided by the greater value.
    """
    cols = points.columns
    left = points.select(*cols, F.lit(None).cast(marks.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    right = marks.select(*[F.col(c) if c in (by, at) else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in cols], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(by).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*cols, name)
