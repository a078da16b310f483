"""Integrity checks as small reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str) -> DataFrame:
    """(check_name, n_bad): rows of ``child`` whose key is set and has no parent."""
    bad = child.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(check).alias("check_name"), "n_bad")


def duplicates(df: DataFrame, key: list[str], check: str) -> DataFrame:
    """Keys that occur more than once, and null keys."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    return counts.agg(F.count_if((F.col("n") > 1) | null).alias("n_bad")).select(F.lit(check).alias("check_name"), "n_bad")


def violations(df: DataFrame, bad: Column, check: str) -> DataFrame:
    """Rows for which ``bad`` holds."""
    return df.agg(F.count_if(bad).alias("n_bad")).select(F.lit(check).alias("check_name"), "n_bad")


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
