"""Name resolution that prefers no link to a wrong one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_match(facts: DataFrame, index: DataFrame, key: str, target: str) -> DataFrame:
    """``facts`` with the one ``target`` of ``index`` for its ``key``, and a reason.

    ``reason`` is ``resolved`` for exactly one distinct candidate, ``ambiguous`` for several,
    ``missing`` for none or a null key; only the first has a target. The index is grouped before the
    join, so a key with many candidates adds one row.
    """
    found = index.groupBy(key).agg(F.countDistinct(target).alias("candidates"), F.min(target).alias("_one"))
    out = facts.join(found, key, "left")
    n = F.coalesce(F.col("candidates"), F.lit(0))
    return out.select(
        *facts.columns,
        F.when(n == 1, F.col("_one")).alias(target),
        n.alias("candidates"),
        F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("missing").alias("reason"),
    )


def ordered_fallback(facts: DataFrame, fact_id: str, keys: list[Column], index: DataFrame, key: str, target: str) -> DataFrame:
    """The first of ``keys`` that has exactly one target decides: (fact_id, target, step from 1).

    All candidate keys of a fact are looked up in one join; facts without a unique match are left out.
    """
    tried = facts.select(fact_id, F.posexplode(F.array(*keys)).alias("step", key)).where(F.col(key).isNotNull())
    found = index.groupBy(key).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1")
    return tried.join(found, key).groupBy(fact_id).agg(
        F.min_by(target, "step").alias(target), (F.min("step") + 1).cast("long").alias("step"))


def best_related(left: DataFrame, right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join to the one row of ``right`` that comes first in ``order`` (a total order)."""
    first = right.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    return left.join(first, key, "left")


def both_ways(edges: DataFrame, a: str, b: str, node: str = "node", other: str = "other") -> DataFrame:
    """Each edge from either end, so the other end is an equi-join away; an edge to itself comes once."""
    rest = [c for c in edges.columns if c not in (a, b)]
    out = edges.select(F.col(a).alias(node), F.col(b).alias(other), *rest)
    return out.unionByName(edges.where(F.col(a) != F.col(b)).select(F.col(b).alias(node), F.col(a).alias(other), *rest))


def labelled_union(parts: dict[str, DataFrame]) -> DataFrame:
    """One table (surface, ...) of several with the same columns: the discriminator is part of the key."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("surface"), "*") for name, df in parts.items()])
