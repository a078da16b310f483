"""Owners that follow from keys: none, one or several, and rows that break the rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.scratch import removed, written


def owners(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, state, owner, least, most): whose each row is, by itself or along ``keys`` (child, parent).

    ``rows`` are (row, owner); a row has its own owner and those of all its parents. Owners are kept as
    their least and greatest, a small lattice (none, one, several) in which a row rises twice at most;
    every round joins the rows that the last one changed, so a fixed point is reached whatever the keys.
    """
    spark, paths = rows.sparkSession, []
    keys = written(keys.where("child is not null and parent is not null").select("child", "parent").distinct())
    now = written(rows.groupBy("row").agg(F.min("owner").alias("least"), F.max("owner").alias("most")))
    changed = written(now.where("least is not null"))
    while not changed.isEmpty():
        offer = keys.join(changed.select(F.col("row").alias("parent"), "least", "most"), "parent").groupBy(F.col("child").alias("row")).agg(F.min("least").alias("low"), F.max("most").alias("high"))
        rises = F.col("least").isNull() | (F.col("low") < F.col("least")) | (F.col("high") > F.col("most"))
        met = now.join(offer, "row").where(rises)
        changed = written(met.select("row", F.least("least", "low").alias("least"), F.greatest("most", "high").alias("most")))
        old, next_ = list(paths), []
        now = written(now.join(changed.select("row", F.col("least").alias("low"), F.col("most").alias("high")), "row", "left").select("row", F.coalesce("low", "least").alias("least"), F.coalesce("high", "most").alias("most")), paths=next_)
        removed(spark, old)
        paths = next_
    state = F.when(F.col("least").isNull(), "none").when(F.col("least") == F.col("most"), "one").otherwise("several")
    return now.select("row", state.alias("state"), F.when(F.col("least") == F.col("most"), F.col("least")).alias("owner"), "least", "most")


def witnesses(found: DataFrame, keys: DataFrame, state: str = "several") -> DataFrame:
    """(row, parent_least, parent_most): of each row with ``state``, parents that bring its least and its greatest owner; null where the row's own does."""
    broken = found.where(F.col("state") == state).select("row", "least", "most")
    met = keys.select(F.col("child").alias("row"), "parent").join(broken, "row").join(found.select(F.col("row").alias("parent"), F.col("least").alias("low"), F.col("most").alias("high")), "parent")
    told = met.groupBy("row").agg(F.min(F.when(F.col("low") == F.col("least"), F.col("parent"))).alias("parent_least"), F.min(F.when(F.col("high") == F.col("most"), F.col("parent"))).alias("parent_most"))
    return broken.select("row").join(told, "row", "left")


def scope_violations(checks: dict[str, tuple[DataFrame, DataFrame]], shown: int = 3) -> DataFrame:
    """(rule, n, witnesses): of each check (children: row, key, owner; parents: key, owner) how many children have another owner than the row they name.

    Both owners must be told. The ``shown`` least rows are told, by a group limit.
    """
    parts = []
    for name, (children, parents) in checks.items():
        met = children.select("row", "key", "owner").join(parents.select("key", F.col("owner").alias("of")), "key").where("owner != of")
        parts.append(met.select(F.lit(name).alias("rule"), "row"))
    every = reduce(DataFrame.unionByName, parts)
    counted = every.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    first = every.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("row"))).where(F.col("_r") <= shown).groupBy("rule").agg(F.sort_array(F.collect_list("row")).alias("witnesses"))
    return counted.join(first, "rule")


def one_proven_owner(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """(row, n_owners, owner): every row with the distinct owners that ``evidence`` (row, owner) proves; the owner only where it is one alone."""
    counted = evidence.where("owner is not null").groupBy("row").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("one"))
    return rows.select("row").distinct().join(counted, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n_owners"), F.when(F.col("n") == 1, F.col("one")).alias("owner"))
