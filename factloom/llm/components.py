"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import removed, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round a node takes the smallest root of its neighbours and itself, then the root of its
    root, so chains halve; a round's result is written before the next, and its predecessor goes.
    Rounds end when no root changes. A link of a node to itself makes it a component; repeated links
    count once; no links give no rows.
    """
    spark, paths, old = links.sparkSession, [], []
    both = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", paths)
    roots = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots", old)
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        jump = lower.join(lower.select(F.col("node").alias("low"), F.col("low").alias("far")), "low")
        written: list[str] = []
        new = saved(jump.select("node", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("moved")), "roots", written)
        removed(spark, old)
        roots, old = new.select("node", "root"), written
        if new.where("moved").isEmpty():
            break
    removed(spark, paths)
    return roots
