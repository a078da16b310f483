"""Bounded traversal and labelling of graphs by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.scratch import written
from factloom.operators.windows import top_n


def steps(edges: DataFrame, cap: int | None, order: list[Column], incoming: bool = True, outgoing: bool = True, nodes: DataFrame | None = None) -> DataFrame:
    """(node, other, relation, direction, ...) with at most ``cap`` edges of each node and direction, all without one, of ``nodes`` alone if they are given."""
    parts = []
    if outgoing:
        parts.append(edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relation", "weight", F.lit("out").alias("direction")))
    if incoming:
        parts.append(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "relation", "weight", F.lit("in").alias("direction")))
    parts = parts if nodes is None else [part.join(nodes, "node", "left_semi") for part in parts]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both if cap is None else top_n(both, ["node", "direction"], order, cap, "_rank").drop("_rank")


def impact(edges: DataFrame, seeds: DataFrame, depth: int, cap: int | None = 25, least: float = 0.0, incoming: bool = True, outgoing: bool = True) -> DataFrame:
    """Breadth-first impact of ``seeds`` (node) over ``edges`` (src, dst, relation, weight).

    Columns: node, depth, relation, direction, origin; seeds have depth 0 and nulls. Edges under
    ``least`` are left out; of each node at most ``cap`` in each direction are followed, the heaviest
    first, then by relation and other end; without a cap all are. A node is visited once, at its least depth; of several
    ways the first is outgoing before incoming, then by relation and origin. Each level ranks the edges
    of its frontier alone, so a few seeds never sort the whole graph; ``edges`` are read once a level
    and direction, and should be written before if they are dear to make.
    """
    ok = F.coalesce(F.col("weight"), F.lit(0.0)) >= least
    # edges under the least come last and go after the ranks, so nothing stands between the frontier and the edges' own keys
    order = [F.desc(ok), F.desc("weight"), F.asc("relation"), F.asc("other")]
    text = F.lit(None).cast("string")
    start = written(seeds.select("node").distinct())
    kind = edges.schema["src"].dataType
    seen = start.select("node", F.lit(0).alias("depth"), text.alias("relation"), text.alias("direction"), F.lit(None).cast(kind).alias("origin"))
    frontier = start
    for level in range(1, depth + 1):
        hops = steps(edges, cap, order, incoming, outgoing, frontier)
        met = hops.select(F.col("other").alias("node"), "relation", "direction", F.col("node").alias("origin"), ok.alias("_ok"))
        new = met.join(seen.select("node"), "node", "left_anti")
        first = Window.partitionBy("node").orderBy(F.desc("_ok"), F.when(F.col("direction") == "out", 0).otherwise(1), "relation", "origin")
        new = new.withColumn("_r", F.row_number().over(first)).where("_r = 1 and _ok").select("node", F.lit(level).alias("depth"), "relation", "direction", "origin")
        new = written(new)
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("node")
    return seen


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with both ends among ``nodes``."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "relation").distinct()


def expansion_risk(found: DataFrame) -> DataFrame:
    """The nodes from which others were reached, those with most first: origin, direction, n_reached."""
    return found.where("depth > 0").groupBy("origin", "direction").agg(F.count(F.lit(1)).alias("n_reached")).orderBy(F.desc("n_reached"), "origin", "direction")


def incoming_links(edges: DataFrame, seeds: DataFrame, depth: int, cap: int, relations: list[str]) -> DataFrame:
    """Edges met on a bounded walk against their direction: depth, src, dst, relation.

    Edges into a node are followed in order of source, at most ``cap``; edges to known nodes are
    reported too, known nodes are not entered again.
    """
    hops = written(top_n(edges.where(F.col("relation").isin(relations)), "dst", [F.asc("src"), F.asc("relation")], cap, "_rank").select("src", "dst", "relation"))
    seen = frontier = seeds.select("node").distinct()
    out = None
    for level in range(1, depth + 1):
        met = written(hops.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.lit(level).alias("depth"), "src", "dst", "relation"))
        if met.isEmpty():
            break
        out = met if out is None else out.unionByName(met)
        frontier = written(met.select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
    return out if out is not None else hops.limit(0).select(F.lit(0).alias("depth"), "src", "dst", "relation")


def structural_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): labels from content and neighbours' labels, refined until no class splits.

    ``nodes`` are (node, label); surrogate ids never enter a label, so equal graphs have equal labels.
    Neighbours' labels are gathered as counts by label, not as lists. They travel as the hash that a label which
    is there once adds; those that are there several times get their own from a table of labels. Tables of nodes
    are small files of many rows, which Spark would broadcast, so their joins are shuffled ones; a node's label
    is one row, so no key makes the hashed side large, and the edges are not sorted.
    """
    now = written(nodes.select("node", F.sha2(F.col("label"), 256).alias("label")))
    classes = now.select("label").distinct().count()
    both = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.concat(F.lit(">"), "relation").alias("by")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.concat(F.lit("<"), "relation").alias("by"))))
    by = both.select("by").distinct()
    once = F.xxhash64("by", "label", F.lit(1).cast("long")).alias("h")
    while True:
        near = both.join(now.withColumnRenamed("node", "other").hint("shuffle_hash"), "other").select("node", once).groupBy("node", "h").agg(F.count(F.lit(1)).alias("n"))
        names = now.select("label").distinct().join(F.broadcast(by)).select(once, "by", "label")  # two kinds of each relation
        several = near.where("n > 1").join(names, "h").select("node", F.xxhash64("by", "label", "n").alias("h"))
        # an order-free sum of hashes stands for the multiset, whatever its size
        near = near.where("n = 1").select("node", "h").unionByName(several)
        near = near.groupBy("node").agg(F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("around"))
        new = written(now.join(near.hint("merge"), "node", "left").select("node", F.sha2(F.concat_ws("|", "label", F.coalesce("around", F.lit(""))), 256).alias("label")))
        n = new.select("label").distinct().count()
        now = new
        if n == classes:
            break
        classes = n
    return now
