"""Traversals over the supplier-part graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.plans.registry import Tables, query

CAP = 3

_EDGES = """e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, 'SUPPLIES' AS relation, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY ALL),
h AS (SELECT node, other, relation, direction FROM (SELECT *, row_number() OVER (PARTITION BY node, direction ORDER BY weight DESC, relation, other) AS r FROM (
  SELECT src AS node, dst AS other, relation, weight, 'out' AS direction FROM e UNION ALL SELECT dst, src, relation, weight, 'in' FROM e)) WHERE r <= 3),
l0 AS (SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_suppkey < 5),
m1 AS (SELECT other AS node, relation, direction, h.node AS origin FROM l0 JOIN h USING (node) WHERE other NOT IN (SELECT node FROM l0)),
l1 AS (SELECT node, relation, direction, origin FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE direction WHEN 'out' THEN 0 ELSE 1 END, relation, origin) AS r FROM m1) WHERE r = 1),
m2 AS (SELECT other AS node, h.relation, h.direction, h.node AS origin FROM l1 JOIN h USING (node) WHERE other NOT IN (SELECT node FROM l0) AND other NOT IN (SELECT node FROM l1)),
l2 AS (SELECT node, relation, direction, origin FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY CASE direction WHEN 'out' THEN 0 ELSE 1 END, relation, origin) AS r FROM m2) WHERE r = 1),
f AS (SELECT node, 0 AS depth, NULL AS relation, NULL AS direction, NULL AS origin FROM l0 UNION ALL SELECT node, 1, relation, direction, origin FROM l1 UNION ALL SELECT node, 2, relation, direction, origin FROM l2)"""


#: The same, every edge followed.
_ALL_EDGES = _EDGES.replace(" WHERE r <= 3", "")


def supply(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return pairs.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("SUPPLIES").alias("relation"), "weight")


def seeds(t: Tables) -> DataFrame:
    return t.supplier.where("s_suppkey < 5").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))


@query(f"WITH {_EDGES} SELECT * FROM f")
def bfs_impact(t: Tables) -> DataFrame:
    return graph.impact(supply(t), seeds(t), 2, CAP)


@query(f"WITH {_EDGES} SELECT DISTINCT src, dst, relation FROM e WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM f)")
def impact_edges(t: Tables) -> DataFrame:
    edges = graph.written(supply(t))
    return graph.inner_edges(edges, graph.impact(edges, seeds(t), 2, CAP))


@query(f"WITH {_ALL_EDGES} SELECT origin, direction, count(*) AS n_reached FROM f WHERE depth > 0 GROUP BY ALL ORDER BY n_reached DESC, origin, direction")
def impact_risk(t: Tables) -> DataFrame:
    return graph.expansion_risk(graph.impact(supply(t), seeds(t), 2, None))


@query("""WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'P' || l_partkey, 'S' || ((l_suppkey + 1) % 10) FROM lineitem WHERE l_quantity > 49),
h AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM e) WHERE r <= 4),
l0 AS (SELECT 'P' || p_partkey AS node FROM part WHERE p_partkey < 10), a1 AS (SELECT h.* FROM h JOIN l0 ON dst = node),
l1 AS (SELECT DISTINCT src AS node FROM a1 WHERE src NOT IN (SELECT node FROM l0)), a2 AS (SELECT h.* FROM h JOIN l1 ON dst = node)
SELECT 1 AS depth, src, dst, 'USES' AS relation FROM a1 UNION ALL SELECT 2, src, dst, 'USES' FROM a2""")
def incoming_bounded(t: Tables) -> DataFrame:
    s, p = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    back = t.lineitem.where("l_quantity > 49").select(p.alias("src"), F.concat(F.lit("S"), ((F.col("l_suppkey") + 1) % 10).cast("string")).alias("dst"))
    edges = t.lineitem.select(s.alias("src"), p.alias("dst")).unionByName(back).distinct().withColumn("relation", F.lit("USES"))
    start = t.part.where("p_partkey < 10").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"))
    return graph.incoming_links(edges, start, 2, 4, ["USES", "CALLS"])


@query("""SELECT DISTINCT n_name, p_brand FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45""")
def path_join(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_quantity > 45").select("l_suppkey", "l_partkey").distinct()
    brands = used.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    owners = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return brands.join(owners, F.col("l_suppkey") == F.col("s_suppkey")).select("n_name", "p_brand").distinct()


@query()
def structural_labels(t: Tables) -> DataFrame:
    nodes = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.lit("supplier").alias("label")).unionByName(
        t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_type").alias("label")))
    found = graph.structural_labels(nodes, supply(t))
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n_nodes"))


def _rounds(n: int) -> str:
    """Colour refinement in SQL, ``n`` rounds written out: more than the graph needs to settle."""
    return ", ".join(
        f"n{i} AS (SELECT node, string_agg(x, ',' ORDER BY x) AS a FROM (SELECT b.node, d || label || count(*) AS x FROM b JOIN l{i - 1} AS l ON l.node = other GROUP BY b.node, d, label) GROUP BY node), "
        f"l{i} AS (SELECT node, md5(label || coalesce(a, '')) AS label FROM l{i - 1} LEFT JOIN n{i} USING (node))" for i in range(1, n + 1))


@query(f"""WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem), b AS (SELECT src AS node, dst AS other, '>' AS d FROM e UNION ALL SELECT dst, src, '<' FROM e),
l0 AS (SELECT 'S' || s_suppkey AS node, md5('supplier') AS label FROM supplier UNION ALL SELECT 'P' || p_partkey, md5(p_type) FROM part), {_rounds(6)}
SELECT n_nodes, count(*) AS n_classes FROM (SELECT label, count(*) AS n_nodes FROM l6 GROUP BY label) GROUP BY n_nodes""")
def structural_class_sizes(t: Tables) -> DataFrame:
    """How many classes of structurally equal nodes there are of each size; labels themselves are hashes of another kind in SQL."""
    return structural_labels(t).groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_classes"))
