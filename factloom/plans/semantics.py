"""Facts between customers, orders and parts: traversal, paths, axes, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import relations
from factloom.plans.registry import Tables, query

#: A customer's facts lead to their orders, an order's to its parts, a part's to a customer again.
_FACTS = """facts AS (
  SELECT 'o' || o_orderkey AS fact_id, 'C' || o_custkey AS source, 'O' || o_orderkey AS target, substr('ABCDE', CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 1) AS axis,
         CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'CORROBORATED' ELSE 'CONFLICTING' END AS assertion_status, 1.0::DOUBLE AS confidence FROM orders
  UNION ALL SELECT 'l' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || l_returnflag || CAST(round(l_discount * 100) AS INTEGER), 'O' || l_orderkey, 'P' || l_partkey, substr('ABCDE', 1 + l_linenumber % 5, 1),
         CASE l_returnflag WHEN 'A' THEN 'VERIFIED' WHEN 'N' THEN 'CORROBORATED' ELSE 'UNRESOLVED' END, 1 - l_discount FROM lineitem
  UNION ALL SELECT 'p' || p_partkey, 'P' || p_partkey, CASE WHEN p_size < 45 THEN 'C' || (p_partkey * 7 % (SELECT count(*) FROM customer)) END, substr('ABCDE', 1 + p_size % 5, 1), 'VERIFIED', p_size / 50.0 FROM part)"""

_COVERAGE = """coverage AS (SELECT 'P' || p_partkey AS node, substr('ABCDE', 1 + CAST(substr(p_brand, 7) AS INTEGER) % 5, 1) AS family,
  CASE WHEN p_size >= 40 THEN 'complete' WHEN p_size >= 20 THEN 'not_applicable' WHEN p_size >= 10 THEN 'partial' ELSE 'skipped' END AS status FROM part)"""


def _id(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def _axis(place):
    return F.substring(F.lit("ABCDE"), place, F.lit(1))


def facts(t: Tables) -> DataFrame:
    orders = t.orders.select(
        _id("o", "o_orderkey").alias("fact_id"), _id("C", "o_custkey").alias("source"), _id("O", "o_orderkey").alias("target"), _axis(F.substring("o_orderpriority", 1, 1).cast("int")).alias("axis"),
        F.when(F.col("o_orderstatus") == "F", "VERIFIED").when(F.col("o_orderstatus") == "O", "CORROBORATED").otherwise("CONFLICTING").alias("assertion_status"), F.lit(1.0).alias("confidence"))
    line = F.concat(_id("l", "l_orderkey"), *[_id("/", c) for c in ("l_linenumber", "l_partkey", "l_suppkey")], "l_returnflag", F.round(F.col("l_discount") * 100).cast("int").cast("string"))
    lines = t.lineitem.select(
        line.alias("fact_id"), _id("O", "l_orderkey").alias("source"), _id("P", "l_partkey").alias("target"), _axis((1 + F.col("l_linenumber") % 5).cast("int")).alias("axis"),
        F.when(F.col("l_returnflag") == "A", "VERIFIED").when(F.col("l_returnflag") == "N", "CORROBORATED").otherwise("UNRESOLVED").alias("assertion_status"), (1 - F.col("l_discount")).alias("confidence"))
    n = t.customer.agg(F.count(F.lit(1)).alias("n"))
    back = F.when(F.col("p_size") < 45, F.concat(F.lit("C"), (F.col("p_partkey") * 7 % F.col("n")).cast("string")))
    parts = t.part.join(F.broadcast(n)).select(  # one row
        _id("p", "p_partkey").alias("fact_id"), _id("P", "p_partkey").alias("source"), back.alias("target"), _axis((1 + F.col("p_size") % 5).cast("int")).alias("axis"), F.lit("VERIFIED").alias("assertion_status"), (F.col("p_size") / 50.0).alias("confidence"))
    return orders.unionByName(lines).unionByName(parts)


def coverage(t: Tables) -> DataFrame:
    size = F.col("p_size")
    status = F.when(size >= 40, "complete").when(size >= 20, "not_applicable").when(size >= 10, "partial").otherwise("skipped")
    return t.part.select(_id("P", "p_partkey").alias("node"), _axis((1 + F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 5).cast("int")).alias("family"), status.alias("status"))


def customers(t: Tables) -> DataFrame:
    return t.customer.select(_id("C", "c_custkey").alias("node"))


@query(f"""WITH RECURSIVE {_FACTS}, ok AS (SELECT * FROM facts WHERE axis IN ('A', 'B', 'C', 'D') AND assertion_status IN ('VERIFIED', 'CORROBORATED') AND target IS NOT NULL),
l1 AS (SELECT 'C' || c_custkey AS seed, ok.* FROM customer JOIN ok ON source = 'C' || c_custkey), f1 AS (SELECT DISTINCT seed, target AS node FROM l1 WHERE target <> seed),
l2 AS (SELECT seed, ok.* FROM f1 JOIN ok ON source = node), f2 AS (SELECT DISTINCT seed, target AS node FROM l2 WHERE target <> seed AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.seed = l2.seed AND f1.node = l2.target)),
l3 AS (SELECT seed, ok.* FROM f2 JOIN ok ON source = node)
SELECT seed, 1 AS depth, fact_id, axis, target FROM l1 UNION ALL SELECT seed, 2, fact_id, axis, target FROM l2 UNION ALL SELECT seed, 3, fact_id, axis, target FROM l3""")
def semantic_traversal(t: Tables) -> DataFrame:
    return relations.traversal(facts(t), customers(t), 3, "ABCD").select("seed", "depth", "fact_id", "axis", "target")


@query(f"""WITH RECURSIVE {_FACTS}, ok AS (SELECT * FROM facts WHERE assertion_status IN ('VERIFIED', 'CORROBORATED') AND target IS NOT NULL),
p AS (
  SELECT source AS seed, target AS node, [source, target] AS nodes, [fact_id] AS facts, [axis] AS axes, assertion_status = 'CORROBORATED' AS strong, confidence, 1 AS depth FROM ok WHERE source IN (SELECT 'C' || c_custkey FROM customer) AND target <> source
  UNION ALL SELECT seed, target, list_append(nodes, target), list_append(facts, fact_id), list_append(axes, axis), strong AND assertion_status = 'CORROBORATED', least(p.confidence, ok.confidence), depth + 1
  FROM p JOIN ok ON source = node WHERE depth < 3 AND NOT list_contains(nodes, target)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, node ORDER BY depth, confidence DESC, facts) AS rank FROM p)
SELECT seed, node AS target, CAST(rank AS INTEGER) AS rank, depth, array_to_string(facts, ' ') AS facts, array_to_string(axes, '') AS axes, CASE WHEN strong THEN 'CORROBORATED' ELSE 'VERIFIED' END AS path_status, confidence FROM r WHERE rank <= 2""")
def evidence_paths(t: Tables) -> DataFrame:
    found = relations.paths(facts(t), customers(t), 3, best=2)
    return found.select("seed", "target", "rank", "depth", F.array_join("facts", " ").alias("facts"), F.array_join("axes", "").alias("axes"), "path_status", "confidence")


@query(f"""WITH {_FACTS}, {_COVERAGE}, nodes AS (SELECT 'P' || p_partkey AS node FROM part), axes AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS axis),
n AS (SELECT source AS node, * FROM facts UNION ALL SELECT target, * FROM facts WHERE target IS NOT NULL AND target <> source),
s AS (SELECT node, axis, max(CASE assertion_status WHEN 'CONFLICTING' THEN 4 WHEN 'CORROBORATED' THEN 3 WHEN 'VERIFIED' THEN 2 WHEN 'UNRESOLVED' THEN 1 ELSE 0 END) AS r, count(*) AS n_facts FROM n WHERE confidence >= 0.95 GROUP BY ALL),
c AS (SELECT node, family AS axis, bool_or(status IN ('partial', 'failed')) AS open, bool_and(status IN ('complete', 'not_applicable')) AS closed FROM coverage GROUP BY ALL)
SELECT node, axis, CASE WHEN r = 4 THEN 'CONFLICTING' WHEN r = 3 THEN 'CORROBORATED' WHEN r = 2 THEN 'VERIFIED' WHEN r = 1 OR open THEN 'UNRESOLVED' WHEN closed THEN 'NOT_OBSERVED' ELSE 'UNRESOLVED' END AS status, coalesce(n_facts, 0) AS n_facts
FROM nodes CROSS JOIN axes LEFT JOIN s USING (node, axis) LEFT JOIN c USING (node, axis)""")
def object_axes(t: Tables) -> DataFrame:
    return relations.axis_states(t.part.select(_id("P", "p_partkey").alias("node")), facts(t), coverage(t), least=0.95)


@query("""WITH o AS (SELECT p_partkey AS node, lower(p_name) AS name, p_brand AS repo FROM part), a AS (
  SELECT c_custkey * 2 AS ask, upper(p_name) AS name, NULL AS repo FROM customer JOIN part ON p_partkey = c_custkey UNION ALL SELECT c_custkey * 2 + 1, CASE WHEN c_acctbal < 0 THEN 'none' ELSE p_name END, p_brand FROM customer JOIN part ON p_partkey = c_custkey),
m AS (SELECT ask, count(*) AS n, min(node) AS node FROM a JOIN o ON lower(a.name) = o.name AND (a.repo IS NULL OR a.repo = o.repo) GROUP BY ask)
SELECT a.ask, CASE WHEN n IS NULL THEN 'entity_not_found' WHEN n = 1 OR repo IS NOT NULL THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 OR (n > 1 AND repo IS NOT NULL) THEN m.node END AS node, coalesce(n, 0) AS candidates FROM a LEFT JOIN m USING (ask)""")
def object_names(t: Tables) -> DataFrame:
    occurrences = t.part.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("repo"))
    both = t.customer.join(t.part, F.col("c_custkey") == F.col("p_partkey"))
    asked = both.select((F.col("c_custkey") * 2).alias("ask"), F.upper("p_name").alias("name"), F.lit(None).cast("string").alias("repo")).unionByName(
        both.select((F.col("c_custkey") * 2 + 1).alias("ask"), F.when(F.col("c_acctbal") < 0, "none").otherwise(F.col("p_name")).alias("name"), F.col("p_brand").alias("repo")))
    return relations.resolved_names(occurrences, asked)
