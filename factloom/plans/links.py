"""Linking operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import linking
from factloom.plans.registry import Tables, query


@query("""WITH r AS (SELECT o_orderkey AS request_id, o_orderstatus AS method, o_orderpriority AS path, o_custkey % 5 AS version FROM orders WHERE o_orderkey % 3 = 0),
e AS (SELECT p_partkey AS endpoint_id, CASE p_partkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS method, CASE p_partkey % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END AS path, p_size % 5 AS version FROM part WHERE p_partkey < 12),
c AS (SELECT DISTINCT p_size % 5 AS version, (p_size + 1) % 5 AS other FROM part), x AS (SELECT request_id, endpoint_id, 'exact' AS match FROM r JOIN e USING (method, path, version))
SELECT * FROM x UNION ALL SELECT DISTINCT request_id, endpoint_id, 'compatible' FROM r JOIN c USING (version) JOIN e ON r.method = e.method AND r.path = e.path AND c.other = e.version WHERE request_id NOT IN (SELECT request_id FROM x)""")
def endpoint_match(t: Tables) -> DataFrame:
    requests = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("path"), (F.col("o_custkey") % 5).alias("version"))
    k = F.col("p_partkey")
    endpoints = t.part.where("p_partkey < 12").select(k.alias("endpoint_id"), F.when(k % 3 == 0, "O").when(k % 3 == 1, "F").otherwise("P").alias("method"), F.when(k % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("path"), (F.col("p_size") % 5).cast("long").alias("version"))
    compatible = t.part.select((F.col("p_size") % 5).cast("long").alias("version"), ((F.col("p_size") + 1) % 5).cast("long").alias("other")).distinct()
    return linking.endpoint_matches(requests, endpoints, compatible)


@query("""WITH r AS (SELECT o_orderkey AS request_id, o_orderstatus AS method, o_orderpriority || '/' || o_custkey AS path, o_custkey % 5 AS version FROM orders),
e AS (SELECT p_partkey AS endpoint_id, CASE p_partkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS method, CASE p_partkey % 2 WHEN 0 THEN '1-URGENT' ELSE '5-LOW' END || '/' || p_partkey AS path, p_size % 5 AS version FROM part),
c AS (SELECT DISTINCT p_size % 5 AS version, (p_size + 1) % 5 AS other FROM part), x AS (SELECT request_id, endpoint_id, 'exact' AS match FROM r JOIN e USING (method, path, version))
SELECT * FROM x UNION ALL SELECT DISTINCT request_id, endpoint_id, 'compatible' FROM r JOIN c USING (version) JOIN e ON r.method = e.method AND r.path = e.path AND c.other = e.version WHERE request_id NOT IN (SELECT request_id FROM x)""")
def endpoint_match_all(t: Tables) -> DataFrame:
    requests = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("method"), F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string")).alias("path"), (F.col("o_custkey") % 5).alias("version"))
    k = F.col("p_partkey")
    path = F.concat_ws("/", F.when(k % 2 == 0, "1-URGENT").otherwise("5-LOW"), k.cast("string"))
    endpoints = t.part.select(k.alias("endpoint_id"), F.when(k % 3 == 0, "O").when(k % 3 == 1, "F").otherwise("P").alias("method"), path.alias("path"), (F.col("p_size") % 5).cast("long").alias("version"))
    compatible = t.part.select((F.col("p_size") % 5).cast("long").alias("version"), ((F.col("p_size") + 1) % 5).cast("long").alias("other")).distinct()
    return linking.endpoint_matches(requests, endpoints, compatible)


@query("""SELECT p_brand AS by_key, min(p_type) AS target FROM part WHERE p_size > 49 GROUP BY p_brand HAVING count(DISTINCT p_type) = 1""")
def only_match(t: Tables) -> DataFrame:
    rows = t.part.where("p_size > 49").select(F.col("p_brand").alias("by_key"), F.col("p_type").alias("target"))
    return linking.only_match(rows, "by_key", "target")


@query(r"""WITH f AS (SELECT url AS path, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS base FROM pages), e AS (SELECT DISTINCT CAST(page_id AS VARCHAR) AS name FROM pages)
SELECT e.name, f.path FROM e JOIN f ON starts_with(f.base, e.name || '.')""")
def prefix_join(t: Tables) -> DataFrame:
    files = t.pages.select(F.regexp_replace("url", "[?#].*$", "").alias("path"), F.col("url"))
    entries = t.pages.select(F.col("page_id").cast("string").alias("name")).distinct()
    return linking.prefix_links(entries, files.select("path").distinct(), "name", "path").join(files, "path").select("name", F.col("url").alias("path"))


@query("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS path, o_orderkey AS target_id, o_orderstatus AS target_name FROM orders), c AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 495000)
SELECT path FROM r WHERE target_id IN (SELECT id FROM c) UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < -900""")
def relationship_closure(t: Tables) -> DataFrame:
    relations = t.orders.select(F.col("o_custkey").cast("string").alias("path"), F.lit(None).cast("long").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.col("o_orderstatus").alias("target_name"))
    changed = t.orders.where("o_totalprice > 495000").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("name"))
    direct = t.customer.where("c_acctbal < -900").select(F.col("c_custkey").cast("string").alias("path"))
    return linking.touched_files(relations, direct, changed)


@query(r"""SELECT folder, stem, n_files FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n_files DESC, stem) AS r FROM (
  SELECT regexp_replace(p, '/?[^/]+$', '') AS folder, split_part(regexp_extract(p, '([^/]*)$', 1), '.', 1) AS stem, count(*) AS n_files FROM (
    SELECT regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[/]*([?#].*)?$', '') AS p FROM pages) GROUP BY ALL)) WHERE r = 1""")
def folder_stems(t: Tables) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+/", ""), "[/]*([?#].*)?$", "")
    return linking.companions(t.pages.select(path.alias("path")))


@query("""WITH f AS (SELECT c_custkey, i AS m, j AS n, CASE i WHEN 0 THEN c_mktsegment ELSE 'x' END AS module, CASE j WHEN 0 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END AS name FROM customer, range(2) a(i), range(2) b(j)),
i AS (SELECT c_mktsegment AS module, c_nationkey AS name, min(c_custkey) AS target FROM customer WHERE c_acctbal > 9000 GROUP BY ALL HAVING count(DISTINCT c_custkey) = 1
  UNION ALL SELECT 'x', n_nationkey, n_regionkey FROM nation)
SELECT c_custkey, arg_min(target, m * 2 + n) AS target FROM f JOIN i USING (module, name) GROUP BY c_custkey""")
def candidate_lists(t: Tables) -> DataFrame:
    nation = F.col("c_nationkey").cast("long")
    facts = t.customer.select("c_custkey", F.array("c_mktsegment", F.lit("x")).alias("modules"), F.array(nation, (nation + 1) % 25).alias("names"))
    index = t.customer.where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("module"), nation.alias("name"), F.col("c_custkey").alias("target")).unionByName(
        t.nation.select(F.lit("x").alias("module"), F.col("n_nationkey").cast("long").alias("name"), F.col("n_regionkey").cast("long").alias("target")))
    return linking.candidate_lists(facts, "c_custkey", "names", "modules", index, "target")
