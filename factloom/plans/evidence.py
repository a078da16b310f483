"""Writes by natural key, reconciliation, symbol choice and request evidence on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import graph, resolve, windows
from factloom.plans.graphs import seeds, supply
from factloom.plans.registry import Tables, query
from factloom.sources import writers


def count() -> Column:
    return F.count(F.lit(1))


@query("""WITH t AS (SELECT p_name AS k, p_brand AS b, 1 AS v FROM part WHERE p_partkey % 40 = 0), n AS (SELECT p_name AS k, p_brand AS b, p_size AS v FROM part WHERE p_partkey % 3 = 0)
SELECT * FROM t UNION ALL SELECT k, b, min(v) FROM n WHERE (k, b) NOT IN (SELECT k, b FROM t) GROUP BY k, b""")
def insert_ignore(t: Tables) -> DataFrame:
    cols = [F.col("p_name").alias("k"), F.col("p_brand").alias("b")]
    target = t.part.where("p_partkey % 40 = 0").select(*cols, F.lit(1).alias("v"))
    return writers.insert_or_ignore(target, t.part.where("p_partkey % 3 = 0").select(*cols, F.col("p_size").alias("v")), ["k", "b"])


@query("""WITH t AS (SELECT DISTINCT p_brand AS k, 0.0 AS v FROM part), n AS (SELECT p_brand AS k, arg_max(p_retailprice, p_partkey) AS v FROM part WHERE p_size > 40 GROUP BY 1)
SELECT t.k, coalesce(n.v, t.v) AS v FROM t LEFT JOIN n USING (k)""")
def upsert_latest(t: Tables) -> DataFrame:
    target = t.part.select(F.col("p_brand").alias("k"), F.lit(0.0).alias("v"), F.lit(-1).cast("long").alias("at")).distinct()
    rows = t.part.where("p_size > 40").select(F.col("p_brand").alias("k"), F.col("p_retailprice").alias("v"), F.col("p_partkey").alias("at"))
    return writers.upsert(target, rows, ["k"], [F.desc("at")]).select("k", "v")


@query("""SELECT coalesce(s.s_nationkey, c.c_nationkey) AS nation, s.n AS n_suppliers, c.n AS n_customers, CASE WHEN c.n IS NULL THEN 'only_left' WHEN s.n IS NULL THEN 'only_right' WHEN s.n <> c.n THEN 'mismatch' ELSE 'same' END AS state
FROM (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 4000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s_nationkey = c_nationkey""")
def reconcile(t: Tables) -> DataFrame:
    s = t.supplier.where("s_acctbal > 4000").groupBy(F.col("s_nationkey").alias("nation")).agg(count().alias("n_suppliers"))
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(count().alias("n_customers"))
    left, right = F.col("n_suppliers"), F.col("n_customers")
    state = F.when(right.isNull(), "only_left").when(left.isNull(), "only_right").when(left != right, "mismatch").otherwise("same")
    return s.join(c, "nation", "full").withColumn("state", state)


@query("""SELECT p_name, arg_min(p_partkey, (CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END) * 100000000 + p_partkey) AS p_partkey FROM part GROUP BY p_name""")
def preferred_symbol(t: Tables) -> DataFrame:
    priority = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    return t.part.groupBy("p_name").agg(F.min_by("p_partkey", F.struct(priority, "p_partkey")).alias("p_partkey"))


@query("""WITH a AS (SELECT c_nationkey AS k, min(c_custkey) AS id FROM customer WHERE c_acctbal > 9900 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT s_nationkey AS k, min(s_suppkey) AS id FROM supplier GROUP BY 1 HAVING count(*) = 1)
SELECT n_nationkey, coalesce(a.id, b.id, n_regionkey) AS target, CASE WHEN a.id IS NOT NULL THEN 'customer' WHEN b.id IS NOT NULL THEN 'supplier' ELSE 'region' END AS via FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey""")
def fallback_chain(t: Tables) -> DataFrame:
    one = lambda df, key, i: df.groupBy(F.col(key).alias("n_nationkey")).agg(count().alias("_n"), F.min(i).alias(f"_{i}")).where("_n = 1").drop("_n")
    rows = t.nation.join(one(t.customer.where("c_acctbal > 9900"), "c_nationkey", "c_custkey"), "n_nationkey", "left").join(one(t.supplier, "s_nationkey", "s_suppkey"), "n_nationkey", "left")
    via = F.when(F.col("_c_custkey").isNotNull(), "customer").when(F.col("_s_suppkey").isNotNull(), "supplier").otherwise("region")
    return rows.select("n_nationkey", F.coalesce("_c_custkey", "_s_suppkey", F.col("n_regionkey").cast("long")).alias("target"), via.alias("via"))


@query("""WITH r AS (SELECT min(p_partkey) AS p_partkey, p_name, p_brand FROM part GROUP BY p_name, p_brand), f AS (SELECT *, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS first FROM r)
SELECT p_name, first AS fact_id, p_partkey AS conflicts_with FROM f WHERE first <> p_partkey""")
def conflict_representatives(t: Tables) -> DataFrame:
    each = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("conflicts_with"))
    first = each.groupBy("p_name").agg(F.min("conflicts_with").alias("fact_id"))
    return each.join(first, "p_name").where("fact_id != conflicts_with").select("p_name", "fact_id", "conflicts_with")


@query("""SELECT conv_id, turn, CAST(sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS request FROM conversations""")
def request_index(t: Tables) -> DataFrame:
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    return t.conversations.select("conv_id", "turn", F.sum((F.col("role") == "user").cast("long")).over(upto).alias("request"))


@query(r"""WITH x AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'GET ' WHEN 1 THEN 'post ' ELSE '' END || regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS s FROM pages)
SELECT page_id, upper(regexp_extract(s, '^([A-Za-z]+) (/.*)$', 1)) AS method, regexp_extract(s, '^([A-Za-z]+) (/.*)$', 2) AS path FROM x WHERE regexp_matches(s, '^[A-Za-z]+ /')""")
def operation_symbols(t: Tables) -> DataFrame:
    verb = F.when(F.col("page_id") % 3 == 0, "GET ").when(F.col("page_id") % 3 == 1, "post ").otherwise("")
    rows = t.pages.select("page_id", F.concat(verb, F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)).alias("s"))
    pattern = "^([A-Za-z]+) (/.*)$"
    return rows.where(F.col("s").rlike("^[A-Za-z]+ /")).select("page_id", F.upper(F.regexp_extract("s", pattern, 1)).alias("method"), F.regexp_extract("s", pattern, 2).alias("path"))


@query(r"""SELECT event_id, CASE WHEN v IN ('true', '1') THEN TRUE WHEN v IN ('false', '0') THEN FALSE END AS flag, CASE WHEN regexp_full_match(w, '-?\d+') THEN TRY_CAST(w AS BIGINT) END AS number, nullif(trim(u), '') AS text
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN '0' WHEN 2 THEN '1' ELSE 'x' END AS v, CASE event_id % 3 WHEN 0 THEN '-' || event_id WHEN 1 THEN event_id || '.5' ELSE CAST(event_id AS VARCHAR) END AS w, CASE event_id % 2 WHEN 0 THEN '  ' ELSE ' ' || event_type END AS u FROM events)""")
def value_normalization(t: Tables) -> DataFrame:
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    flag = F.when(i % 4 == 0, " TRUE").when(i % 4 == 1, "0").when(i % 4 == 2, "1").otherwise("x")
    number = F.when(i % 3 == 0, F.concat(F.lit("-"), s)).when(i % 3 == 1, F.concat(s, F.lit(".5"))).otherwise(s)
    text = F.when(i % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    return t.events.select("event_id", names.to_bool(flag).alias("flag"), names.to_int(number).alias("number"), names.to_text(text).alias("text"))


@query("""SELECT event_id, CASE WHEN json_valid(s) THEN json_extract_string(s, '$.k') ELSE s END AS value, json_valid(s) AS parsed FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'raw ' || event_id ELSE props END AS s FROM events)""")
def json_or_raw(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("raw "), F.col("event_id").cast("string"))).otherwise(F.col("props")).alias("s"))
    v = F.try_parse_json("s")
    return rows.select("event_id", F.when(v.isNotNull(), F.try_variant_get(v, "$.k", "string")).otherwise(F.col("s")).alias("value"), v.isNotNull().alias("parsed"))


@query("""SELECT position, o_orderkey, c_name, o_totalprice FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position, * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) LEFT JOIN customer ON c_custkey = o_custkey""")
def enrich_in_order(t: Tables) -> DataFrame:
    top = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long"))
    return placed.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left").select("position", "o_orderkey", "c_name", "o_totalprice").orderBy("position")


@query("""WITH x AS (SELECT p_partkey, p_name, p_brand, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_type, p_size, p_retailprice, p_partkey) - 1 AS ordinal FROM part) SELECT p_partkey, ordinal FROM x""")
def payload_ordinal(t: Tables) -> DataFrame:
    return windows.duplicate_ordinal(t.part, ["p_name", "p_brand"], [F.asc(c) for c in ("p_type", "p_size", "p_retailprice", "p_partkey")]).select("p_partkey", "ordinal")


@query("""WITH e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, count(*) AS w FROM lineitem GROUP BY ALL), h AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM e) WHERE r <= 5),
i AS (SELECT DISTINCT dst AS node FROM h WHERE src IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey < 5))
SELECT p_brand, count(*) AS n_parts, round(sum(p_retailprice), 2) AS price FROM i JOIN part ON node = 'P' || p_partkey GROUP BY p_brand""")
def impact_surfaces(t: Tables) -> DataFrame:
    found = graph.impact(supply(t), seeds(t), 1, 5, incoming=False).where("depth = 1")
    parts = t.part.withColumn("node", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    return found.join(parts, "node").groupBy("p_brand").agg(count().alias("n_parts"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("""WITH w AS (SELECT n_nationkey, x AS asked FROM nation, (SELECT unnest(['NATION_1', 'nation_2', 'NATION', 'Nation_3']) AS x) WHERE lower(n_name) = lower(x))
SELECT asked, CASE WHEN n = 1 THEN k END AS n_nationkey, candidates, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS reason FROM (
  SELECT x AS asked, count(n_nationkey) AS n, min(n_nationkey) AS k, count(n_nationkey) AS candidates FROM (SELECT unnest(['NATION_1', 'nation_2', 'NATION', 'Nation_3']) AS x) LEFT JOIN w ON asked = x GROUP BY x)""")
def folded_names(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([(x, x.lower()) for x in ("NATION_1", "nation_2", "NATION", "Nation_3")], "asked string, low string")
    return resolve.unique_match(asked, t.nation.select(F.lower("n_name").alias("low"), "n_nationkey"), "low", "n_nationkey").drop("low")


@query("""SELECT doc_id, CASE WHEN file_id IS NOT NULL THEN 'exact' WHEN low_id IS NOT NULL THEN 'folded' ELSE 'missing' END AS how FROM (
  SELECT d.doc_id, e.source AS file_id, l.low AS low_id FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN upper(source) ELSE source || 'x' END AS s FROM documents) d
  LEFT JOIN (SELECT DISTINCT source FROM documents) e ON e.source = s LEFT JOIN (SELECT DISTINCT lower(source) AS low FROM documents) l ON l.low = lower(s))""")
def path_backfill(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    rows = t.documents.select("doc_id", F.when(i % 3 == 0, F.col("source")).when(i % 3 == 1, F.upper("source")).otherwise(F.concat("source", F.lit("x"))).alias("s"))
    files = t.documents.select(F.col("source").alias("s")).distinct()
    folded = files.select(F.lower("s").alias("low")).distinct().withColumn("_low", F.lit(True))
    met = rows.join(files.withColumn("_exact", F.lit(True)), "s", "left").withColumn("low", F.lower("s")).join(folded, "low", "left")
    return met.select("doc_id", F.when(F.col("_exact"), "exact").when(F.col("_low"), "folded").otherwise("missing").alias("how"))
