"""Catalog operators on the driver's tables: searches, joins, roll-ups, windows, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import extract, names
from factloom.operators import diff, paging, resolve, rollups, search, validate, windows
from factloom.plans.registry import Tables, query

def count() -> Column:
    return F.count(F.lit(1))


# ---- searches and filters


@query("SELECT lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def lang_stats(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(count().alias("n_docs"), F.sum("n_chars").alias("n_chars")).orderBy(F.desc("n_docs"), "lang")


@query(r"""SELECT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS top, count(*) AS n_pages FROM pages GROUP BY 1""")
def top_level(t: Tables) -> DataFrame:
    top = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1)
    return t.pages.groupBy(top.alias("top")).agg(count().alias("n_pages")).orderBy(F.desc("n_pages"), "top")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL")
def two_key_stats(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(count().alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%RING%'")
def find_substring(t: Tables) -> DataFrame:
    return t.part.where(search.contains("p_name", "RING")).select("p_partkey", "p_name", "p_brand").orderBy("p_name", "p_partkey")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE 'red%' OR p_type ILIKE 'red%' OR p_type ILIKE 'eco%' OR p_name ILIKE 'eco%'")
def prefix_either(t: Tables) -> DataFrame:
    hit = search.prefix_any(["p_name", "p_type"], "red") | search.prefix_any(["p_name", "p_type"], "eco")
    return t.part.where(hit).select("p_partkey", "p_name", "p_type")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 26 OFFSET 50")
def page_cursor(t: Tables) -> DataFrame:
    orders, order = t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"]
    return paging.page_plan(orders, order, 25, paging.page(orders, order, 50)["next_cursor"])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal >= 1000 AND s_acctbal <= 5000")
def confidence_band(t: Tables) -> DataFrame:
    return t.supplier.where(F.col("s_acctbal").between(1000, 5000)).select("s_suppkey", "s_name", "s_acctbal").orderBy("s_acctbal", "s_suppkey")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) >= 1")
def null_safe_floor(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").where(search.at_least("quality", 1, 0))


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic = 1")
def missing_or_equal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left").where(search.missing_or_equal("toxic", 1))


@query("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment = 'MACHINERY'")
def optional_filters(t: Tables) -> DataFrame:
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return search.where_given(rows, c_mktsegment="MACHINERY", n_name=None).select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def exists_semi(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return search.having_ids(t.customer.select("c_custkey", "c_name"), big, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def not_exists_anti(t: Tables) -> DataFrame:
    return search.lacking(t.customer.select("c_custkey", "c_name"), t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE (p_brand, p_size) IN (SELECT p_brand, max(p_size) FROM part GROUP BY p_brand)")
def row_value_in(t: Tables) -> DataFrame:
    largest = t.part.groupBy("p_brand").agg(F.max("p_size").alias("p_size"))
    return search.having_ids(t.part.select("p_partkey", "p_brand", "p_size"), largest, ["p_brand", "p_size"])


@query("SELECT e.event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events e WHERE event_type = 'error'")
def json_extract(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


# ---- joins and resolution


@query("""SELECT o_orderkey, o_custkey, l_partkey, l_linenumber FROM orders LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS r FROM lineitem) l
  ON l_orderkey = o_orderkey AND r = 1""")
def best_related_row(t: Tables) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = [rank, *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax"))]
    return resolve.best_related(t.orders.withColumn("l_orderkey", F.col("o_orderkey")), t.lineitem, "l_orderkey", order).select("o_orderkey", "o_custkey", "l_partkey", "l_linenumber")


@query("""WITH e AS (SELECT l_suppkey AS a, l_partkey + 1000000 AS b, count(*) AS w FROM lineitem GROUP BY ALL),
u AS (SELECT a AS node, b AS other, w FROM e UNION ALL SELECT b, a, w FROM e)
SELECT node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weight FROM u GROUP BY node""")
def other_endpoint(t: Tables) -> DataFrame:
    edges = t.lineitem.groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b")).agg(count().alias("w"))
    return resolve.both_ways(edges, "a", "b").groupBy("node").agg(count().alias("degree"), F.sum("w").alias("weight"))


@query("""SELECT s_suppkey, c_custkey FROM supplier s JOIN customer c
  ON lower(replace(s_name, 'Supplier', 'X')) = lower(replace(upper(c_name), 'CUSTOMER', 'x'))""")
def ci_join(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("X"))).alias("k"))
    c = t.customer.select("c_custkey", F.lower(F.replace(F.upper("c_name"), F.lit("CUSTOMER"), F.lit("x"))).alias("k"))
    return s.join(c, "k").select("s_suppkey", "c_custkey")


@query("SELECT p_name, count(DISTINCT p_brand) AS n_values FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def key_conflicts(t: Tables) -> DataFrame:
    return diff.conflicts(t.part, ["p_name"], ["p_brand"])


@query("""SELECT p_name, min(a.p_partkey) AS first_key, b.p_partkey AS other_key FROM part a JOIN part b USING (p_name)
  WHERE a.p_type = b.p_type AND a.p_brand <> b.p_brand AND a.p_partkey < b.p_partkey GROUP BY p_name, b.p_partkey""")
def conflict_pairs(t: Tables) -> DataFrame:
    # the first part of each (name, type) and the first of another brand decide, so no pairs are formed
    by = ["p_name", "p_type"]
    brands = t.part.groupBy(*by, "p_brand").agg(F.min("p_partkey").alias("k"))
    two = windows.top_n(brands, by, [F.asc("k")], 2)
    first = two.groupBy(*by).agg(F.min("k").alias("k1"), F.min_by("p_brand", "k").alias("b1"), F.max(F.when(F.col("rank") == 2, F.col("k"))).alias("k2"))
    rows = t.part.join(first, by)
    other = F.when(F.col("p_brand") != F.col("b1"), F.col("k1")).otherwise(F.col("k2"))
    return rows.withColumn("first_key", other).where("first_key < p_partkey").select("p_name", "first_key", F.col("p_partkey").alias("other_key"))


@query("""WITH i AS (SELECT p_name, p_type, count(DISTINCT p_partkey) AS c, min(p_partkey) AS k FROM part WHERE p_size > 45 GROUP BY ALL)
SELECT p.p_partkey, CASE WHEN c = 1 THEN k END AS target, coalesce(c, 0) AS candidates,
  CASE WHEN c = 1 THEN 'resolved' WHEN c > 1 THEN 'ambiguous' ELSE 'missing' END AS reason
FROM part p LEFT JOIN i ON p.p_name = i.p_name AND p.p_type = i.p_type""")
def unique_match(t: Tables) -> DataFrame:
    key = F.concat_ws("/", "p_name", "p_type").alias("key")
    index = t.part.where("p_size > 45").select(key, F.col("p_partkey").alias("target"))
    return resolve.unique_match(t.part.select("p_partkey", key), index, "key", "target").drop("key")


@query("""WITH i AS (SELECT k, min(s) AS s FROM (SELECT s_name AS k, s_suppkey AS s FROM supplier UNION ALL SELECT lower(s_name), s_suppkey FROM supplier
  UNION ALL SELECT regexp_replace(s_name, '^.*#0*', ''), s_suppkey FROM supplier) GROUP BY k HAVING count(DISTINCT s) = 1),
f AS (SELECT c_custkey, 1 AS step, c_name AS k FROM customer UNION ALL SELECT c_custkey, 2, replace(lower(c_name), 'customer', 'supplier') FROM customer
  UNION ALL SELECT c_custkey, 3, regexp_replace(c_name, '^.*#0*', '') FROM customer)
SELECT c_custkey, arg_min(s, step) AS s_suppkey, CAST(min(step) AS BIGINT) AS step FROM f JOIN i USING (k) GROUP BY c_custkey""")
def ordered_fallback(t: Tables) -> DataFrame:
    short = lambda c: F.regexp_replace(c, "^.*#0*", "")
    index = t.supplier.select("s_suppkey", F.explode(F.array("s_name", F.lower("s_name"), short("s_name"))).alias("k"))
    keys = [F.col("c_name"), F.replace(F.lower("c_name"), F.lit("customer"), F.lit("supplier")), short("c_name")]
    return resolve.ordered_fallback(t.customer, "c_custkey", keys, index, "k", "s_suppkey")


@query("""SELECT surface, label, count(*) AS n_rows, min(record_id) AS first_id FROM (
  SELECT 'customer' AS surface, c_custkey AS record_id, c_mktsegment AS label FROM customer UNION ALL
  SELECT 'part', p_partkey, p_type FROM part UNION ALL SELECT 'order', o_orderkey, o_orderstatus FROM orders) GROUP BY ALL""")
def polymorphic_label(t: Tables) -> DataFrame:
    pick = lambda df, i, label: df.select(F.col(i).alias("record_id"), F.col(label).alias("label"))
    parts = {"customer": pick(t.customer, "c_custkey", "c_mktsegment"), "part": pick(t.part, "p_partkey", "p_type"), "order": pick(t.orders, "o_orderkey", "o_orderstatus")}
    return resolve.labelled_union(parts).groupBy("surface", "label").agg(count().alias("n_rows"), F.min("record_id").alias("first_id"))


@query("""SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000
  UNION SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000""")
def anchors_union(t: Tables) -> DataFrame:
    rich = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    parts = [t.customer.where("c_acctbal < 0").select("c_nationkey"), t.supplier.where("s_acctbal < 1000").select("s_nationkey"), search.having_ids(t.customer, rich, "c_custkey").select("c_nationkey")]
    return parts[0].union(parts[1]).union(parts[2]).distinct().toDF("nation")


# ---- aggregates and roll-ups


@query("""SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey""")
def preaggregated_releases(t: Tables) -> DataFrame:
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(count().alias("n_orders"))
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(count().alias("k"))
    lines = per_order.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("k").alias("n_lines"))
    return t.customer.select("c_custkey").join(orders, "c_custkey", "left").join(lines, "c_custkey", "left").fillna(0, ["n_orders", "n_lines"])


@query("SELECT p_type, string_agg(p_brand, ',' ORDER BY p_brand) AS brands FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type")
def group_concat(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("""SELECT o_custkey, count(*) AS n_facts, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' WHEN bool_or(o_orderstatus = 'P') THEN 'P' ELSE 'NOT_OBSERVED' END AS status
  FROM orders GROUP BY o_custkey""")
def coverage_rollup(t: Tables) -> DataFrame:
    return rollups.precedence(t.orders, "o_custkey", F.col("o_orderstatus"), ["F", "P"], "NOT_OBSERVED")


@query("""WITH r AS (SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'F' WHEN bool_or(o_orderstatus = 'P') THEN 'P' ELSE 'NOT_OBSERVED' END AS status FROM orders GROUP BY 1)
SELECT coalesce(status, 'UNRESOLVED') AS status, count(*) AS n_customers FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY 1""")
def coverage_summary(t: Tables) -> DataFrame:
    found = rollups.precedence(t.orders, "o_custkey", F.col("o_orderstatus"), ["F", "P"], "NOT_OBSERVED").withColumnRenamed("o_custkey", "c_custkey")
    return t.customer.select("c_custkey").join(found, "c_custkey", "left").groupBy(F.coalesce("status", F.lit("UNRESOLVED")).alias("status")).agg(count().alias("n_customers"))


@query("""SELECT lang, axis, count(*) AS n_facts, CASE WHEN count(DISTINCT v) > 1 THEN 'CONFLICTING' WHEN count(v) > 1 THEN 'CORROBORATED' WHEN count(v) = 1 THEN 'VERIFIED' ELSE 'UNRESOLVED' END AS status
FROM (SELECT lang, 'quality' AS axis, quality AS v FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT lang, 'toxic', toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY ALL""")
def axis_rollup(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    long = rows.select("lang", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("axis", "v"))
    status = F.when(F.countDistinct("v") > 1, "CONFLICTING").when(F.count("v") > 1, "CORROBORATED").when(F.count("v") == 1, "VERIFIED").otherwise("UNRESOLVED")
    return long.groupBy("lang", "axis").agg(count().alias("n_facts"), status.alias("status"))


@query("""SELECT round_even(0.5 * o.f / greatest(o.n, 1) + 0.3 * e.f / greatest(e.n, 1) + 0.2 * c.f / greatest(c.n, 1), 3) AS risk FROM
  (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS f FROM orders) o, (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS f FROM events) e,
  (SELECT count(*) AS n, count(*) FILTER (c_acctbal < 0) AS f FROM customer) c""")
def risk_score(t: Tables) -> DataFrame:
    share = lambda df, bad, p: df.agg(F.count_if(F.expr(bad)).alias(f"{p}_f"), count().alias(f"{p}_n"))
    one = share(t.orders, "o_orderstatus = 'P'", "o").join(share(t.events, "event_type = 'error'", "e")).join(share(t.customer, "c_acctbal < 0", "c"))
    parts = [(F.col(f"{p}_f"), F.col(f"{p}_n"), w) for p, w in (("o", 0.5), ("e", 0.3), ("c", 0.2))]
    return one.select(rollups.risk(parts).alias("risk"))


@query("""WITH a AS (SELECT 1 - count(*) FILTER (l_returnflag = 'R' OR l_quantity < 5) / greatest(count(*), 1) AS resolution, coalesce(avg(1 - l_discount), 0) AS confidence FROM lineitem),
b AS (SELECT count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) / greatest(count(*), 1) AS completeness FROM orders), c AS (SELECT 1 - count(*) FILTER (event_type = 'error' OR value > 90) / greatest(count(*), 1) AS security FROM events),
d AS (SELECT 1 - coalesce(sum(CAST(contains(url, '#') AS INTEGER) + CAST(contains(url, '?') AS INTEGER)), 0) / greatest(count(*), 1) AS openapi FROM pages), e AS (SELECT CASE WHEN count(*) = count(DISTINCT c_custkey) THEN 1.0 ELSE 0.5 END AS freshness FROM customer),
f AS (SELECT count(*) FILTER (s_acctbal > 0) / greatest(count(*), 1) AS repositories FROM supplier)
SELECT round_even(resolution, 3) AS resolution, round_even(confidence, 3) AS confidence, round_even(completeness, 3) AS completeness, round_even(security, 3) AS security, round_even(openapi, 3) AS openapi, CAST(freshness AS DOUBLE) AS freshness,
  round_even(repositories, 3) AS repositories, round_even(0.2 * resolution + 0.15 * confidence + 0.15 * completeness + 0.15 * security + 0.15 * openapi + 0.1 * CAST(freshness AS DOUBLE) + 0.1 * repositories, 3) AS overall FROM a, b, c, d, e, f""")
def catalog_risk(t: Tables) -> DataFrame:
    relations = t.lineitem.select((1 - F.col("l_discount")).alias("confidence"), ((F.col("l_returnflag") == "R") | (F.col("l_quantity") < 5)).alias("loose"))
    rooted = t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("rooted", F.lit(True)), "o_orderkey", "left").fillna(False, ["rooted"])
    operations = t.events.select(((F.col("event_type") == "error") | (F.col("value") > 90)).alias("broken"))
    specs = t.pages.select((F.col("url").contains("#").cast("int") + F.col("url").contains("?").cast("int")).alias("doubtful"))
    fresh = t.customer.agg((F.count(F.lit(1)) == F.countDistinct("c_custkey")).alias("fresh"))
    return rollups.catalog_score(relations, rooted, operations, specs, t.supplier.select((F.col("s_acctbal") > 0).alias("active")), fresh)


@query("""WITH p AS (SELECT doc_id, lang FROM documents WHERE n_chars > 500), g AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
b AS (SELECT coalesce(p.lang, g.lang) AS lang, p.doc_id AS p, g.doc_id AS g FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.lang = g.lang),
c AS (SELECT lang, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM b GROUP BY lang)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def prf_scores(t: Tables) -> DataFrame:
    predicted = t.documents.where("n_chars > 500").select("lang", "doc_id")
    gold = search.having_ids(t.documents.select("lang", "doc_id"), t.labels.where("quality = 1"), "doc_id")
    return rollups.precision_recall(predicted, gold, ["doc_id"], "lang")


@query("""SELECT count(*) AS n, count(*) FILTER (value > 50) AS n_high, count(DISTINCT user_id) AS n_users, round(avg(value), 4) AS mean_value, min(event_id) AS first_id, max(event_id) AS last_id FROM events""")
def conditional_counts(t: Tables) -> DataFrame:
    return t.events.agg(count().alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 4).alias("mean_value"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) > 1 AND (SELECT count(DISTINCT p_brand) FROM part q WHERE q.p_name = p.p_name) > 1 AS shared FROM part p""")
def shared_flag(t: Tables) -> DataFrame:
    shared = t.part.groupBy("p_name").agg((F.countDistinct("p_brand") > 1).alias("shared"))
    return t.part.select("p_partkey", "p_name").join(shared, "p_name")


@query("SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id")
def nested_groups(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",").alias("turns"))


@query("SELECT 'documents' AS table_name, count(*) AS n_rows FROM documents UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(t: Tables) -> DataFrame:
    return rollups.row_counts({"documents": t.documents, "orders": t.orders, "events": t.events})


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 20")
def top_twenty(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(count().alias("n")).orderBy(F.desc("n"), "p_brand").limit(20)


# ---- windows


@query("""SELECT l_orderkey, l_partkey, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 3""")
def per_node_topn(t: Tables) -> DataFrame:
    return windows.top_n(t.lineitem, "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 3).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def duplicate_ordinal(t: Tables) -> DataFrame:
    return windows.duplicate_ordinal(t.events, ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "ordinal")


@query("""SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS r FROM part) WHERE r = 1""")
def best_duplicate(t: Tables) -> DataFrame:
    return windows.first_seen(t.part, "p_name", [F.desc("p_retailprice"), F.desc("p_size"), F.asc("p_partkey")]).select("p_name", "p_partkey", "p_retailprice")


@query("SELECT * FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) WHERE next_role IS NOT NULL")
def step_next(t: Tables) -> DataFrame:
    return windows.following(t.conversations, "conv_id", "turn", "role", "next_role").select("conv_id", "turn", "role", "next_role")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def carry_forward(t: Tables) -> DataFrame:
    rows = t.events.withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return windows.carried(rows, "user_id", [F.asc("ts"), F.asc("event_id")], "v", "last_purchase").select("event_id", "last_purchase")


@query("""SELECT e.event_id, p.event_id AS login FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_offset(t: Tables) -> DataFrame:
    marks = t.events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    points = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return windows.nearest_before(points, marks, "user_id", "ts", "event_id", "login").select("event_id", "login")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_wins(t: Tables) -> DataFrame:
    return windows.first_seen(t.events, "user_id", [F.asc("event_id")]).select("user_id", "event_id")


@query("""SELECT o_custkey, CAST(n AS BIGINT) AS n_orders, n > 5 AS truncated, o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5""")
def nested_limit(t: Tables) -> DataFrame:
    sizes = t.orders.groupBy("o_custkey").agg(count().alias("n_orders"), (count() > 5).alias("truncated"))
    return windows.top_n(t.orders, "o_custkey", [F.asc("o_orderkey")], 5).join(sizes, "o_custkey").select("o_custkey", "n_orders", "truncated", "o_orderkey")


# ---- validation and differences


@query("""SELECT 'line_order' AS check_name, count(*) AS n_bad FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
  UNION ALL SELECT 'line_part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
  UNION ALL SELECT 'line_supplier', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
  UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
  UNION ALL SELECT 'part_name', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1 OR p_name IS NULL)
  UNION ALL SELECT 'price', count(*) FROM orders WHERE o_totalprice < 1000""")
def orphan_checks(t: Tables) -> DataFrame:
    o = validate.orphans
    return validate.report([
        o(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "line_order"), o(t.lineitem, "l_partkey", t.part, "p_partkey", "line_part"),
        o(t.lineitem, "l_suppkey", t.supplier, "s_suppkey", "line_supplier"), o(t.orders, "o_custkey", t.customer, "c_custkey", "order_customer"),
        validate.duplicates(t.part, ["p_name"], "part_name"), validate.violations(t.orders, F.col("o_totalprice") < 1000, "price")])


_SNAPSHOT = """a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted'
  WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    old = t.orders.where("o_orderkey % 7 <> 0").select(*cols)
    new = t.orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).select(*cols)
    return old, new


@query(f"WITH {_SNAPSHOT} SELECT o_orderkey, change FROM d WHERE change IS NOT NULL")
def snapshot_diff(t: Tables) -> DataFrame:
    return diff.keyed_diff(*_snapshots(t), ["o_orderkey"])


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, o_orderpriority, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o_orderpriority, count(*) FILTER (c = 'added') AS added, count(*) FILTER (c = 'deleted') AS deleted, count(*) FILTER (c = 'changed') AS changed FROM (
  SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.o_totalprice <> b.o_totalprice THEN 'changed' END AS c
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE c IS NOT NULL GROUP BY 1""")
def projection_diff(t: Tables) -> DataFrame:
    cols = ["o_orderkey", "o_orderpriority", "o_totalprice"]
    old = t.orders.where("o_orderkey % 7 <> 0").select(*cols)
    more = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    new = t.orders.where("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") + more).alias("o_totalprice"))
    return diff.diff_counts(old, new, ["o_orderkey"], "o_orderpriority")


@query("""WITH a AS (SELECT url AS path, sha1(html) AS sha FROM pages WHERE page_id % 3 <> 0), b AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'moved/' || page_id ELSE url END AS path, CASE WHEN page_id % 4 = 0 THEN sha1(html || '!') ELSE sha1(html) END AS sha FROM pages WHERE page_id % 7 <> 1),
c AS (SELECT coalesce(a.path, b.path) AS path, a.sha AS old_sha, b.sha AS new_sha, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'deleted' WHEN a.sha <> b.sha THEN 'modified' END AS change FROM a FULL JOIN b ON a.path = b.path),
d AS (SELECT old_sha AS sha, min(path) AS old_path FROM c WHERE change = 'deleted' GROUP BY 1 HAVING count(*) = 1), n AS (SELECT new_sha AS sha, min(path) AS path FROM c WHERE change = 'added' GROUP BY 1 HAVING count(*) = 1),
r AS (SELECT n.path, d.old_path FROM d JOIN n USING (sha))
SELECT path, NULL AS old_path, change FROM c WHERE change IS NOT NULL AND path NOT IN (SELECT path FROM r) AND path NOT IN (SELECT old_path FROM r) UNION ALL SELECT path, old_path, 'renamed' FROM r""")
def manifest_diff(t: Tables) -> DataFrame:
    old = t.pages.where("page_id % 3 <> 0").select(F.col("url").alias("path"), F.sha1(F.col("html").cast("binary")).alias("sha"))
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("moved/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    body = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    return diff.manifest_diff(old, t.pages.where("page_id % 7 <> 1").select(path.alias("path"), F.sha1(body.cast("binary")).alias("sha")))


@query("""WITH a AS (SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 10), b AS (SELECT r_name FROM region WHERE r_regionkey > 1 UNION ALL SELECT n_name FROM nation WHERE n_nationkey > 5 UNION ALL SELECT n_name FROM nation WHERE n_nationkey > 22)
SELECT r_name AS name, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT r_name, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def multiset_parity(t: Tables) -> DataFrame:
    nation = t.nation.select("n_name", "n_nationkey")
    a = t.region.select(F.col("r_name").alias("name")).union(nation.where("n_nationkey < 10").select("n_name"))
    b = t.region.where("r_regionkey > 1").select(F.col("r_name").alias("name")).union(nation.where("n_nationkey > 5").select("n_name")).union(nation.where("n_nationkey > 22").select("n_name"))
    return diff.multiset_diff(a, b)


@query("""WITH h AS (
  SELECT 'customer' AS table_name, sha256(to_json({'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR) AS h FROM customer
  UNION ALL SELECT 'part', sha256(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_size': p_size})::VARCHAR) FROM part)
SELECT table_name, count(*) AS n_rows, concat_ws('-', sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR,
  sum(('0x' || substr(h, 31, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 46, 15))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 61, 4))::BIGINT)::VARCHAR) AS digest
FROM h GROUP BY ALL""")
def table_fingerprint(t: Tables) -> DataFrame:
    return diff.fingerprint({"customer": (t.customer, ["c_name", "c_mktsegment", "c_nationkey"]), "part": (t.part, ["p_name", "p_brand", "p_size"])})


@query("""WITH s AS (SELECT s_name, s_nationkey, s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0), d AS (SELECT s_name, s_nationkey + 1 AS s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT d.s_name, d.s_nationkey, s.id FROM d LEFT JOIN s USING (s_name) UNION ALL SELECT * FROM s WHERE s.id % 10 = 1 AND s_name NOT IN (SELECT s_name FROM d)""")
def snapshot_sync(t: Tables) -> DataFrame:
    stored = t.supplier.where("s_suppkey % 3 <> 0").select("s_name", "s_nationkey", F.col("s_suppkey").alias("id"))
    desired = t.supplier.where("s_suppkey % 4 <> 0").select("s_name", (F.col("s_nationkey") + 1).alias("s_nationkey"))
    return diff.synchronized(stored, desired, ["s_name"], "id", stored.where("id % 10 = 1"))


# ---- names and extraction


@query(r"""SELECT page_id, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END AS path, nullif(split_part(CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END, '/', 2), '') AS lang
FROM (SELECT page_id, regexp_replace('/' || regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/+', '/', 'g') AS p FROM pages)""")
def url_canonical(t: Tables) -> DataFrame:
    path = names.canonical_path(F.col("url"))
    return t.pages.select("page_id", path.alias("path"), names.path_segment(path, 1).alias("lang"))


@query(r"""WITH k AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages)
SELECT page_id, trim(p[1]) AS module, CASE WHEN len(p) > 3 THEN array_to_string(p[2:len(p)-2], '/') END AS route, trim(p[len(p)-1]) AS entity, trim(p[len(p)]) AS action FROM k WHERE len(p) >= 3""")
def key_parse(t: Tables) -> DataFrame:
    key = names.operation_key(F.regexp_replace("url", "^https?://", ""))
    return t.pages.select("page_id", key.alias("k")).where("k is not null").select("page_id", "k.*")


@query("SELECT p_partkey, regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]', '', 'g') AS name FROM part")
def name_normalize(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.normalized(F.concat_ws("-", "p_name", "p_brand")).alias("name"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: x[1]), '') AS acronym,
  array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM part""")
def name_variants(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", names.acronym(F.col("p_name"), " ").alias("acronym"), names.slug_to_pascal(F.col("p_name")).alias("pascal"))


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, CAST(len(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS BIGINT) AS n_links FROM pages""")
def regex_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", extract.html_title().alias("title"), F.regexp_count("html", F.lit('<a href="[^"]*">[^<]*</a>')).cast("long").alias("n_links"))


@query(r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages)
SELECT page_id, i - 1 AS ordinal, h[i] AS href, l[i] AS label FROM (SELECT page_id, h, l, unnest(range(1, len(h) + 1)) AS i FROM x)""")
def page_links(t: Tables) -> DataFrame:
    return extract.html_links(t.pages)
