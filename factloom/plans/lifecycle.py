"""Access links, registry documents, histories and parsed content."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import validity
from factloom.operators.access import Evidence, folded
from factloom.operators.scratch import shared_dir, written
from factloom.plans.registry import Tables, query
from factloom.sources import parsed


@query("""WITH a AS (
  SELECT DISTINCT 'entity_fk' AS kind, CAST(s_suppkey AS VARCHAR) AS key, s_suppkey AS entity FROM supplier UNION SELECT 'file', CAST(l_partkey AS VARCHAR), l_suppkey FROM lineitem WHERE l_quantity > 45
  UNION SELECT 'file', CAST(p_partkey AS VARCHAR), p_partkey % (SELECT count(*) FROM supplier) FROM part UNION SELECT 'table_name', lower(n_name), s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
t AS (
  SELECT 'part' AS surface, CAST(p_partkey AS VARCHAR) AS record, 'file' AS kind, CAST(p_partkey AS VARCHAR) AS key, p_brand AS evidence FROM part
  UNION ALL SELECT 'order', CAST(l_orderkey AS VARCHAR), 'entity_fk', CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM lineitem UNION ALL SELECT 'order', CAST(l_orderkey AS VARCHAR), 'file', CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'table_name', lower(n_name), n_name FROM nation),
m AS (SELECT entity, surface, record, CASE kind WHEN 'entity_fk' THEN 1 WHEN 'file' THEN 2 ELSE 3 END AS rank, kind, min(evidence) AS evidence FROM a JOIN t USING (kind, key) GROUP BY ALL)
SELECT entity, surface, record, arg_min(kind, rank) AS link_type, arg_min(evidence, rank) AS evidence, string_agg(kind, ' ' ORDER BY rank) AS reasons FROM m GROUP BY ALL""")
def access_links(t: Tables) -> DataFrame:
    n = t.supplier.agg(F.count(F.lit(1)).alias("n"))
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    told = Evidence()
    told.anchor(t.supplier, F.col("s_suppkey"), entity_fk=F.col("s_suppkey"))
    told.anchor(t.lineitem.where("l_quantity > 45"), F.col("l_suppkey"), file=F.col("l_partkey"))
    told.anchor(t.part.join(F.broadcast(n)), F.col("p_partkey") % F.col("n"), file=F.col("p_partkey"))  # one row
    told.anchor(named, F.col("s_suppkey"), table_name=folded("n_name"))
    told.target(t.part, "part", F.col("p_partkey"), F.col("p_brand"), file=F.col("p_partkey"))
    told.target(t.lineitem, "order", F.col("l_orderkey"), F.col("l_linenumber"), entity_fk=F.col("l_suppkey"), file=F.col("l_partkey"))
    told.target(t.nation, "nation", F.col("n_nationkey"), F.col("n_name"), table_name=folded("n_name"))
    links = told.links()
    return links.withColumn("reasons", F.array_join("reasons", " "))


@query("""WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, s_acctbal < 0 AND s_suppkey % 2 = 0 AS bad, s_suppkey % 3 = 0 AS core FROM supplier), f AS (SELECT n, bool_or(bad) AS bad FROM s GROUP BY n)
SELECT 'r' || (s.n % 2) AS release, s.n || '.json' AS path, '/mod~1' || s.n || '/objects/part~0' || s.k || '/sub' AS pointer, CASE WHEN NOT f.bad THEN 'mod/' || s.n END AS module, CASE WHEN NOT f.bad THEN 'objects' END AS resource_kind, CASE WHEN NOT f.bad THEN 'part~' || s.k || '/sub' END AS resource_path,
  CASE WHEN NOT f.bad THEN CASE WHEN core THEN 'ALL' ELSE 'v' || (s.k % 4) END END AS revision, CASE WHEN NOT f.bad THEN CASE WHEN core THEN '-1' ELSE 'h' || s.k END END AS declared_hash, CASE WHEN NOT f.bad THEN core END AS source_optional, CASE WHEN f.bad THEN 'invalid_registry_leaf' END AS problem
FROM s JOIN f USING (n) WHERE s.bad OR NOT f.bad""")
def registry_entries(t: Tables) -> DataFrame:
    """A registry document for each nation's suppliers; a leaf without its hash makes a document faulty."""
    k, core = F.col("s_suppkey"), F.col("s_suppkey") % 3 == 0
    word = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    bad = (F.col("s_acctbal") < 0) & (k % 2 == 0)
    leaf = F.struct(F.when(core, "ALL").otherwise(word("v", k % 4)).alias("revision"), F.when(bad, None).when(core, "-1").otherwise(word("h", k)).alias("hash"), F.when(core, "coreService").alias("type"))
    inside = F.map_from_entries(F.collect_list(F.struct(word("part~", k).alias("k"), F.struct(leaf.alias("sub")).alias("v"))))
    documents = t.supplier.groupBy("s_nationkey").agg(inside.alias("parts"))
    document = F.to_json(F.create_map(word("mod/", F.col("s_nationkey")), F.create_map(F.lit("objects"), F.col("parts"))))
    files = documents.select(word("r", F.col("s_nationkey") % 2).alias("release"), F.concat(F.col("s_nationkey").cast("string"), F.lit(".json")).alias("path"), document.alias("content"))
    return parsed.registry_entries(files).select("release", "path", "pointer", "module", "resource_kind", "resource_path", "revision", "declared_hash", "source_optional", "problem")


_DAYS = """WITH k AS (SELECT o_orderkey AS key, o_orderstatus AS s FROM orders),
d AS (SELECT key, s AS d1, CASE WHEN key % 5 = 0 THEN NULL WHEN key % 4 = 0 THEN s || '2' ELSE s END AS d2, CASE WHEN key % 6 = 0 THEN s || '3' WHEN key % 5 = 0 THEN NULL ELSE s END AS d3, key % 7 = 0 AS failed FROM k)"""


def _days(t: Tables) -> DataFrame:
    """Three days of orders; on the second some changed, some were gone and some could not be read."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    day = lambda value: t.orders.select(k.alias("key"), value.alias("value")).where("value is not null")
    none = t.orders.select(k.alias("key")).limit(0)
    second = F.when(k % 5 == 0, None).when(k % 4 == 0, F.concat(s, F.lit("2"))).otherwise(s)
    third = F.when(k % 6 == 0, F.concat(s, F.lit("3"))).when(k % 5 == 0, None).otherwise(s)
    failed = t.orders.where("o_orderkey % 7 = 0").select(k.alias("key"))
    history = written(validity.history_of(day(s), 1), "history")
    history = written(validity.advanced(history, day(second).join(failed, "key", "left_anti"), failed, 2), "history")
    return validity.merged(validity.advanced(history, day(third), none, 3))


@query(_DAYS + """, r AS (
  SELECT key, d1 AS value, 1 AS since, CASE WHEN NOT failed AND d2 IS NOT DISTINCT FROM d1 THEN CASE WHEN d3 IS NOT DISTINCT FROM d1 THEN NULL ELSE 3 END WHEN failed AND d3 = d1 THEN NULL WHEN failed THEN 2 ELSE 2 END AS until, false AS stale FROM d
  UNION ALL SELECT key, d1, 2, 3, true FROM d WHERE failed AND d3 IS DISTINCT FROM d1
  UNION ALL SELECT key, d2, 2, CASE WHEN d3 IS NOT DISTINCT FROM d2 THEN NULL ELSE 3 END, false FROM d WHERE NOT failed AND d2 IS NOT NULL AND d2 <> d1
  UNION ALL SELECT key, d3, 3, NULL, false FROM d WHERE d3 IS NOT NULL AND d3 IS DISTINCT FROM CASE WHEN failed THEN d1 ELSE d2 END)
SELECT key, value, CAST(since AS BIGINT) AS since, CAST(until AS BIGINT) AS until, stale FROM r""")
def orders_history(t: Tables) -> DataFrame:
    return _days(t)


@query(_DAYS + """ SELECT key, CASE WHEN failed THEN d1 ELSE d2 END AS value, failed AND d3 IS DISTINCT FROM d1 AS stale FROM d WHERE failed OR d2 IS NOT NULL""")
def orders_as_of(t: Tables) -> DataFrame:
    return validity.as_of(_days(t), 2)


@query("SELECT page_id AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS size FROM pages WHERE html IS NOT NULL")
def parsed_titles(t: Tables) -> DataFrame:
    """The title of each page, read once for each content and kept; the second update has nothing to parse."""
    parser = lambda blobs: blobs.select("blob", F.regexp_extract("content", "<title>([^<]*)</title>", 1).alias("title"), F.char_length("content").cast("long").alias("size"))
    store = parsed.Parsed(t.spark, f"{shared_dir(t.spark)}/titles-{uuid.uuid4().hex}", "1", parser, "title string, size long")
    files = t.pages.where("html is not null").select(F.col("page_id").alias("path"), F.col("html").alias("content"))
    store.update(files)
    if store.update(files):
        raise RuntimeError("known content was parsed again")
    return store.rows(files).select("path", "title", "size")
