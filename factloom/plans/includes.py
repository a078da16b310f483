"""Parts that include others: closure, cycles, nearest definitions, required files; handlers; owners; generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import closure, handlers, hashtree, ownership
from factloom.operators.scratch import shared_dir
from factloom.plans.registry import Tables, query
from factloom.sources.generations import Table

#: Each part includes the one of half its number, and some their neighbour, which makes cycles.
_EDGES = """e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0
  UNION SELECT p_partkey, xor(p_partkey, 1) FROM part WHERE p_size > 40 AND xor(p_partkey, 1) < (SELECT count(*) FROM part)),
c AS (SELECT src, dst, 1 AS steps FROM e UNION SELECT c.src, e.dst, steps + 1 FROM c JOIN e ON e.src = c.dst WHERE steps < 40),
r AS (SELECT src, dst, min(steps) AS steps FROM c GROUP BY ALL)"""


def _edges(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    half = t.part.where("p_partkey > 0").select(p.alias("src"), F.floor(p / 2).alias("dst"))
    mate = t.part.where("p_size > 40").select(p.alias("src"), p.bitwiseXOR(F.lit(1).cast("long")).alias("dst")).join(t.part.select(p.alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")
    return half.unionByName(mate).distinct()


@query(f"WITH RECURSIVE {_EDGES} SELECT src, dst, steps FROM r")
def include_closure(t: Tables) -> DataFrame:
    return closure.closure(_edges(t))


@query(f"WITH RECURSIVE {_EDGES} SELECT p_partkey AS node, least(p_partkey, coalesce(min(a.dst), p_partkey)) AS component FROM part LEFT JOIN (SELECT r.src, r.dst FROM r JOIN r AS b ON b.src = r.dst AND b.dst = r.src) AS a ON a.src = p_partkey GROUP BY p_partkey")
def include_cycles(t: Tables) -> DataFrame:
    return closure.components(t.part.select(F.col("p_partkey").alias("node")), _edges(t))


@query(f"""WITH RECURSIVE {_EDGES}, d AS (SELECT p_partkey AS node, p_brand AS key FROM part WHERE p_size % 3 = 0),
a AS (SELECT node, key, 0 AS steps, node AS owner FROM d UNION ALL SELECT src, key, steps, node FROM r JOIN d ON d.node = dst WHERE src <> dst),
n AS (SELECT node, key, steps, owner, min(steps) OVER (PARTITION BY node, key) AS least FROM a)
SELECT node, key, steps, CASE WHEN min(owner) = max(owner) THEN min(owner) END AS owner, min(owner) <> max(owner) AS several FROM n WHERE steps = least GROUP BY node, key, steps""")
def nearest_definitions(t: Tables) -> DataFrame:
    return closure.nearest_definitions(_edges(t), t.part.where("p_size % 3 = 0").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("key")))


@query("""WITH f AS (SELECT p_partkey AS k, 'app/source/' || replace(p_brand, '#', '') || '/' || p_partkey || '.ent' AS path, p_brand AS brand, p_size AS size FROM part), q AS (
  SELECT f.path, f.size, CASE WHEN f.size % 5 = 0 THEN 'lib/' || g.k || '.ent' WHEN f.size % 5 = 1 THEN 'none.ent' ELSE '../' || replace(g.brand, '#', '') || '/./' || g.k || '.ent' END AS required, g.path AS half FROM f JOIN f AS g ON g.k = f.k // 2)
SELECT path, required, CASE WHEN size % 5 <> 1 THEN half END AS target, CASE WHEN size % 5 = 0 THEN 'definition name' WHEN size % 5 > 1 THEN 'relative' END AS how FROM q""")
def required_files(t: Tables) -> DataFrame:
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    path = F.concat(F.lit("app/source/"), brand, F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".ent"))
    other = t.part.select(F.col("p_partkey").alias("half"), brand.alias("half_brand"))
    rows = t.part.select("p_partkey", "p_size", path.alias("path")).withColumn("half", F.floor(F.col("p_partkey") / 2)).join(other, "half")
    name = F.concat(F.col("half").cast("string"), F.lit(".ent"))
    required = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("lib/"), name)).when(F.col("p_size") % 5 == 1, "none.ent").otherwise(F.concat(F.lit("../"), "half_brand", F.lit("/./"), name))
    files = rows.select("path", F.concat(F.lit("<?php\nrequire_once '"), required, F.lit("';\n$a = 1; require_once(\""), F.replace(required, F.lit("/"), F.lit("\\")), F.lit("\");")).alias("content"))
    definitions = t.part.select(F.col("p_partkey").alias("place"), path.alias("ent_file"), F.lit(None).cast("string").alias("entity_name"))
    return closure.resolved_requires(closure.required_paths(files), files, closure.definition_keys(definitions))


_HANDLERS = """names AS (SELECT p_partkey AS script, replace(p_name, ' ', '_') || '_' || p_size AS name, p_brand = 'Brand#1' AS nested, p_size = 50 AS broken FROM part),
links AS (SELECT DISTINCT o_custkey AS surface, l_partkey AS script, CASE l_returnflag WHEN 'R' THEN 'conditional' ELSE 'active' END AS scope FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
ev AS (SELECT o_orderkey AS event, o_custkey AS surface, CASE o_orderstatus WHEN 'P' THEN 'view.' ELSE '' END || name AS name FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS script FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN names USING (script)),
sy AS (SELECT script, name FROM names WHERE NOT nested AND NOT broken UNION ALL SELECT script, name FROM names WHERE NOT nested AND NOT broken AND script % 10 = 0),
g AS (SELECT surface, name, count(*) FILTER (scope = 'active') AS a, count(*) FILTER (scope = 'conditional') AS c, min(script) AS script FROM links JOIN sy USING (script) GROUP BY ALL),
b AS (SELECT DISTINCT surface FROM links JOIN names USING (script) WHERE broken)"""


@query(f"""WITH {_HANDLERS}, s AS (
  SELECT event, ev.surface, ev.name, script, CASE WHEN ev.name LIKE '%.%' THEN 'unsupported' WHEN a = 1 AND c = 0 THEN 'resolved' WHEN a > 0 THEN 'ambiguous' WHEN c > 0 THEN 'conditional' ELSE 'unresolved' END AS status, a, c, b.surface IS NOT NULL AS blocked
  FROM ev LEFT JOIN g ON g.surface = ev.surface AND g.name = ev.name LEFT JOIN b ON b.surface = ev.surface)
SELECT event, surface, name, status, CASE status WHEN 'unsupported' THEN 'member_or_dynamic_handler_expression' WHEN 'resolved' THEN 'unique_active_exact_callable' WHEN 'ambiguous' THEN CASE WHEN c > 0 THEN 'mixed_active_and_conditional' ELSE 'multiple_active_exact_callables' END
  WHEN 'conditional' THEN 'conditional_exact_callable' ELSE CASE WHEN blocked THEN 'linked_script_parse_error' ELSE 'no_linked_exact_callable' END END AS reason,
  CASE WHEN status = 'resolved' OR (status = 'conditional' AND c = 1) THEN script END AS script FROM s""")
def event_handlers(t: Tables) -> DataFrame:
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))
    parts = t.part.select(F.col("p_partkey").alias("script"), name.alias("name"), F.when(F.col("p_brand") == "Brand#1", "outer").alias("parent"), "p_size")
    links = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("surface"), F.col("l_partkey").alias("script"), F.when(F.col("l_returnflag") == "R", "conditional").otherwise("active").alias("scope"))
    asked = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("script")).join(parts.select("script", "name"), "script")
    events = t.orders.join(asked, "o_orderkey").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("surface"), F.concat(F.when(F.col("o_orderstatus") == "P", "view.").otherwise(""), "name").alias("name"))
    symbols = parts.select("script", "name", "parent").unionByName(parts.where("script % 10 = 0").select("script", "name", "parent"))
    return handlers.handlers(events, links, symbols, parts.where("p_size = 50").select("script"))


#: Customers and suppliers belong to nations, orders to customers, lines to orders and suppliers.
_OWNERS = """rows AS (SELECT 'C' || c_custkey AS row, c_nationkey AS owner FROM customer UNION ALL SELECT 'S' || s_suppkey, s_nationkey FROM supplier UNION ALL SELECT 'O' || o_orderkey, NULL FROM orders UNION ALL SELECT 'P' || p_partkey, NULL FROM part),
keys AS (SELECT 'O' || o_orderkey AS child, 'C' || o_custkey AS parent FROM orders UNION SELECT 'P' || l_partkey, 'O' || l_orderkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem WHERE l_quantity > 45),
o AS (SELECT row, owner FROM rows WHERE owner IS NOT NULL UNION SELECT child, o.owner FROM keys JOIN o ON o.row = parent),
f AS (SELECT row, min(o.owner) AS least, max(o.owner) AS most FROM rows LEFT JOIN o USING (row) GROUP BY 1)"""


def _owner_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    id_ = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    none = F.lit(None).cast("int").alias("owner")
    rows = t.customer.select(id_("C", "c_custkey").alias("row"), F.col("c_nationkey").alias("owner")).unionByName(t.supplier.select(id_("S", "s_suppkey").alias("row"), F.col("s_nationkey").alias("owner")))
    rows = rows.unionByName(t.orders.select(id_("O", "o_orderkey").alias("row"), none)).unionByName(t.part.select(id_("P", "p_partkey").alias("row"), none))
    keys = t.orders.select(id_("O", "o_orderkey").alias("child"), id_("C", "o_custkey").alias("parent")).unionByName(
        t.lineitem.where("l_linenumber = 1").select(id_("P", "l_partkey").alias("child"), id_("O", "l_orderkey").alias("parent"))).unionByName(
        t.lineitem.where("l_quantity > 45").select(id_("P", "l_partkey").alias("child"), id_("S", "l_suppkey").alias("parent")))
    return rows, keys.distinct()


@query(f"WITH RECURSIVE {_OWNERS} SELECT row, CASE WHEN least IS NULL THEN 'none' WHEN least = most THEN 'one' ELSE 'several' END AS state, CASE WHEN least = most THEN least END AS owner, least, most FROM f")
def key_owners(t: Tables) -> DataFrame:
    return ownership.owners(*_owner_rows(t))


@query(f"""WITH RECURSIVE {_OWNERS} SELECT b.row, min(k.parent) FILTER (p.least = b.least) AS parent_least, min(k.parent) FILTER (p.most = b.most) AS parent_most FROM f AS b JOIN keys AS k ON k.child = b.row JOIN f AS p ON p.row = k.parent WHERE b.least <> b.most GROUP BY b.row""")
def owner_witnesses(t: Tables) -> DataFrame:
    rows, keys = _owner_rows(t)
    return ownership.witnesses(ownership.owners(rows, keys), keys)


@query("""WITH v AS (SELECT 'line_supplier' AS rule, 'L' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS row FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey
  UNION ALL SELECT 'customer_nation', 'C' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> c_custkey % 5),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY row) AS r FROM v)
SELECT rule, count(*) AS n, string_agg(row, ' ' ORDER BY row) FILTER (r <= 3) AS witnesses FROM r GROUP BY rule""")
def scope_violations(t: Tables) -> DataFrame:
    line = F.concat(F.lit("L"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    owned = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).select(line.alias("row"), F.col("l_suppkey").alias("key"), F.col("c_nationkey").alias("owner"))
    customers = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("row"), F.col("c_nationkey").alias("key"), (F.col("c_custkey") % 5).alias("owner"))
    found = ownership.scope_violations({
        "line_supplier": (lines, t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("owner"))),
        "customer_nation": (customers, t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("owner")))})
    return found.select("rule", "n", F.array_join("witnesses", " ").alias("witnesses"))


@query("""SELECT p_partkey AS row, count(DISTINCT s_nationkey) AS n_owners, CASE WHEN count(DISTINCT s_nationkey) = 1 THEN min(s_nationkey) END AS owner FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48 LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def proven_owners(t: Tables) -> DataFrame:
    told = t.lineitem.where("l_quantity > 48").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("row"), F.col("s_nationkey").alias("owner"))
    return ownership.one_proven_owner(t.part.select(F.col("p_partkey").alias("row")), told)


def _changed(t: Tables) -> DataFrame:
    """The orders of another day: some dearer, some gone, some new."""
    k = F.col("o_orderkey")
    stay = t.orders.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(k % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return stay.unionByName(t.orders.where("o_orderkey % 13 = 0").withColumn("o_orderkey", k + 1_000_000_000))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' ELSE 'modified' END AS change FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey + 1000000000, 'added' FROM orders WHERE o_orderkey % 13 = 0""")
def tree_diff(t: Tables) -> DataFrame:
    return hashtree.tree_diff(t.orders, _changed(t), ["o_orderkey"], t.orders.columns)


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey < 1000000000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM (
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 13 = 0)""")
def copied_on_write(t: Tables) -> DataFrame:
    """A table of orders, changed by what differs to another day, read again."""
    import uuid

    table = Table(t.spark, f"{shared_dir(t.spark)}/orders-{uuid.uuid4().hex}", "o_orderkey", 16)
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    table.create(rows)
    new = _changed(t).select("o_orderkey", "o_custkey", "o_totalprice")
    kinds = hashtree.tree_diff(rows, new, ["o_orderkey"], rows.columns)
    k, gone = F.col("o_orderkey"), F.col("change") == "deleted"
    changes = kinds.join(new, "o_orderkey", "left").select(
        "change", F.when(F.col("change") != "added", k).alias("old_key"), F.when(~gone, k).alias("new_key"), F.lit(None).cast("string").alias("old_hash"), F.lit(None).cast("string").alias("new_hash"), "o_custkey", "o_totalprice")
    table.apply(changes)
    return table.read()
