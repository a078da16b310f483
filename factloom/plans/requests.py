"""Requests, their coverage, and reports over unlike rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import requests
from factloom.operators import rollups, search
from factloom.plans.registry import Tables, query


@query("""SELECT event_id, CASE event_type WHEN 'create' THEN 'POST' WHEN 'delete' THEN 'DELETE' WHEN 'patch' THEN 'PATCH' WHEN 'post' THEN 'POST' WHEN 'put' THEN 'PUT' WHEN 'read' THEN 'GET'
  WHEN 'update' THEN 'PATCH' END AS by_type, CASE WHEN value >= 50 THEN 'GET' ELSE 'PATCH' END AS method FROM events""")
def request_methods(t: Tables) -> DataFrame:
    verb = F.when(F.col("value") >= 50, "Read").otherwise("UPDATE")
    return t.events.select("event_id", requests.method(F.col("event_type")).alias("by_type"), requests.method(verb).alias("method"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'known_issue' WHEN l_quantity < 10 THEN 'ci_only' ELSE 'active' END AS eligibility FROM lineitem""")
def case_eligibility(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", requests.eligibility(_tags()).alias("eligibility"))


def _tags():
    known = F.when(F.col("l_returnflag") == "R", "@KnownIssue").otherwise("@smoke")
    return F.array(F.concat(F.lit("@"), F.lower("l_returnflag")), known, F.when(F.col("l_quantity") < 10, "@CI_only").otherwise("@any"))


@query(r"""SELECT p_partkey, CASE WHEN p_size >= 10 THEN nullif(regexp_extract('/workflows/' || replace(p_type, ' ', '/'), '^/workflows/[^/]+/[^/]+/([^/]+)$', 1), '') END AS action FROM part""")
def workflow_actions(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/workflows/"), F.replace(F.col("p_type"), F.lit(" "), F.lit("/")))
    return t.part.select("p_partkey", requests.workflow_action(F.when(F.col("p_size") >= 10, "workflow").otherwise("item"), path).alias("action"))


@query("""WITH c AS (SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 'known_issue' WHEN l_quantity < 10 THEN 'ci_only' ELSE 'active' END AS e FROM lineitem),
g AS (SELECT l_partkey, count(*) FILTER (e = 'active') AS a, count(*) FILTER (e = 'ci_only') AS c, count(*) FILTER (e = 'known_issue') AS k FROM c GROUP BY 1)
SELECT p_partkey, coalesce(a, 0) AS active_cases, coalesce(c, 0) AS ci_cases, coalesce(k, 0) AS known_issue_cases,
  CASE WHEN a > 0 THEN 'active' WHEN c > 0 THEN 'ci_conditional' WHEN k > 0 THEN 'known_issue_only' ELSE 'uncovered' END AS coverage FROM part LEFT JOIN g ON l_partkey = p_partkey""")
def request_coverage(t: Tables) -> DataFrame:
    active, ci, known, level = requests.coverage(requests.eligibility(_tags()))
    cases = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(active.alias("active_cases"), ci.alias("ci_cases"), known.alias("known_issue_cases"), level.alias("coverage"))
    return t.part.select("p_partkey").join(cases, "p_partkey", "left").fillna(0, ["active_cases", "ci_cases", "known_issue_cases"]).fillna("uncovered", ["coverage"])


@query("""SELECT 0 AS severity, 'customer' AS kind, to_json({'id': c_custkey, 'name': c_name}) AS detail FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 1, 'supplier', to_json({'id': s_suppkey, 'name': s_name}) FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 2, 'order', to_json({'id': o_orderkey, 'status': o_orderstatus}) FROM orders WHERE o_orderstatus = 'P'""")
def severity_merge(t: Tables) -> DataFrame:
    parts = [
        (t.customer.where("c_acctbal < 0"), "customer", {"id": "c_custkey", "name": "c_name"}),
        (t.supplier.where("s_acctbal < 0"), "supplier", {"id": "s_suppkey", "name": "s_name"}),
        (t.orders.where("o_orderstatus = 'P'"), "order", {"id": "o_orderkey", "status": "o_orderstatus"}),
    ]
    return rollups.by_severity(parts)


@query("""WITH g AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name FROM part), p AS (SELECT DISTINCT regexp_replace(lower(replace(p_name, ' ', '-')), '[^a-z0-9]', '', 'g') AS name FROM part WHERE p_size > 20)
SELECT count(*) AS n_wanted, count(p.name) AS n_found, round(count(p.name) / count(*), 6) AS recall FROM g LEFT JOIN p USING (name)""")
def normalized_recall(t: Tables) -> DataFrame:
    said = t.part.where("p_size > 20").select(F.replace(F.upper("p_name"), F.lit(" "), F.lit("-")).alias("name"))
    return rollups.name_recall(t.part.select(F.col("p_name").alias("name")), said, "name")


@query("""WITH p AS (SELECT doc_id, lang FROM documents WHERE n_chars > 500), g AS (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
b AS (SELECT coalesce(p.lang, g.lang) AS lang, p.doc_id AS p, g.doc_id AS g FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.lang = g.lang),
c AS (SELECT lang, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM b GROUP BY lang),
f AS (SELECT *, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c)
SELECT round(avg(f1), 5) AS macro_f1, round(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 6) AS micro_f1 FROM f""")
def macro_micro_scores(t: Tables) -> DataFrame:
    predicted = t.documents.where("n_chars > 500").select("lang", "doc_id")
    gold = search.having_ids(t.documents.select("lang", "doc_id"), t.labels.where("quality = 1"), "doc_id")
    return rollups.macro_micro(rollups.precision_recall(predicted, gold, ["doc_id"], "lang"))
