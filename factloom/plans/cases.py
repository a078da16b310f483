"""Test cases made of conversations: their steps, requests, endpoints and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import requests as R
from factloom.operators import evidence
from factloom.plans.registry import Tables, query
from factloom.sources import gherkin

#: A user's turn is a request by the length of its text, an assistant's tells a status or a version.
_STEPS = """steps AS (
  SELECT conv_id AS c, turn AS at, CAST(turn AS INTEGER) AS line, role, length(text) AS n,
         CASE WHEN role = 'user' THEN ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'][1 + length(text) % 5] END AS method,
         CASE WHEN role = 'user' THEN 'obj' || (length(text) % 7) END AS token,
         CASE WHEN length(text) % 11 = 0 OR (role <> 'user' AND length(text) % 3 = 1) THEN 'v' || (length(text) % 4) END AS named,
         CASE WHEN role <> 'user' AND length(text) % 3 = 0 THEN 200 + length(text) % 7 END AS told FROM conversations),
cases AS (SELECT DISTINCT conv_id AS c, CASE WHEN conv_id % 3 > 0 THEN 'v' || (conv_id % 3) END AS declared, CASE conv_id % 4 WHEN 0 THEN 'known_issue' WHEN 1 THEN 'ci_only' ELSE 'active' END AS eligibility FROM conversations),
mapping AS (SELECT 'obj' || r_regionkey AS token, CASE WHEN r_regionkey = 1 THEN '/workflows/ap/bill/submit' WHEN r_regionkey = 2 THEN 'x/workflow-log' ELSE 'core/' || lower(replace(r_name, ' ', '-')) END AS target FROM region),
f AS (
  SELECT s.*, declared, eligibility, coalesce(last_value(named IGNORE NULLS) OVER w, declared) AS version, count(method) OVER w AS ordinal,
         n % 3 = 0 AS keyed, n % 10 = 4 AS acts, n % 6 = 5 AS child FROM steps s JOIN cases USING (c) WINDOW w AS (PARTITION BY c ORDER BY s."at" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT c, ordinal, max_by(told, f."at") AS expected FROM f WHERE method IS NULL AND told IS NOT NULL AND ordinal > 0 GROUP BY ALL),
q AS (
  SELECT f.c, CAST(f.ordinal AS INTEGER) AS ordinal, f.line, f.method, f.token, f.eligibility,
         CASE WHEN m.target IS NULL THEN NULL WHEN child AND n % 4 = 3 THEN NULL
              WHEN child THEN '/objects/core/africa/{key}/' || ltrim(m.target, '/') || CASE WHEN acts THEN '/post' ELSE '' END
              WHEN m.target LIKE '/%' THEN m.target || CASE WHEN acts THEN '/post' ELSE '' END
              ELSE '/objects/' || m.target || CASE WHEN m.target LIKE '%workflow%' OR acts THEN '' WHEN keyed THEN '/{key}' ELSE '' END || CASE WHEN acts THEN '/post' ELSE '' END END AS path,
         f.version, t.expected AS expected_status,
         CASE WHEN m.target IS NULL THEN 'unknown' WHEN child AND n % 4 = 3 THEN 'child' WHEN acts THEN 'workflow' WHEN child THEN 'child' WHEN m.target LIKE '%workflow%' THEN 'workflow' WHEN keyed THEN 'item' ELSE 'collection' END AS operation,
         named IS NOT NULL AS explicit_version, CASE WHEN m.target IS NULL THEN 'unresolved_object' WHEN child AND n % 4 = 3 THEN 'unresolved_parent' END AS problem
  FROM f LEFT JOIN mapping m ON m.token = f.token LEFT JOIN t ON t.c = f.c AND t.ordinal = f.ordinal WHERE f.method IS NOT NULL)"""

_ENDPOINTS = """endpoints AS (
  SELECT n_nationkey * 2 + v AS endpoint, ['GET', 'POST', 'PUT', 'PATCH', 'DELETE'][1 + n_nationkey // 5] AS method, '/services/v' || v || CASE n_regionkey WHEN 1 THEN '/workflows/ap/bill/submit' WHEN 2 THEN '/objects/x/workflow-log' ELSE '/objects/core/' || lower(replace(r_name, ' ', '-')) END
    || CASE WHEN v = 1 AND n_regionkey NOT IN (1, 2) THEN '/{key}' ELSE '' END AS path, CASE WHEN n_nationkey % 6 < 5 THEN 'v' || (n_nationkey % 4) END AS source_version
  FROM nation JOIN region ON r_regionkey = n_regionkey CROSS JOIN (SELECT unnest([0, 1]) AS v)),
bridges AS (SELECT * FROM (VALUES ('v1', 'v0', 'active'), ('v3', 'v2', 'active'), ('v2', 'v1', 'retired')) AS b(version, source_version, status)),
e AS (SELECT endpoint, method, coalesce(nullif(rtrim(regexp_replace(path, '^/services/v[0-9]+/', '/'), '/'), ''), '/') AS path, source_version FROM endpoints WHERE source_version IS NOT NULL),
m AS (
  SELECT c, ordinal, endpoint, 'exact' AS how FROM q JOIN e USING (method, path) WHERE version = source_version
  UNION ALL SELECT c, ordinal, endpoint, 'compatible' FROM q JOIN e USING (method, path) JOIN bridges b ON b.version = q.version AND b.source_version = e.source_version WHERE b.status = 'active' AND q.version <> e.source_version),
g AS (SELECT c, ordinal, count(*) AS n, min(endpoint) AS endpoint, min(how) AS how FROM m GROUP BY ALL)"""


def _steps(t: Tables) -> DataFrame:
    n, user = F.length("text"), F.col("role") == "user"
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    when = lambda condition, *parts: F.when(condition, said(*parts)).otherwise("")
    verb = F.get(F.array(*[F.lit(x) for x in ("GET", "POST", "PUT", "PATCH", "DELETE")]), (n % 5).cast("int"))
    child = when(n % 6 == 5, ' for parent "', F.when(n % 4 == 3, "nobody").otherwise("{{ obj0 }}"), '" with key "k"')
    key = F.when(n % 6 == 5, "").otherwise(when(n % 3 == 0, ' with key "k', n, '"'))
    version = when(n % 11 == 0, ' for version "v', n % 4, '"')
    request = F.concat(said('"', verb, '" to '), F.when(n % 6 == 5, "child ").otherwise(""), said('"obj', n % 7, '"'), key, child, version, when(n % 10 == 4, ' with action "/post/"'))
    other = F.concat(when(n % 3 == 0, "the status code is ", 200 + n % 7), when((n % 3 == 1) | (n % 11 == 0), 'all for version "v', n % 4, '"'))
    return t.conversations.select(F.col("conv_id").alias("c"), F.col("turn").alias("at"), F.col("turn").cast("int").alias("line"), F.when(user, request).otherwise(other).alias("text"))


def _cases(t: Tables) -> DataFrame:
    c = F.col("conv_id")
    tag = F.array(F.when(c % 4 == 0, "@KnownIssue").when(c % 4 == 1, "@CI_only").otherwise("@smoke"))
    versions = F.when(c % 3 > 0, F.array(F.concat(F.lit("v"), (c % 3).cast("string")))).otherwise(F.expr("cast(array() as array<string>)"))
    return t.conversations.select(c.alias("c"), versions.alias("versions"), F.lit(None).cast("string").alias("fallback"), R.eligibility(tag).alias("eligibility")).distinct()


def _mapping(t: Tables) -> DataFrame:
    r = F.col("r_regionkey")
    name = F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))
    return t.region.select(F.concat(F.lit("obj"), r.cast("string")).alias("token"), F.when(r == 1, "/workflows/ap/bill/submit").when(r == 2, "x/workflow-log").otherwise(F.concat(F.lit("core/"), name)).alias("target"))


def _requests(t: Tables) -> DataFrame:
    return evidence.case_requests(_cases(t), _steps(t), _mapping(t), ["c"])


def _endpoints(t: Tables) -> DataFrame:
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    name = F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))
    base = F.when(r == 1, "/workflows/ap/bill/submit").when(r == 2, "/objects/x/workflow-log").otherwise(F.concat(F.lit("/objects/core/"), name))
    path = F.concat(F.lit("/services/v"), F.col("v").cast("string"), base, F.when((F.col("v") == 1) & ~r.isin(1, 2), "/{key}").otherwise(""))
    verb = F.get(F.array(*[F.lit(x) for x in ("GET", "POST", "PUT", "PATCH", "DELETE")]), F.floor(k / 5).cast("int"))
    return both.select((k * 2 + F.col("v")).alias("endpoint"), verb.alias("method"), path.alias("path"), F.when(k % 6 < 5, F.concat(F.lit("v"), (k % 4).cast("string"))).alias("source_version"))


def _matches(t: Tables) -> DataFrame:
    bridges = t.spark.createDataFrame([("v1", "v0", "active"), ("v3", "v2", "active"), ("v2", "v1", "retired")], "test_version string, endpoint_version string, status string")
    return evidence.endpoint_matches(_requests(t), _endpoints(t), bridges, ["c"])


@query(f"WITH {_STEPS} SELECT c, ordinal, line, method, token, path AS route, version, expected_status, operation, explicit_version, problem, CASE WHEN operation = 'workflow' THEN nullif(regexp_extract(path, '^/workflows/[^/]+/[^/]+/([^/]+)$', 1), '') END AS action FROM q")
def request_evidence(t: Tables) -> DataFrame:
    return _requests(t)


@query(f"WITH {_STEPS}, {_ENDPOINTS} SELECT c, ordinal, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN n = 1 THEN endpoint END AS endpoint, CASE WHEN n = 1 THEN how END AS match FROM q LEFT JOIN g USING (c, ordinal)")
def request_endpoints(t: Tables) -> DataFrame:
    return _matches(t)


@query(f"""WITH {_STEPS}, {_ENDPOINTS}, p AS (SELECT DISTINCT c, endpoint FROM g WHERE n = 1), k AS (
  SELECT endpoint, count(*) FILTER (eligibility = 'active') AS a, count(*) FILTER (eligibility = 'ci_only') AS ci, count(*) FILTER (eligibility = 'known_issue') AS ki FROM p JOIN cases USING (c) GROUP BY 1)
SELECT endpoint, coalesce(a, 0) AS active_cases, coalesce(ci, 0) AS ci_cases, coalesce(ki, 0) AS known_issue_cases, CASE WHEN a > 0 THEN 'active' WHEN ci > 0 THEN 'ci_conditional' WHEN ki > 0 THEN 'known_issue_only' ELSE 'uncovered' END AS coverage FROM endpoints LEFT JOIN k USING (endpoint)""")
def endpoint_coverage(t: Tables) -> DataFrame:
    return evidence.endpoint_coverage(_endpoints(t), _matches(t), _cases(t), ["c"])


def _features(t: Tables) -> DataFrame:
    """A feature file for each conversation: a plain scenario for each assistant's turn, an outline of two examples for each user's."""
    turn = F.col("turn").cast("string")
    outline = F.concat(F.lit("  @AB-"), turn, F.lit(' @CI_only\n  Scenario Outline: S <x> of <y>\n    When "GET" to "<x>"\n    # not a step\n    Then the status code is 200\n    Examples:\n      | testCaseID | x |\n      | T'), turn, F.lit(" | <y> |\n      | | b\\|c |\n"))
    plain = F.concat(F.lit("Scenario: P"), turn, F.lit('\n    Given text\n    """\n    Given no step\n    """\n    And more\n'))
    lines = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", outline).otherwise(plain).alias("text")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    head = F.concat(F.lit("﻿@version:v"), (F.col("conv_id") % 3).cast("string"), F.lit("\nFeature: F"), F.col("conv_id").cast("string"), F.lit("\n  Background:\n    Given nothing\n"))
    return lines.select(F.col("conv_id").alias("path"), F.concat(head, body).alias("content"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, 2 + count(*) FILTER (role = 'user') OVER w + row_number() OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, 2 + count(*) OVER v + count(*) FILTER (role = 'user') OVER v AS scenario FROM c WINDOW v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT unnest([1, 2]) AS example)
SELECT conv_id AS path, scenario + 1 AS scenario, example, 'F' || conv_id AS feature_name, CASE example WHEN 1 THEN 'S <y> of <y>' ELSE 'S b|c of <y>' END AS name, CASE example WHEN 1 THEN 'T' || turn ELSE 'S b|c of <y>' END AS case_name,
  '@version:v' || (conv_id % 3) || ' @AB-' || turn || ' @CI_only' AS tags, 'AB-' || turn AS issues, 'ci_only' AS eligibility, CASE WHEN conv_id % 3 = 2 THEN '' ELSE 'v' || (conv_id % 3) END AS versions, conv_id % 3 = 2 AS conflicted, 2 AS n_steps, CASE example WHEN 1 THEN '"GET" to "<y>"' ELSE '"GET" to "b|c"' END AS first_step
FROM n CROSS JOIN e WHERE role = 'user'
UNION ALL SELECT conv_id, scenario + 1, NULL, 'F' || conv_id, 'P' || turn, 'P' || turn, '@version:v' || (conv_id % 3), '', 'active', CASE WHEN conv_id % 3 = 2 THEN '' ELSE 'v' || (conv_id % 3) END, conv_id % 3 = 2, 2, 'text' FROM n WHERE role <> 'user'""")
def feature_cases(t: Tables) -> DataFrame:
    files = _features(t)
    c = F.col("path") % 3
    meta = files.select("path", F.when(c == 1, "v1").when(c == 2, "v9").alias("version"), F.lit(None).cast("string").alias("test_object"))
    cases, steps, _ = gherkin.features(files, meta)
    counted = steps.groupBy("path", "scenario", "example").agg(F.count(F.lit(1)).alias("n_steps"), F.min_by("text", "at").alias("first_step")).withColumn("example", F.coalesce("example", F.lit(0)))
    shown = cases.withColumn("example", F.coalesce("example", F.lit(0))).join(counted, ["path", "scenario", "example"])
    return shown.select(
        "path", "scenario", F.nullif("example", F.lit(0)).alias("example"), "feature_name", "name", "case_name", F.array_join("tags", " ").alias("tags"), F.array_join("issues", " ").alias("issues"), "eligibility",
        F.array_join("versions", " ").alias("versions"), "conflicted", "n_steps", "first_step")
