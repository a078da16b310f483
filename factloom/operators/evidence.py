"""Requests that the steps of test cases make, the endpoints that they prove, and the coverage that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import requests as R


def unambiguous(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The aliases of ``mapping`` (token, target) that name one target, and those that name several (token, targets)."""
    counted = mapping.where("target is not null").groupBy("token").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    return counted.where("n = 1").select("token", "target"), counted.where("n > 1").select("token", F.col("n").alias("targets"))


def case_requests(cases: DataFrame, steps: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """The requests of each case: ``key``, ordinal, line, method, token, route, version, expected_status, operation, action, explicit_version, problem.

    ``steps`` (key, at, line, text) are gone through in order of ``at`` as one fold over each case's
    sorted steps, with the version in force as its state: the case's declared one (``versions``, if it is
    one alone), until a step names another. A request's token is its own, else the case's ``fallback``;
    ``mapping`` (token, target) gives the route; wrapped parents lose their braces. A status that a
    later step tells is that of the last request before it. Routes that cannot be told have the
    problem: unresolved_object, unresolved_parent, generic_request.
    """
    known, _ = unambiguous(mapping)
    text = F.col("text")
    found = steps.select(
        *key, "at", "line", R.step_method(text).alias("method"), R.step_token(text).alias("own"), R.step_version(text).alias("named"), R.step_status(text).alias("status"),
        R.step_parent(text).alias("parent"), R.step_parent_key(text).alias("parent_key"), R.step_key(text).alias("key_"), R.step_action(text).alias("named_action"))
    found = found.where("method is not null or named is not null or status is not null")
    told = found.join(cases.select(*key, "versions", "fallback"), key).withColumn("token", F.when(F.col("method").isNotNull(), F.coalesce("own", "fallback")))
    # aliases are joined before the fold, so that it needs no lookups
    told = told.join(known.select("token", "target"), "token", "left").join(known.select(F.col("token").alias("parent"), F.col("target").alias("parent_target")), "parent", "left")
    told = told.withColumn("target", F.when(F.col("token").startswith("/"), F.col("token")).otherwise(F.col("target")))
    route = R.route(*[F.col(c) for c in ("token", "target", "parent", "parent_target", "parent_key", "key_", "named_action")])
    told = told.withColumn("r", route)
    step = F.struct("at", "line", "method", "token", "named", "status", F.col("r.path").alias("route"), F.col("r.operation").alias("operation"), F.col("r.problem").alias("problem"))
    grouped = told.groupBy(*key).agg(F.sort_array(F.collect_list(step)).alias("steps"), F.first("versions").alias("versions"))
    start = F.struct(F.when(F.size("versions") == 1, F.col("versions")[0]).alias("version"), F.expr("cast(array() as array<struct<ordinal:int,line:int,method:string,token:string,route:string,version:string,expected_status:int,operation:string,explicit_version:boolean,problem:string>>)").alias("made"))

    def advance(state, x):
        version, made, n = F.coalesce(x["named"], state["version"]), state["made"], F.size(state["made"])
        # a status is the last request's before this step
        told_ = F.when(x["status"].isNotNull() & (n > 0), F.transform(made, lambda r, i: F.when(i == n - 1, r.withField("expected_status", x["status"])).otherwise(r))).otherwise(made)
        new = F.struct(
            (n + 1).alias("ordinal"), x["line"].cast("int").alias("line"), x["method"].alias("method"), x["token"].alias("token"), x["route"].alias("route"), version.alias("version"),
            F.lit(None).cast("int").alias("expected_status"), x["operation"].alias("operation"), x["named"].isNotNull().alias("explicit_version"), x["problem"].alias("problem"))
        return F.struct(version.alias("version"), F.when(x["method"].isNotNull(), F.array_append(told_, new)).otherwise(told_).alias("made"))

    out = grouped.select(*key, F.explode(F.aggregate("steps", start, advance)["made"]).alias("q")).select(*key, "q.*")
    return out.withColumn("action", R.workflow_action(F.col("operation"), F.col("route")))


def endpoint_matches(requests: DataFrame, endpoints: DataFrame, compatible: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ordinal, status (matched, ambiguous, none), endpoint, match (exact, compatible) of each request.

    ``endpoints`` are (endpoint, method, path, source_version); one without a version proves nothing.
    Method and canonical path must agree, and the version be the request's or ``compatible`` with it
    (test_version, endpoint_version, status active). More than one way is ambiguous.
    """
    there = endpoints.where("source_version is not null").select("endpoint", "method", R.canonical_path(F.col("path")).alias("route"), "source_version")
    asked = requests.where("route is not null and version is not null").select(*key, "ordinal", "method", "route", "version")
    met = asked.join(there, ["method", "route"])
    exact = met.where("version = source_version").select(*key, "ordinal", "endpoint", F.lit("exact").alias("match"))
    bridge = compatible.where("status = 'active'").select(F.col("test_version").alias("version"), F.col("endpoint_version").alias("source_version"))
    other = met.where("version != source_version").join(bridge, ["version", "source_version"]).select(*key, "ordinal", "endpoint", F.lit("compatible").alias("match"))
    found = exact.unionByName(other).groupBy(*key, "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("endpoint", "match")).alias("one"))
    every = requests.select(*key, "ordinal").join(found, [*key, "ordinal"], "left")
    one = F.when(F.col("n") == 1, F.col("one"))
    return every.select(*key, "ordinal", F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("status"), one["endpoint"].alias("endpoint"), one["match"].alias("match"))


def endpoint_coverage(endpoints: DataFrame, matches: DataFrame, cases: DataFrame, key: list[str]) -> DataFrame:
    """Of every endpoint the cases that prove it, by eligibility, each case once, and the level of coverage."""
    proven = matches.where("status = 'matched'").select(*key, "endpoint").distinct().join(cases.select(*key, "eligibility"), key)
    active, ci, known, level = R.coverage(F.col("eligibility"))
    counted = proven.groupBy("endpoint").agg(active.alias("active_cases"), ci.alias("ci_cases"), known.alias("known_issue_cases"), level.alias("coverage"))
    return endpoints.select("endpoint").join(counted, "endpoint", "left").fillna(0, ["active_cases", "ci_cases", "known_issue_cases"]).fillna("uncovered", ["coverage"])
