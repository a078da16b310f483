"""Features, their cases, and the requests of their steps."""

import pytest

from factloom.operators import evidence
from factloom.sources import gherkin

KEY = ["path", "scenario", "example"]
ACCOUNT = """@version:v1
Feature: Accounts
  Background:
    Given all is well
  @AB-100 @CI_Only
  Scenario Outline: Read <who>
    When "GET" to "<token>" with key "k" for version "v0"
    Then the response code is 200
    And "PATCH" to "account" with key "k"
    # Then status 500
    Then status "204"
    Examples:
      | testCaseID | who | token |
      | AB-101 | one | account |
      | AB-102 | two | none |
"""


def load(spark, content, mapping, version=None, test_object=None):
    files = spark.createDataFrame([("f", content)], "path string, content string")
    meta = spark.createDataFrame([("f", version, test_object)], "path string, version string, test_object string")
    cases, steps, problems = gherkin.features(files, meta)
    cases = cases.fillna(0, ["example"])
    made = evidence.case_requests(cases, steps.fillna(0, ["example"]), spark.createDataFrame(mapping, "token string, target string"), KEY)
    return cases.orderBy(*KEY).collect(), made.orderBy(*KEY, "ordinal").collect(), problems.collect()


def test_outlines_carry_their_version(spark):
    cases, made, problems = load(spark, ACCOUNT, [("account", "accounts-payable/account")])
    assert [c.case_name for c in cases] == ["AB-101", "AB-102"] and [c.name for c in cases] == ["Read one", "Read two"]
    assert {c.eligibility for c in cases} == {"ci_only"} and cases[0].issues == ["AB-100"] and cases[0].versions == ["v1"] and not problems
    assert [(r.method, r.version, r.route, r.expected_status, r.explicit_version) for r in made[:2]] == [
        ("GET", "v0", "/objects/accounts-payable/account/{key}", 200, True), ("PATCH", "v0", "/objects/accounts-payable/account/{key}", 204, False)]
    assert made[2].problem == "unresolved_object" and made[2].operation == "unknown" and made[2].route is None and made[3].route


def test_versions_in_conflict(spark):
    cases, made, _ = load(spark, ACCOUNT.replace(' for version "v0"', ""), [("account", "a/account")], "v3")
    assert all(c.conflicted and c.versions == [] for c in cases) and {r.version for r in made} == {None}
    cases, made, _ = load(spark, ACCOUNT.replace(' for version "v0"', ""), [("account", "a/account")], "v1")
    assert not cases[0].conflicted and {r.version for r in made} == {"v1"}


@pytest.mark.parametrize("step,want", [
    ('"GET" to child "child" with key "ck" for parent "{{dad}}" with key "pk" and file ""', ("GET", "/objects/ap/dad/{key}/ap/child", "child", None)),
    ('"GET" to child "child" for parent "dad" with key ""', ("GET", "/objects/ap/dad/ap/child", "child", None)),
    ('"GET" to child "child" for parent "nobody" with key "x"', ("GET", None, "child", "unresolved_parent")),
    ('"post" to "child"', ("POST", "/objects/ap/child", "collection", None)),
    ('I update object "child" with key "k"', ("PATCH", "/objects/ap/child/{key}", "item", None)),
    ('I read "query"', ("GET", None, "unknown", "generic_request")),
    ('"PUT" to "/services/v1/workflows/ap/bill/submit/"', ("PUT", "/workflows/ap/bill/submit", "workflow", None)),
    ('"POST" to "child" with key "k" and action "/void/"', ("POST", "/objects/ap/child/void", "workflow", None)),
    ('"GET" to "twice"', ("GET", None, "unknown", "unresolved_object")),
    ('I create "twice" for version "v7"', ("POST", None, "unknown", "unresolved_object"))])
def test_routes(spark, step, want):
    mapping = [("child", "ap/child"), ("dad", "ap/dad"), ("twice", "a/x"), ("twice", "b/x"), ("child", "ap/child"), ("none", None)]
    _, made, _ = load(spark, f"Feature: x\n Scenario: y\n  When {step}\n", mapping)
    assert [(r.method, r.route, r.operation, r.problem) for r in made] == [want]
    assert made[0].action == ("submit" if "submit" in step else None)


def test_states_of_the_fold(spark):
    steps = ["Then status 404", 'When "GET" to "a"', 'Given all for version "v2"', 'And "GET" to "a" has status 201', "Then status code is 200", "Then status 202", 'And "GET" to "a" for version "v3"', 'And "GET" to "a"']
    _, made, _ = load(spark, "Feature: x\nScenario: y\n" + "\n".join(s if s.split()[0] in ("Given", "When", "Then", "And") else f"* {s}" for s in steps), [("a", "a")], "v1")
    assert [(r.ordinal, r.version, r.expected_status) for r in made] == [(1, "v1", 201), (2, "v2", 202), (3, "v3", None), (4, "v3", None)]


def test_files_that_are_no_features(spark):
    files = spark.createDataFrame([("bom", "﻿@version:v1\r\nFeature: B\r\n Scenario: s\r\n  When x\r\n"), ("off", "#Feature: x\n Scenario: s\n When x"), ("none", "text"), ("null", None), ("back", 'Feature: b\nBackground:\n Given "GET" to "a"\nScenario: s\n * y\n')], "path string, content string")
    cases, steps, problems = gherkin.features(files)
    assert {(c.path, c.feature_name, tuple(c.versions)) for c in cases.collect()} == {("bom", "B", ("v1",)), ("back", "b", ())}
    assert {(s.path, s.text) for s in steps.collect()} == {("bom", "x"), ("back", "y")}
    assert {(p.path, p.kind) for p in problems.collect()} == {("off", "commented_feature"), ("none", "no_feature"), ("null", "no_feature"), ("back", "background_request")}


def test_matches_and_coverage(spark):
    requests = spark.createDataFrame([("a", 1, "GET", "/objects/x", "v1"), ("a", 2, "GET", "/objects/x", "v2"), ("b", 1, "GET", "/objects/x", "v9"), ("b", 2, "GET", "/objects/y", "v1"), ("c", 1, "GET", None, "v1")], "path_ string, ordinal int, method string, route string, version string")
    endpoints = spark.createDataFrame([(1, "GET", "/services/s1/objects/x", "v1"), (2, "GET", "/objects/y", "v1"), (3, "GET", "objects//y/", "v1"), (4, "GET", "/objects/x", None)], "endpoint long, method string, path string, source_version string")
    compatible = spark.createDataFrame([("v2", "v1", "active"), ("v9", "v1", "retired")], "test_version string, endpoint_version string, status string")
    got = evidence.endpoint_matches(requests, endpoints, compatible, ["path_"])
    assert {(r.path_, r.ordinal): (r.status, r.endpoint, r.match) for r in got.collect()} == {
        ("a", 1): ("matched", 1, "exact"), ("a", 2): ("matched", 1, "compatible"), ("b", 1): ("none", None, None), ("b", 2): ("ambiguous", None, None), ("c", 1): ("none", None, None)}
    cases = spark.createDataFrame([("a", "ci_only"), ("b", "active")], "path_ string, eligibility string")
    assert {r.endpoint: (r.ci_cases, r.coverage) for r in evidence.endpoint_coverage(endpoints, got, cases, ["path_"]).collect()} == {1: (1, "ci_conditional"), 2: (0, "uncovered"), 3: (0, "uncovered"), 4: (0, "uncovered")}
