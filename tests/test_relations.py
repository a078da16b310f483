"""Facts between objects: diamonds, cycles, states of axes, ambiguous names."""

import pytest

from factloom.operators import relations

FACTS = "fact_id long, source string, target string, axis string, assertion_status string, confidence double"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([
        (1, "a", "b", "A", "VERIFIED", 0.9), (2, "a", "c", "A", "CORROBORATED", 0.8), (3, "b", "d", "B", "CORROBORATED", 0.7), (4, "c", "d", "B", "CORROBORATED", None),
        (5, "d", "a", "C", "VERIFIED", 1.0), (6, "d", "e", "C", "UNRESOLVED", 1.0), (7, "d", None, "C", "VERIFIED", 1.0), (8, "b", "b", "E", "CONFLICTING", 0.2), (9, "c", "d", "A", "VERIFIED", 0.9)], FACTS)


def test_traversal_ends_at_cycles(spark, facts):
    seeds = spark.createDataFrame([("a",), ("d",), ("a",)], "node string")
    got = relations.traversal(facts, seeds, 3)
    assert got.columns == ["seed", "depth", *facts.columns]
    assert sorted((r.seed, r.depth, r.fact_id) for r in got.collect()) == [
        ("a", 1, 1), ("a", 1, 2), ("a", 2, 3), ("a", 2, 4), ("a", 2, 9), ("a", 3, 5), ("d", 1, 5), ("d", 2, 1), ("d", 2, 2), ("d", 3, 3), ("d", 3, 4), ("d", 3, 9)]
    assert sorted(r.fact_id for r in relations.traversal(facts, seeds, 3, ["A"]).where("seed = 'a'").collect()) == [1, 2, 9]


def test_paths_through_a_diamond(spark, facts):
    got = {(r.target, r["rank"]): r for r in relations.paths(facts, spark.createDataFrame([("a",)], "node string"), 3, best=2).collect()}
    assert set(got) == {("b", 1), ("c", 1), ("d", 1), ("d", 2)}  # the way back to a is none
    first, second = got["d", 1], got["d", 2]
    assert first.facts == [2, 9] and first.nodes == ["a", "c", "d"] and first.path_status == "VERIFIED" and first.confidence == 0.8
    assert second.facts == [1, 3] and second.axes == ["A", "B"] and second.path_status == "VERIFIED" and second.confidence == 0.7
    three = relations.paths(facts, spark.createDataFrame([("a",)], "node string"), 2, ["A", "B"], best=9).where("target = 'd'").orderBy("rank").collect()
    assert [r.facts for r in three] == [[2, 9], [1, 3], [2, 4]] and three[2].path_status == "CORROBORATED" and three[2].confidence == 0.0
    assert relations.paths(facts, spark.createDataFrame([], "node string"), 3).count() == 0


def test_states_of_axes(spark, facts):
    objects = spark.createDataFrame([("b",), ("d",), ("e",), ("f",)], "node string")
    coverage = spark.createDataFrame([("f", "A", "complete"), ("f", "A", "not_applicable"), ("f", "B", "complete"), ("f", "B", "failed"), ("f", "C", "unheard of"), ("b", "E", "complete"), ("d", "E", "complete")], "node string, family string, status string")
    got = {(r.node, r.axis): (r.status, r.n_facts) for r in relations.axis_states(objects, facts, coverage).collect()}
    assert len(got) == 20 and got["b", "E"] == ("CONFLICTING", 1) and got["b", "A"] == ("VERIFIED", 1) and got["b", "B"] == ("CORROBORATED", 1)
    assert got["d", "A"] == ("VERIFIED", 1) and got["d", "B"] == ("CORROBORATED", 2) and got["e", "C"] == ("UNRESOLVED", 1) and got["d", "E"] == ("NOT_OBSERVED", 0)
    assert got["f", "A"] == ("NOT_OBSERVED", 0) and got["f", "B"][0] == got["f", "C"][0] == got["f", "D"][0] == "UNRESOLVED"
    one = {(r.node, r.axis): r.status for r in relations.axis_states(objects, facts, coverage, ["A", "B"], "outgoing", 0.75).collect()}
    assert one["b", "A"] == one["b", "B"] == "UNRESOLVED" and len(one) == 8


def test_object_relationships(spark, facts):
    occurrences = spark.createDataFrame([("a", "Bill", "r1"), ("b", "bill", "r2"), ("c", "Vendor", "r1")], "node string, name string, repo string")
    coverage = spark.createDataFrame([], "node string, family string, status string")
    ask = lambda *a, **k: relations.object_relationships(occurrences, facts, coverage, *a, **k)
    assert ask("BILL")["status"] == "ambiguous" and ask("BILL")["candidates"].count() == 2 and ask("none")["status"] == "entity_not_found"
    got = ask("BILL", "r1", depth=3)
    assert got["status"] == "ok" and [r.fact_id for r in got["relationships"].collect()] == [1, 2, 5] and got["traversal"].count() == 6 and got["axes"].count() == 5
    assert [r.fact_id for r in ask("vendor", direction="incoming")["relationships"].collect()] == [2]
    for wrong in ({"axes": ["Z"]}, {"depth": 4}, {"direction": "up"}, {"least": 2.0}):
        with pytest.raises(ValueError):
            ask("vendor", **wrong)
