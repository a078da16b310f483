"""Closures, cycles, inheritance, handlers, owners, generations and hash trees on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import closure, handlers, hashtree, ownership
from factloom.sources import generations, writers


def pairs(spark, rows, names="src string, dst string"):
    return spark.createDataFrame(rows, names)


def test_closure_and_cycles(spark):
    edges = pairs(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "e"), ("f", "d"), ("a", "b"), ("g", "h"), ("h", "g"), ("h", "a")])
    nodes = spark.createDataFrame([(x,) for x in "abcdefghi"], "node string")
    got = {(r.src, r.dst): r.steps for r in closure.closure(edges).collect()}
    assert got["a", "a"] == 3 and got["a", "e"] == 4 and got["g", "e"] == 6 and ("f", "a") not in got and ("d", "d") not in got and got["e", "e"] == 1
    parts = {r.node: r.component for r in closure.components(nodes, edges).collect()}
    assert parts == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "g", "i": "i"}
    members, reach = closure.condensed_closure(nodes, edges)
    assert members.count() == 9 and {(r.src, r.dst) for r in reach.collect()} == {("a", "a"), ("a", "d"), ("a", "e"), ("d", "e"), ("e", "e"), ("f", "d"), ("f", "e"), ("g", "g"), ("g", "a"), ("g", "d"), ("g", "e")}
    assert closure.closure(edges.limit(0)).count() == 0 and closure.components(nodes, edges.limit(0)).where("node = component").count() == 9


def test_nearest_definition_wins(spark):
    edges = pairs(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")])
    defs = spark.createDataFrame([("b", "x"), ("c", "x"), ("d", "x"), ("d", "y"), ("a", "z")], "node string, key string")
    got = {(r.node, r.key): (r.steps, r.owner, r.several) for r in closure.nearest_definitions(edges, defs).collect()}
    assert got["a", "x"] == (1, None, True) and got["a", "y"] == (2, "d", False) and got["d", "x"] == (0, "d", False) and got["b", "z"] == (2, "a", False) and got["c", "x"] == (0, "c", False)


def test_inheritance_needs_one_parent(spark):
    parents = pairs(spark, [("A", "B"), ("B", "C"), ("D", "B"), ("D", "C"), ("E", "F"), ("F", "E"), ("A", "B")], "child string, parent string")
    declared = spark.createDataFrame([("C", "load"), ("B", "show"), ("A", "own"), ("F", "f"), ("Z", "lost")], "class string, method string")
    classes = spark.createDataFrame([(x,) for x in "ABCDEF"], "class string")
    got = {(r["class"], r["method"]): (r.owner, r.steps, r.problem) for r in closure.inherited(classes, parents, declared).collect()}
    assert got["A", "load"] == ("C", 2, None) and got["A", "show"] == ("B", 1, None) and got["A", "own"] == ("A", 0, None) and got["D", "load"] == (None, 0, "inheritance_ambiguous")
    assert got["E", "f"] == ("F", 1, None) and got["F", "f"] == ("F", 0, None) and ("A", "lost") not in got


def test_required_files(spark):
    content = "require_once '../lib/base.ent';\ninclude(\"..\\lib\\base.ent\"); include 'other.ent'; require 'Only.ent'; include 'none.ent'; include '../../../x.ent'; requirement 'no.ent'"
    files = spark.createDataFrame([("app/source/ap/bill.ent", content), ("app/source/lib/base.ent", None), ("app/source/zz/other.ent", ""), ("app/source/aa/other.ent", ""), ("old/only.ent", ""), ("x.ent", "")], "path string, content string")
    named = closure.required_paths(files)
    assert [r.required for r in named.orderBy("place").collect()] == ["../lib/base.ent", "other.ent", "Only.ent", "none.ent", "../../../x.ent"]
    keys = closure.definition_keys(spark.createDataFrame([(1, ".\\old\\only.ent", "Only"), (2, "app/source/zz/only.ent", None)], "place long, ent_file string, entity_name string"))
    got = {r.required: (r.target, r.how) for r in closure.resolved_requires(named, files, keys).collect()}
    assert got == {"../lib/base.ent": ("app/source/lib/base.ent", "relative"), "other.ent": ("app/source/aa/other.ent", "name"), "Only.ent": ("old/only.ent", "definition path"), "none.ent": (None, None), "../../../x.ent": ("x.ent", "relative")} or got["Only.ent"] == ("old/only.ent", "definition name")


def test_handlers_fail_closed(spark):
    links = spark.createDataFrame([("s", "a", "active"), ("s", "b", "active"), ("s", "c", "conditional"), ("s", "bad", "active"), ("s", "a", "active"), ("t", "x", "active"), ("u", "c", "conditional"), ("u", "d", "conditional")], "surface string, script string, scope string")
    symbols = spark.createDataFrame([("a", "one", None), ("a", "both", None), ("b", "both", None), ("a", "mixed", None), ("c", "mixed", None), ("c", "maybe", None), ("d", "maybe", None), ("c", "sole", None), ("x", "far", None), ("bad", "lost", None), ("a", "inner", "outer"), ("b", "twice", None), ("b", "twice", None)], "script string, name string, parent string")
    failed = spark.createDataFrame([("bad",)], "script string")
    names = ["one", "both", "mixed", "maybe", "far", "lost", "inner", "twice", "a.b", "f()", None]
    events = spark.createDataFrame([(i, "s", n) for i, n in enumerate(names)] + [(20, "t", "one"), (21, "u", "maybe"), (22, "u", "sole"), (23, "none", "one")], "event long, surface string, name string")
    got = {(r.surface, r["name"]): (r.status, r.reason, r.script) for r in handlers.handlers(events, links, symbols, failed).collect()}
    assert got["s", "one"] == ("resolved", "unique_active_exact_callable", "a") and got["s", "both"] == ("ambiguous", "multiple_active_exact_callables", None) == got["s", "twice"]
    assert got["s", "mixed"] == ("ambiguous", "mixed_active_and_conditional", None) and got["s", "maybe"] == ("conditional", "conditional_exact_callable", "c")
    assert got["s", "far"] == got["s", "lost"] == got["s", "inner"] == ("unresolved", "linked_script_parse_error", None) and got["t", "one"] == got["none", "one"] == ("unresolved", "no_linked_exact_callable", None)
    assert {got["s", n][0] for n in ("a.b", "f()", None)} == {"unsupported"} and got["u", "maybe"] == ("conditional", "conditional_exact_callable", None) and got["u", "sole"][2] == "c"


def test_numbers_over_many_bitmaps(spark):
    rows = spark.range(70_000).select(F.format_string("s%06d", "id").alias("script"))
    numbers = handlers.dense_numbers(rows.unionByName(rows), "script")
    assert numbers.agg(F.min("number"), F.max("number"), F.count_distinct("number"), F.count("*")).first()[:] == (1, 70_000, 70_000, 70_000)
    one = handlers.bitmaps(numbers.where("number in (1, 8, 9, 32768, 32769, 70000)").select("script", "number"), ["script"])
    assert sorted(r[0] for r in one.select(handlers.only_number(F.col("bucket"), F.col("bits"))).collect()) == [1, 8, 9, 32768, 32769, 70000]


def test_owners_along_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", None), ("e", None), ("f", None), ("g", 5), ("g", 5)], "row string, owner int")
    keys = spark.createDataFrame([("c", "a"), ("d", "c"), ("d", "b"), ("e", "f"), ("f", "e"), ("g", "e"), ("x", "a"), (None, "a"), ("c", None)], "child string, parent string")
    found = ownership.owners(rows, keys)
    assert {r.row: (r.state, r.owner) for r in found.collect()} == {"a": ("one", 1), "b": ("one", 2), "c": ("one", 1), "d": ("several", None), "e": ("none", None), "f": ("none", None), "g": ("one", 5)}
    assert [tuple(r) for r in ownership.witnesses(found, keys).collect()] == [("d", "c", "b")]
    got = ownership.one_proven_owner(rows, spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "row string, owner int"))
    assert {r.row: (r.n_owners, r.owner) for r in got.collect()} == {"a": (1, 1), "b": (2, None), **{x: (0, None) for x in "cdefg"}}


# ---- generations


@pytest.fixture
def table(spark, tmp_path):
    out = generations.Table(spark, f"file://{tmp_path}", "path", 8)
    out.create(spark.range(100).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.col("id").alias("size"), F.lit(None).cast("string").alias("note")))
    return out


def change(spark, *rows):
    return spark.createDataFrame(rows, "change string, old_key string, new_key string, old_hash string, new_hash string, size long, note string")


def test_one_changed_row_rewrites_one_bucket(spark, table):
    first = writers.latest(spark, table.root)
    h = table.read().where("path = 'p7'").select(generations.row_hash(["path", "size", "note"])).first()[0]
    done = table.apply(change(spark, ("modified", "p7", "p7", h, None, 700, "new")))
    assert len(done["buckets"]) == 1 and done["put"] == 1 and table.read().count() == 100 and table.read().where("path = 'p7'").first().size == 700
    lines = table.manifest()
    assert lines.where(F.col("made") == done["generation"]).count() == 1 and lines.where(F.col("made") == first).count() == lines.count() - 1
    assert table.read(first).where("path = 'p7'").first().size == 7  # the old generation stays
    assert table.changed_buckets(first, done["generation"]) == done["buckets"] and [tuple(r) for r in table.diff(first, done["generation"]).collect()] == [("p7", "modified")]
    again = table.apply(change(spark, ("added", None, "q", None, None, 1, None), ("deleted", "p8", None, None, None, None, None), ("renamed", "p9", "r9", None, None, 9, None), ("renamed", "p10", "p9", None, None, 10, None)))
    keys = {r.path: r.size for r in table.read().collect()}
    assert len(keys) == 100 and keys["q"] == 1 and "p8" not in keys and keys["r9"] == 9 and keys["p9"] == 10 and "p10" not in keys and again["out"] == 3
    assert table.apply(change(spark).limit(0))["buckets"] == []


@pytest.mark.parametrize("row,problem", [
    (("modified", "p1", "p1", "wrong", None, 1, None), "another hash than expected"), (("deleted", "p1", None, "wrong", None, None, None), "another hash than expected"),
    (("deleted", "gone", None, None, None, None, None), "is not there"), (("added", None, "n", None, "wrong", 1, None), "than stated"), (("moved", "p1", "p2", None, None, 1, None), "unsupported")])
def test_wrong_changes_are_refused(spark, table, row, problem):
    before = writers.latest(spark, table.root)
    with pytest.raises(ValueError, match=problem):
        table.apply(change(spark, row))
    assert writers.latest(spark, table.root) == before and table.read().count() == 100


def test_scope_and_twice(spark, table):
    scope = ~F.col("key").startswith("x")
    table.apply(change(spark, ("renamed", "p1", "x1", None, None, 1, None), ("modified", "p2", "x2", None, None, 1, None), ("added", None, "x3", None, None, 1, None), ("deleted", "x9", None, None, None, None, None)), scope)
    keys = {r.path for r in table.read().collect()}
    assert len(keys) == 98 and not {"p1", "p2", "x1", "x2", "x3"} & keys
    with pytest.raises(ValueError, match="changes twice"):
        table.apply(change(spark, ("added", None, "n", None, None, 1, None), ("added", None, "n", None, None, 2, None)))


def test_promotion_survives_a_driver_that_dies(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = writers.write_generation({"t": spark.range(3)}, root)
    os.makedirs(tmp_path / "drafts")
    (tmp_path / "drafts" / "dead").write_text("half")  # written, not renamed
    writers.promote(spark, root, first, None)
    second = writers.write_generation({"t": spark.range(5)}, root)
    (tmp_path / "promotions" / "000000000002").write_text(second)  # another was quicker
    with pytest.raises(ValueError, match="active generation is"):
        writers.promote(spark, root, first, first)
    assert writers.active(spark, root, "t").count() == 5


def test_hash_trees_are_compared_from_the_top(spark):
    old = spark.range(5_000).select("id", (F.col("id") % 10).alias("v"))
    new = old.withColumn("v", F.when(F.col("id") == 77, 99).otherwise(F.col("v"))).repartition(3)
    a, b = (hashtree.hash_tree(t, ["id"], ["id", "v"]) for t in (old, new))
    assert a.where("level = 0").first().n == 5_000 and a.groupBy("level").agg(F.sum("n").alias("n")).where("n = 5000").count() == 4
    ranges, compared = hashtree.differing(a, b, 3)
    assert len(ranges) == 1 and compared <= 1 + 3 * 16
    assert hashtree.differing(a, a, 3) == ([], 1)
    assert [tuple(r) for r in hashtree.tree_diff(old, new, ["id"], ["id", "v"]).collect()] == [(77, "modified")]
    mine = hashtree.hash_tree(old.withColumn("repo", F.col("id") % 2), ["id"], ["id", "v"], 1, ["repo"])
    assert {(r.repo, r.n) for r in mine.where("level = 0").collect()} == {(0, 2500), (1, 2500)}
    doubled = hashtree.hash_tree(old.unionByName(old.limit(1)), ["id"], ["id", "v"])
    assert doubled.where("level = 0").first().digest != a.where("level = 0").first().digest


def test_freshness_tells_the_first_reason(spark):
    columns = "catalog_build long, catalog_fingerprint string, content_fingerprint string, graph_path string, wanted_path string, source_path string, catalog_path string, graph_catalog_build long, graph_fingerprint string, graph_version int, wanted_version int"
    good = [1, "f", "f", "g", "g", "c", "c", 1, "f", 2, 2]
    rows, reasons = [good], ["fresh"]
    for place, value, reason in ((0, None, "no active catalog build"), (1, "x", "catalog fingerprint mismatch"), (3, None, "no active graph build for the path"), (5, "x", "source database mismatch"), (7, 2, "catalog generation mismatch"), (8, None, "graph fingerprint mismatch"), (9, 1, "projection version mismatch")):
        rows.append([value if i == place else v for i, v in enumerate(good)])
        reasons.append(reason)
    got = hashtree.freshness(spark.createDataFrame(rows, columns)).collect()
    assert [r.reason for r in got] == reasons and [r.fresh for r in got] == [x == "fresh" for x in reasons]
