"""Histories, parsed content, registry documents and access links on small tables."""

import json

from pyspark.sql import functions as F

from factloom.operators import linking, validity
from factloom.operators.access import Evidence, folded
from factloom.sources import parsed

KV = "key string, value string"


def states(history):
    return sorted((r.key, r.value, r.since, r.until, r.stale) for r in history.collect())


def test_histories_keep_what_failed_and_mend_it(spark):
    day = lambda **kv: spark.createDataFrame(list(kv.items()), KV)
    lost = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    h = validity.history_of(day(a="1", b="1", c="1", d="1"), 1)
    h = validity.advanced(h, day(a="1", b="2"), lost("c", "new"), 2)
    assert states(h) == [("a", "1", 1, None, False), ("b", "1", 1, 2, False), ("b", "2", 2, None, False), ("c", "1", 1, 2, False), ("c", "1", 2, None, True), ("d", "1", 1, 2, False)]
    again = validity.advanced(h, day(a="1", b="2", e="1"), lost("c"), 3)
    assert ("c", "1", 2, None, True) in states(again) and ("e", "1", 3, None, False) in states(again)  # still stale, one interval
    assert {(r.key, r.stale) for r in validity.as_of(again, 3).collect()} == {("a", False), ("b", False), ("c", True), ("e", False)}
    repaired = validity.merged(validity.advanced(again, day(a="1", c="1", e="1"), lost(), 4))
    assert [x for x in states(repaired) if x[0] == "c"] == [("c", "1", 1, None, False)]  # the failure was no change
    changed = validity.merged(validity.advanced(again, day(c="9"), lost(), 4))
    assert [x for x in states(changed) if x[0] == "c"] == [("c", "1", 1, 2, False), ("c", "1", 2, 4, True), ("c", "9", 4, None, False)]
    back = validity.advanced(validity.advanced(h, day(d="1"), lost(), 5), day(), lost(), 6)
    assert [x for x in states(validity.merged(back)) if x[0] == "d"] == [("d", "1", 1, 2, False), ("d", "1", 5, 6, False)]  # a gap stays


def test_content_is_parsed_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def parser(blobs):
        def read(parts):
            for rows in parts:
                calls.add(len(rows))
                yield rows.assign(word=rows["content"].str.split().str[0])[["blob", "word"]].dropna()

        return blobs.mapInPandas(read, "blob string, word string")

    files = spark.createDataFrame([("a", "one x"), ("b", "two"), ("c", "one x"), ("d", None), ("e", " ")], "path string, content string")
    store = parsed.Parsed(spark, f"file://{tmp_path}", "1", parser, "word string")
    assert store.update(files) == 4 and calls.value == 4
    assert {(r.path, r.word) for r in store.rows(files).collect()} == {("a", "one"), ("b", "two"), ("c", "one")}
    more = files.unionByName(spark.createDataFrame([("f", "two"), ("g", "six")], files.schema))
    assert store.update(files) == 0 and calls.value == 4 and store.update(more) == 1 and calls.value == 5
    assert store.rows(more).count() == 5 and parsed.Parsed(spark, f"file://{tmp_path}", "2", parser, "word string").update(files) == 4
    mapping = spark.createDataFrame([("ONE", "e1"), ("two", "e2"), ("Two", "e3")], "word string, entity string")
    linked, without = parsed.relinked(store.rows(more), mapping, ["word"], "entity")
    assert {(r.path, r.entity) for r in linked.collect()} == {("a", "e1"), ("c", "e1")} and {r.path for r in without.collect()} == {"b", "f", "g"}
    linked, _ = parsed.relinked(store.rows(more), mapping.where("entity != 'e3'"), ["word"], "entity")
    assert linked.count() == 4 and calls.value == 9  # links are made anew, nothing is parsed


def test_registry_documents(spark):
    leaf = {"revision": "v1", "hash": "h", "type": "object", "more": {"revision": 1}}
    good = {"ap": {"objects": {"bill": leaf, "a/b": {"c~d": {"revision": "ALL", "hash": "-1", "type": "coreService", "runtimeOwner": "x"}}}, "note": [leaf], "systemViews": {"bill": {"all": leaf}}}}
    files = [("r", "good", json.dumps(good)), ("r", "half", json.dumps({"ap": {"objects": {"x": {"revision": "v1"}, "y": leaf}}})), ("r", "number", json.dumps({"a": {"b": {"c": {"revision": 1, "hash": "h"}}}})), ("r", "flat", json.dumps({"a": {"b": leaf}})), ("r", "list", "[]"), ("r", "text", "{"), ("r", "null", None), ("r", "empty", "{}")]
    got = parsed.registry_entries(spark.createDataFrame(files, "release string, path string, content string")).collect()
    ok = {r.pointer: r for r in got if r.path == "good"}
    assert set(ok) == {"/ap/objects/bill", "/ap/objects/a~1b/c~0d", "/ap/systemViews/bill/all"} and ok["/ap/objects/a~1b/c~0d"].source_optional and ok["/ap/objects/a~1b/c~0d"].resource_path == "a/b/c~d"
    assert ok["/ap/objects/bill"].api_type == "object" and not ok["/ap/objects/bill"].source_optional and json.loads(ok["/ap/objects/bill"].payload) == leaf
    assert {(r.path, r.pointer, r.problem) for r in got if r.path != "good"} == {
        ("half", "/ap/objects/x", "invalid_registry_leaf"), ("number", "/a/b/c", "invalid_registry_leaf"), ("flat", "/a/b", "missing_registry_resource_identity"), ("list", "", "invalid_registry_document"), ("text", "", "invalid_registry_json"), ("null", "", "invalid_registry_json")}
    components = spark.createDataFrame([(p,) for p in ("api/models/objects.ap.bill.v1.s1.yaml", "api/paths/ap.bill.v1.yaml", "api/other/objects.ap.bill.v1.yaml", "api/views/objects.ap.bill.all.v1.view.yaml", "api/models/objects.ap.bill.v10.yaml", "models/objects.ap.bill.v1")], "path string")
    linked = parsed.registry_components(parsed.registry_entries(spark.createDataFrame(files, "release string, path string, content string")), components)
    assert {(r.pointer, r.file, r.kind) for r in linked.collect()} == {
        ("/ap/objects/bill", "api/models/objects.ap.bill.v1.s1.yaml", "openapi_schema"), ("/ap/objects/bill", "api/paths/ap.bill.v1.yaml", "openapi_operations"), ("/ap/systemViews/bill/all", "api/views/objects.ap.bill.all.v1.view.yaml", "openapi_view")}


def test_leaves_without_a_job(spark):
    rows = spark.createDataFrame([(1, '{"a": {"x/y": [10, "t", 1.5]}, "b": null, "c~": true, "d": {}}'), (2, "7"), (3, "no json"), (4, None)], "id int, j string")
    got = sorted(((r.id, r.pointer, r.value) for r in parsed.json_leaves(rows, "id", "j").collect()), key=str)
    assert got == sorted([(1, "/a/x~1y/0", "10"), (1, "/a/x~1y/1", "t"), (1, "/a/x~1y/2", "1.5"), (1, "/b", None), (1, "/c~0", "true"), (2, "", "7")], key=str)


def test_links_count_by_their_first_kind(spark):
    people = spark.createDataFrame([(1, "f1", " Bill"), (2, "f1", ""), (3, None, "vendor")], "e int, file string, name string")
    tables = spark.createDataFrame([(10, "f1", "BILL"), (11, "f9", "Vendor "), (12, None, None)], "t int, file string, name string")
    told = Evidence().anchor(people, F.col("e"), file=F.col("file"), name=folded("name")).target(tables, "table", F.col("t"), F.col("file"), file=F.col("file"), name=folded("name"))
    got = {(r.entity, r.record): (r.link_type, r.reasons, r.evidence) for r in told.links().collect()}
    assert got == {(1, "10"): ("file", ["file", "name"], "f1"), (2, "10"): ("file", ["file"], "f1"), (3, "11"): ("name", ["name"], "f9")}


def test_references_climb_any_number_of_levels(spark):
    deep = "/".join(f"d{i}" for i in range(12))
    refs = spark.createDataFrame([(f"{deep}/a.yaml", "../" * 12 + "b.yaml#/x"), (f"{deep}/a.yaml", "../" * 13 + "b.yaml")], "source_path string, ref string")
    files = spark.createDataFrame([("b.yaml",), (f"{deep}/a.yaml",)], "path string")
    assert {r.ref[-4:]: (r.target, r.kind) for r in linking.ref_targets(refs, files).collect()} == {"l#/x": ("b.yaml", "resolved"), "yaml": (None, "missing")}
