"""Operators that no SQL query covers, on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.functions import extract, names
from factloom.operators import diff, graph, paging, search, windows
from factloom.sources import readers, writers
from factloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_like_wildcards_are_literal(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("100%",), ("A_Bc",), ("a\\b",)], "s string")
    assert {r.s for r in df.where(search.contains("s", "a_b")).collect()} == {"a_b", "A_Bc"}
    assert {r.s for r in df.where(search.contains("s", "0%")).collect()} == {"100%"}
    assert {r.s for r in df.where(search.contains("s", "\\")).collect()} == {"a\\b"}


def test_pages_follow_one_another(spark):
    df, seen, cursor = spark.range(60).toDF("id"), [], None
    while True:
        got = paging.page(df, ["id"], 25, cursor)
        seen += [r["id"] for r in got["rows"]]
        cursor = got["next_cursor"]
        if cursor is None:
            break
    assert seen == list(range(60))
    with pytest.raises(ValueError):
        paging.page(df, ["id"], 101)
    with pytest.raises(ValueError):
        paging.page(df, ["id"], 25, "%%%")
    mixed = spark.createDataFrame([(i, None if i % 5 == 0 else i % 7) for i in range(40)], "id int, rank int")
    for order in (["rank", "-id"], ["-rank", "id"]):
        seen, cursor = [], None
        while True:
            got = paging.page(mixed, order, 7, cursor)
            seen += [r["id"] for r in got["rows"]]
            cursor = got["next_cursor"]
            if cursor is None:
                break
        whole = mixed.orderBy(*[F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in order])
        assert seen == [r.id for r in whole.collect()]
    assert paging.search_all({"a": df.where("id < 2"), "b": df.where("id < 1")}, ["surface", "id"])["status"] == "ok"
    assert paging.search_all({"a": df}, ["id"])["status"] == "error"


def test_impact_handles_cycles_self_edges_and_caps(spark):
    edges = spark.createDataFrame([("a", "a", "X", 1.0), ("a", "b", "X", 0.9), ("b", "a", "X", 0.9), ("b", "c", "X", 0.5), ("a", "d", "X", 0.1), ("e", "a", "Y", 0.8)], "src string, dst string, relation string, weight double")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = {r.node: (r.depth, r.direction, r.origin) for r in graph.impact(edges, seeds, 3).collect()}
    assert got == {"a": (0, None, None), "b": (1, "out", "a"), "d": (1, "out", "a"), "e": (1, "in", "a"), "c": (2, "out", "b")}
    assert {r.node for r in graph.impact(edges, seeds, 3, cap=2, incoming=False).collect()} == {"a", "b", "c"}
    assert {r.node for r in graph.impact(edges, seeds, 3, least=0.4, incoming=False).collect()} == {"a", "b", "c"}
    shuffled = graph.impact(edges.repartition(5), seeds, 3)
    assert rows(shuffled) == rows(graph.impact(edges.coalesce(1), seeds, 3))


def test_expansion_risk_has_every_origin(spark):
    edges = spark.createDataFrame([(f"a{i:02}", f"b{i:02}-{j}", "X", 1.0) for i in range(30) for j in range(1 + i % 2)], "src string, dst string, relation string, weight double")
    got = [(r.origin, r.direction, r.n_reached) for r in graph.expansion_risk(graph.impact(edges, edges.select(F.col("src").alias("node")), 1)).collect()]
    assert got == [(f"a{i:02}", "out", 2) for i in range(1, 30, 2)] + [(f"a{i:02}", "out", 1) for i in range(0, 30, 2)]


def test_impact_risk_follows_every_edge(spark, tmp_path):
    from factloom.plans import QUERIES, SQL

    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = [(s, p) for s in range(5) for p in range(10 * s, 10 * s + 10)] + [(5 + p % 35, p) for p in range(50)]
    spark.createDataFrame(pairs, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in QUERIES["impact_risk"](spark, str(tmp_path)).collect()]
    assert [x for x in got if x[1] == "out"] == [(f"S{s}", "out", 10) for s in range(5)]
    assert len(got) == 40 and sum(n for _, direction, n in got if direction == "in") == 35
    assert "r <= 3" not in SQL["impact_risk"] and "r <= 3" in SQL["bfs_impact"] and "r <= 3" in SQL["impact_edges"]


def test_structural_labels_do_not_see_ids(spark):
    schema = "src string, dst string, relation string"
    one = spark.createDataFrame([("1", "2", "r"), ("2", "3", "r")], schema)
    two = spark.createDataFrame([("x", "z", "r"), ("z", "y", "r")], schema)
    label = lambda e, ids: sorted(r.label for r in graph.structural_labels(spark.createDataFrame([(i, "n") for i in ids], "node string, label string"), e).collect())
    assert label(one, "123") == label(two, "xyz") and len(set(label(one, "123"))) == 3


def test_fingerprint_ignores_order_and_ids(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 3)], "id int, s string, v int")
    b = spark.createDataFrame([(9, "y", 3), (8, "x", None)], "id int, s string, v int")
    digest = lambda df: diff.fingerprint({"t": (df, ["s", "v"])}).first()["digest"]
    assert digest(a) == digest(b) != digest(b.union(b))


def test_insert_or_ignore_and_nulls(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "c"), (3, "c")], "k int, v string")
    assert rows(writers.insert_or_ignore(target, new, ["k", "v"])) == rows(spark.createDataFrame([(1, "a"), (2, None), (2, None), (2, None), (3, "c")], "k int, v string"))
    assert writers.insert_or_ignore(target, new, ["k", "v"], null_distinct=False).count() == 3
    assert rows(writers.upsert(target, new.withColumn("v", F.lit("z")), ["k"], [F.col("v")])) == [(1, "z"), (2, "z"), (3, "z")]


def test_generations_switch_only_when_valid(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    first = writers.write_generation({"t": spark.range(3)}, root)
    writers.promote(spark, root, first, None)
    second = writers.write_generation({"t": spark.range(5)}, root)
    bad = spark.createDataFrame([("c", 2)], "check_name string, n_bad long")
    with pytest.raises(ValueError):
        writers.promote(spark, root, second, first, bad)
    with pytest.raises(ValueError):
        writers.promote(spark, root, second, None)
    assert writers.active(spark, root, "t").count() == 3
    writers.promote(spark, root, second, first, bad.where("n_bad = 0"))
    assert writers.active(spark, root, "t").count() == 5
    (tmp_path / "promotions" / f"{3:012d}").write_text(first)  # another promotion that has read the same parent is ahead
    monkeypatch.setattr(writers, "_latest", lambda *_: (second, 2))
    with pytest.raises(ValueError, match="another"):
        writers.promote(spark, root, second, second)
    monkeypatch.undo()
    assert writers.latest(spark, root) == first  # what was there is not replaced


def test_names(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(names.camel_to_kebab(F.lit("APInvoiceLine"))) == "ap-invoice-line"
    assert pick(names.pascal_to_snake(F.lit("PurchaseOrder"))) == "purchase_order"
    assert pick(names.slug_to_pascal(F.lit("purchase-order_line"))) == "PurchaseOrderLine"
    assert pick(names.acronym(F.lit("general-ledger"))) == "gl"
    assert pick(names.variants(F.lit("ap-bills"))) == ["ap-bills", "ap-bill", "bills"]
    assert pick(names.canonical_path(F.lit("https://h/a//b/?x=1"))) == "/a/b" and pick(names.canonical_path(F.lit("http://h"))) == "/"
    assert tuple(pick(names.operation_key(F.lit("ap/lists/x/bill/edit")))) == ("ap", "lists/x", "bill", "edit")
    assert pick(names.operation_key(F.lit("ap/bill"))) is None
    assert [pick(names.to_bool(F.lit(x))) for x in ("Yes", "0", "maybe")] == [True, False, None]
    assert [pick(names.to_int(F.lit(x))) for x in (" -12", "1.5", "x")] == [-12, None, None]
    assert pick(names.json_pointer(F.array(F.lit("a/b"), F.lit("c~d")))) == "/a~1b/c~0d"
    assert {pick(names.repository_identity(F.lit(u))) for u in ("https://user@H.com/O/n.git", "git@h.com:O/n.git", "ssh://git@h.COM:22//O/n/", "h.com:/O/n", " https://h.com/O/n?x=1#y ")} == {"h.com/O/n"}
    assert {pick(names.repository_identity(F.lit(u))) for u in ("h.com/O/n", "https://h.com/", "https://h.com", "", "git@h.com:/")} == {None} and pick(names.repository_identity(F.lit("git@h.com:o/n"))) == "h.com/o/n"
    assert pick(names.language(F.lit("a/b.PHP"))) == "php" and pick(names.language(F.lit("Makefile"))) == "unknown"


def test_extraction_by_lines(spark):
    files = spark.createDataFrame(
        [
            ("a.php", "php", "<?php\nuse Lib\\Tool;\nclass A extends B {\n function f() { C::g(1); }\n}\nclass D implements E {\n require_once 'x.inc';\n}"),
            ("a.sql", "sql", "-- t\nCREATE TABLE IF NOT EXISTS t1 (a int);\ncreate or replace view v1 as select * from t1 join s.t2 on 1=1;"),
            ("a.js", "javascript", "import x from './m';\nexport function go() { run(1); }"),
            ("a.xml", "xml", '<a ref="r1"/>'),
        ],
        "path string, language string, content string",
    )
    found = {(r.path, r.kind, r.name, r.line) for r in extract.symbols(files).collect()}
    assert {("a.php", "class", "A", 3), ("a.php", "class", "D", 6), ("a.php", "function", "f", 4), ("a.sql", "table", "t1", 2), ("a.sql", "view", "v1", 3), ("a.js", "function", "go", 2)} <= found
    links = {(r.path, r.source_name, r.relation, r.target_name, r.confidence) for r in extract.relations(files).collect()}
    assert {("a.php", None, "USES", "Lib\\Tool", 0.75), ("a.php", "A", "INHERITS", "B", 0.95), ("a.php", "A", "STATIC_CALLS", "C", 0.65), ("a.php", "D", "IMPLEMENTS", "E", 0.95), ("a.php", "D", "IMPORTS", "x.inc", 0.9), ("a.js", None, "IMPORTS", "./m", 0.65), ("a.xml", None, "REFERENCES", "r1", 0.55)} <= links
    assert {r.table_name for r in extract.queries(files.where("language = 'sql'")).collect()} == {"t1", "s.t2"}


def test_readers(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.php").write_text("<?php")
    (tmp_path / "src" / "node_modules" / "b.js").write_text("x")
    got = readers.scan_files(spark, f"file://{tmp_path}", "r").drop("last_modified")
    assert [(r.path, r.language, r.size_bytes, r.sha1) for r in got.collect()] == [("src/a.php", "php", 5, hashlib.sha1(b"<?php").hexdigest())]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n')
    assert [(r.a, r._corrupt) for r in readers.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()] == [(1, None), (None, "not json")]
    js = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1}',), ('{"a": 1, "b": 2, "c": 3}',), ("[]",)], "j string")
    assert [r.problem for r in readers.closed_object(js, "j", "a int, b int", ["a", "b"]).collect()] == [None, "missing key", "unknown key", "not an object"]
    text = spark.createDataFrame([("; meta",), ("a,b,c,d,e,f",), ('"x,y",1,2,3,4,5',), ("a,b",), (" ",), ("user = bob",), ("password=p",), ("# c",)], "value string")
    assert rows(readers.definition_rows(text.limit(5)))[0][0] in ("a", "x,y", None) and readers.definition_rows(text.limit(5)).count() == 3
    assert rows(readers.properties(text, ["user"])) == [("user", "bob")]
    yaml = spark.createDataFrame([("a.yaml", "a: 1\n---\nb: [1, 2]\n"), ("b.yaml", "a: [1")], "path string, content string")
    docs = {(r.path, r.document): (r.json, r.problem is None) for r in readers.yaml_documents(yaml).collect()}
    assert docs[("a.yaml", 1)] == ('{"b": [1, 2]}', True) and docs[("b.yaml", 0)][1] is False
    leaves = readers.json_leaves(spark.createDataFrame([(1, '{"a": {"x/y": [10, "t"]}, "b": null}')], "id int, j string"), "id", "j")
    assert {(r.pointer, r.value) for r in leaves.collect()} >= {("/a/x~1y/0", "10"), ("/a/x~1y/1", "t")}
    xml = spark.createDataFrame([("a", '<f><field id="1" name="n"/><field id="2"/></f>'), ("b", '<!DOCTYPE x><field id="3"/>')], "path string, content string")
    assert rows(readers.xml_elements(xml, "field", ["id", "name"])) == [("a", 0, "1", "n"), ("a", 1, "2", None)]
    feature = spark.createDataFrame([("f", "Feature: x\nScenario: one\n Given v3 of the api\n When I post\nScenario: two\n When I get")], "path string, content string")
    assert [(r.scenario, r.keyword, r.version) for r in readers.scenarios(feature).orderBy("line").collect()] == [("one", "Given", "3"), ("one", "When", "3"), ("two", "When", None)]
    outline = spark.createDataFrame([("f", "get <id> of <k>", ["id", "k"], [["1", "a"], ["2", "b"]])], "path string, template string, header array<string>, rows array<array<string>>")
    assert [r.text for r in readers.outline_rows(outline).orderBy("example").collect()] == ["get 1 of a", "get 2 of b"]


def test_nearest_before_ties_and_gaps(spark):
    points = spark.createDataFrame([("g", 1, 0), ("g", 2, 5), ("g", 3, 9), ("h", 4, 1)], "k string, id int, at int")
    marks = spark.createDataFrame([("g", 5, "a"), ("g", 5, "b"), ("g", 7, "c")], "k string, at int, v string")
    assert {r.id: r.v2 for r in windows.nearest_before(points, marks, "k", "at", "v", "v2").collect()} == {1: None, 2: "b", 3: "c", 4: None}


def test_streaming_ingest_drops_repeats(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet")
    source.unionByName(source.limit(50)).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.deduplicated(ingest.event_stream(spark, f"{tmp_path}/in", source.schema), late="10000 days")
    ingest.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == source.count() and got.select("event_id").distinct().count() == source.count()
    batch = ingest.windowed_counts(source.withColumn("ts", F.col("ts").cast("timestamp")))
    assert batch.agg(F.sum("n")).first()[0] == source.count()


def test_ref_targets(spark):
    from factloom.operators import linking

    files = spark.createDataFrame([("a/b.yaml",), ("a/c/D.yaml",), ("e.yaml",)], "path string")
    refs = spark.createDataFrame([("a/b.yaml", x) for x in ("#/x", "c/d.yaml#/y", "../e.yaml", "/e.yaml", "./c/D.yaml", "https://h/e.yaml", "no.yaml", "c/../../e.yaml")], "source_path string, ref string")
    got = {r.ref: (r.target, r.kind) for r in linking.ref_targets(refs, files).collect()}
    assert got == {
        "#/x": ("a/b.yaml", "local"), "c/d.yaml#/y": ("a/c/D.yaml", "resolved"), "../e.yaml": ("e.yaml", "resolved"), "/e.yaml": ("e.yaml", "resolved"),
        "./c/D.yaml": ("a/c/D.yaml", "resolved"), "https://h/e.yaml": (None, "external"), "no.yaml": (None, "missing"), "c/../../e.yaml": ("e.yaml", "resolved")}


def test_agreeing_and_archive(spark):
    from factloom.operators import linking

    facts = spark.createDataFrame([("r", 1, "x"), ("r", 1, "x"), ("s", 2, "y")], "repo string, k int, v string")
    assert linking.agreeing(facts, ["k"]).count() == 2
    with pytest.raises(ValueError):
        linking.agreeing(facts.union(spark.createDataFrame([("r", 1, "z")], facts.schema)), ["k"])
    links = spark.createDataFrame([("s", "r")], "repo string, target_repo string")
    with pytest.raises(ValueError):
        linking.without_repository({"f": facts}, links, "r")
    assert linking.without_repository({"f": facts}, links, "s")["f"].count() == 2


def test_structural_labels_go_on_until_no_class_splits(spark, tmp_path):
    from factloom.operators.graph import structural_labels

    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tmp_path.as_uri())
    nodes = spark.createDataFrame([(f"n{i}", "x") for i in range(26)], "node string, label string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "NEXT") for i in range(25)], "src string, dst string, relation string")
    assert structural_labels(nodes, edges).select("label").distinct().count() == 26


def test_relation_classes(spark):
    rows = [("java.util.List", "IMPORTS", "builtin"), ("Math", "CALLS", "builtin"), ("react", "IMPORTS", "external"), ("./a", "IMPORTS", "local"), ("react", "CALLS", "local"), ("  ", "CALLS", "empty"), (None, "CALLS", "empty")]
    df = spark.createDataFrame(rows, "target_name string, relation string, want string")
    assert df.where(extract.relation_class() != F.col("want")).count() == 0
