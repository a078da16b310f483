"""What a step costs, as rows that its joins make and bytes that it moves, grows with its input."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import access, closure, graph, handlers, relations
from factloom.sources import generations


@pytest.fixture
def measured(spark):
    """Collects a query; its rows, the most rows that any join of it made, the bytes of all its exchanges, and how many tables were broadcast."""

    def run(make):
        store = spark._jsparkSession.sharedState().statusStore()
        before = {e.executionId() for e in _listed(store.executionsList())}
        got = make().collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        most = {"join": 0, "moved": 0.0, "broadcast": 0}
        for e in _listed(store.executionsList()):
            if e.executionId() in before:
                continue
            values = store.executionMetrics(e.executionId())
            for node in _listed(store.planGraph(e.executionId()).allNodes()):
                most["broadcast"] += node.name() == "BroadcastExchange"
                for m in _listed(node.metrics()):
                    if not values.contains(m.accumulatorId()):
                        continue
                    value = values.apply(m.accumulatorId())
                    if "Join" in node.name() and m.name() == "number of output rows":
                        most["join"] = max(most["join"], int(value.replace(",", "")))
                    if node.name() == "Exchange" and m.name() == "data size":
                        number, unit = value.split("\n")[-1].split()[:2]
                        most["moved"] += float(number.replace(",", "")) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}[unit]
        return got, most

    return run


def _listed(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_a_common_name_is_one_row(spark, measured):
    occurrences = spark.range(2_000).select(F.col("id").alias("node"), F.lit("Bill").alias("name"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("r"), (F.col("id") % 4).cast("string"))).alias("repo"))
    asked = spark.range(2_000).select(F.col("id").alias("ask"), F.lit("BILL").alias("name"), F.when(F.col("id") % 2 == 1, "r3").alias("repo"))
    got, most = measured(lambda: relations.resolved_names(occurrences, asked))
    assert {(r.ask % 2, r.status, r.node, r.candidates) for r in got} == {(0, "ambiguous", None, 2_000), (1, "ok", 3, 500)} and len(got) == 2_000
    assert 2_000 <= most["join"] <= 4_000


def test_links_are_followed_from_their_cheaper_end(spark, measured):
    surfaces = spark.range(300).select(F.col("id").alias("surface"))
    library = surfaces.select("surface", F.lit("lib").alias("script"), F.lit("active").alias("scope"))
    busy = spark.range(300).select(F.lit(0).cast("long").alias("surface"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("script"), F.lit("conditional").alias("scope"))
    symbols = spark.range(300).select(F.lit("lib").alias("script"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("parent"))
    symbols = symbols.unionByName(busy.select("script", F.lit("g").alias("name"), F.lit(None).cast("string").alias("parent")))
    events = surfaces.select(F.col("surface").alias("event"), "surface", F.lit("f7").alias("name"))
    events = events.unionByName(spark.range(300).select((F.col("id") + 1_000).alias("event"), F.lit(0).cast("long").alias("surface"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name")))
    got, most = measured(lambda: handlers.handlers(events, library.unionByName(busy), symbols, symbols.select("script").limit(0)))
    assert len(got) == 600 and {(r.status, r.script) for r in got} == {("resolved", "lib")}
    assert most["join"] <= 1_200 and most["moved"] < 1_000_000


def _star(spark, n=3_000):
    """Edges between a few hubs and many leaves, so that a small frontier meets a large graph."""
    return spark.range(n).select(F.concat(F.lit("h"), (F.col("id") % 7).cast("string")).alias("src"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("dst"), F.lit("USES").alias("relation"), (F.col("id") % 100).cast("double").alias("weight"))


def test_impact_ranks_the_edges_of_its_frontier_alone(spark, measured):
    edges = graph.written(_star(spark, 20_000))
    got, most = measured(lambda: graph.impact(edges, spark.createDataFrame([("l5",)], "node string"), 2, 3, least=1.0))
    assert [(r.node, r.depth) for r in got if r.depth < 2] == [("l5", 0), ("h5", 1)] and len([r for r in got if r.depth == 2]) == 3
    assert most["moved"] < 500_000


def test_no_weight_counts_as_none(spark):
    edges = spark.createDataFrame([("a", "b", "r", -1.0), ("a", "c", "r", None), ("a", "d", "r", 2.0)], "src string, dst string, relation string, weight double")
    seeds = spark.createDataFrame([("a",)], "node string")
    reached = lambda **k: {r.node for r in graph.impact(edges, seeds, 1, **k).collect()} - {"a"}
    assert reached(cap=2) == {"c", "d"} and reached(cap=1) == {"d"} and reached(cap=2, least=1.0) == {"d"} and reached(cap=2, least=-1.0) == {"b", "d"}


def test_changes_are_made_once(spark, tmp_path):
    table = generations.Table(spark, f"file://{tmp_path}", "path", 8)
    table.create(spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.col("id").alias("size")))
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for row in rows:
            made.add(len(row))
            yield row

    changes = spark.range(20).select(F.lit("modified").alias("change"), *[F.concat(F.lit("p"), F.col("id").cast("string")).alias(c) for c in ("old_key", "new_key")], *[F.lit(None).cast("string").alias(c) for c in ("old_hash", "new_hash")], (F.col("id") + 100).alias("size"))
    table.apply(changes.mapInPandas(seen, changes.schema))
    assert made.value == 20 and table.read().where("size >= 100").count() == 20


def test_rounds_of_labels_make_no_edges(spark):
    edges = _star(spark)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for row in rows:
            made.add(len(row))
            yield row

    got = graph.structural_labels(nodes.withColumn("label", F.lit("x")), edges.mapInPandas(seen, edges.schema)).collect()
    assert len({r.label for r in got}) == 4 and len(got) == 3_007
    assert made.value == 2 * 3_000  # once for each direction


def _with_broadcasts(spark, make):
    """Collects a query; its rows and the most rows that any table had which it broadcast."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in _listed(store.executionsList())}
    got = make().collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = [0]
    for e in _listed(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            metrics = [m for node in _listed(store.planGraph(e.executionId()).allNodes()) if node.name() == "BroadcastExchange" for m in _listed(node.metrics())]
            rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return got, max(rows)


def test_rounds_of_labels_broadcast_no_nodes(spark):
    edges = _star(spark)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("label", F.lit("x"))
    got, most = _with_broadcasts(spark, lambda: graph.structural_labels(nodes, edges))
    assert len({r.label for r in got}) == 4 and len(got) == 3_007
    assert most < 100  # two kinds of each relation, and these for each label


def test_class_sizes_broadcast_no_nodes(spark, tmp_path):
    from factloom.plans import QUERIES

    spark.range(2_000).select(F.col("id").alias("p_partkey"), F.lit("STEEL").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(3).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(6_000).select((F.col("id") % 3).alias("l_suppkey"), (F.col("id") % 2_000).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, most = _with_broadcasts(spark, lambda: QUERIES["structural_class_sizes"](spark, str(tmp_path)))
    assert {(r.n_nodes, r.n_classes) for r in got} == {(3, 1), (2_000, 1)}
    assert most < 100


def test_include_edges_broadcast_no_parts(spark, tmp_path):
    from factloom.plans import includes
    from factloom.plans.registry import Tables

    spark.range(500).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    got, most = _with_broadcasts(spark, lambda: includes._edges(Tables(spark, str(tmp_path))))
    assert {(r.src, r.dst) for r in got} == {(i, i // 2) for i in range(1, 500)} | {(i, i ^ 1) for i in range(500) if i % 50 >= 40}
    assert most == 0


def test_a_last_level_is_not_written(spark):
    facts = spark.createDataFrame([(1, "a", "b", "A", "VERIFIED", 1.0), (2, "b", "c", "A", "VERIFIED", 1.0)], "fact_id long, source string, target string, axis string, assertion_status string, confidence double")
    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = len(os.listdir(place))
    found = relations.paths(facts, spark.createDataFrame([("a",)], "node string"), 2)
    assert len(os.listdir(place)) - before == 1 and sorted(r.target for r in found.collect()) == ["b", "c"]


def test_rounds_of_cycles_broadcast_nothing(spark, measured):
    chain = spark.range(1, 40).select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst")).unionByName(spark.createDataFrame([(3, 7), (1, 39)], "src long, dst long"))
    got, most = measured(lambda: closure.components(spark.range(40).withColumnRenamed("id", "node"), chain))
    parts = {r.node: r.component for r in got}
    assert parts[1] == parts[39] == parts[19] == parts[9] == parts[4] == parts[2] == 1 and parts[3] == parts[7] == 3 and parts[0] == 0 and parts[5] == 5
    assert most["broadcast"] == 0


def test_rounds_of_a_closure_broadcast_nothing_and_keep_few_tables(spark, measured):
    chain = spark.range(19).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(0, 0), (19, 17)], "src long, dst long"))
    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = len(os.listdir(place))
    got, most = measured(lambda: closure.closure(chain))
    want = {(a, b): b - a for a in range(20) for b in range(a + 1, 20)} | {(0, 0): 1, (17, 17): 3, (18, 17): 2, (18, 18): 3, (19, 17): 1, (19, 18): 2, (19, 19): 3}
    assert {(r.src, r.dst): r.steps for r in got} == want and len(got) == len(want)
    assert most["broadcast"] == 0
    assert len(os.listdir(place)) - before < 19  # levels are as many


def test_links_are_sorted_once(spark, measured):
    told = access.Evidence()
    rows = spark.range(2_000)
    told.anchor(rows, F.col("id"), file=F.col("id") % 500, name=F.col("id"))
    told.target(rows, "order", F.col("id"), F.col("id"), name=F.col("id"), file=F.col("id") % 500)
    plan = told.links()
    got = {(r.entity, r.record): (r.link_type, r.evidence, r.reasons) for r in plan.collect()}
    assert len(got) == 8_000 and got[3, "3"] == ("file", "3", ["file", "name"]) and got[503, "3"] == ("file", "3", ["file"])
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ObjectHashAggregate" not in text
