"""Approximate nearest neighbours: a graph grown by NN-descent, searched greedily."""

from __future__ import annotations

import gc
import warnings
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.batches import saved_by
from factloom.llm.common import removed, running_start, saved

#: Vectors that one block of the first graph compares with one another, and nodes that one task group updates.
BLOCK, CHUNK = 512, 256
#: Sets of hyperplanes that order the vectors for their first edges.
TABLES = 4
#: The graph is grown until a smaller share of its edges is new; queries that measure the search, and
#: the share of their true neighbours that it must find; nodes that every search starts from.
SETTLED, SAMPLE, RECALL, ENTRIES = 0.05, 64, 0.93, 32


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) that take part: those with an id whose vector is not null, zero, or non-finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(fine)


def scaled(rows: DataFrame, narrow: bool) -> tuple[DataFrame, float]:
    """``rows`` with v multiplied by a power of two, the largest component then in 0.5 to 1, and the factor back.

    So squares neither overflow nor vanish, and no digit changes. Components travel as floats where the
    vectors were floats (``narrow``) and none is too small beside the largest one for it.
    """
    size = lambda x: F.abs(x)
    got = rows.select(F.array_max(F.transform("v", size)).alias("most"), F.array_min(F.filter(F.transform("v", size), lambda x: x > 0)).alias("least"))
    got = got.agg(F.max("most").alias("most"), F.min("least").alias("least")).first()
    if got["most"] is None:
        return rows, 1.0
    power = int(np.clip(np.frexp(got["most"])[1], -1000, 1000))
    kind = "float" if narrow and got["least"] > got["most"] * 2.0**-100 else "double"
    return rows.withColumn("v", F.transform("v", lambda x: (x * F.lit(2.0**-power)).cast(kind))), 2.0**power


def packed(rows: DataFrame, kind: str, column: str = "v") -> DataFrame:
    """``rows`` with the vector ``column`` as the bytes of its components, floats ("f4") or doubles ("f8")."""
    at = rows.columns.index(column)
    schema = ", ".join(f"{c} {'binary' if c == column else t}" for c, t in rows.dtypes)

    def pack(batches):
        for batch in batches:
            v = batch.column(at)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
            step = flat.nbytes // max(1, batch.num_rows)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(step)
            bytes_ = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([bytes_ if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return rows.mapInArrow(pack, schema)


def _matrix(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(float)


def _top(owner: np.ndarray, other: np.ndarray, d: np.ndarray, fresh: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of each owner, without repeats; what was known before is not fresh."""
    order = np.lexsort((fresh, other, d, owner))
    owner, other, d, fresh = owner[order], other[order], d[order], fresh[order]
    # equal pairs have equal distances, so they stand together
    keep = np.append(True, (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])) if len(owner) else np.zeros(0, bool)
    owner, other, d, fresh = owner[keep], other[keep], d[keep], fresh[keep]
    first = np.searchsorted(owner, owner)
    best = np.arange(len(owner)) - first < k
    return pd.DataFrame({"node": owner[best], "other": other[best], "d": d[best], "fresh": fresh[best]})


_EDGE = "node long, other long, d double, fresh boolean"


def _distances(v: np.ndarray) -> np.ndarray:
    v = v - v.mean(0)
    sq = (v * v).sum(-1)
    return np.maximum(sq[:, None] + sq[None, :] - 2 * (v @ v.T), 0)


def cells(rows: DataFrame, name: str, kind: str, dims: int, tables: int, n: int) -> DataFrame:
    """(name, t, code, p) of every vector: its cell of hashed hyperplanes in each of ``tables`` sets, and its place along one more."""
    planes = max(1, int(np.log2(max(2, n / BLOCK))) + 1)
    normal = [np.random.default_rng(1000 + t).standard_normal((planes + 1, dims)) for t in range(tables)]

    def code(batches):
        for rows in batches:
            v = _matrix(rows["v"], kind)
            for t, w in enumerate(normal):
                side = v @ w.T
                yield pd.DataFrame({name: rows[name], "t": t, "code": (side[:, :-1] > 0) @ (1 << np.arange(planes)), "p": side[:, -1]})

    return rows.select(name, "v").mapInPandas(code, f"{name} long, t int, code long, p double")


def _blocks(nodes: DataFrame, placed: DataFrame, kind: str, k: int) -> DataFrame:
    """First edges: in the order of each set of hyperplanes each block of near rows compares its own."""
    placed = running_start(placed.withColumn("one", F.lit(1)), ["t", "code", "p", "node"], "one", "place")
    blocks = placed.select("node", "t", F.floor(F.col("place") / BLOCK).alias("block"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, v = rows["node"].to_numpy(), _matrix(rows["v"], kind)
        d = _distances(v)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(ids) - 1)
        if m < 1:
            return pd.DataFrame({"node": [], "other": [], "d": [], "fresh": []})
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"node": np.repeat(ids, m), "other": ids[near].ravel(), "d": np.take_along_axis(d, near, 1).ravel(), "fresh": True})

    return blocks.join(nodes, "node").groupBy("t", "block").applyInPandas(compare, _EDGE)


def neighbour_graph(nodes: DataFrame, placed: DataFrame, kind: str, n: int, k: int = 20, rounds: int | None = None) -> DataFrame:
    """Edges (node, other, d) to about the ``k`` nearest of each node, d the squared distance.

    ``nodes`` (node, v) have ``n`` distinct packed vectors of one length, saved by node; ``placed`` their :func:`cells`. Every round joins each node's
    neighbours, forward and reverse, with their vectors, compares them with one another where one of
    the two is new, and offers each the nearer ones; the k nearest stay. A node meets ``k`` of its
    reverse neighbours, chosen by hash anew each round, so a hub's group stays small. Rounds end when
    under 5 % of the edges are new, or after ``rounds`` where that is given.
    """
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, n // CHUNK)))
    paths: list[str] = []

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _top(*(rows[c].to_numpy() for c in ("node", "other", "d", "fresh")), k)

    def merged(edges: DataFrame) -> DataFrame:
        written: list[str] = []
        out = saved(edges.withColumn("chunk", chunk("node")).groupBy("chunk").applyInPandas(merge, _EDGE), "edges", written)
        removed(nodes.sparkSession, paths)
        paths.extend(written)
        swept(nodes.sparkSession)
        return out

    def offer(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs among the members of each node, for the members that gain by them."""
        rows = rows.sort_values(["node", "other"], kind="stable")
        node, ids, fresh, radius = (rows[c].to_numpy() for c in ("node", "other", "fresh", "radius"))
        v = _matrix(rows["v"], kind)
        edges = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
        out: list[tuple] = []
        for a, b in zip(edges, edges[1:], strict=False):
            d = _distances(v[a:b])
            d[~(fresh[a:b, None] | fresh[None, a:b])] = np.inf
            np.fill_diagonal(d, np.inf)
            d[d >= radius[a:b, None]] = np.inf
            m = min(8, b - a)
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            i, j = np.nonzero(np.isfinite(np.take_along_axis(d, near, 1)))
            j = near[i, j]
            out.append((ids[a:b][i], ids[a:b][j], d[i, j]))
        got = [np.concatenate(x) for x in zip(*out, strict=True)]
        best = _top(got[0], got[1], got[2], np.ones(len(got[0]), bool), k)
        return best

    edges = merged(_blocks(nodes, placed, kind, k))
    vectors = nodes.select(F.col("node").alias("other"), "v")
    for turn in count() if rounds is None else range(rounds):
        radius = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf")).alias("radius")).withColumnRenamed("node", "other")
        chosen = F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node", F.lit(turn))))
        back = edges.withColumn("_r", chosen).where(F.col("_r") <= k).select(F.col("other").alias("node"), F.col("node").alias("other"), "fresh")
        members = edges.select("node", "other", "fresh").unionByName(back).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
        met = members.join(vectors, "other").join(radius, "other", "left").fillna(float("inf"), ["radius"])
        offers = met.withColumn("chunk", chunk("node")).groupBy("chunk").applyInPandas(offer, _EDGE)
        edges = merged(edges.withColumn("fresh", F.lit(False)).unionByName(offers))
        new = edges.agg(F.count_if("fresh").alias("fresh"), F.count(F.lit(1)).alias("all")).first()
        if new["fresh"] <= SETTLED * new["all"]:
            break
    return edges.select("node", "other", "d")


def swept(spark) -> None:
    """Lets Spark delete the shuffles of steps that nothing refers to any more: it does so after a garbage collection of the driver."""
    gc.collect()
    spark._jvm.System.gc()


def _state(rows: pd.DataFrame, ef: int, width: int) -> pd.DataFrame:
    """Known nodes of each query, the ``ef`` nearest; the ``width`` nearest unvisited are next. A query that has such is open."""
    order = np.lexsort((~rows["visited"].to_numpy(), rows["other"].to_numpy(), rows["d"].to_numpy(), rows["query"].to_numpy()))
    rows = rows.iloc[order]
    q, o = rows["query"].to_numpy(), rows["other"].to_numpy()
    keep = np.append(True, (q[1:] != q[:-1]) | (o[1:] != o[:-1])) if len(q) else np.zeros(0, bool)
    rows = rows[keep]
    q = rows["query"].to_numpy()
    rows = rows[np.arange(len(q)) - np.searchsorted(q, q) < ef]
    q, open_ = rows["query"].to_numpy(), ~rows["visited"].to_numpy()
    seen = np.cumsum(open_)
    before, end = np.append(0, seen)[np.searchsorted(q, q)], np.append(0, seen)[np.searchsorted(q, q, "right")]
    return rows.assign(next=open_ & (seen - before <= width), open=end > before)[["query", "other", "d", "visited", "next", "open"]]


def neighbours(graph: DataFrame, most: int = 40) -> DataFrame:
    """Links (node, others) of the graph, forward and up to ``most`` of the reverse ones by hash."""
    chosen = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("other")))
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("_r", chosen).where(F.col("_r") <= most).drop("_r")
    return saved_by(graph.select("node", "other").unionByName(back).groupBy("node").agg(F.collect_set("other").alias("others")), "links", "node")


def true_nearest(nodes: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """The ``k`` nearest nodes (query, other) but its own of a few ``queries`` (query, qv, own), by all distances."""
    asked = queries.collect()
    own, qv = [x["own"] for x in asked], [np.frombuffer(x["qv"], kind).astype(float) for x in asked]
    names = [x["query"] for x in asked]

    def near(parts):
        for rows in parts:
            ids, v = rows["node"].to_numpy(), _matrix(rows["v"], kind)
            for i, name in enumerate(names):
                d = ((v - qv[i]) ** 2).sum(1)
                if own[i] is not None:
                    d = np.where(ids == own[i], np.inf, d)
                best = np.lexsort((ids, d))[:k]
                best = best[np.isfinite(d[best])]
                yield pd.DataFrame({"query": name, "other": ids[best], "d": d[best]})

    met = nodes.select("node", "v").mapInPandas(near, "query long, other long, d double")
    return met.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("d", "other"))).where(F.col("_r") <= k).select("query", "other")


def doors(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, other): in each cell that a query lies in, the nodes right before and after it along the cell's order.

    A cell holds about a block of nodes; a larger one, of vectors that no plane parts, is sorted by one task, spilling.
    """
    both = placed.select("t", "code", "p", "node").withColumn("query", F.lit(None).cast("long")).unionByName(asked.select("t", "code", "p", F.lit(None).cast("long").alias("node"), "query"))
    side = lambda *order: F.last("node", ignorenulls=True).over(Window.partitionBy("t", "code").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("before", side(F.asc("p"), F.asc_nulls_last("node"))).withColumn("after", side(F.desc("p"), F.desc_nulls_last("node")))
    return met.where("query is not null").select("query", F.explode(F.array_compact(F.array("before", "after"))).alias("other"))


def search(nodes: DataFrame, links: DataFrame, queries: DataFrame, begin: DataFrame, kind: str, k: int, ef: int) -> DataFrame:
    """Nodes (query, other, d) that a greedy search for ``queries`` (query, qv, own) meets, the nearest of them.

    Every search starts from the same 32 nodes, those of least hash, from the nodes that ``begin`` (query,
    other) names and from its own. Each step expands the nearest nodes of every query that it has not visited among its
    ``ef`` nearest, 32 or half of ``ef``, by a join with the graph, until none is left; a query that has
    none left goes through no further step. 64 queries, those of least hash, are searched first and held
    against all nodes; while less than 93 % of their true neighbours are found, they are searched anew, half as
    wide again. All others are searched once, as wide as that. A search as wide as the table that still
    misses its target gives a warning.
    """
    spark = nodes.sparkSession
    queries = saved(queries.select("query", "qv", "own"), "queries")
    n, many = queries.count(), nodes.count()
    sample = saved(queries.orderBy(F.xxhash64("query"), "query").limit(SAMPLE), "sample")
    true = saved(true_nearest(nodes, sample, kind, k), "true")
    wanted = true.count()
    asking = queries.select("query", "qv")
    size = queries.agg(F.sum(F.octet_length("qv"))).first()[0] or 0
    asking = F.broadcast(asking) if size <= 8_000_000 else asking
    gates = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES)

    def measure(batches):
        for rows in batches:
            qv, v = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(rows.num_rows, -1).astype(float) for c in ("qv", "v"))
            yield pa.RecordBatch.from_arrays([rows.column("query"), rows.column("other"), pa.array(((v - qv) ** 2).sum(1))], ["query", "other", "d"])

    def measured(met: DataFrame) -> DataFrame:
        """Ids travel to the vectors, which stay where they are."""
        return met.withColumnRenamed("other", "node").join(nodes, "node").withColumnRenamed("node", "other").join(asking, "query").select("query", "other", "qv", "v").mapInArrow(measure, "query long, other long, d double")

    schema = "query long, other long, d double, visited boolean, next boolean, open boolean"
    own = queries.where("own is not null").select("query", F.col("own").alias("other"))
    first = queries.select("query").join(F.broadcast(gates.withColumnRenamed("node", "other"))).unionByName(own).unionByName(begin)  # 32 rows
    first = saved(measured(first.distinct()).withColumn("visited", F.lit(False)), "first")

    def descended(state: DataFrame, asked: int, ef: int) -> DataFrame:
        """What the searches that start from ``state``, of ``asked`` queries, end with."""
        paths: list[str] = []
        chunk = F.pmod(F.xxhash64("query"), F.lit(max(1, asked // 16)))
        width = max(32, ef // 2)

        def kept(rows: DataFrame) -> DataFrame:
            return saved(rows.withColumn("chunk", chunk).groupBy("chunk").applyInPandas(lambda g: _state(g, ef, width), schema), "state", paths)

        state = kept(state)
        while True:
            state = state.where("open")
            front = state.where("next").select("query", F.col("other").alias("node"))
            if front.isEmpty():
                break
            met = front.join(links, "node").select("query", F.explode("others").alias("other")).distinct().join(state.select("query", "other"), ["query", "other"], "left_anti")
            old = state.select("query", "other", "d", (F.col("visited") | F.col("next")).alias("visited"))
            state = kept(old.unionByName(measured(met).withColumn("visited", F.lit(False))))
            swept(spark)
        # a query's rows are written without being open once, at its end
        out = saved(spark.read.schema(schema).parquet(*paths).where("not open").select("query", "other", "d"), "found")
        removed(spark, paths)
        return out

    names = F.broadcast(sample.select("query"))  # 64 rows
    while True:
        found = descended(first.join(names, "query", "left_semi"), min(n, SAMPLE), ef)
        hits = found.join(F.broadcast(true), ["query", "other"], "left_semi").count()  # k rows for each of 64 queries
        if hits >= RECALL * wanted:
            break
        if ef >= many:
            warnings.warn(f"a search as wide as the table finds {hits} of {wanted} true neighbours", stacklevel=2)
            break
        ef += -(-ef // 2)
    return found if n <= SAMPLE else found.unionByName(descended(first.join(names, "query", "left_anti"), n - SAMPLE, ef))


def _ranked(rows: DataFrame, queries: DataFrame, k: int, ef: int, degree: int, rounds: int | None, narrow: bool) -> DataFrame:
    """The ``k`` nearest of ``queries`` (query_id, v, own: its vec_id if it is a row) among ``rows`` (vec_id, v) of one length."""
    both, back = scaled(rows.select("vec_id", "v", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("own")).unionByName(
        queries.select(F.col("query_id").alias("vec_id"), "v", F.lit(True).alias("asks"), "own")), narrow)
    both = saved(both, "vectors")
    rows = both.where("not asks").select("vec_id", "v")
    groups = saved(rows.groupBy("v").agg(F.min("vec_id").alias("node")), "nodes")
    nodes = groups.select("node", "v")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    members = rows.withColumn("_r", rank).where(F.col("_r") <= k + 1).join(groups, "v").select("node", "vec_id")
    # equal vectors ask once; a vector that is in the table knows its node
    queries = saved(both.where("asks").select(F.col("vec_id").alias("query_id"), "v", "own").join(groups.withColumnRenamed("node", "here"), "v", "left"), "asked")
    asked = saved(queries.groupBy("v").agg(F.min("query_id").alias("query"), F.min("here").alias("own")).select("query", F.col("v").alias("qv"), "own"), "starts")
    first = nodes.first()
    if first is None or asked.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = len(first["v"]), nodes.count()
    kind = "f4" if nodes.schema["v"].dataType.simpleString() == "array<float>" else "f8"
    flat = saved_by(packed(nodes, kind), "vectors", "node")
    placed = saved(cells(flat, "node", kind, dims, TABLES, n), "cells")
    links = neighbours(neighbour_graph(flat, placed, kind, n, degree, rounds))
    flat_asked = saved(packed(asked, kind, "qv"), "packed")
    begin = doors(placed, cells(flat_asked.select("query", F.col("qv").alias("v")), "query", kind, dims, TABLES, n))
    found = search(flat, links, flat_asked, begin, kind, k, ef)
    close = found.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy("d", "other"))).where(F.col("_r") <= 4 * k + 1)
    apart = F.zip_with("qv", "cv", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    exact = (
        close.select("query", F.col("other").alias("node"))
        .join(nodes.withColumnRenamed("v", "cv"), "node")
        .join(asked.select("query", "qv"), "query")
        .withColumn("score", F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x)) * F.lit(back))
        .select("query", "node", "score")
    )
    order = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    short = exact.join(members, "node").withColumn("_r", order).where(F.col("_r") <= k + 1).select("query", "vec_id", "score")
    who = queries.join(asked.select("query", F.col("qv").alias("v")), "v").select("query_id", "own", "query")
    pairs = who.join(short, "query").where(F.col("own").isNull() | (F.col("own") != F.col("vec_id")))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 10, ef: int = 256, degree: int = 20, rounds: int | None = None) -> DataFrame:
    """The ``k`` nearest found of each query row: query_id, rank, vec_id, score (Euclidean distance).

    Every usable row is indexed; equal vectors are one node of the graph, and of a node the ``k + 1``
    smallest ids can be results. The graph search starts from 32 nodes that all queries share, from some of the
    cells of hashed hyperplanes that the query lies in, and from the query's own; 64 of the queries, which are held against
    all nodes, go first, ``ef`` wide and then wider until 93 % of their true neighbours are found, and set the width for all. Distances are computed in double precision on the vectors, of any
    scale; nearest first, equal ones by smaller id. The query itself is no candidate.

    Null, zero, and non-finite vectors take no part; a vector has neighbours among those of its own
    length, so each length is a table for itself. Fewer candidates give fewer rows; rows that
    repeat an id count once, the smallest vector stands; an empty table gives no rows. Other columns are not looked at.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = saved(rows.withColumn("asks", F.coalesce(is_query, F.lit(False))), "vectors")
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v", F.col("vec_id").alias("own"))
    return _by_length(vectors, rows, queries, k, ef, degree, rounds)


def nearest_to(vectors: DataFrame, queries: DataFrame, k: int = 10, ef: int = 256, degree: int = 20, rounds: int | None = None) -> DataFrame:
    """As :func:`nearest`, for ``queries`` (query_id, embedding) that need not be rows of the table; none is excluded."""
    rows = saved(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asked = usable(queries, "query_id").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return _by_length(vectors, rows, saved(asked.withColumn("own", F.lit(None).cast("long")), "queries"), k, ef, degree, rounds)


def _by_length(vectors: DataFrame, rows: DataFrame, queries: DataFrame, *options) -> DataFrame:
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    lengths = sorted(r["n"] for r in queries.select(F.size("v").alias("n")).distinct().collect())
    found = None
    for n in lengths:
        part = _ranked(rows.where(F.size("v") == n).select("vec_id", "v"), queries.where(F.size("v") == n), *options, narrow)
        found = part if found is None else found.unionByName(part)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found
