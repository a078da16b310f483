"""Neighbour search against all distances, with the query's own parameters."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm.ann import nearest, nearest_to


def found(df):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def by_all_distances(v, q, skip, k=10):
    v, q = np.asarray(v, float), np.asarray(q, float)
    top = np.abs(v).max()
    d = np.sqrt((((v - q) / top) ** 2).sum(1)) * top
    return [i for i in np.lexsort((np.arange(len(v)), d)) if i != skip][:k], d


@pytest.mark.parametrize(("scale", "kind"), [(1e20, "float"), (1e-25, "float"), (1e200, "double")])
def test_recall_at_every_scale(spark, scale, kind):
    v = (np.random.default_rng(2).standard_normal((700, 32)) * scale).astype(np.float32 if kind == "float" else float)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")
    got, hit = found(nearest(table, F.col("vec_id") % 100 == 0)), 0
    assert set(got) == set(range(0, 700, 100))
    for q, rows in got.items():
        best, d = by_all_distances(v, v[q], q)
        assert [r[0] for r in rows] == list(range(1, 11)) and all(math.isclose(s, d[i], rel_tol=1e-12) for _, i, s in rows)
        hit += len(set(best) & {i for _, i, _ in rows})
    assert hit >= 0.9 * 70


def test_edges(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[400:500] = v[3]
    short = [(7000 + i, x.tolist()) for i, x in enumerate(rng.standard_normal((15, 4)).astype(np.float32))]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + short + [(8000, [1.0])]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] + [1.0] * 15), (None, [1.0] * 16), (5, v[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit("own"), "node": F.lit(1)})
    got = found(nearest(table, F.col("vec_id") % 100 == 0))
    assert set(got) == {*range(0, 600, 100), 7000}  # a vector of a length of its own has no neighbour
    assert [x[1] for x in got[400]] == [3, *range(401, 410)] and all(x[2] == 0 for x in got[400])
    best, _ = by_all_distances([x for _, x in short], short[0][1], 0)
    assert [x[1] - 7000 for x in got[7000]] == best
    assert nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    outside = spark.createDataFrame([(1, v[17].tolist()), (2, (v[20] * 1.01).tolist())], "query_id long, embedding array<float>")
    near = found(nearest_to(table, outside))
    assert near[1][0][1:] == (17, 0.0) and near[2][0][1] == 20


def test_a_narrow_search_is_widened(spark):
    v = np.random.default_rng(4).standard_normal((800, 48)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = found(nearest(table, F.col("vec_id") % 50 == 0, ef=64, degree=5, rounds=1))
    hits = sum(len(set(by_all_distances(v, v[q], q)[0]) & {x[1] for x in rows}) for q, rows in got.items())
    assert hits >= 0.9 * 160


def test_queries_from_outside_reach_every_cluster(spark):
    """60 clusters far from one another, 40 vectors each: no edge leads from one to another."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 24)) * 100
    v = (np.repeat(centres, 40, axis=0) + rng.standard_normal((2400, 24))).astype(np.float32)
    q = (centres + rng.standard_normal((60, 24))).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = found(nearest_to(table, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<float>")))
    hits = sum(len(set(by_all_distances(v, q[i], None)[0]) & {x[1] for x in rows}) for i, rows in got.items())
    assert hits >= 0.9 * 600


def test_a_query_leaves_the_search_when_it_is_done(spark, monkeypatch):
    """Only the measuring queries are searched more than once, and none goes through a step after its last."""
    from factloom.llm import ann

    v = np.random.default_rng(6).standard_normal((1500, 32)).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    done, saved = collections.Counter(), ann.saved

    def spied(df, name, *rest):
        out = saved(df, name, *rest)
        if name == "state":
            done.update(r.query for r in out.groupBy("query").agg(F.max("next").alias("next")).where("not next").collect())
        return out

    monkeypatch.setattr(ann, "saved", spied)
    got = found(nearest(table, F.col("vec_id") % 10 == 0, ef=64, degree=8, rounds=1))
    assert len(done) == 150 and sum(n == 1 for n in done.values()) >= 150 - ann.SAMPLE
    hits = sum(len(set(by_all_distances(v, v[q], q)[0]) & {x[1] for x in rows}) for q, rows in got.items())
    assert hits >= 0.9 * 1500
