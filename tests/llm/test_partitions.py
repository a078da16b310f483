"""Partitions and batches that hold copies, blanks or a few words only, and the whole pipeline on such tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm.near_dedup import drop_near_copies, near_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60))


def table(spark, *parts):
    """A table with a partition for each list of texts."""
    out, at = None, 0
    for texts in parts:
        rows = [(at + i, t, "en", "s", None) for i, t in enumerate(texts)]
        part = spark.createDataFrame(rows, DOCS).coalesce(1)
        out, at = part if out is None else out.unionByName(part), at + len(rows)
    return out


@pytest.mark.parametrize("parts", [
    ([LONG, LONG + " more"], [LONG], [None, "", " \t"]), ([None], [""]), (["a"], ["a b c d"], [LONG])])
def test_near_groups_of_partitions(spark, parts):
    docs = table(spark, *parts)
    texts = [t for p in parts for t in p]
    first = {}
    want = {i: i for i in range(len(texts))}
    for i, t in enumerate(texts):
        if t and t.strip():
            want[i] = first.setdefault((t.lower().split() or [""])[0], i)
    got = near_groups(docs).collect()
    if "a b c d" in texts:  # short texts of other words are classes of their own
        want[texts.index("a b c d")] = texts.index("a b c d")
    assert {r.doc_id: r.class_id for r in got} == want
    assert drop_near_copies(docs).count() == len(set(want.values()))


def test_near_groups_in_many_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = ({r.doc_id: r.class_id for r in near_groups(d).collect()} for d in (docs.coalesce(1), docs.repartition(64)))
    assert few == many


@pytest.fixture
def folder(spark, tmp_path):
    """Writes documents beside the given labels."""

    def write(docs):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        os.symlink("/root/testdata/sf0.001/labels.parquet", tmp_path / "labels.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("case", ["empty", "nulls", "repeated", "clashing"])
def test_run_of_the_pipeline(spark, folder, case):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs = {
        "empty": base.limit(0),
        "nulls": base.select(*[F.lit(None).cast(t).alias(c) for c, t in base.dtypes]),
        "repeated": base.unionByName(base).repartition(7),
        "clashing": base.withColumns({c: F.lit("own") for c in ("a.b", "_row", "score", "uid", "size", "_copy")}),
    }[case]
    out = corpus_pipeline.run(spark, folder(docs))
    rows = out.collect()
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if case == "empty":
        assert not rows
    elif case in ("repeated", "clashing"):
        assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in base.select("doc_id").collect()}


def test_a_tile_sends_on_what_its_classes_need():
    import numpy as np

    from factloom.llm.near_dedup import forest

    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(64), np.arange(100, 164)))
    kept = forest(a, b)
    assert len(kept) == 127 and set(a[kept]) == set(range(64)) and set(b[kept]) == set(range(100, 164))
    assert forest(np.array([1, 1, 2, 5]), np.array([2, 2, 1, 6])).tolist() == [0, 3] and len(forest(a[:0], b[:0])) == 0
