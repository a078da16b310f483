"""Bounded samples of labelled documents and small fits that run in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import id_remainder
from factloom.llm.encoding import runs

NAMES = ("score", "predicted", "held_out")


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, mod: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``per_class`` labelled documents of each class (text, label, place), and the classes' sizes.

    Only ids whose crc32 leaves a remainder by ``mod`` are learnt from. Of a class, the ids of
    smallest hash are taken, so the sample is the same whatever the order. An id with several labels
    has the greatest; null ids and labels are left out.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", mod) != 0))
        .groupBy(F.col("doc_id").alias("_id")).agg((F.max(label).cast("int") > 0).cast("int").alias("label"))
        .withColumn("place", F.xxhash64("_id"))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy("place", "_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of three numbers
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return sample.groupBy("_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("place").alias("place")), sizes


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], Any]) -> Any:
    """What ``fit`` makes of the whole bounded sample, in one task; None for an empty one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pickle.dumps(fit(rows.sort_values("place", kind="stable").reset_index(drop=True)))]})

    got = sample.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "model binary").first()
    return None if got is None else pickle.loads(got["model"])


def scored(docs: DataFrame, score_texts: Callable[[pa.Array], np.ndarray], threshold: float, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with the score of each whole text, whether it reaches ``threshold``, and whether the id is held out.

    The three columns have the given names, in place of columns of ``docs`` that have them.
    """
    score, predicted, held_out = names
    keep = [c for c in docs.columns if c not in names]
    plain = [f"c{i}" for i in range(len(keep))]  # columns may have names that cannot go through Arrow functions
    text = plain[keep.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole, text):
                got = score_texts(batch.column(text).cast(pa.large_string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(got)], [*plain, "score"])

    rows = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(p) for c, p in zip(keep, plain, strict=True)])
    out = rows.mapInArrow(run, rows.limit(0).withColumn("score", F.lit(0.0)).schema)
    out = out.withColumn("held_out", id_remainder(plain[keep.index("doc_id")], 5) == 0)
    return out.select(*[F.col(p).alias(c) for c, p in zip(keep, plain, strict=True)], F.col("score").alias(score),
                      (F.col("score") >= threshold).cast("int").alias(predicted), F.col("held_out").alias(held_out))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last column of ``x`` should be ones."""
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penal = np.full(x.shape[1], ridge * len(y))
    penal[-1] = 1e-6 * len(y)
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penal * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penal)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
