"""Mixing of sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh_names, n_tokens, quoted, running_start, saved, text_of

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Targets by source for ``sizes`` (source, source_size, n_docs); adds weight, target and rate.

    Sources by code point, null last, have the weights in turn. They share ``share`` times all words
    by weight; a target stops at ``most`` times its source's size and the excess is shared again by
    weight until none is above. Sizes of 0 get the target 0. Targets are rounded to 6 places.

    Sources are ranked with a range sort; each resharing is one aggregate to a single row, and the
    rounds end when no further source is capped.
    """
    rows = sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1))
    ranked = running_start(rows, ["_null", "source"], "_one", "_rank").drop("_null", "_one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = saved(ranked.withColumn("weight", weight).drop("_rank"), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level, n_capped = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        got = ranked.agg(
            F.count_if(capped).alias("n"),
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("free"),
        ).first()
        if got["n"] == n_capped or not got["free"]:
            break
        n_capped, level = got["n"], (share * total - got["fixed"]) / got["free"]
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(float(level)))
    out = ranked.withColumn("target", F.round(target.cast("double"), 6))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _plan(docs: DataFrame, seed: str, size: str, source: str, rate: str, repeats: str, **targets) -> DataFrame:
    """``docs`` with the columns of the plan under the given names, each row drawn for itself."""
    rows = docs.withColumn(size, n_tokens())
    found = source_targets(rows.groupBy("source").agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_docs")), **targets)
    found = found.select(F.col("source").alias(source), F.struct("source_size", "target", "rate").alias(rate))
    joined = rows.join(F.broadcast(found) if found.count() <= 100_000 else found, F.col("source").eqNullSafe(F.col(source)))
    who = F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text_of()))
    uniform = F.conv(F.substring(F.md5(who), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    whole = F.floor(f"{rate}.rate")
    return joined.withColumn(repeats, (whole + (uniform < F.col(f"{rate}.rate") - whole).cast("int")).cast("long"))


def mix(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """How often the mix takes each document.

    Columns: doc_id, source, size, source_size, target, rate, repeats, taken. ``repeats`` is
    floor(rate) plus one copy if the document's draw is under the rate's fraction. The draw is a
    uniform number from a hash of seed, id and text, so documents are drawn independently. ``taken`` is
    repeats * size.

    Null text has size 0, a null source is a source of its own. Rows that repeat an id or have none
    are told apart by their texts; rows that also repeat the text share their draw. Reruns agree,
    whatever the partitioning; other columns are not looked at. An empty table gives no rows.
    """
    size, source, rate, repeats = fresh_names(docs, "size", "source", "rate", "repeats")
    return _plan(docs, seed, size, source, rate, repeats, **targets).select(
        "doc_id", "source", F.col(size).alias("size"), F.col(f"{rate}.source_size").cast("long").alias("source_size"), F.col(f"{rate}.target").alias("target"),
        F.col(f"{rate}.rate").alias("rate"), F.col(repeats).alias("repeats"), (F.col(repeats) * F.col(size)).alias("taken"),
    )


def mixed(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, columns as they were.

    Draws, nulls, repeated rows and empty tables are as in :func:`mix`; columns of any name are kept.
    """
    size, source, rate, repeats, copy = fresh_names(docs, "size", "source", "rate", "repeats", "copy")
    plan = _plan(docs, seed, size, source, rate, repeats, **targets).where(F.col(repeats) > 0)
    return plan.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int")))).select(*quoted(docs))
