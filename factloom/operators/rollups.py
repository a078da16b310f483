"""Roll-ups with precedence, scores and ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def precedence(df: DataFrame, by: str, value: Column, ranked: list[str], default: str, name: str = "status") -> DataFrame:
    """For each group the value that stands first in ``ranked``; ``default`` if it has none of them."""
    rank = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(ranked))):
        rank = F.when(value == v, i).otherwise(rank)
    best = df.groupBy(by).agg(F.min(rank).alias("_rank"), F.count(F.lit(1)).alias("n_facts"))
    names = F.array(*[F.lit(x) for x in ranked])
    return best.select(by, "n_facts", F.coalesce(F.when(F.col("_rank").isNotNull(), F.element_at(names, F.col("_rank") + 1)), F.lit(default)).alias(name))


def risk(parts: list[tuple[Column, Column, float]], digits: int = 3) -> Column:
    """Weighted sum of n / greatest(total, 1), rounded half to even."""
    total = F.lit(0.0)
    for n, of, weight in parts:
        total = total + F.lit(weight) * n.cast("double") / F.greatest(of, F.lit(1)).cast("double")
    return F.bround(total, digits)


def precision_recall(predicted: DataFrame, gold: DataFrame, key: list[str], facet: str) -> DataFrame:
    """True and false positives and misses for each facet, with precision, recall and F1 (null if undefined).

    Both sides are taken as sets of (facet, key).
    """
    cols = [facet, *key]
    p = predicted.select(*cols).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*cols).distinct().withColumn("_g", F.lit(1))
    n = p.join(g, cols, "full").groupBy(facet).agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"),
        F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("*", F.round(ratio(tp, tp + fp), 6).alias("precision"), F.round(ratio(tp, tp + fn), 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of several tables in one pass over each."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def by_severity(parts: list[tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """(severity, kind, detail) of unlike rows, the first part being the most severe, in the order of the three.

    A part is a DataFrame, its kind, and the columns behind the fields of ``detail``, a JSON text.
    """
    one = lambda i, df, kind, fields: df.select(F.lit(i).alias("severity"), F.lit(kind).alias("kind"), F.to_json(F.struct(*[F.col(c).alias(n) for n, c in fields.items()])).alias("detail"))
    return reduce(DataFrame.unionByName, [one(i, *part) for i, part in enumerate(parts)]).orderBy("severity", "kind", "detail")


def name_recall(wanted: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(n_wanted, n_found, recall) over names that agree in their lower-case letters and digits."""
    bare = lambda df: df.select(F.regexp_replace(F.lower(name), "[^a-z0-9]", "").alias("bare")).distinct()
    met = bare(wanted).join(bare(found).withColumn("hit", F.lit(1)), "bare", "left")
    return met.agg(F.count(F.lit(1)).alias("n_wanted"), F.count("hit").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_wanted"), 6))


def macro_micro(scores: DataFrame) -> DataFrame:
    """(macro_f1, micro_f1) of scores by facet: the facets' mean, and the score of all cases together."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return scores.agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("micro_f1"))


#: What each of the seven shares of a catalog's score weighs.
CATALOG_WEIGHTS = {"resolution": 0.2, "confidence": 0.15, "completeness": 0.15, "security": 0.15, "openapi": 0.15, "freshness": 0.1, "repositories": 0.1}


def catalog_score(relations: DataFrame, roots: DataFrame, operations: DataFrame, specs: DataFrame, repositories: DataFrame, fresh: DataFrame, digits: int = 3) -> DataFrame:
    """One row: the seven shares of a catalog and their weighted sum ``overall``, rounded half to even.

    relations (confidence, loose: unresolved or heuristic), roots (rooted: an entity with a root), operations (broken: in
    conflict or allowed without a definition), specs (doubtful: how many faults, 0 to 2), repositories (active), fresh (fresh: one
    row). Empty tables count as without fault, or as 0 where a share of good ones is asked. Every table is
    one aggregate of its own; only these single rows meet.
    """
    good = lambda bad, n: 1 - F.coalesce(bad, F.lit(0)) / F.greatest(n, F.lit(1))
    share = lambda fine, n: F.coalesce(fine, F.lit(0)) / F.greatest(n, F.lit(1))
    n = F.count(F.lit(1))
    one = relations.agg(good(F.count_if("loose"), n).alias("resolution"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    for df, column in (
        (roots, share(F.count_if("rooted"), n).alias("completeness")), (operations, good(F.count_if("broken"), n).alias("security")),
        (specs, good(F.sum("doubtful"), n).alias("openapi")), (fresh, F.when(F.coalesce(F.bool_and("fresh"), F.lit(False)), 1.0).otherwise(0.5).alias("freshness")), (repositories, share(F.count_if("active"), n).alias("repositories"))):
        one = one.join(df.agg(column))
    total = sum((F.col(c) * w for c, w in CATALOG_WEIGHTS.items()), F.lit(0.0))
    return one.select(*[F.bround(F.col(c).cast("double"), digits).alias(c) for c in CATALOG_WEIGHTS], F.bround(total, digits).alias("overall"))
