"""Facts between objects: traversal over what is verified, paths that carry their evidence, the state of each axis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.scratch import written

#: Axes, the states of a fact that a traversal may follow, and states of extraction coverage.
AXES = ("A", "B", "C", "D", "E")
FOLLOWED = ("VERIFIED", "CORROBORATED")
OPEN, CLOSED = ("partial", "failed"), ("complete", "not_applicable")


def _checked(axes, depth: int = 1, direction: str = "both", least: float | None = None) -> list[str]:
    axes = list(AXES if axes is None else axes)
    if not set(axes) <= set(AXES):
        raise ValueError(f"axes must be among {', '.join(AXES)}")
    if direction not in ("incoming", "outgoing", "both"):
        raise ValueError("direction must be incoming, outgoing or both")
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    if least is not None and not 0 <= least <= 1:
        raise ValueError("the least confidence must be 0 to 1")
    return axes


def _followed(facts: DataFrame, axes: list[str]) -> DataFrame:
    return facts.where(F.col("axis").isin(axes) & F.col("assertion_status").isin(*FOLLOWED) & F.col("target").isNotNull())


def traversal(facts: DataFrame, seeds: DataFrame, depth: int, axes=None) -> DataFrame:
    """The facts that each seed reaches within ``depth`` steps, outgoing, with the depth of the step: seed, depth and the columns of ``facts``.

    ``facts`` have source, target, axis and assertion_status; only verified or corroborated ones with a
    target are followed. All facts of a frontier are told, also those to known objects; an object is
    entered once for each seed, so cycles end. Every level is one join of all seeds' frontiers.
    """
    axes = _checked(axes, depth)
    kept = _followed(facts, axes)
    frontier = seeds.select("node").distinct().select(F.col("node").alias("seed"), "node")
    seen, levels = [frontier], []
    for level in range(1, depth + 1):
        met = written(frontier.join(kept, F.col("node") == F.col("source")).drop("node").withColumn("depth", F.lit(level)))
        levels.append(met)
        if level == depth:
            break
        reached = met.select("seed", F.col("target").alias("node")).distinct()
        frontier = written(reduce(lambda new, old: new.join(old, ["seed", "node"], "left_anti"), seen, reached))
        seen.append(frontier)
    return reduce(DataFrame.unionByName, levels).select("seed", "depth", *facts.columns)


def paths(facts: DataFrame, seeds: DataFrame, depth: int, axes=None, best: int = 3) -> DataFrame:
    """Of every pair of seed and object reached, the ``best`` paths.

    Columns: seed, target, rank, depth, nodes, facts (ids in order), axes, path_status, confidence. A
    path enters no object twice. Its state is the weakest of its facts, CORROBORATED only if all are, its
    confidence the least (a missing one counts 0). Shorter paths come first, then more confidence, then
    the lists of facts in order. Every path carries its own state, so two ways through a diamond are two
    paths; the best of a pair are picked by a group limit before and after the shuffle.
    """
    axes = _checked(axes, depth)
    kept = _followed(facts, axes).select(
        "source", "target", "fact_id", "axis", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("c"), (F.col("assertion_status") == "CORROBORATED").alias("strong"))
    now = seeds.select("node").distinct().select(
        F.col("node").alias("seed"), "node", F.array("node").alias("nodes"), F.expr(f"cast(array() as array<{facts.schema['fact_id'].dataType.simpleString()}>)").alias("facts"),
        F.expr("cast(array() as array<string>)").alias("axes"), F.lit(True).alias("all_strong"), F.lit(1.0).alias("confidence"))
    levels = []
    for level in range(1, depth + 1):
        met = now.join(kept, F.col("node") == F.col("source")).where(~F.array_contains("nodes", F.col("target")))
        now = met.select(
            "seed", F.col("target").alias("node"), F.array_append("nodes", F.col("target")).alias("nodes"), F.array_append("facts", F.col("fact_id")).alias("facts"),
            F.array_append("axes", F.col("axis")).alias("axes"), (F.col("all_strong") & F.col("strong")).alias("all_strong"), F.least("confidence", "c").alias("confidence"))
        now = written(now) if level < depth else now  # the last level is read once
        levels.append(now.withColumn("depth", F.lit(level)))
    order = Window.partitionBy("seed", "node").orderBy("depth", F.desc("confidence"), "facts")
    ranked = reduce(DataFrame.unionByName, levels).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    status = F.when(F.col("all_strong"), "CORROBORATED").otherwise("VERIFIED").alias("path_status")
    return ranked.select("seed", F.col("node").alias("target"), "rank", "depth", "nodes", "facts", "axes", status, "confidence")


def touching(facts: DataFrame, direction: str = "both") -> DataFrame:
    """(node, and the columns of ``facts``): every fact at its source, its target or both; one from an object to itself once."""
    out = facts.select(F.col("source").alias("node"), "*")
    into = facts.where("target is not null").select(F.col("target").alias("node"), "*")
    if direction == "both":
        return out.unionByName(into.where(~F.col("source").eqNullSafe(F.col("target"))))
    return out if direction == "outgoing" else into


def axis_states(objects: DataFrame, facts: DataFrame, coverage: DataFrame, axes=None, direction: str = "both", least: float | None = None) -> DataFrame:
    """(node, axis, status, n_facts) of every object and axis.

    Of an axis' facts the strongest word counts: CONFLICTING, CORROBORATED, VERIFIED. Without these it
    is UNRESOLVED if a fact is or any of its ``coverage`` (node, family, status) is partial or failed;
    NOT_OBSERVED if there is coverage and all of it is complete or not applicable; else UNRESOLVED.
    Facts under ``least`` confidence do not count. Facts and coverage are summed up before they meet.
    """
    axes = _checked(axes, 1, direction, least)
    kept = touching(facts.where(F.col("axis").isin(axes)), direction)
    kept = kept if least is None else kept.where(F.col("confidence") >= least)
    rank = F.max(F.when(F.col("assertion_status") == "CONFLICTING", 4).when(F.col("assertion_status") == "CORROBORATED", 3).when(F.col("assertion_status") == "VERIFIED", 2).when(F.col("assertion_status") == "UNRESOLVED", 1).otherwise(0))
    said = kept.groupBy("node", "axis").agg(rank.alias("rank"), F.count(F.lit(1)).alias("n_facts"))
    closed = coverage.where(F.col("family").isin(axes)).groupBy("node", F.col("family").alias("axis")).agg(F.bool_or(F.col("status").isin(*OPEN)).alias("open"), F.bool_and(F.col("status").isin(*CLOSED)).alias("closed"))
    every = objects.select("node").distinct().withColumn("axis", F.explode(F.array(*[F.lit(a) for a in axes])))
    met = every.join(said, ["node", "axis"], "left").join(closed, ["node", "axis"], "left")
    status = (
        F.when(F.col("rank") == 4, "CONFLICTING").when(F.col("rank") == 3, "CORROBORATED").when(F.col("rank") == 2, "VERIFIED")
        .when((F.col("rank") == 1) | F.col("open"), "UNRESOLVED").when(F.col("closed"), "NOT_OBSERVED").otherwise("UNRESOLVED"))
    return met.select("node", "axis", status.alias("status"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def resolved_names(occurrences: DataFrame, asked: DataFrame) -> DataFrame:
    """For each row of ``asked`` (ask, name, repo): ask, status, node, candidates.

    Names agree whatever the case of their letters, a repo that is not null must be the same. One
    occurrence is ok; several are ambiguous, with the number of candidates and no node, unless a repo was named, whose
    least node is taken; none is entity_not_found. ``occurrences`` are (node, name, repo). They are summed up
    by name, and by name and repo, before they meet, so a name costs a row however often it is there.
    """
    own = occurrences.groupBy(F.lower("name").alias("folded"), F.col("repo").alias("in_repo")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    anywhere = own.groupBy("folded").agg(F.lit(None).cast("string").alias("in_repo"), F.sum("n").alias("n"), F.min("least").alias("least"))
    sums = own.where("in_repo is not null").unionByName(anywhere)
    met = asked.select("ask", "repo", F.lower("name").alias("asked")).join(sums, (F.col("asked") == F.col("folded")) & F.col("repo").eqNullSafe(F.col("in_repo")))
    counted = met.groupBy("ask").agg(F.sum("n").alias("candidates"), F.min("least").alias("least"))
    all_ = asked.select("ask", "repo").join(counted, "ask", "left")
    clear = (F.col("candidates") == 1) | F.col("repo").isNotNull()
    status = F.when(F.col("candidates").isNull(), "entity_not_found").when(clear, "ok").otherwise("ambiguous")
    return all_.select("ask", status.alias("status"), F.when(status == "ok", F.col("least")).alias("node"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def object_relationships(occurrences: DataFrame, facts: DataFrame, coverage: DataFrame, name: str, repo: str | None = None, axes=None, direction: str = "both", depth: int = 1, least: float | None = None) -> dict:
    """All that is known of one object: status, object, axes, relationships (by fact id) and, from depth 2 on, traversal and paths.

    Without an answer, ``status`` is entity_not_found or ambiguous (then with ``candidates``).
    """
    axes = _checked(axes, depth, direction, least)
    spark = occurrences.sparkSession
    asked = spark.createDataFrame([(0, name, repo)], "ask long, name string, repo string")
    one = resolved_names(occurrences, asked).first()
    named = occurrences.where(F.lower("name") == name.lower())
    if one["status"] != "ok":
        return {"status": one["status"], "candidates": named}
    object_ = occurrences.where(F.col("node") == one["node"])
    near = touching(facts.where(F.col("axis").isin(axes)), direction).where(F.col("node") == one["node"])
    near = near if least is None else near.where(F.col("confidence") >= least)
    out = {"status": "ok", "object": object_, "axes": axis_states(object_, facts, coverage, axes, direction, least), "relationships": near.orderBy("fact_id")}
    if depth > 1:
        out |= {"traversal": traversal(facts, object_, depth, axes), "paths": paths(facts, object_, depth, axes)}
    return out
