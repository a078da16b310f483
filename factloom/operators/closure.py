"""Include and inheritance graphs: what reaches what, parts that reach each other, nearest definitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.scratch import removed, written

#: A literal require or include of an .ent file.
REQUIRED = r"""(?i)\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+\.ent)['"]"""


def required_paths(files: DataFrame, pattern: str = REQUIRED) -> DataFrame:
    """(path, place, required): what each file (path, content) names, each once, in order of its first place; backslashes are slashes."""
    found = F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda x: F.translate(F.trim(x), "\\", "/"))
    return files.select("path", F.posexplode(F.array_distinct(F.filter(found, lambda x: x != ""))).alias("place", "required"))


def settled(path):
    """``path`` without empty, ``.`` and ``..`` segments, as one fold with a stack; what leads above the root keeps its dots."""
    none = F.expr("cast(array() as array<string>)")
    top = lambda stack: F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(".."))
    up = lambda stack: F.when(top(stack) == "..", F.array_append(stack, F.lit(".."))).otherwise(F.slice(stack, F.lit(1), F.size(stack) - 1))
    step = lambda stack, s: F.when(s.isin("", "."), stack).when(s == "..", up(stack)).otherwise(F.array_append(stack, s))
    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def _folder(path):
    return F.regexp_replace(path, "[^/]*$", "")


def _name(path):
    return F.element_at(F.split(path, "/"), -1)


def _stem(path):
    return F.regexp_replace(_name(path), r"(?<=.)\.[^.]*$", "")


def resolved_requires(required: DataFrame, files: DataFrame, definitions: DataFrame | None = None, below: str = "app/source/") -> DataFrame:
    """(path, required, target, how): the file that each required path means; target is null where none is there.

    Tried in order, the first that exists: relative to the naming file; ``definitions`` (key, ent_file) by the whole path, the
    name, the stem, in lower case, the first of a key counting; the first file of that name under ``below``, by
    path. Each way is one equi-join with the files that exist, and the least rank wins.
    """
    there = files.select(F.col("path").alias("target"))
    plain = F.regexp_replace("required", r"^[./]+", "")
    asked = required.select("path", "required", F.lower(plain).alias("whole"), F.lower(_name(F.col("required"))).alias("name"), F.lower(_stem(F.col("required"))).alias("stem"), _name(F.col("required")).alias("exact"))
    ways = [asked.select("path", "required", F.lit(0).alias("rank"), settled(F.concat(_folder(F.col("path")), F.col("required"))).alias("target")).join(there, "target", "left_semi")]
    if definitions is not None:
        first = definitions.select("key", "ent_file")
        for rank, key in enumerate(("whole", "name", "stem"), 1):
            ways.append(asked.withColumnRenamed(key, "key").join(first, "key").select("path", "required", F.lit(rank).alias("rank"), settled(F.col("ent_file")).alias("target")).join(there, "target", "left_semi"))
    named = there.where(F.col("target").startswith(below)).select("target", _name(F.col("target")).alias("exact")).groupBy("exact").agg(F.min("target").alias("target"))
    ways.append(asked.join(named, "exact").select("path", "required", F.lit(4).alias("rank"), "target"))
    found = reduce(lambda a, b: a.unionByName(b), ways)
    best = found.groupBy("path", "required").agg(F.min(F.struct("rank", "target")).alias("best"))
    how = F.get(F.array(*[F.lit(x) for x in ("relative", "definition path", "definition name", "definition stem", "name")]), F.col("best.rank"))
    return required.select("path", "required").distinct().join(best, ["path", "required"], "left").select("path", "required", F.col("best.target").alias("target"), how.alias("how"))


def definition_keys(definitions: DataFrame) -> DataFrame:
    """(key, ent_file) of definitions (place, ent_file, entity_name): path, file name, stem and entity name in lower case; the first place keeps a key."""
    path = F.translate("ent_file", "\\", "/")
    keys = F.array(F.lower(F.regexp_replace(path, r"^[./]+", "")), F.lower(_name(path)), F.lower(_stem(path)), F.lower("entity_name"))
    every = definitions.select("place", path.alias("ent_file"), F.posexplode(keys).alias("turn", "key")).where(F.coalesce("key", F.lit("")) != "")
    first = Window.partitionBy("key").orderBy("place", "turn")
    return every.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("key", "ent_file")


def _merged(spark: SparkSession, runs: list[tuple[int, DataFrame, list[str]]]) -> list[tuple[int, DataFrame, list[str]]]:
    """``runs`` (rank, table, paths) with every eight last ones of one rank as one of the next, so a deep graph's levels stay few tables and a row is rewritten once a rank."""
    while len(runs) >= 8 and runs[-8][0] == runs[-1][0]:
        paths = []
        whole = written(reduce(DataFrame.unionByName, [df for _, df, _ in runs[-8:]]), paths=paths)
        for _, _, old in runs[-8:]:
            removed(spark, old)
        runs = [*runs[:-8], (runs[-1][0] + 1, whole, paths)]
    return runs


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, steps): all that is reached from each node over ``edges`` (src, dst) and by how few steps.

    Only pairs that the last round found new are joined with the edges, so a pair is made once for
    each edge that leads to it, and rounds are as many as the longest of the shortest ways. Around a cycle a node reaches itself.
    Written pairs are small files of many rows, which Spark would broadcast, so the joins of the rounds are shuffled ones.
    """
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst").distinct())
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    delta, runs, steps = edges.withColumn("steps", F.lit(1)), [], 1
    while True:
        paths = []
        delta = written(delta, paths=paths)
        if delta.isEmpty():
            break
        runs = [*_merged(spark, runs), (0, delta, paths)]
        known = reduce(DataFrame.unionByName, [df for _, df, _ in runs]).select("src", "dst")
        steps += 1
        delta = delta.join(step.hint("merge"), "dst").select("src", F.col("next").alias("dst")).distinct().join(known.hint("merge"), ["src", "dst"], "left_anti").withColumn("steps", F.lit(steps))
    return reduce(DataFrame.unionByName, [df for _, df, _ in runs]) if runs else delta


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the parts of ``nodes`` whose members reach each other, by their least node.

    Nodes without a way in or out are trimmed first. Then the least node that reaches each is spread
    along the edges, changes only; whoever leads back to it among those of its colour is of its part.
    What is left goes on, so rounds are few and every step is a join of rows that changed. Rounds grow with the
    depth of the graph, so their joins are shuffled ones: what each would broadcast goes through the driver.
    """
    spark = nodes.sparkSession
    edges = written(edges.where("src != dst").select("src", "dst").distinct())
    active = written(nodes.select("node").distinct())
    found, scratch = [], []
    while True:
        while True:
            kept = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct().hint("merge"), "node", "left_semi")
            kept = written(kept.join(active.hint("merge"), "node", "left_semi"))
            alone = written(active.join(kept.hint("merge"), "node", "left_anti"))
            active = kept
            if alone.isEmpty():
                break
            found.append(alone.select("node", F.col("node").alias("component")))
            edges = written(edges.join(active.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(active.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi"))
        if active.isEmpty():
            break
        colours = written(active.select("node", F.col("node").alias("colour")))
        changed = colours
        while not changed.isEmpty():
            offers = changed.withColumnRenamed("node", "src").join(edges.hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
            changed = written(offers.join(colours.hint("merge"), "node").where("offer < colour").select("node", F.col("offer").alias("colour")), paths=scratch)
            colours = written(colours.join(changed.withColumnRenamed("colour", "less").hint("merge"), "node", "left").select("node", F.coalesce("less", "colour").alias("colour")), paths=scratch)
        inside = edges.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("c1")).hint("merge"), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("c2")).hint("merge"), "dst")
        inside = written(inside.where("c1 = c2").select("src", "dst"), paths=scratch)
        frontier = colours.where("node = colour")
        part = [written(frontier)]
        while True:
            back = inside.join(frontier.select(F.col("node").alias("dst"), "colour").hint("merge"), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = written(back.join(reduce(DataFrame.unionByName, part).select("node").hint("merge"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            part.append(frontier)
        whole = reduce(DataFrame.unionByName, part)
        found.append(whole.select("node", F.col("colour").alias("component")))
        active = written(active.join(whole.hint("merge"), "node", "left_anti"))
        edges = written(edges.join(active.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(active.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi"))
        removed(spark, scratch)
    return reduce(DataFrame.unionByName, found) if found else nodes.select("node", F.col("node").alias("component")).limit(0)


def condensed_closure(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Membership (node, component) and what each component reaches (src, dst, steps), itself only if it is a cycle.

    Parts that reach each other are one node of the closure, so a cycle of n files gives n rows and one pair instead of n squared.
    """
    parts = written(components(nodes, edges))
    own = edges.join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return parts, closure(own)


def nearest_definitions(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """(node, key, steps, owner, several): for each key that a node has or reaches, who defines it nearest.

    ``definitions`` are (node, key); edges lead from who includes to who is included. A node's own
    definition hides all others; of those equally near, more than one owner leaves ``owner`` null and
    ``several`` true. Definitions travel against the edges, new ones only, as their least and
    greatest owner, so neither the closure nor lists of owners are ever formed.
    """
    edges = written(edges.select("src", "dst").distinct())
    delta = definitions.select("node", "key").distinct().select("node", "key", F.lit(0).alias("steps"), F.col("node").alias("least"), F.col("node").alias("most"))
    levels = []
    while True:
        delta = written(delta)
        if delta.isEmpty():
            break
        levels.append(delta)
        known = reduce(DataFrame.unionByName, levels).select("node", "key")
        met = edges.join(delta.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "key").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        delta = met.join(known, ["node", "key"], "left_anti").select("node", "key", F.lit(len(levels)).alias("steps"), "least", "most")
    every = reduce(DataFrame.unionByName, levels) if levels else delta
    return every.select("node", "key", "steps", F.when(F.col("least") == F.col("most"), F.col("least")).alias("owner"), (F.col("least") != F.col("most")).alias("several"))


def inherited(classes: DataFrame, parents: DataFrame, declared: DataFrame) -> DataFrame:
    """(class, method, owner, steps, problem): whose declaration each class and method of its ancestors has.

    ``parents`` (child, parent) are explicit facts, ``declared`` (class, method). A class' own declaration
    overrides. Going up needs exactly one parent: inheritance_missing, inheritance_ambiguous or
    inheritance_cycle tell why it ended. All open searches of a round go up together, one join.
    """
    up = written(parents.distinct().groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")))
    wanted = declared.select("class", "method").distinct()
    ways = closure(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    above = ways.join(wanted.withColumnRenamed("class", "dst"), "dst").select(F.col("src").alias("class"), "method")
    open_ = classes.select("class").join(above.unionByName(wanted).distinct(), "class").select("class", "method", F.col("class").alias("at"), F.array("class").alias("path"))
    have = wanted.withColumnRenamed("class", "at").withColumn("has", F.lit(True))
    done, steps = [], 0
    while True:
        met = written(open_.join(have, ["at", "method"], "left").join(up.withColumnRenamed("child", "at"), "at", "left"))
        if met.isEmpty():
            break
        problem = F.when(F.col("n").isNull(), "inheritance_missing").when(F.col("n") > 1, "inheritance_ambiguous").when(F.array_contains("path", F.col("parent")), "inheritance_cycle")
        told = met.withColumn("problem", F.when(F.col("has").isNull(), problem))
        done.append(told.where("has or problem is not null").select("class", "method", F.when(F.col("has"), F.col("at")).alias("owner"), F.lit(steps).alias("steps"), "problem"))
        open_ = told.where("has is null and problem is null").select("class", "method", F.col("parent").alias("at"), F.array_append("path", F.col("parent")).alias("path"))
        steps += 1
    return reduce(DataFrame.unionByName, done) if done else classes.select("class", F.lit(None).cast("string").alias("method"), F.col("class").alias("owner"), F.lit(0).alias("steps"), F.lit(None).cast("string").alias("problem")).limit(0)
