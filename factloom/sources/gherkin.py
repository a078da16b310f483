"""Gherkin features as tables: cases, one for each example row, and their steps in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.requests import eligibility

#: The words that begin sections and steps, and the forms of version and issue tags.
SCENARIO = r"^(Scenario Outline|Scenario Template|Scenario|Example):\s*(.*)$"
EXAMPLES = r"^(Examples|Scenarios):"
STEP = r"^(Given|When|Then|And|But|\*)\s+(.*)$"
VERSION_TAG = r"(?i)^@version:(\S+)$"
ISSUE_TAG = r"^@([A-Z][A-Z0-9]+-\d+)$"


def substituted(text: Column, values: Column) -> Column:
    """``text`` with each <name> that ``values`` has put in, in one pass: what is put in is not looked at again."""
    names = F.regexp_extract_all(text, F.lit("<([^>]+)>"), F.lit(1))
    filled = F.transform(names, lambda n: F.coalesce(values[n], F.concat(F.lit("<"), n, F.lit(">"))))
    return F.array_join(F.zip_with(F.split(text, "<[^>]+>", -1), filled, lambda piece, x: F.concat(piece, F.coalesce(x, F.lit("")))), "")


def _lines(files: DataFrame) -> DataFrame:
    """(path, line, raw, section, kind, title): every line that counts, with the section that it belongs to.

    A tag belongs to the section after it. Comments, blank lines and doc strings do not count.
    """
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "^﻿+", "")
    rows = files.select("path", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("at", "raw")).select("path", (F.col("at") + 1).alias("line"), F.trim(F.regexp_replace("raw", r"^[\s ]+|[\s ]+$", "")).alias("raw"))
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("raw").startswith('"""') | F.col("raw").startswith("```")
    rows = rows.withColumn("_fences", F.sum(fence.cast("int")).over(upto)).where(~fence & (F.col("_fences") % 2 == 0) & (F.col("raw") != "") & ~F.col("raw").startswith("#"))
    kind = (
        F.when(F.col("raw").rlike("^Feature:"), "feature").when(F.col("raw").rlike("^Background:"), "background").when(F.col("raw").rlike(SCENARIO), "scenario")
        .when(F.col("raw").rlike(EXAMPLES), "examples").when(F.col("raw").rlike("^Rule:"), "rule"))
    rows = rows.withColumn("kind", kind).withColumn("_sections", F.sum(F.col("kind").isNotNull().cast("int")).over(upto))
    tag = F.col("raw").startswith("@")
    return rows.withColumn("section", F.col("_sections") + tag.cast("int")).withColumn("title", F.trim(F.regexp_extract("raw", r"^[^:]+:\s*(.*)$", 1))).drop("_fences", "_sections")


def features(files: DataFrame, meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cases, steps and problems of Gherkin ``files`` (path, content).

    cases: path, scenario (its number in the file), example (from 1; null without examples),
    feature_name, name, case_name (the example's testCaseID, else the name), line, tags, issues,
    eligibility, versions (declared), conflicted, fallback. ``meta`` (path, version, test_object) has a
    file's properties; its version must be one of the feature's version tags, if there are any, else
    the case is conflicted and has no declared version.

    steps: path, scenario, example, at, line, text; names in angle brackets are filled from the example row.

    problems: path, line, kind (commented_feature, no_feature, background_request). A file without a
    Feature line has no cases. Names of examples and cells go together as far as both reach. A byte
    order mark is left out. Background steps are no case's steps: a request among them is a problem.
    """
    rows = _lines(files)
    heads = rows.where("kind is not null").select("path", "section", "line", "kind", "title")
    tags = rows.where(F.col("raw").startswith("@")).select("path", "section", "line", F.posexplode(F.split(F.regexp_replace("raw", r"\s+#.*$", ""), r"\s+")).alias("at", "tag"))
    tags = tags.groupBy("path", "section").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "at", "tag"))), lambda x: x["tag"]).alias("tags"))
    none = F.expr("cast(array() as array<string>)")
    heads = heads.join(tags, ["path", "section"], "left").withColumn("tags", F.coalesce("tags", none))
    feature = heads.where("kind = 'feature'").groupBy("path").agg(F.min(F.struct("line", "title", "tags")).alias("f"))
    order = Window.partitionBy("path").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    owned = heads.withColumn("owner", F.last(F.when(F.col("kind").isin("scenario", "background", "rule"), F.col("section")), ignorenulls=True).over(order))

    cells = F.transform(F.split(F.regexp_replace("raw", r"^\||\|$", ""), r"(?<!\\)\|", -1), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    table = rows.where(F.col("raw").startswith("|")).select("path", "section", "line", cells.alias("cells"))
    table = table.join(owned.where("kind = 'examples'").select("path", "section", "owner"), ["path", "section"])
    first = table.withColumn("_n", F.row_number().over(Window.partitionBy("path", "section").orderBy("line")))
    header = first.where("_n = 1").select("path", "section", F.col("cells").alias("names"))
    body = first.where("_n > 1").join(header, ["path", "section"])
    n = F.least(F.size("names"), F.size("cells"))
    values = F.map_from_entries(F.arrays_zip(F.slice("names", 1, n).alias("k"), F.slice("cells", 1, n).alias("v")))
    examples = body.select("path", F.col("owner").alias("section"), values.alias("values"), F.row_number().over(Window.partitionBy("path", "owner").orderBy("line")).alias("example"))

    scenarios = heads.where("kind = 'scenario'").join(feature, "path").select("path", "section", "line", F.col("title").alias("template"), F.col("tags").alias("own"), "f")
    made = scenarios.join(examples, ["path", "section"], "left").withColumn("values", F.coalesce("values", F.expr("cast(map() as map<string,string>)")))
    if meta is None:
        meta = files.select("path", F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("test_object"))
    made = made.join(meta.select("path", F.nullif("version", F.lit("")).alias("stated"), F.col("test_object").alias("fallback")), "path", "left")
    tagged = F.filter(F.transform("f.tags", lambda x: F.regexp_extract(x, VERSION_TAG, 1)), lambda x: x != "")
    conflict = F.col("stated").isNotNull() & (F.size(tagged) > 0) & ~F.array_contains(tagged, F.col("stated"))
    every = F.concat("f.tags", "own")
    name = substituted(F.col("template"), F.col("values"))
    cases = made.select(
        "path", F.col("section").alias("scenario"), "example", F.col("f.title").alias("feature_name"), name.alias("name"), F.coalesce(F.nullif(F.col("values")["testCaseID"], F.lit("")), name).alias("case_name"), "line",
        every.alias("tags"), F.filter(F.transform(every, lambda x: F.regexp_extract(x, ISSUE_TAG, 1)), lambda x: x != "").alias("issues"), eligibility(every).alias("eligibility"),
        F.when(F.coalesce(conflict, F.lit(False)), none).when(F.col("stated").isNotNull(), F.array("stated")).otherwise(tagged).alias("versions"), F.coalesce(conflict, F.lit(False)).alias("conflicted"), "fallback")
    steps = rows.where(F.col("raw").rlike(STEP)).select("path", "section", "line", F.trim(F.regexp_extract("raw", STEP, 2)).alias("template"))
    mine = steps.join(made.select("path", "section", "example", "values"), ["path", "section"])
    case = Window.partitionBy("path", "section", "example").orderBy("line")
    out = mine.select("path", F.col("section").alias("scenario"), "example", F.row_number().over(case).alias("at"), "line", substituted(F.col("template"), F.col("values")).alias("text"))

    commented = F.coalesce("content", F.lit("")).rlike(r"(?im)^\s*#\s*Feature\s*:")
    lost = files.join(feature.select("path"), "path", "left_anti").select("path", F.lit(None).cast("int").alias("line"), F.when(commented, "commented_feature").otherwise("no_feature").alias("kind"))
    shaped = F.col("template").startswith('"') | F.col("template").rlike(r"^[A-Z][A-Z0-9_-]*\s+to\b") | F.col("template").rlike(r'(?i)^I\s+[A-Z][A-Z-]*\s+(?:object\s+)?(?:"[^"]+"|[A-Z][A-Z0-9_-]*)$')
    background = steps.join(heads.where("kind = 'background'").select("path", "section"), ["path", "section"]).where(shaped).select("path", "line", F.lit("background_request").alias("kind"))
    return cases, out, lost.unionByName(background)
