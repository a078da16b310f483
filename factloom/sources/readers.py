"""Readers of files and documents as DataFrames; bad input becomes rows, not failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import language
from factloom.sources.parsed import json_leaves  # noqa: F401

#: Directories that a scan leaves out.
EXCLUDED = (".git", "node_modules", "vendor", "dist", "build", "__pycache__")


def scan_files(spark: SparkSession, root: str, repo: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(repo, path, language, size_bytes, sha1, last_modified, content) of every file under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    path = F.regexp_replace(F.element_at(F.split("path", F.lit(base.replace("\\", "\\\\")), 2), 2), "^/+", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.sha1("content").alias("sha1"), F.col("modificationTime").alias("last_modified"), "content")
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded]))).select(F.lit(repo).alias("repo"), "path", language(F.col("path")).alias("language"), "size_bytes", "sha1", "last_modified", "content")


def with_text(files: DataFrame) -> DataFrame:
    """Content as text; what is not UTF-8 has null."""
    return files.withColumn("content", F.try_to_binary(F.hex("content"), F.lit("hex"))).withColumn("content", F.expr("CASE WHEN is_valid_utf8(content) THEN decode(content, 'UTF-8') END"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema; a line that is not one has nulls and its text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def closed_object(df: DataFrame, col: str, schema: str, keys: list[str]) -> DataFrame:
    """JSON objects with exactly ``keys``: ``value`` parsed, or ``problem`` says what is wrong."""
    found = F.json_object_keys(col)
    problem = (
        F.when(found.isNull(), "not an object")
        .when(F.size(F.array_distinct(found)) < F.size(found), "duplicate key")
        .when(F.size(F.array_except(found, F.array(*[F.lit(k) for k in keys]))) > 0, "unknown key")
        .when(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), found)) > 0, "missing key")
    )
    return df.withColumn("problem", problem).withColumn("value", F.when(F.col("problem").isNull(), F.from_json(col, schema)))


def definition_rows(lines: DataFrame, col: str = "value", fields: int = 6) -> DataFrame:
    """Strict positional CSV: (key, problem); ``;`` lines and blank lines are dropped, others have six fields."""
    rows = lines.where(~F.trim(col).startswith(";") & (F.trim(col) != ""))
    # commas inside quotes do not separate
    parts = F.split(F.col(col), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return rows.select(
        F.when(F.size(parts) == fields, F.trim(F.regexp_replace(F.get(parts, F.lit(0)), '^"|"$', ""))).alias("key"),
        F.when(F.size(parts) != fields, F.concat(F.lit("fields: "), F.size(parts).cast("string"))).alias("problem"))


def properties(lines: DataFrame, allowed: list[str], col: str = "value") -> DataFrame:
    """(name, value) of allowed keys of a properties file; others, secrets among them, are never kept."""
    pattern = r"^\s*([^#!=:\s][^=:\s]*)\s*[=:]\s*(.*?)\s*$"
    return lines.select(F.regexp_extract(col, pattern, 1).alias("name"), F.regexp_extract(col, pattern, 2).alias("value")).where(F.col("name").isin(allowed))


def yaml_documents(files: DataFrame) -> DataFrame:
    """(path, document, json, problem): each YAML document as JSON; a syntax failure is a row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, i, json.dumps(d, default=str), None) for i, d in enumerate(yaml.safe_load_all(content or ""))]
                except yaml.YAMLError as error:
                    out.append((path, 0, None, str(error).split("\n")[0]))
            yield pd.DataFrame(out, columns=["path", "document", "json", "problem"])

    return files.select("path", "content").mapInPandas(parse, "path string, document int, json string, problem string")


def xml_elements(files: DataFrame, tag: str, attributes: list[str]) -> DataFrame:
    """(path, ordinal, one column for each attribute) of the elements ``tag``; unsafe files give no rows.

    A file with a document type declaration is unsafe. For elements with quoted attributes; nesting is not looked at.
    """
    safe = files.where(~F.col("content").rlike("(?i)<!doctype|<!entity"))
    found = safe.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(rf"<{tag}\b([^>]*)>"), F.lit(1))).alias("ordinal", "_a"))
    pick: list[Column] = [F.nullif(F.regexp_extract("_a", rf'\b{a}="([^"]*)"', 1), F.lit("")).alias(a) for a in attributes]
    return found.select("path", "ordinal", *pick)


def scenarios(files: DataFrame) -> DataFrame:
    """(path, scenario, line, keyword, text, version) of the steps of Gherkin features.

    Steps belong to the last scenario above them; ``version`` is the last API version that a step of
    the scenario has named, up to and including the step.
    """
    from pyspark.sql import Window

    rows = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "raw")).select("path", (F.col("at") + 1).alias("line"), F.trim("raw").alias("raw"))
    title = F.regexp_extract("raw", r"^Scenario(?: Outline)?:\s*(.*)$", 1)
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scenario", F.last(F.when(F.col("raw").rlike("^Scenario"), title), ignorenulls=True).over(upto))
    rows = rows.withColumn("number", F.sum(F.col("raw").rlike("^Scenario").cast("int")).over(upto))
    steps = rows.where(F.col("raw").rlike(r"^(Given|When|Then|And|But)\b") & F.col("scenario").isNotNull())
    version = F.nullif(F.regexp_extract("raw", r"\bv(\d+)\b", 1), F.lit(""))
    inside = Window.partitionBy("path", "number").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("path", "scenario", "line", F.regexp_extract("raw", r"^(\w+)", 1).alias("keyword"), F.regexp_extract("raw", r"^\w+\s+(.*)$", 1).alias("text"), F.last(version, ignorenulls=True).over(inside).alias("version"))


def outline_rows(outlines: DataFrame) -> DataFrame:
    """Outlines (path, template, header array, rows array of arrays) to one text for each example row."""
    cells = F.arrays_zip(F.col("header").alias("name"), F.col("row").alias("value"))
    text = F.aggregate(cells, F.col("template"), lambda s, c: F.replace(s, F.concat(F.lit("<"), c["name"], F.lit(">")), c["value"]))
    return outlines.select("path", "template", "header", F.posexplode("rows").alias("example", "row")).select("path", F.col("example").alias("example"), text.alias("text"))
