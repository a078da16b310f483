"""Facts of source files by regular expressions over lines: all built-in functions.

``files`` are (path, language, content). A line is exploded with its number, so a fact's line is
known without a search for its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.names import evidence
from factloom.operators.windows import nearest_before

#: How sure a kind of relation is when a pattern finds it.
CONFIDENCE = {
    "php": {"INHERITS": 0.95, "IMPLEMENTS": 0.95, "IMPORTS": 0.9, "USES": 0.75, "STATIC_CALLS": 0.65},
    "java": {"INHERITS": 0.95, "IMPLEMENTS": 0.95, "IMPORTS": 0.9, "CALLS": 0.6},
    "javascript": {"IMPORTS": 0.65, "CALLS": 0.55},
    "xml": {"REFERENCES": 0.55},
}
#: Patterns of relations: the first group is the target.
RELATIONS = {
    "php": {
        "INHERITS": r"\bclass\s+\w+\s+extends\s+([\w\\]+)",
        "IMPLEMENTS": r"\bclass\s+\w+[^{]*?\bimplements\s+([\w\\]+)",
        "IMPORTS": r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]",
        "USES": r"^\s*use\s+([\w\\]+)",
        "STATIC_CALLS": r"\b([A-Z]\w*)::\w+\s*\(",
    },
    "java": {
        "INHERITS": r"\bclass\s+\w+\s+extends\s+([\w.]+)",
        "IMPLEMENTS": r"\bclass\s+\w+[^{]*?\bimplements\s+([\w.]+)",
        "IMPORTS": r"^\s*import\s+(?:static\s+)?([\w.]+)",
        "CALLS": r"\b([A-Za-z_]\w*)\s*\.\s*\w+\s*\(",
    },
    "javascript": {
        "IMPORTS": r"\b(?:from|require\()\s*['\"]([^'\"]+)['\"]",
        "CALLS": r"\b([A-Za-z_$][\w$]*)\s*\(",
    },
    "xml": {"REFERENCES": r"\b(?:ref|href|src|class)\s*=\s*\"([^\"]+)\""},
}
#: Patterns of symbols: the first group is the name.
SYMBOLS = {
    "php": {"class": r"^\s*(?:abstract\s+|final\s+)*class\s+(\w+)", "interface": r"^\s*interface\s+(\w+)", "function": r"\bfunction\s+&?(\w+)\s*\("},
    "java": {"class": r"\bclass\s+(\w+)", "interface": r"\binterface\s+(\w+)", "enum": r"\benum\s+(\w+)"},
    "javascript": {"class": r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)", "function": r"^(?:export\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"},
    "sql": {
        "table": r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:global\s+temporary\s+|temporary\s+|temp\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)",
        "view": r"(?i)\bcreate\s+(?:or\s+replace\s+)?view\s+([\w.\"`]+)",
        "procedure": r"(?i)\bcreate\s+(?:or\s+replace\s+)?procedure\s+([\w.\"`]+)",
    },
    "xslt": {"template": r"<xsl:template\b[^>]*\bname=\"([^\"]+)\"", "match": r"<xsl:template\b[^>]*\bmatch=\"([^\"]+)\""},
}


def lines(files: DataFrame) -> DataFrame:
    """(path, language, line, text), lines from 1."""
    return files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("_at", "text")).select("path", "language", (F.col("_at") + 1).alias("line"), "text")


def _with(kind: Column):
    return lambda name: F.struct(kind, name.alias("name"))


def _matches(table: dict[str, dict[str, str]]) -> Column:
    """For a line of a language: (kind, name) of every match of its patterns."""
    out = F.array().cast("array<struct<kind:string,name:string>>")
    for lang, kinds in table.items():
        named = [(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(1))) for k, p in kinds.items()]
        found = F.flatten(F.array(*[F.transform(names, _with(kind)) for kind, names in named]))
        out = F.when(F.col("language") == lang, found).otherwise(out)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """(path, language, kind, name, line, evidence) of declarations."""
    return lines(files).select("path", "language", "line", evidence(F.trim("text")).alias("evidence"), F.explode(_matches(SYMBOLS)).alias("m")).select(
        "path", "language", "m.kind", "m.name", "line", "evidence")


def relations(files: DataFrame) -> DataFrame:
    """(path, language, source_name, relation, target_name, confidence, line, evidence).

    The source of a relation is the last class or interface declared at or above its line, else null.
    A relation that a line states twice comes once.
    """
    found = lines(files).select("path", "language", "line", evidence(F.trim("text")).alias("evidence"), F.explode(F.array_distinct(_matches(RELATIONS))).alias("m"))
    found = found.select("path", "language", "line", "evidence", F.col("m.kind").alias("relation"), F.col("m.name").alias("target_name"))
    owners = symbols(files).where(F.col("kind").isin("class", "interface")).select("path", "line", "name")
    out = nearest_before(found, owners, "path", "line", "name", "source_name")
    sure = F.create_map(*[F.lit(x) for lang, kinds in CONFIDENCE.items() for k, v in kinds.items() for x in (f"{lang}/{k}", v)])
    return out.withColumn("confidence", F.try_element_at(sure, F.concat_ws("/", "language", "relation")))


def queries(files: DataFrame) -> DataFrame:
    """(path, table_name) named after from and join in SQL text, lower-cased, once each."""
    found = F.regexp_extract_all("content", F.lit(r"(?i)\b(?:from|join)\s+([A-Za-z_][\w.]*)"), F.lit(1))
    return files.select("path", F.explode(F.array_distinct(F.transform(found, F.lower))).alias("table_name"))


def html_links(pages: DataFrame, page_id: str = "page_id") -> DataFrame:
    """(page_id, ordinal, href, label) of plain links, in order."""
    pattern = r'<a href="([^"]*)">([^<]*)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("label"))
    return pages.select(page_id, F.posexplode(pairs).alias("ordinal", "p")).select(page_id, F.col("ordinal").cast("long").alias("ordinal"), "p.href", "p.label")


def html_title(html: str = "html") -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)), F.lit(""))


def relation_class(target: str = "target_name", relation: str = "relation") -> Column:
    """builtin, external, local or empty by the form of a target's name."""
    name = F.trim(F.coalesce(F.col(target), F.lit("")))
    return (
        F.when(name == "", "empty")
        .when(name.rlike(r"^(?:java|javax|php|std)\b") | F.lower(name).isin("array", "string", "int", "bool", "object", "console", "math", "json"), "builtin")
        .when((F.col(relation) == "IMPORTS") & ~name.startswith("."), "external")
        .otherwise("local")
    )
