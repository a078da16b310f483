"""Column expressions for names, paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    """Lower case, only a-z and 0-9 kept."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def acronym(c: Column, sep: str = "-") -> Column:
    """First letters of the parts."""
    return F.array_join(F.transform(F.split(c, sep), lambda x: F.substring(x, 1, 1)), "")


def camel_to_kebab(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1-$2"), "([a-z0-9])([A-Z])", "$1-$2"))


def pascal_to_snake(c: Column) -> Column:
    return F.regexp_replace(camel_to_kebab(c), "-", "_")


def slug_to_pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "[-_ ]"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), "")


def variants(c: Column, sep: str = "-") -> Column:
    """The name, it without a plural s, and every tail of its parts; distinct, in that order."""
    parts = F.split(c, sep)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), sep))
    return F.array_distinct(F.concat(F.array(c, F.regexp_replace(c, "s$", "")), tails))


def canonical_path(c: Column, prefix: str = r"^https?://[^/]+") -> Column:
    """Without service prefix, query and fragment; slashes collapsed, none at the end, one at the start."""
    path = F.regexp_replace(F.regexp_replace(c, prefix, ""), "[?#].*$", "")
    path = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", ""))


def path_segment(c: Column, i: int) -> Column:
    """The i-th segment of a canonical path, from 1; null if it has fewer."""
    return F.nullif(F.get(F.split(c, "/"), F.lit(i)), F.lit(""))


def operation_key(c: Column, sep: str = "/") -> Column:
    """module, route, entity and action of a key with three parts at least; null for a shorter one.

    Four parts and more have a route: all between the module and the last two.
    """
    p = F.transform(F.split(c, sep), lambda x: F.trim(x))
    n = F.size(p)
    struct = F.struct(
        F.get(p, F.lit(0)).alias("module"),
        F.when(n > 3, F.array_join(F.slice(p, F.lit(2), n - 3), sep)).alias("route"),
        F.get(p, n - 2).alias("entity"),
        F.get(p, n - 1).alias("action"),
    )
    return F.when(n >= 3, struct)


def to_bool(c: Column) -> Column:
    """True for true, t, yes, y, 1; false for false, f, no, n, 0; else null."""
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "t", "yes", "y", "1"), True).when(low.isin("false", "f", "no", "n", "0"), False)


def to_text(c: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def to_int(c: Column) -> Column:
    """Whole numbers with an optional minus sign; else null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("long"))


def json_pointer(parts: Column) -> Column:
    """RFC 6901 pointer of an array of keys."""
    return F.array_join(F.transform(parts, lambda x: F.concat(F.lit("/"), F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))), "")


def evidence(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)


def stable_key(*cols: str) -> Column:
    """A content key that no surrogate id enters; null and empty differ."""
    return F.sha1(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).cast("binary"))


def repository_identity(url: Column) -> Column:
    """host/path of a Git remote in URL or scp form: the host in lower case, the path as it is written.

    User, port, query and fragment are left out, slashes count once, a last .git goes. Null for what is
    neither form or has no path.
    """
    text = F.trim(url)
    schemed, scp = text.contains("://"), r"^(?:[^@]+@)?([^:]+):(.+)$"
    host = F.when(schemed, F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#@]+)", 1)).otherwise(F.regexp_extract(text, scp, 1))
    path = F.when(schemed, F.regexp_extract(text, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)).otherwise(F.regexp_extract(text, scp, 2))
    plain = F.regexp_replace(F.regexp_replace(F.array_join(F.filter(F.split(path, "/"), lambda x: x != ""), "/"), r"\.git$", ""), "/$", "")
    return F.when((host != "") & (plain != ""), F.concat(F.lower(host), F.lit("/"), plain))


#: File suffixes and the language each stands for.
LANGUAGES = {
    "php": "php", "inc": "php", "java": "java", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript",
    "sql": "sql", "xml": "xml", "xsl": "xslt", "xslt": "xslt", "yaml": "yaml", "yml": "yaml", "json": "json", "html": "html",
    "css": "css", "py": "python", "sh": "shell", "md": "markdown", "csv": "csv", "feature": "gherkin", "properties": "properties",
}


def language(path: Column) -> Column:
    """Language by suffix, ``unknown`` for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(table, suffix), F.lit("unknown"))
