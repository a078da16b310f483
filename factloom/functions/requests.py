"""Column expressions over requests in test steps and over the cases that make them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The HTTP method of each verb in a step.
METHODS = {"create": "POST", "delete": "DELETE", "patch": "PATCH", "post": "POST", "put": "PUT", "read": "GET", "update": "PATCH"}


def method(verb: Column) -> Column:
    """The HTTP method that a verb stands for; null for other words."""
    return F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[F.lower(verb)]


def eligibility(tags: Column) -> Column:
    """known_issue, ci_only or active, by the tags of a case in any case of letters."""
    lower = F.transform(tags, F.lower)
    return F.when(F.array_contains(lower, "@knownissue"), "known_issue").when(F.array_contains(lower, "@ci_only"), "ci_only").otherwise("active")


def workflow_action(kind: Column, path: Column) -> Column:
    """The last segment of a workflow's route of exactly four; null for all other requests."""
    return F.when(kind == "workflow", F.nullif(F.regexp_extract(path, "^/workflows/[^/]+/[^/]+/([^/]+)$", 1), F.lit("")))


def coverage(cases: Column) -> tuple[Column, Column, Column, Column]:
    """Counts of active, ci_only and known_issue cases of a group, and the level of coverage they give."""
    active, ci, known = (F.count_if(cases == x) for x in ("active", "ci_only", "known_issue"))
    level = F.when(active > 0, "active").when(ci > 0, "ci_conditional").when(known > 0, "known_issue_only").otherwise("uncovered")
    return active, ci, known, level


#: How a step names a request, its version, key, parent, action and the status it expects.
QUOTED_REQUEST = r'(?i)"(GET|POST|PUT|PATCH|DELETE)"\s+to\s+(?:child\s+)?"([^"]+)"'
SPOKEN_REQUEST = r'(?i)\bI\s+(read|create|update|delete|patch|post|put)\s+(?:object)?\s*"([^"]+)"'
STEP_VERSION = r'(?i)\bfor\s+version\s+"([^"]+)"'
STEP_KEY = r'(?i)\bwith\s+key\s+"([^"]*)"'
STEP_PARENT = r'(?i)\bfor\s+parent\s+"([^"]+)"\s+with\s+key\s+"([^"]*)"'
STEP_ACTION = r'(?i)\b(?:action|workflow)\s+"([^"]+)"'
STEP_STATUS = r"""(?i)\b(?:status(?:\s+code)?|response\s+code)(?:\s+is)?\s*["']?(\d{3})"""
#: Words that stand for any object.
GENERIC = ("query", "model")


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def step_method(text: Column) -> Column:
    """The HTTP method of a step that is a request; null for other steps."""
    return F.coalesce(F.upper(_part(text, QUOTED_REQUEST)), method(_part(text, SPOKEN_REQUEST)))


def step_token(text: Column) -> Column:
    return F.when(text.rlike(QUOTED_REQUEST), _part(text, QUOTED_REQUEST, 2)).otherwise(_part(text, SPOKEN_REQUEST, 2))


def step_version(text: Column) -> Column:
    return _part(text, STEP_VERSION)


def step_status(text: Column) -> Column:
    return _part(text, STEP_STATUS).cast("int")


def step_key(text: Column) -> Column:
    """The first key of a step, null if it is empty."""
    return _part(text, STEP_KEY)


def step_parent(text: Column) -> Column:
    """The parent's alias, out of double braces if it stands in them."""
    alias = F.trim(_part(text, STEP_PARENT))
    return F.when(alias.startswith("{{") & alias.endswith("}}"), F.trim(F.regexp_extract(alias, r"(?s)^\{\{(.*)\}\}$", 1))).otherwise(alias)


def step_parent_key(text: Column) -> Column:
    return _part(text, STEP_PARENT, 2)


def step_action(text: Column) -> Column:
    return _part(text, STEP_ACTION)


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def canonical_path(path: Column) -> Column:
    """One slash before each segment, none at the end, the service version before the route left out."""
    whole = F.concat(F.lit("/"), _bare(F.trim(path)))
    plain = F.regexp_replace(F.regexp_replace(whole, r"(?i)^/services/(?:v[^/]+|s\d+)(?=/)", ""), "//+", "/")
    return F.coalesce(F.nullif(F.regexp_replace(plain, "/+$", ""), F.lit("")), F.lit("/"))


def route(token: Column, target: Column, parent: Column, parent_target: Column, parent_key: Column, key: Column, action: Column) -> Column:
    """A request's path, operation (collection, item, child, workflow, unknown) and problem, as a struct.

    ``target`` is what the token's alias stands for, a route if it begins with a slash.
    """
    base = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/objects/"), _bare(target)))
    child = F.concat(F.lit("/objects/"), _bare(parent_target), F.when(parent_key.isNotNull(), F.lit("/{key}/")).otherwise(F.lit("/")), _bare(target))
    plain = F.when(target.contains("workflow") | action.isNotNull(), "workflow").when(key.isNotNull(), "item").otherwise("collection")
    path = F.when(parent.isNotNull(), child).when(plain == "item", F.concat(base, F.lit("/{key}"))).otherwise(base)
    path = F.when(action.isNotNull(), F.concat(path, F.lit("/"), _bare(action))).otherwise(path)
    lost = F.when(token.isNull(), "unresolved_object").when(token.isin(*GENERIC), "generic_request").when(target.isNull(), "unresolved_object").when(parent.isNotNull() & parent_target.isNull(), "unresolved_parent")
    operation = F.when(lost == "unresolved_parent", "child").when(lost.isNotNull(), "unknown").when(action.isNotNull(), "workflow").when(parent.isNotNull(), "child").otherwise(plain)
    return F.struct(F.when(lost.isNull(), canonical_path(path)).alias("path"), operation.alias("operation"), lost.alias("problem"))
