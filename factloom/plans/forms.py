"""Forms of names, pointers and remotes, and facts that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import linking
from factloom.plans.registry import Tables, query


@query(r"""WITH p AS (SELECT p_partkey, array_to_string(list_transform(string_split_regex(p_name, '[-_ ]'), lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM part),
k AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(pascal, '([A-Z]+)([A-Z][a-z])', '\1-\2', 'g'), '([a-z0-9])([A-Z])', '\1-\2', 'g')) AS kebab FROM p)
SELECT p_partkey, kebab, replace(kebab, '-', '_') AS snake FROM k""")
def name_cases(t: Tables) -> DataFrame:
    """Kebab and snake form of each part's Pascal-case name."""
    pascal = names.slug_to_pascal(F.col("p_name"))
    return t.part.select("p_partkey", names.camel_to_kebab(pascal).alias("kebab"), names.pascal_to_snake(pascal).alias("snake"))


@query("SELECT url, '/pages/' || replace(replace(url, '~', '~0'), '/', '~1') AS pointer FROM pages")
def page_pointers(t: Tables) -> DataFrame:
    """The JSON pointer to each page under its address."""
    return t.pages.select("url", names.json_pointer(F.array(F.lit("pages"), "url")).alias("pointer"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') AS plain FROM p)
SELECT page_id, CASE WHEN page_id % 5 < 4 AND plain <> '' THEN lower(host) || '/' || plain END AS identity FROM c""")
def remote_identity(t: Tables) -> DataFrame:
    """Each page's address as a Git remote in one of the forms there are."""
    host, path = F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    form = F.pmod("page_id", F.lit(5))
    remote = (
        F.when(form == 0, F.concat(F.lit("https://"), F.upper(host), path, F.lit(".git?x=1#top"))).when(form == 1, F.concat(F.lit(" ssh://git@"), host, F.lit(":22/"), path, F.lit("/")))
        .when(form == 2, F.concat(F.lit("git@"), host, F.lit(":"), path, F.lit("//"))).when(form == 3, F.concat(F.upper(host), F.lit(":"), path)).otherwise(F.concat(host, path)))
    return t.pages.select("page_id", names.repository_identity(remote).alias("identity"))


@query("SELECT DISTINCT l_partkey, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def agreeing_facts(t: Tables) -> DataFrame:
    """Brand and type of each ordered part; facts that differ for one part would be an error."""
    ordered = t.lineitem.select("l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return linking.agreeing(ordered.select("l_partkey", "p_brand", "p_type"), ["l_partkey"])


@query("SELECT doc_id, substr(text, 1, 500) AS evidence FROM documents")
def evidence_text(t: Tables) -> DataFrame:
    """What a report shows of each document's text."""
    return t.documents.select("doc_id", names.evidence(F.col("text")).alias("evidence"))
