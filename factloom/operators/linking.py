"""Links between evidence of different kinds, and what follows when evidence changes or goes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.closure import settled


def endpoint_matches(requests: DataFrame, endpoints: DataFrame, compatible: DataFrame) -> DataFrame:
    """Requests (request_id, method, path, version) with endpoints (endpoint_id, method, path, version).

    A match has the method and path and either the version (``exact``) or a pair of ``compatible``
    (version, other) (``compatible``); an exact match hides the others of its request. Two equi-joins.
    """
    e = endpoints.select("endpoint_id", "method", "path", F.col("version").alias("other"))
    exact = requests.join(e.withColumnRenamed("other", "version"), ["method", "path", "version"]).select("request_id", "endpoint_id", F.lit("exact").alias("match")).distinct()
    near = requests.join(compatible, "version").join(e, ["method", "path", "other"]).select("request_id", "endpoint_id", F.lit("compatible").alias("match"))
    near = near.join(exact.select("request_id"), "request_id", "left_anti").distinct()
    return exact.unionByName(near)


def only_match(matches: DataFrame, by: str, target: str) -> DataFrame:
    """Keys with exactly one target; others fail closed and are left out."""
    return matches.groupBy(by).agg(F.countDistinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")


def prefix_links(entries: DataFrame, files: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Entries joined to files whose base name starts with the entry's name and a dot.

    Every prefix of a file name that ends before a dot is a key, so the join is an equi-join.
    """
    base = F.element_at(F.split(path, "/"), -1)
    parts = F.split(base, "[.]")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    keyed = files.where(F.contains(base, F.lit("."))).select(path, F.explode(keys).alias(name))
    return entries.join(keyed, name)


def ref_targets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References (source_path, ref) to files (path): same file, relative, or from the root.

    ``target`` is the file's path, by exact name and else by the only one equal in lower case;
    ``kind`` is local, external (never resolved), resolved or missing.
    """
    file = F.regexp_replace("ref", "#.*$", "")
    folder = F.regexp_replace("source_path", "[^/]+$", "")
    joined = settled(F.when(file.startswith("/"), file).otherwise(F.concat(folder, file)))
    wanted = refs.withColumn("_file", file).withColumn("_path", joined)
    low = files.groupBy(F.lower("path").alias("_low")).agg(F.countDistinct("path").alias("_k"), F.min("path").alias("_other")).where("_k = 1")
    out = wanted.join(files.select(F.col("path").alias("_path"), F.col("path").alias("_exact")).distinct(), "_path", "left").join(low, F.lower("_path") == F.col("_low"), "left")
    external = F.col("_file").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    target = F.when(external, None).when(F.col("_file") == "", F.col("source_path")).otherwise(F.coalesce("_exact", "_other"))
    kind = F.when(external, "external").when(F.col("_file") == "", "local").when(F.coalesce("_exact", "_other").isNotNull(), "resolved").otherwise("missing")
    return out.select(*refs.columns, target.alias("target"), kind.alias("kind"))


def touched_files(relations: DataFrame, direct: DataFrame, changed_symbols: DataFrame) -> DataFrame:
    """Files whose relations must be extracted again: changed ones and those that touch a changed symbol.

    ``relations`` (path, source_id, target_id, target_name), ``direct`` (path), ``changed_symbols`` (id, name).
    """
    ids, names = changed_symbols.select("id").where("id is not null"), changed_symbols.select("name").where("name is not null")
    parts = [
        direct.select("path"),
        relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("path"),
        relations.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("path"),
        relations.join(names.withColumnRenamed("name", "target_name"), "target_name", "left_semi").select("path"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def agreeing(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key; raises if two rows of a key disagree."""
    distinct = facts.distinct()
    bad = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"facts disagree: {[tuple(r)[:-1] for r in bad]}")
    return distinct


def without_repository(tables: dict[str, DataFrame], links: DataFrame, repo: str) -> dict[str, DataFrame]:
    """Tables (repo, ...) without a repository; raises if a link (repo, target_repo) of another points to it."""
    inbound = links.where((F.col("target_repo") == repo) & (F.col("repo") != repo))
    if (first := inbound.first()) is not None:
        raise ValueError(f"{first['repo']} still refers to {repo}")
    return {name: df.where(F.col("repo") != repo) for name, df in tables.items()}


def companions(files: DataFrame, path: str = "path") -> DataFrame:
    """(folder, stem, n_files): the commonest first part of file names in each folder, ties by name."""
    base = F.element_at(F.split(path, "/"), -1)
    rows = files.select(F.regexp_replace(path, "/?[^/]+$", "").alias("folder"), F.get(F.split(base, "[.]"), F.lit(0)).alias("stem"))
    counts = rows.groupBy("folder", "stem").agg(F.count(F.lit(1)).alias("n_files"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("n_files"), "stem"))).where("_r = 1").drop("_r")


def candidate_lists(facts: DataFrame, fact_id: str, names: str, modules: str, index: DataFrame, target: str) -> DataFrame:
    """The first (module, name) of a fact's two ordered lists with exactly one target: (fact_id, target).

    ``index`` has (module, name, target); modules count before names.
    """
    tried = facts.select(fact_id, F.posexplode(modules).alias("_m", "module"), F.col(names).alias("_names")).select(fact_id, "_m", "module", F.posexplode("_names").alias("_n", "name"))
    found = index.groupBy("module", "name").agg(F.countDistinct(target).alias("_k"), F.min(target).alias(target)).where("_k = 1")
    return tried.join(found, ["module", "name"]).groupBy(fact_id).agg(F.min_by(target, F.struct("_m", "_n")).alias(target))
