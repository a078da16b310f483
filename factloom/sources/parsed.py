"""Results of a parser kept by the content that they come from, so that no content is parsed twice."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Parsed:
    """Results under ``root`` by parser version and blob hash.

    ``parser`` turns (blob, content) into rows with the column blob, any number for each. Blobs that
    gave no rows are known too. Versions do not mix: a new one parses all anew.
    """

    def __init__(self, spark: SparkSession, root: str, version: str, parser: Callable[[DataFrame], DataFrame], schema: str):
        self.spark, self.root, self.version, self.parser = spark, f"{root.rstrip('/')}/version={version}", version, parser
        self.schema = f"blob string, {schema}"

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def update(self, files: DataFrame) -> int:
        """Parses the blobs of ``files`` (path, content) that are not known yet, each once; returns how many.

        The known hashes are joined by hash, contents of known blobs are never sent to the parser. The
        rows are written before the blobs are marked known: a run that dies in between parses them again, and
        rows of blobs that are not marked do not count.
        """
        blobs = files.select(F.sha1(F.coalesce("content", F.lit("")).cast("binary")).alias("blob"), F.coalesce("content", F.lit("")).alias("content"))
        new = blobs.join(self._read("known", "blob string, batch string").select("blob"), "blob", "left_anti").groupBy("blob").agg(F.first("content").alias("content"))
        batch = uuid.uuid4().hex
        place = f"{self.root}/inputs/{batch}"
        new.write.parquet(place)  # the same blobs for both steps
        new = self.spark.read.parquet(place)
        names = [x.split()[0] for x in self.schema.split(", ")]
        self.parser(new).select(*names).withColumn("batch", F.lit(batch)).write.parquet(f"{self.root}/rows/{batch}")
        known = new.select("blob", F.lit(batch).alias("batch"))
        known.write.parquet(f"{self.root}/known/{batch}")
        return self.spark.read.parquet(f"{self.root}/known/{batch}").count()

    def rows(self, files: DataFrame) -> DataFrame:
        """The results of ``files``: path and the parser's columns, for each path of a blob, from what is kept."""
        kept = self._read("rows", f"{self.schema}, batch string").join(self._read("known", "blob string, batch string"), ["blob", "batch"], "left_semi").drop("batch")
        return files.select("path", F.sha1(F.coalesce("content", F.lit("")).cast("binary")).alias("blob")).join(kept, "blob")


def relinked(rows: DataFrame, mapping: DataFrame, key: list[str], target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the ``target`` that ``mapping`` (key, target) has for their key, letters' case aside, and the rows without one.

    Links are made at reading, so a mapping that changes relinks all rows and parses none.
    """
    fold = [F.lower(F.col(k)).alias(f"_{k}") for k in key]
    single = mapping.select(*fold, target).groupBy(*[f"_{k}" for k in key]).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target)).where("_n = 1").drop("_n")
    met = rows.select("*", *fold).join(single, [f"_{k}" for k in key], "left").drop(*[f"_{k}" for k in key])
    return met.where(F.col(target).isNotNull()), met.where(F.col(target).isNull()).drop(target)


def _pointer(path: tuple) -> str:
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in path)


def json_leaves(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, pointer, value) of every scalar of a JSON column, with RFC 6901 pointers; text that is no JSON gives no rows.

    One pass over each document with a stack of its own, in the tasks that hold it: no job while the plan is
    made, nothing shared between callers. Values are as they stand in JSON, strings without quotes, null as null.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    stack = [((), json.loads(text))] if text is not None else []
                except ValueError:
                    continue
                while stack:
                    path, value = stack.pop()
                    if isinstance(value, dict):
                        stack += [((*path, k), v) for k, v in value.items()]
                    elif isinstance(value, list):
                        stack += [((*path, i), v) for i, v in enumerate(value)]
                    else:
                        out.append((name, _pointer(path), None if value is None else value if isinstance(value, str) else json.dumps(value)))
            yield pd.DataFrame(out, columns=[key, "pointer", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, col).mapInPandas(walk, f"{key} {kind}, pointer string, value string")


_ENTRY = "release string, path string, pointer string, module string, resource_kind string, resource_path string, revision string, declared_hash string, api_type string, runtime_owner string, source_optional boolean, payload string, problem string"


def registry_entries(files: DataFrame) -> DataFrame:
    """The entries of registry documents (release, path, content): one row for each leaf, and for each fault a row with ``problem``.

    A leaf is an object with revision and hash, both strings; its path is module, kind and
    resource, so it lies at least three deep. Nothing below a leaf is looked at, and only objects are
    entered. A document with a fault gives its faults alone: invalid_registry_json, invalid_registry_document,
    invalid_registry_leaf, missing_registry_resource_identity. Entries of core services with revision ALL
    and hash -1 need no source. ``payload`` is canonical JSON.
    """

    def entries(release: str, path: str, content: str | None) -> list[tuple]:
        fault = lambda pointer, problem: (release, path, pointer, *[None] * 7, None, None, problem)
        try:
            document = json.loads(content or "")
        except ValueError:
            return [fault("", "invalid_registry_json")]
        if not isinstance(document, dict):
            return [fault("", "invalid_registry_document")]
        found, faults, stack = [], [], [((), document)]
        while stack:
            at, node = stack.pop()
            told = [k for k in ("revision", "hash") if k in node]
            if told:
                if len(told) < 2 or not all(isinstance(node[k], str) for k in told):
                    faults.append(fault(_pointer(at), "invalid_registry_leaf"))
                elif len(at) < 3:
                    faults.append(fault(_pointer(at), "missing_registry_resource_identity"))
                else:
                    text = lambda k: node[k] if isinstance(node.get(k), str) else None  # noqa: B023, E731
                    optional = (node["revision"], node["hash"], node.get("type")) == ("ALL", "-1", "coreService")
                    found.append((release, path, _pointer(at), at[0], at[1], "/".join(at[2:]), node["revision"], node["hash"], text("type"), text("runtimeOwner"), optional, json.dumps(node, sort_keys=True, separators=(",", ":")), None))
                continue
            stack += [((*at, k), v) for k, v in node.items() if isinstance(v, dict)]
        return faults or found

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [e for row in zip(batch["release"], batch["path"], batch["content"], strict=True) for e in entries(*row)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _ENTRY.split(", ")])

    return files.select("release", "path", "content").mapInPandas(walk, _ENTRY)


#: The folders whose files are components, what each is, and the kind of entry with a name rule of its own.
COMPONENT_FOLDERS = {"models": "openapi_schema", "paths": "openapi_operations", "history": "openapi_history", "views": "openapi_view"}
SYSTEM_VIEWS = "systemViews"


def registry_components(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(release, pointer, file, kind): the component files (path) of each entry, by the names that its revision stands for.

    A name begins with kind, module, resource and revision, each with a dot, or without the kind; a
    system view of two parts has a name of its own form. Every beginning of a file name that ends with
    a dot is a key, so this is an equi-join.
    """
    dotted = F.replace("resource_path", F.lit("/"), F.lit("."))
    plain = F.array(F.concat_ws(".", "resource_kind", "module", dotted, "revision"), F.concat_ws(".", "module", dotted, "revision"))
    view = F.when(F.size(F.split("resource_path", "/")) == 2, F.array(F.concat_ws(".", F.lit("objects"), "module", dotted, "revision", F.lit("view"))))
    names = F.when(F.col("resource_kind") == SYSTEM_VIEWS, view).otherwise(plain)
    asked = entries.where("problem is null and revision != ''").select("release", "pointer", F.explode(names).alias("name"))
    folder, base = F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)
    kind = F.create_map(*[F.lit(x) for kv in COMPONENT_FOLDERS.items() for x in kv])
    parts = F.split(base, "[.]")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    keyed = files.where(F.contains(base, F.lit(".")) & F.col("path").contains("/")).select("path", F.try_element_at(kind, folder).alias("kind"), F.explode(beginnings).alias("name")).where("kind is not null")
    return asked.join(keyed, "name").select("release", "pointer", F.col("path").alias("file"), "kind").distinct()
