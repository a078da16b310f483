"""Sinks: writes by natural key, generations behind a pointer, diagnostics."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_or_ignore(target: DataFrame, rows: DataFrame, key: list[str], null_distinct: bool = True) -> DataFrame:
    """``target`` and the rows whose key it lacks, the first by all columns of each key.

    With ``null_distinct`` a key that holds a null equals no other, as in SQL unique constraints.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    same: Column = F.lit(True)
    for k in key:
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}"))
    keyed = rows.where(whole) if null_distinct else rows
    order = [F.col(c) for c in rows.columns]
    once = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
    new = once.alias("n").join(target.select(*key).alias("t"), same, "left_anti")
    out = target.unionByName(new.select(*target.columns))
    return out.unionByName(rows.where(~whole).select(*target.columns)) if null_distinct else out


def upsert(target: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``target`` replaced by the last of ``rows`` with their key, and the new ones."""
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").select(*target.columns)
    return target.join(last.select(*key), key, "left_anti").unionByName(last)


def write_diagnostics(rows: DataFrame, path: str) -> None:
    """Diagnostics with a key of their content, appended as JSON lines."""
    rows.withColumn("diagnostic_key", F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)).write.mode("append").json(path)


def write_generation(tables: dict[str, DataFrame], root: str) -> str:
    """Tables as Parquet under a new generation folder; readers still see the one before."""
    generation = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/generations/{generation}/{name}")
    return generation


def promote(spark: SparkSession, root: str, generation: str, parent: str | None, checks: DataFrame | None = None) -> None:
    """Makes a generation the active one if ``checks`` (n_bad) are all zero and ``parent`` is still active.

    Promotions are numbered files that hold the generation's name. One is written beside them and then
    renamed to its number, which fails where that is taken: of two promotions at once one fails, and a
    driver that dies before the rename leaves nothing that counts. A rename must be atomic and not replace a
    file, as on HDFS; object stores without such a rename, and several drivers on one local folder, are not supported.
    """
    if checks is not None and (bad := checks.where("n_bad > 0").collect()):
        raise ValueError("checks failed: " + ", ".join(f"{r['check_name']} {r['n_bad']}" for r in bad))
    now, number = _latest(spark, root)
    if now != parent:
        raise ValueError(f"the active generation is {now}, not {parent}")
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    draft, place = hadoop.Path(f"{root}/drafts/{uuid.uuid4().hex}"), hadoop.Path(f"{root}/promotions/{number + 1:012d}")
    files = draft.getFileSystem(conf)
    out = files.create(draft, False)
    out.write(bytearray(generation.encode()))
    out.close()
    files.mkdirs(place.getParent())
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(draft), files.makeQualified(place), none)
    except Py4JJavaError as error:
        files.delete(draft, False)
        raise ValueError(f"promotion {number + 1} is another's") from error


def _latest(spark: SparkSession, root: str) -> tuple[str | None, int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/promotions")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in files.listStatus(path)) if files.exists(path) else []
    if not names:
        return None, 0
    source = files.open(spark._jvm.org.apache.hadoop.fs.Path(path, names[-1]))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"), int(names[-1])
    finally:
        source.close()


def latest(spark: SparkSession, root: str) -> str | None:
    """The active generation; None before the first promotion."""
    return _latest(spark, root)[0]


def active(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the active generation: an immutable snapshot for as long as it is read."""
    generation, _ = _latest(spark, root)
    if generation is None:
        raise ValueError(f"{root} has no active generation")
    return spark.read.parquet(f"{root}/generations/{generation}/{table}")
