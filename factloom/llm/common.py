"""What several operators share: column expressions, written tables and running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A token is a run of anything but space, tab, line feed, vertical tab, form feed and return.
TOKEN = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    A local session that names none gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-factloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The path is added to ``paths``, for :func:`removed` once no plan reads it any more.
    """
    path = new_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more, paths and "table " with a name."""
    for path in paths:
        if path.startswith("table "):
            spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix('table ')}")
            continue
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have yet, case aside."""
    taken = {c.lower() for c in df.columns}
    while any(f"_{n}".lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return [f"_{n}" for n in names]


def quoted(df: DataFrame) -> list[str]:
    """The columns of ``df``, also those with dots in their names."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


def crc_of_id(doc_id: str | Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit("")).cast("binary"))


def id_remainder(doc_id: str, mod: int) -> Column:
    return crc_of_id(F.col(doc_id).cast("string")) % mod


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def n_tokens(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(TOKEN)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_start(df: DataFrame, order: list[str], size: str, start: str) -> DataFrame:
    """``df`` with ``start``: the sum of ``size`` over all rows before, in the total order ``order``.

    Rows are range-partitioned, summed within each partition, and moved by the totals of earlier
    partitions; only one total per partition is brought together. ``df`` should be narrow.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    ranged = saved(ranged, "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("_part").agg(F.sum(size).alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(F.broadcast(totals), "_part")
        .withColumn(start, (F.col("_base") + F.col("_inside")).cast("long"))
        .drop("_part", "_base", "_inside")
    )
