"""Tables in hash buckets whose generations share the buckets that did not change."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.scratch import written
from factloom.sources.writers import latest, promote


def row_hash(columns: list[str]) -> Column:
    """sha1 of the canonical JSON of ``columns``, nulls told."""
    return F.sha1(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


class Table:
    """A table under ``root`` with a unique ``key``, in ``buckets`` by hash of the key.

    ``files/made=G/bucket=B`` holds rows; the manifest of a generation (``manifests/G``) says for each
    bucket which generation wrote it, with its rows and a digest, the order-free sum of its row hashes. A
    generation becomes the active one by :func:`factloom.sources.writers.promote`.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64):
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, generation: str) -> DataFrame:
        """Writes rows (with bucket) and returns the manifest lines of their buckets."""
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/files/made={generation}")
        columns = [c for c in rows.columns if c != "bucket"]
        back = self.spark.read.schema(rows.schema).parquet(f"{self.root}/files/made={generation}")
        h = row_hash(columns)
        parts = [F.sum(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
        return back.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *parts).alias("digest")).withColumn("made", F.lit(generation))

    def _manifest(self, lines: DataFrame, generation: str) -> None:
        lines.select("bucket", "made", "rows", "digest").coalesce(1).write.parquet(f"{self.root}/manifests/{generation}")

    def manifest(self, generation: str | None = None) -> DataFrame:
        """(bucket, made, rows, digest) of a generation, the active one if none is named: a line for each bucket with rows."""
        generation = generation or latest(self.spark, self.root)
        if generation is None:
            raise ValueError(f"{self.root} has no active generation")
        return self.spark.read.parquet(f"{self.root}/manifests/{generation}")

    def create(self, rows: DataFrame) -> str:
        """A first generation with all ``rows``, promoted."""
        generation = uuid.uuid4().hex
        twice = rows.groupBy(self.key).count().where(F.col("count") > 1).limit(3).collect()
        if twice:
            raise ValueError(f"keys that come twice: {', '.join(str(r[0]) for r in twice)}")
        rows.limit(0).write.parquet(f"{self.root}/shape")
        self._manifest(self._write(rows.withColumn("bucket", self._bucket(self.key)), generation), generation)
        promote(self.spark, self.root, generation, None)
        return generation

    def read(self, generation: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a generation; of ``buckets`` alone, if given. Only the folders that the manifest names are read.

        The manifest is no longer than the number of buckets, and it is read by the driver.
        """
        lines = self.manifest(generation)
        lines = lines if buckets is None else lines.where(F.col("bucket").isin(buckets))
        places = [f"{self.root}/files/made={r['made']}/bucket={r['bucket']}" for r in lines.collect()]
        if not places:
            return self.spark.read.parquet(f"{self.root}/shape")
        return self.spark.read.option("basePath", f"{self.root}/files").parquet(*places).drop("made", "bucket")

    def apply(self, changes: DataFrame, in_scope: Column | None = None) -> dict:
        """A new generation by ``changes`` (change, old_key, new_key, old_hash, new_hash, and the row's other columns), promoted.

        added and modified put the row in under new_key, deleted takes old_key's out, renamed is a deletion and
        an insertion; a key may be left by one change and taken by another. A null hash is not checked; else old_hash must be the :func:`row_hash` of the
        row that is there, new_hash that of the row that comes. Keys outside ``in_scope`` (over ``key``) are
        left alone: a row modified out of it is deleted. A deletion needs its row; a key that two changes put
        in, or take out, is refused. Any of these problems raises ValueError, and the active generation stays.

        Only buckets that hold a changed key are read and written; all others are referred to.
        Returns the generation, the buckets written, and the keys put in and taken out.
        """
        parent = latest(self.spark, self.root)
        old_manifest = self.manifest(parent)
        changes = written(changes, "changes")  # looked at many times
        columns = [c for c in changes.columns if c not in ("change", "old_key", "new_key", "old_hash", "new_hash")]
        scope = F.lit(True) if in_scope is None else in_scope
        keyed = lambda c: changes.where(F.col(c).isNotNull()).withColumn("key", F.col(c)).where(scope)
        comes, goes = keyed("new_key"), keyed("old_key")
        unknown = changes.where(~F.col("change").isin("added", "modified", "deleted", "renamed") | F.col("change").isNull()).limit(1).collect()
        if unknown:
            raise ValueError(f"unsupported change: {unknown[0]['change']}")
        kept = ["key", "old_hash", "new_hash", *columns]
        put = comes.where(F.col("change").isin("added", "renamed")).withColumn("old_hash", F.lit(None).cast("string")).select(*kept)
        put = put.unionByName(comes.where("change = 'modified'").select(*kept))
        left = changes.where("change = 'modified'").withColumn("key", F.col("new_key")).withColumn("_in", F.coalesce(scope, F.lit(False))).where("not _in or new_key is null").drop("key")
        out = goes.where(F.col("change").isin("deleted", "renamed")).select("key", "old_hash")
        out = out.unionByName(left.where(F.col("old_key").isNotNull()).withColumn("key", F.col("old_key")).where(scope).select("key", "old_hash"))
        moves = put.withColumn("comes", F.lit(True)).unionByName(out.withColumn("comes", F.lit(False)), allowMissingColumns=True)
        moves = moves.withColumn("bucket", self._bucket("key"))
        touched = sorted(r["bucket"] for r in moves.select("bucket").distinct().collect())
        if not touched:
            return {"generation": parent, "buckets": [], "put": 0, "out": 0}
        own = self.read(parent, touched)
        data = [c for c in own.columns if c != self.key]
        there = own.select(F.col(self.key).alias("key"), row_hash(own.columns).alias("hash"))
        new_row = moves.select(F.col("key").alias(self.key), *data, "key", "old_hash", "new_hash", "comes", "bucket")
        met = new_row.withColumn("own_hash", F.when(F.col("comes"), row_hash([self.key, *data]))).join(there, "key", "left")
        told = met.select("key", F.explode(F.filter(F.array(
            F.when(~F.col("comes") & F.col("hash").isNull(), "is not there"),
            F.when(F.col("hash").isNotNull() & F.col("old_hash").isNotNull() & (F.col("hash") != F.col("old_hash")), "has another hash than expected"),
            F.when(F.col("comes") & F.col("new_hash").isNotNull() & (F.col("own_hash") != F.col("new_hash")), "comes with another hash than stated")), lambda x: x.isNotNull())).alias("problem"))
        twice = moves.groupBy("key", "comes").count().where(F.col("count") > 1).select("key", F.lit("changes twice").alias("problem"))
        problems = told.unionByName(twice).orderBy("key", "problem").limit(3).collect()
        if problems:
            raise ValueError("; ".join(f"{r['key']} {r['problem']}" for r in problems))
        generation = uuid.uuid4().hex
        stays = own.join(moves.select(F.col("key").alias(self.key)), self.key, "left_anti").withColumn("bucket", self._bucket(self.key))
        arrives = new_row.where("comes").select(*own.columns, "bucket")
        lines = self._write(stays.select(*own.columns, "bucket").unionByName(arrives), generation)
        same = old_manifest.where(~F.col("bucket").isin(touched))
        self._manifest(same.select("bucket", "made", "rows", "digest").unionByName(lines.select("bucket", "made", "rows", "digest")), generation)
        promote(self.spark, self.root, generation, parent)
        return {"generation": generation, "buckets": touched, "put": arrives.count(), "out": out.count()}

    def changed_buckets(self, old: str, new: str) -> list[int]:
        """Buckets whose digests differ between two generations."""
        a, b = (self.manifest(g).select("bucket", F.col("digest").alias(n), F.col("rows").alias(f"{n}_rows")) for g, n in ((old, "a"), (new, "b")))
        both = a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b")) | ~F.col("a_rows").eqNullSafe(F.col("b_rows")))
        return sorted(r["bucket"] for r in both.select("bucket").collect())

    def diff(self, old: str, new: str) -> DataFrame:
        """(key, change): keys added, deleted and modified from ``old`` to ``new``, read from the differing buckets alone."""
        buckets = self.changed_buckets(old, new)
        a, b = (self.read(g, buckets) for g in (old, new))
        a, b = a.select(self.key, row_hash(a.columns).alias("_a")), b.select(self.key, row_hash(b.columns).alias("_b"))
        kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").otherwise("modified")
        return a.join(b, self.key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(self.key, kind.alias("change"))
