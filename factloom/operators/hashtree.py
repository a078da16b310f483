"""Digests over ranges of keys, in levels that add up, so that two tables are compared from the top."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Children of a range.
FAN = 16


def _place(key: list[str]):
    return F.md5(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))


def with_range(rows: DataFrame, key: list[str], levels: int) -> DataFrame:
    """``rows`` with the range of their key at the lowest level: the first hex digits of its hash."""
    return rows.withColumn("range", F.substring(_place(key), 1, levels))


def hash_tree(rows: DataFrame, key: list[str], columns: list[str], levels: int = 3, by: list[str] | None = None) -> DataFrame:
    """(by, level, range, n, digest): rows and digest of every range of keys, from one for all (level 0) to 16 ** ``levels``.

    A digest is the sum of the sha256 of each row's canonical JSON, piece by piece, so it does not look at
    order, counts copies, and that of a range is the sum of its children's: levels above are rolled up
    from the lowest, never from rows. With ``by`` (a repository) there is a tree for each value.
    """
    by = by or []
    whole = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    pieces = [F.conv(F.substring(whole, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(8)]
    hashed = with_range(rows, key, levels).select(*by, "range", *pieces)
    add = lambda df, n: [F.sum(n).alias("n"), *[F.sum(f"p{i}").cast("decimal(38,0)").alias(f"p{i}") for i in range(8)]]  # noqa: E731, ARG005
    level = hashed.groupBy(*by, "range").agg(*add(hashed, F.lit(1)))
    every = [level.withColumn("level", F.lit(levels))]
    for depth in range(levels - 1, -1, -1):
        level = level.withColumn("range", F.substring("range", 1, depth)).groupBy(*by, "range").agg(*add(level, "n"))
        every.append(level.withColumn("level", F.lit(depth)))
    digest = F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(8)]), 256)
    return reduce(DataFrame.unionByName, every).select(*by, "level", "range", "n", digest.alias("digest"))


def differing(a: DataFrame, b: DataFrame, levels: int) -> tuple[list[str], int]:
    """The lowest ranges in which two trees differ, and how many ranges were compared on the way down.

    Only children of ranges that differ are looked at. Ranges, not rows, come to the driver: of a few changes
    a few paths.
    """
    open_, compared = [""], 0
    for level in range(levels + 1):
        one, two = (t.where((F.col("level") == level) & F.col("range").isin(open_)).select("range", F.col("digest").alias(n)) for t, n in ((a, "x"), (b, "y")))
        met = one.join(two, "range", "full").select("range", (~F.col("x").eqNullSafe(F.col("y"))).alias("differs")).collect()
        compared += len(met)
        found = sorted(r["range"] for r in met if r["differs"])
        if level == levels or not found:
            return found, compared
        open_ = [f"{r}{d:x}" for r in found for d in range(FAN)]
    return [], compared


def tree_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], levels: int = 3) -> DataFrame:
    """(key, change): added, deleted and modified rows of unique keys, compared only in the ranges whose digests differ."""
    a, b = (hash_tree(t, key, columns, levels).where(F.col("level") == levels).select("range", "digest") for t in (old, new))
    ranges = a.join(b.withColumnRenamed("digest", "other"), "range", "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("range")
    whole = F.unhex(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))
    x, y = (with_range(t, key, levels).join(ranges, "range", "left_semi").select(*key, whole.alias(n)) for t, n in ((old, "_x"), (new, "_y")))
    kind = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "deleted").otherwise("modified")
    return x.join(y, key, "full").where(~F.col("_x").eqNullSafe(F.col("_y"))).select(*key, kind.alias("change"))


def freshness(builds: DataFrame) -> DataFrame:
    """``builds`` with fresh and reason: whether a projection was built from exactly the catalog that is active.

    Columns looked at: catalog_build, catalog_fingerprint (stored), content_fingerprint (computed anew),
    graph_path, wanted_path, source_path, catalog_path, graph_catalog_build, graph_fingerprint,
    graph_version, wanted_version. The first that does not hold is the reason.
    """
    unlike = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reason = (
        F.when(F.col("catalog_build").isNull(), "no active catalog build").when(unlike("catalog_fingerprint", "content_fingerprint"), "catalog fingerprint mismatch")
        .when(F.col("graph_path").isNull() | unlike("graph_path", "wanted_path"), "no active graph build for the path").when(unlike("source_path", "catalog_path"), "source database mismatch")
        .when(unlike("graph_catalog_build", "catalog_build"), "catalog generation mismatch").when(unlike("graph_fingerprint", "content_fingerprint"), "graph fingerprint mismatch")
        .when(unlike("graph_version", "wanted_version"), "projection version mismatch").otherwise("fresh"))
    return builds.withColumn("reason", reason).withColumn("fresh", F.col("reason") == "fresh")
