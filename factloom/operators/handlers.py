"""Event handlers resolved only within the scripts that a surface links; sets of numbered scripts as bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.scratch import written

#: A handler that is a plain callable.
CALLABLE = r"^[A-Za-z_$][A-Za-z0-9_$]*$"


def dense_numbers(df: DataFrame, column: str) -> DataFrame:
    """(column, number): the distinct values, numbered from 1 in their order: ranges count alone and move by the rows before them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(n, column).withColumn("_part", F.spark_partition_id()), "numbers")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return ranged.withColumn("_i", inside).join(F.broadcast(before), "_part").select(column, (F.col("_base") + F.col("_i")).alias("number"))  # a row for each partition


def bitmaps(sets: DataFrame, by: list[str]) -> DataFrame:
    """(by, bucket, bits): the numbers of each set, 32,768 in a bitmap."""
    return sets.groupBy(*by, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def only_number(bucket, bits):
    """The number of a bitmap's one bit."""
    text = F.hex(bits)
    byte = F.floor(F.length(F.regexp_extract(text, "^(0*)", 1)) / 2)
    value = F.conv(F.substring(text, (2 * byte + 1).cast("int"), F.lit(2)), 16, 10).cast("double")
    return ((bucket - 1) * 32768 + byte * 8 + F.log2(value).cast("long") + 1).cast("long")


def handlers(events: DataFrame, links: DataFrame, symbols: DataFrame, failed: DataFrame) -> DataFrame:
    """(event, surface, name, status, reason, script) of every event call.

    ``events`` (event, surface, name); ``links`` (surface, script, scope: active or conditional), a
    script that a surface links twice in one way counts once; ``symbols`` (script, name, parent), of which only
    those without a parent can be handlers; ``failed`` (script) could not be parsed and prove nothing.

    A name that is no plain callable is unsupported. One active declaration and no conditional one
    resolves; several active, or both kinds, are ambiguous; only conditional ones are conditional, with the script
    if it is one alone; else it is unresolved, because of a linked script that failed or for want of any. Nothing is
    looked up outside the surface's own links.

    A link is followed from its cheaper end: by the names that its script declares or by those that its surface
    asks for, whichever are fewer. So neither all symbols of a large common script are listed for each
    surface, nor all questions of a busy surface for each of its scripts.
    """
    alive = symbols.where("parent is null").join(failed.select("script").distinct(), "script", "left_anti")
    declared = written(alive.groupBy("script", "name").agg(F.count(F.lit(1)).alias("n")), "declared")
    asked = written(events.where(F.col("name").rlike(CALLABLE)).select("surface", "name").distinct(), "asked")
    asks, names = asked.groupBy("surface").agg(F.count(F.lit(1)).alias("asks")), declared.groupBy("script").agg(F.count(F.lit(1)).alias("names"))
    linked = written(links.select("surface", "script", "scope").distinct().join(asks, "surface", "left").join(names, "script", "left"), "linked")
    by_script = linked.where("names <= asks").join(declared, "script").join(asked, ["surface", "name"], "left_semi")
    by_surface = linked.where("names > asks").join(asked, "surface").join(declared, ["script", "name"])
    met = by_script.select("surface", "name", "scope", "script", "n").unionByName(by_surface.select("surface", "name", "scope", "script", "n"))
    counted = met.groupBy("surface", "name").agg(
        *[F.coalesce(F.sum(F.when(F.col("scope") == s, F.col("n"))), F.lit(0)).alias(s) for s in ("active", "conditional")], F.max("script").alias("found"))
    blocked = linked.join(failed.select("script").distinct(), "script", "left_semi").select("surface").distinct().withColumn("blocked", F.lit(True))
    told = events.join(counted, ["surface", "name"], "left").join(blocked, "surface", "left")
    plain, active, conditional = F.coalesce(F.col("name").rlike(CALLABLE), F.lit(False)), F.coalesce("active", F.lit(0)), F.coalesce("conditional", F.lit(0))
    status = F.when(~plain, "unsupported").when((active == 1) & (conditional == 0), "resolved").when(active > 0, "ambiguous").when(conditional > 0, "conditional").otherwise("unresolved")
    reason = (
        F.when(status == "unsupported", "member_or_dynamic_handler_expression").when(status == "resolved", "unique_active_exact_callable")
        .when(status == "ambiguous", F.when(conditional > 0, "mixed_active_and_conditional").otherwise("multiple_active_exact_callables"))
        .when(status == "conditional", "conditional_exact_callable").when(F.col("blocked"), "linked_script_parse_error").otherwise("no_linked_exact_callable"))
    script = F.when((status == "resolved") | ((status == "conditional") & (conditional == 1)), F.col("found"))
    return told.select("event", "surface", "name", status.alias("status"), reason.alias("reason"), script.alias("script"))
