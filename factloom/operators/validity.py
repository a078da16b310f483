"""Rows with the time for which they hold, kept on as stale where their source could not be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = ["key", "value", "since", "until", "stale"]


def history_of(snapshot: DataFrame, at: int) -> DataFrame:
    """A history (key, value, since, until, stale) that begins with ``snapshot`` (key, value); an open interval has no end."""
    return snapshot.select("key", "value", F.lit(at).cast("long").alias("since"), F.lit(None).cast("long").alias("until"), F.lit(False).alias("stale"))


def advanced(history: DataFrame, snapshot: DataFrame, failed: DataFrame, at: int) -> DataFrame:
    """``history`` after ``snapshot`` (key, value) of time ``at``, of which the keys ``failed`` (key) could not be read.

    A value that still holds stays open. One that changed is closed at ``at`` and the new one opened;
    one that is gone is closed. A key that failed keeps its last value, in an interval marked stale from
    ``at`` on; when it is read again the stale interval is closed, or, if the value is the same, made good
    by :func:`merged`. A failed key without a value has nothing to keep. ``at`` must be later than
    all that the history knows. Closed intervals are not touched: one join of the open ones with the snapshot.
    """
    now = snapshot.select("key", F.col("value").alias("new"), F.lit(True).alias("seen"))
    lost = failed.select("key").distinct().withColumn("lost", F.lit(True))
    met = history.where("until is null").join(lost, "key", "left").join(now, "key", "full")
    t = F.lit(at).cast("long")
    was, lost_, seen = F.col("since").isNotNull(), F.coalesce("lost", F.lit(False)), F.coalesce("seen", F.lit(False))
    stays = was & ((lost_ & F.col("stale")) | (~lost_ & seen & F.col("value").eqNullSafe(F.col("new")) & ~F.col("stale")))
    old = F.when(was, F.struct("value", "since", F.when(~stays, t).alias("until"), "stale"))
    kept = F.struct(F.col("value"), t.alias("since"), F.lit(None).cast("long").alias("until"), F.lit(True).alias("stale"))
    fresh = F.struct(F.col("new").alias("value"), t.alias("since"), F.lit(None).cast("long").alias("until"), F.lit(False).alias("stale"))
    next_ = F.when(was & ~stays & lost_, kept).when(~stays & ~lost_ & seen, fresh)
    # a key that failed and was not known before is not in the snapshot either, or its failure hides it
    rows = met.select("key", F.explode(F.array_compact(F.array(old, next_))).alias("x")).select("key", "x.*")
    return history.where("until is not null").select(*HISTORY).unionByName(rows.select(*HISTORY))


def merged(history: DataFrame) -> DataFrame:
    """``history`` with intervals of one key that follow each other without a gap and have one value made one.

    A stale interval between two readings of the same value was no change: it is merged into them and is stale no more.
    One at the end stays stale, in a row of its own.
    """
    order = Window.partitionBy("key").orderBy("since")
    good = Window.partitionBy("key", "_run").orderBy("since").rowsBetween(0, Window.unboundedFollowing)
    rows = history.withColumn("_before", F.lag("until").over(order)).withColumn("_value", F.lag("value").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    starts = F.col("_first") | ~F.col("_before").eqNullSafe(F.col("since")) | ~F.col("_value").eqNullSafe(F.col("value"))
    rows = rows.withColumn("_run", F.sum(starts.cast("int")).over(order))
    rows = rows.withColumn("_stale", F.coalesce(F.bool_and("stale").over(good), F.lit(False)))  # stale to the end of the run
    last = F.max_by("until", "since")
    return rows.groupBy("key", "_run", "_stale").agg(F.first("value").alias("value"), F.min("since").alias("since"), last.alias("until")).select("key", "value", "since", "until", F.col("_stale").alias("stale"))


def as_of(history: DataFrame, at: int) -> DataFrame:
    """(key, value, stale): what held at time ``at``; an interval's end is not part of it."""
    return history.where((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at))).select("key", "value", "stale")
