"""Exact deduplication with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BLANK, fresh_names, quoted, saved, text_of


def _normalised(digest: Callable[[Column], Column]) -> tuple[Column, Column]:
    """The text without blanks, and its 128-bit hash."""
    plain = F.regexp_replace(text_of(), BLANK, "")
    return plain, digest(plain)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs`` with the document of its group that stays.

    The normalised text has every blank of ``[\\x20\\x09-\\x0D]`` deleted. Groups form on the 128-bit
    hash of that text (``digest``) and, inside a hash, on its bytes, so that two texts of one hash stay
    apart. Of a group the row with most code points in the original text stays, then the smallest id
    (a null id comes last).

    Columns: doc_id, keep_id, group_size (rows), kept, text_sha256.

    Null text counts as empty. Rows that repeat an id come out each; those that repeat the id and the
    text of the kept row are all marked ``kept``, as the id stays. An empty table gives no rows; other
    columns of ``docs`` are not looked at.

    The text is shuffled once, after copies within a task have met; what goes on is narrow: rows get
    their group by the hash alone where the bytes have shown it to be of one text, and rows of the
    other hashes, if there are any, by hash and bytes. A hash that holds a third of all rows arrives
    as one row per task; the join back is an equi-join on narrow rows, which adaptive execution splits.
    """
    plain, hash128 = _normalised(digest)
    rows = docs.select("doc_id", F.char_length(text_of()).alias("n_points"), plain.alias("plain"), hash128.alias("hash128"))
    order = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    texts = rows.groupBy("hash128", "plain").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    described = ["hash128", F.sha2("plain", 256).alias("text_sha256"), "group_size", F.col("best.id").alias("keep_id")]
    classes = saved(texts.select(*described), "texts")
    shared = classes.groupBy("hash128").count().where("count > 1").select("hash128")
    if shared.isEmpty():
        found = rows.select("doc_id", "hash128").join(classes, "hash128")
    else:
        alone = classes.join(shared, "hash128", "left_anti")
        collided = texts.join(shared, "hash128", "left_semi").select("plain", *described)
        found = rows.select("doc_id", "hash128").join(alone, "hash128").unionByName(
            rows.join(shared, "hash128", "left_semi").select("doc_id", "hash128", "plain").join(collided, ["hash128", "plain"]).drop("plain"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they were.

    Groups and the row that stays are those of :func:`exact_groups`; of rows that repeat its id and
    text one stays. Null texts count as empty; columns of any name are kept; an empty table gives no
    rows. Rows travel once, whole, after copies within a task have met.
    """
    plain, row, key = fresh_names(docs, "plain", "row", "key")
    text, hash128 = _normalised(digest)
    order = F.struct((-F.char_length(text_of())).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    best = F.min_by(F.struct(*quoted(docs)), order).alias(row)
    return docs.withColumn(plain, text).withColumn(key, hash128).groupBy(key, plain).agg(best).select(*[F.col(f"{row}.{c}").alias(n) for c, n in zip(quoted(docs), docs.columns, strict=True)])
