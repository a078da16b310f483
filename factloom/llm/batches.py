"""Documents as batches of word codes, and counting over all batches.

A batch holds about two million words as codes into its own sorted list of word hashes. Counts over
the corpus come by question and answer: every batch sends its distinct keys, with its own counts, to
the bucket of each key; the bucket adds up and answers every batch in the order it was asked. Keys
and counts travel as packed arrays, a row for each batch and bucket, so 135 million words move as a
few thousand rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import new_path, partitions
from factloom.llm.encoding import runs
from factloom.llm.spans import LOWER, mixed64, span_hashes, sums_by_text, text_bytes, word_spans

U = np.uint64
#: Bytes of text in a batch, about.
BATCH_BYTES = 12_000_000
#: Bytes of a count on its way, enough for 280 million million occurrences.
COUNT = 6


def saved_by(df: DataFrame, name: str, key: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder in hash buckets of ``key``: later groupings by it need no shuffle."""
    spark = df.sparkSession
    table, path = f"{name}_{uuid.uuid4().hex}", new_path(spark, name)
    if paths is not None:
        paths.extend([f"table {table}", path])
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def word_batches(docs: DataFrame, mark: str | None = None, paths: list[str] | None = None, size: int = BATCH_BYTES) -> DataFrame:
    """Batches of ``docs`` (doc_id, text, and the boolean column ``mark``), A-Z lower-cased, of about ``size`` bytes of text.

    Columns: batch, uid (number of its first document; the others follow), n_words, doc_ids,
    counts (int32 words of each document), marks (a byte each), words (sorted 64-bit hashes), codes
    (uint32 place in words of each word), same (two 64-bit hashes of the words of each document in
    their order, one after the other).
    """

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        number = TaskContext.get().partitionId() << 24
        for whole in rows:
            for part in runs(whole, "text", size):
                body, offsets = text_bytes(part.column("text"))
                low = LOWER[body]
                starts, ends, text = word_spans(low, offsets)
                words, codes = np.unique(span_hashes(low, starts, ends), return_inverse=True)
                n = part.num_rows
                marks = part.column("mark").fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
                ids = part.column("doc_id")
                counts = np.bincount(text, minlength=n)
                place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
                same = np.stack([sums_by_text(mixed64(words[codes.reshape(-1)] ^ mixed64(place.astype(U) + U(seed))), text, n) for seed in (1, 1 << 40)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([uid]), pa.array([len(codes)]), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                     pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([marks.tobytes()], pa.binary()),
                     pa.array([words.tobytes()], pa.binary()), pa.array([codes.reshape(-1).astype(np.uint32).tobytes()], pa.binary()),
                     pa.array([same.view(np.int64).ravel()], pa.list_(pa.int64()))],
                    ["batch", "uid", "n_words", "doc_ids", "counts", "marks", "words", "codes", "same"])
                uid, number = uid + n, number + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.col(mark) if mark else F.lit(True)).alias("mark"))
    schema = f"batch long, uid long, n_words long, doc_ids array<{kind}>, counts binary, marks binary, words binary, codes binary, same array<long>"
    return saved_by(rows.mapInArrow(cut, schema), "word_batches", "batch", paths)


def read(raw: bytes, kind: str | type) -> np.ndarray:
    return np.frombuffer(raw, kind)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each 64-bit value, byte plane by byte plane."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; buckets (under 2^32) are equal ranges of the upper 32 bits."""
    return ((hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def bucket_runs(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that sorted ``hashes`` are in."""
    if not len(hashes):
        return []
    bucket = bucket_of(hashes, buckets)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True))


def count_buckets(batches: DataFrame, words_each: int = 2_000_000) -> int:
    """Buckets so that one gets the keys of about ``words_each`` words; grows with the corpus."""
    return max(8, (batches.agg(F.sum("n_words")).first()[0] or 0) // words_each)


def ask_counts(batch: int, hashes: np.ndarray, counts: np.ndarray, buckets: int, width: int = 6) -> pd.DataFrame:
    """Questions of one batch for the corpus counts of its sorted distinct hashes."""
    rows = [(b, batch, pack(hashes[i:j], width), pack(counts[i:j], COUNT)) for b, i, j in bucket_runs(hashes, buckets)]
    return pd.DataFrame(rows, columns=["bucket", "batch", "keys", "counts"])


ASK = "bucket int, batch long, keys binary, counts binary"


def answer_counts(asked: DataFrame, width: int = 6) -> DataFrame:
    """Answers (batch, bucket, counts, n_keys, n_all): the corpus count of each key asked for.

    ``n_keys`` and ``n_all`` are set in one row of each bucket: its distinct keys with a count and
    the sum of all counts. Keys of a bucket are told apart by their low ``width`` bytes.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x, width) for x in rows["keys"]]
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        back = back.reshape(-1)
        totals = np.bincount(back, np.concatenate([unpack(x, COUNT) for x in rows["counts"]]).astype(float)).astype(np.uint64)
        edges = np.cumsum([0, *map(len, keys)])
        first = np.arange(len(rows)) == 0
        return pd.DataFrame({
            "batch": rows["batch"], "bucket": rows["bucket"], "counts": [pack(totals[back[i:j]], COUNT) for i, j in zip(edges, edges[1:], strict=False)],
            "n_keys": np.where(first, int((totals > 0).sum()), 0), "n_all": np.where(first, int(totals.sum()), 0)})

    return asked.groupBy("bucket").applyInPandas(add, "batch long, bucket int, counts binary, n_keys long, n_all long")
