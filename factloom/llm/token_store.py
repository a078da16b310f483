"""Binary token shards with a minimal perfect hash index."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import new_path, partitions
from factloom.llm.encoding import encoded, runs
from factloom.llm.spans import mixed64

#: A shard is this header (magic, bytes an id, zeros) and then ids without any mark between documents.
MAGIC, HEADER = b"FLIDS001", 16
#: Keys that one part of the index holds about.
PART = 50_000
LEVELS, LOOSE = 24, 1.6
U = np.uint64


def _seeded(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed64(keys ^ U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def mph_build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys.

    Level by level each remaining key marks a bit of an array about 1.6 times their number; keys
    alone on their bit stay there, the others go on. A key's number is the count of set bits before
    its own. Keys left after the last level are listed and numbered last.

    Returns the sizes of levels in bits, the packed bits, set bits before each byte, the listed keys.
    """
    sizes, arrays, left = [], [], keys
    for level in range(LEVELS):
        if not len(left):
            break
        size = int(len(left) * LOOSE) // 8 * 8 + 8
        place = (_seeded(left, level) % U(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        arrays.append(alone)
        sizes.append(size)
        left = left[~alone[place]]
    bits = np.packbits(np.concatenate(arrays)) if arrays else np.zeros(0, np.uint8)
    counts = np.bitwise_count(bits).astype(np.uint32)
    return sizes, bits, (np.cumsum(counts) - counts).astype(np.uint32), np.sort(left)


def mph_find(keys: np.ndarray, sizes: list[int], bits: np.ndarray, before: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """The number of each key; for a key that was not built in, any number or -1."""
    out = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        place = (_seeded(keys[open_], level) % U(size)).astype(np.int64) + base
        byte, bit = place >> 3, 7 - (place & 7)
        hit = (bits[byte] >> bit) & 1 == 1
        above = np.bitwise_count((bits[byte[hit]].astype(np.uint16) >> (bit[hit] + 1)).astype(np.uint8))
        out[open_[hit]] = before[byte[hit]].astype(np.int64) + above
        open_, base = open_[~hit], base + size
    if len(open_) and len(listed):
        at = np.minimum(np.searchsorted(listed, keys[open_]), len(listed) - 1)
        hit = listed[at] == keys[open_]
        ones = int(before[-1]) + int(np.bitwise_count(bits[-1])) if len(bits) else 0
        out[open_[hit]] = ones + at[hit]
    return out


def _keys(df: DataFrame, parts: int) -> DataFrame:
    """Adds key (64-bit hash of id and ordinal), fingerprint (32 bits of another hash) and part."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.col("ordinal"))
    mark = F.crc32(F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("ordinal").cast("string")).cast("binary"))
    return df.withColumns({"key": key, "fingerprint": mark, "part": F.pmod(F.hash(key), F.lit(parts))})


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> str:
    """Writes the ids of all documents and their index under ``path`` and returns it.

    Layout: ``shards/*.bin`` hold raw ids in ascending (doc_id, text) order, 2 bytes an id if the
    vocabulary allows, each document ended by ``end_id``; ``entries`` (Parquet) lists the documents
    of each shard file that counts; ``manifest`` orders the shards and gives the ids before each;
    ``index`` has one minimal perfect hash for each part of the keys.

    A task names its shard file anew at every attempt and the entries name the file that counts, so
    a task that runs twice does no harm. The k-th row (from 0) of a repeated doc_id has the key
    (doc_id, k); a null id is a key and comes first; null text is empty and has its end id only; an
    empty table gives a store without shards.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        kind = np.dtype("<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(f"{root}/shards", recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"shards/{shard:06d}-{uuid.uuid4().hex}.bin"
        offset, last, ordinal, out = 0, None, 0, None
        try:
            for whole in batches:
                for batch in runs(whole, "text"):
                    if out is None:
                        out = files.open_output_stream(f"{root}/{name}")
                        out.write(MAGIC + kind.itemsize.to_bytes(4, "little") + bytes(4))
                    ids, lengths = encoded(tokenizer_path, batch.column("text"), end_id)
                    out.write(ids.astype(kind).tobytes())
                    ordinals = []
                    for doc in batch.column("doc_id").to_pylist():
                        ordinal = ordinal + 1 if ordinals or offset else 0
                        if (doc,) != last:
                            ordinal = 0
                        last = (doc,)
                        ordinals.append(ordinal)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array(ordinals, pa.int64()), pa.array([shard] * len(lengths), pa.int32()),
                         pa.array([name] * len(lengths)), pa.array(offset + np.cumsum(lengths) - lengths), pa.array(lengths)],
                        ["doc_id", "ordinal", "shard", "file", "offset", "n_tokens"])
                    offset += int(lengths.sum())
        finally:
            if out is not None:
                out.close()

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, f"doc_id {id_type}, ordinal long, shard int, file string, offset long, n_tokens long").write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    totals = entries.groupBy("shard", "file").agg(F.sum("n_tokens").alias("shard_tokens"), F.count(F.lit(1)).alias("shard_docs"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("first", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")
    parts = max(1, -(-entries.count() // PART))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # two keys of one hash can't be told apart by it: the later ones are listed by their rows
        rows = rows.sort_values(["key", "fingerprint"], kind="stable")
        twin = rows["key"].duplicated().to_numpy()
        one, more = rows[~twin], rows[twin]
        keys = one["key"].to_numpy().view(U)
        sizes, bits, before_, listed = mph_build(keys)
        one = one.iloc[np.argsort(mph_find(keys, sizes, bits, before_, listed))]
        both = pd.concat([one, more])
        return pd.DataFrame({
            "part": [int(key[0])], "n": [len(one)], "sizes": [list(map(int, sizes))], "bits": [bits.tobytes()], "before": [before_.tobytes()],
            "listed": [listed.tobytes()], "fingerprints": [both["fingerprint"].to_numpy().astype("<u4").tobytes()],
            "shards": [both["shard"].to_numpy().astype("<u4").tobytes()], "offsets": [both["offset"].to_numpy().astype("<u8").tobytes()],
            "lengths": [both["n_tokens"].to_numpy().astype("<u4").tobytes()], "twins": [more["key"].to_numpy().astype("<i8").tobytes()]})

    keyed = _keys(entries, parts).select("part", "key", "fingerprint", "shard", "offset", "n_tokens")
    keyed.groupBy("part").applyInPandas(
        build, "part int, n long, sizes array<long>, bits binary, before binary, listed binary, fingerprints binary, shards binary, offsets binary, lengths binary, twins binary"
    ).write.parquet(f"{path}/index")
    return path


def find(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Where the documents of ``wanted`` (doc_id, ordinal) lie: adds shard, offset and n_tokens.

    Each key costs a fixed number of probes in its part of the index; its stored fingerprint must
    agree. Keys that the store lacks are left out, but for one in four billion.
    """
    index = spark.read.parquet(f"{path}/index")
    parts = max(1, (index.agg(F.max("part")).first()[0] or 0) + 1)
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def probe(key: tuple, ask: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(ask):
            return pd.DataFrame({"doc_id": [], "ordinal": [], "shard": [], "offset": [], "n_tokens": []})
        row = part.iloc[0]
        read = lambda c, t: np.frombuffer(row[c], t)
        at = mph_find(ask["key"].to_numpy().view(U), list(map(int, row["sizes"])), read("bits", np.uint8), read("before", np.uint32), read("listed", U))
        marks = read("fingerprints", "<u4")
        wanted_marks = ask["fingerprint"].to_numpy()
        ok = (at >= 0) & (marks[np.maximum(at, 0)] == wanted_marks)
        for k, twin in enumerate(read("twins", "<i8")):
            other = (ask["key"].to_numpy() == twin) & (marks[row["n"] + k] == wanted_marks)
            at[other], ok = row["n"] + k, ok | other
        at = at[ok]
        return pd.DataFrame({"doc_id": ask["doc_id"].to_numpy()[ok], "ordinal": ask["ordinal"].to_numpy()[ok], "shard": read("shards", "<u4")[at].astype(np.int32),
                             "offset": read("offsets", "<u8")[at].astype(np.int64), "n_tokens": read("lengths", "<u4")[at].astype(np.int64)})

    asked = _keys(wanted.select("doc_id", "ordinal"), parts).select("doc_id", "ordinal", "key", "fingerprint", "part")
    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(probe, f"doc_id {id_type}, ordinal long, shard int, offset long, n_tokens long")


def read_store(spark: SparkSession, path: str, wanted: DataFrame | None = None, with_ids: bool = False) -> DataFrame:
    """The documents of ``wanted`` (all, if None), found through the index and read from the shards.

    Columns: doc_id, ordinal, start (ids of all documents before), n_tokens, ids_crc32 (over 4-byte
    little-endian ids), and ids (array of long) if asked for.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    places = find(spark, path, spark.read.parquet(f"{path}/entries") if wanted is None else wanted)
    id_type = places.schema["doc_id"].dataType.simpleString()

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        files, root = pafs.FileSystem.from_uri(path)
        rows = rows.sort_values("offset", kind="stable")
        crcs, lists = [], []
        with files.open_input_file(f"{root}/{rows['file'].iloc[0]}") as source:
            head = source.read_at(HEADER, 0)
            if head[:8] != MAGIC:
                raise ValueError(f"{path}: not a shard")
            width = int.from_bytes(head[8:12], "little")
            held, at = b"", 0
            for offset, n in zip(rows["offset"].tolist(), rows["n_tokens"].tolist(), strict=True):
                a, size = HEADER + offset * width, n * width
                if a < at or a + size > at + len(held):
                    held, at = source.read_at(max(size, 1 << 22), a), a
                ids = np.frombuffer(held[a - at : a - at + size], f"<u{width}")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                if with_ids:
                    lists.append(ids.astype(np.int64))
        out = pd.DataFrame({"doc_id": rows["doc_id"], "ordinal": rows["ordinal"], "start": rows["first"] + rows["offset"], "n_tokens": rows["n_tokens"], "ids_crc32": crcs})
        return out.assign(ids=lists) if with_ids else out

    asked = places.join(F.broadcast(manifest.select("shard", "file", "first")), "shard")
    schema = f"doc_id {id_type}, ordinal long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return asked.groupBy("shard").applyInPandas(read, schema)
