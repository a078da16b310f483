"""Packing of documents along a space-filling curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import running_start, saved
from factloom.llm.encoding import encoded, runs
from factloom.llm.spans import mixed64

DIMS, BITS = 4, 12


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``points`` (integers of ``bits`` bits), as int64.

    Works on the bit planes from the top: each plane undoes the exchange and inversion of axes that
    the planes above have caused, then the planes are Gray-decoded and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for plane in range(bits - 1, 0, -1):
        q = np.int64(1) << plane
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        q = np.int64(1) << plane
        fix ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= fix
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> plane) & 1)
    return key


def projected(ids: np.ndarray, lengths: np.ndarray, vocabulary: int = 1 << 16) -> np.ndarray:
    """Each document's bag of ids, hashed to DIMS signed axes and scaled to BITS bits an axis."""
    rows = mixed64(np.arange(vocabulary * DIMS, dtype=np.uint64)).reshape(vocabulary, DIMS)
    signs = np.where(rows >> np.uint64(63), 1.0, -1.0).astype(np.float32)
    out = np.zeros((len(lengths), DIMS))
    ends = np.cumsum(lengths)
    for k in range(DIMS):
        sums = np.concatenate([[0.0], np.cumsum(signs[ids % vocabulary, k], dtype=np.float64)])
        out[:, k] = sums[ends] - sums[ends - lengths]
    mean = out / np.maximum(lengths, 1)[:, None]
    return np.clip((np.tanh(3 * mean) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)


def cut_points(total: int, size: int) -> np.ndarray:
    """Starts of all sequences after the last full one: the rest of ``total`` in falling powers of two."""
    at, rest, out = total - total % size, total % size, []
    while rest:
        part = 1 << (rest.bit_length() - 1)
        out.append(at)
        at, rest = at + part, rest - part
    return np.array([*out, at], np.int64)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """Pieces of documents in sequences of ``size`` ids, neighbours on the Hilbert curve together.

    Every document's ids and ``end_id`` are laid one after another in the order of (curve, doc_id)
    and cut at each multiple of ``size``; what remains at the very end is cut to falling powers of
    two. So no sequence needs padding: all are full or a power of two long.

    Columns: doc_id, start, length, ids (binary, little-endian, 2 bytes an id below 65,536 ids of
    vocabulary, else 4), ids_crc32 (over 4-byte ids), doc_tokens, sequence_id, offset, curve.

    Null text is empty: its document is its end id alone. Rows that repeat an id are packed each.
    An empty table gives no rows. The order is total but for rows equal in id and curve, so a rerun
    over the same files gives the same pieces. Ids are written once to the shared folder and moved
    once, to meet their positions; ordering and summing run on narrow rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in runs(whole, "text"):
                ids, lengths = encoded(tokenizer_path, batch.column("text"), end_id)
                curve = hilbert_key(projected(ids, lengths))
                kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32
                ends = np.cumsum(lengths) * kind().itemsize
                raw = ids.astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(lengths))), batch.column("doc_id"), pa.array(curve), pa.array(lengths),
                     pa.array([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())],
                    ["uid", "doc_id", "curve", "doc_tokens", "ids"])
                row += len(lengths)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = saved(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        encode, f"uid long, doc_id {id_type}, curve long, doc_tokens long, ids binary"), "ids")
    narrow = table.select("uid", "doc_id", "curve", "doc_tokens")
    total = narrow.agg(F.sum("doc_tokens")).first()[0] or 0
    places = running_start(narrow, ["curve", "doc_id", "uid"], "doc_tokens", "place").select("uid", "place")
    tail = cut_points(total, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = total // size
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "curve", "doc_tokens", "ids", "place")]
            for doc, curve, n, raw, place in zip(*cols, strict=True):
                width = len(raw) // n
                wide = np.frombuffer(raw, f"<u{width}").astype("<u4")
                edges = {place, place + n, *range((place // size + 1) * size, place + n, size)}
                if place + n > full * size:
                    edges |= {int(t) for t in tail if place < t < place + n}
                edges = sorted(edges)
                for a, b in zip(edges, edges[1:], strict=False):
                    if a < full * size:
                        seq, first = a // size, a // size * size
                    else:
                        k = int(np.searchsorted(tail, a, side="right")) - 1
                        seq, first = full + k, int(tail[k])
                    out.append((doc, a - place, b - a, raw[(a - place) * width : (b - place) * width],
                                zlib.crc32(wide[a - place : b - place].tobytes()), n, seq, a - first, curve))
            names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve"]
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
            for at in range(0, len(out), 5000):
                columns = zip(*out[at : at + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    met = table.join(places.hint("shuffle_hash"), "uid").select("doc_id", "curve", "doc_tokens", "ids", "place")
    return met.mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long")
