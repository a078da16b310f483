"""Vectorised work on the bytes of an Arrow column of texts: spans, their hashes, distinct spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
U = np.uint64
HASH_BLOCK = 1 << 20


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each starts (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def mixed64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.full(n, b, U)) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``body``; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    if len(body) > 2 * HASH_BLOCK and len(starts) > 1:  # the sums take 24 bytes for each of body's
        order = None if np.all(starts[1:] >= starts[:-1]) else np.argsort(starts)
        a, b = (starts, ends) if order is None else (starts[order], ends[order])
        cuts = np.unique(np.searchsorted(a, np.arange(a[0], a[-1] + HASH_BLOCK, HASH_BLOCK)))
        out = np.empty(len(a), U)
        for i, j in zip(cuts, [*cuts[1:], len(a)], strict=True):
            if j > i:
                low, high = a[i], b[i:j].max()
                part = body[low:high]
                out[i:j] = _hashes(part, a[i:j] - low, b[i:j] - low)
        if order is None:
            return out
        back = np.empty(len(a), U)
        back[order] = out
        return back
    return _hashes(body, starts, ends)


def _hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(body) + 1)
    sums = np.empty(len(body) + 1, U)
    sums[0] = 0
    np.cumsum((body.astype(U) + U(1)) * power[: len(body)], out=sums[1:])
    return mixed64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of non-blanks, cut at the ends of texts."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_BLANK[body]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(body)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = inner[inner > 0]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of ``flat`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def sums_by_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by the ascending ``text``, which runs from 0 to n - 1 with gaps."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    edges = np.searchsorted(text, np.arange(n + 1))
    return sums[edges[1:]] - sums[edges[:-1]]


class Known:
    """Distinct spans that a worker has met, with a running number for each.

    ``numbers`` gives the number of each span and the spans that are new. Hashes find a span; its
    bytes are then compared, and None is returned if any two differ behind one hash. Past ``most``
    spans all are forgotten, which costs time only.
    """

    def __init__(self, most: int = 3_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.order = np.zeros(0, U), np.zeros(0, np.int64)
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def numbers(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """Numbers of the spans, and the indices of spans that got a new number, in its order."""
        if len(self.hashes) > self.most:
            self.clear()
        unique, first, back = np.unique(span_hashes(body, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, unique)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == unique[hit]
        which = np.empty(len(unique), np.int64)
        which[hit] = self.order[at[hit]]
        fresh = np.flatnonzero(~hit)
        which[fresh] = len(self.order) + np.arange(len(fresh))
        new = first[fresh]
        lengths = ends[new] - starts[new]
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, gather(body, starts[new], lengths)])
        self.order = np.insert(self.order, at[fresh], which[fresh])
        self.hashes = np.insert(self.hashes, at[fresh], unique[fresh])
        number = which[back.reshape(-1)]
        lengths = ends - starts
        same = np.array_equal(self.lengths[number], lengths) and np.array_equal(
            gather(self.flat, self.starts[number], lengths), gather(body, starts, lengths))
        return (number if same else None), new
