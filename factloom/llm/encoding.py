"""Token ids of whole texts with the tokenizers library."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.llm.spans import Known, gather, text_bytes


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    letter, mark = np.zeros(256, bool), np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    mark[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    return letter, mark


_LETTER, _MARK = _kinds()


def piece_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the byte-level pattern always cuts, whatever stands around; starts of texts too.

    These are a space between two non-blanks, a line feed after a non-blank, a non-blank after such
    a line feed, and an ASCII mark after an ASCII letter. Characters that may be blanks of
    Unicode count as blanks here, so no cut is taken next to them.
    """
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.zeros(3, np.uint8), body, np.zeros(2, np.uint8)])
    spaces, feeds = np.flatnonzero(body == 32), np.flatnonzero(body == 10)

    def solid_before(i):
        a, b, c = padded[i], padded[i + 1], padded[i + 2]  # the three bytes before i
        blank = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A))
        return (c > 32) & (c != 127) & ~blank

    def solid_at(i):
        a, b = padded[i + 3], padded[i + 4]
        blank = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a >= 0xE1) & (a <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A))
        return (a > 32) & (a != 127) & ~blank

    cut = np.zeros(n + 1, bool)
    cut[spaces[solid_before(spaces) & solid_at(spaces + 1)]] = True
    feeds = feeds[solid_before(feeds)]
    cut[feeds] = True
    cut[(feeds + 1)[solid_at(feeds + 1)]] = True
    cut[1:n] |= _LETTER[body[:-1]] & _MARK[body[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of texts, each distinct piece of text encoded once for as long as it is known.

    A piece ends where the library's own first split always ends, so the ids of the pieces in a row
    are those of the text. For byte-level vocabularies without normaliser. Strings that look like
    special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Known()
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain ids and lengths, text by text."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum())), lengths

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        body, offsets = text_bytes(column)
        starts = piece_starts(body, offsets)
        ends = np.append(starts[1:], len(body)) if len(starts) else starts
        if len(self.known.hashes) > self.known.most:
            self.clear()
        number, new = self.known.numbers(body, starts, ends)
        if number is None:  # two pieces behind one hash
            self.clear()
            return self.ids_of([x or "" for x in column.to_pylist()])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            raw = body.tobytes() if at == 0 else raw
            ids, lengths = self.ids_of([raw[s:e].decode() for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, ids])
        lengths = self.lengths[number]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        edges = np.searchsorted(starts, offsets)
        return gather(self.flat, self.starts[number], lengths), sums[edges[1:]] - sums[edges[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def runs(batch: pa.RecordBatch, text: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most_bytes`` of text, one row at least."""
    size = pc.binary_length(batch.column(text).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def encoded(path: str, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in a row, ``end_id`` after each, and how many each has with it."""
    ids, lengths = encoder(path)(column)
    if end_id is None:
        return ids, lengths
    return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1
