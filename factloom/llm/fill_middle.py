"""Fill-in-the-middle: texts cut at two ranks of their units, the middle moved to the end."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import quoted, text_of
from factloom.llm.encoding import runs
from factloom.llm.spans import text_bytes

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a chunk.
CHUNK = 4096
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True

#: Where a unit starts, told from each byte and the one before it. A text's first byte stands after a line feed.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: _BLANK[before] & ~_BLANK[here],
    "line": lambda before, here: before == 10,
}


class Chunks:
    """Texts in overlapping chunks: each also sees the byte before its first, so all count on their own.

    ``counts`` has the units that start in each chunk, ``before`` those that start in the same text
    before it (a prefix sum), ``units`` those of each text.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray, unit: str, size: int = CHUNK):
        self.body, self.offsets, self.starts_unit = body, offsets, UNITS[unit]
        each = -(-np.diff(offsets) // size)
        self.first = np.concatenate([[0], np.cumsum(each)])  # the first chunk of each text
        text = np.repeat(np.arange(len(each)), each)
        self.starts = offsets[text] + (np.arange(len(text)) - self.first[text]) * size
        self.ends = np.minimum(self.starts + size, offsets[text + 1]) if len(text) else self.starts
        self.opens = self.starts == offsets[text] if len(text) else np.zeros(0, bool)
        counts = np.zeros(len(text), np.int64)
        block = max(1, (1 << 20) // size)
        for at in range(0, len(text), block):
            lo, hi = self.starts[at], self.ends[min(at + block, len(text)) - 1]
            counts[at : at + block] = np.add.reduceat(self._marked(lo, hi, self.starts[at : at + block][self.opens[at : at + block]]), self.starts[at : at + block] - lo, dtype=np.int64)
        self.counts = counts
        sums = np.concatenate([[0], np.cumsum(counts)])
        self.total = sums[self.first]  # units before each text
        self.sums = sums[:-1]
        self.units = np.diff(self.total)

    def _marked(self, lo: int, hi: int, opens: np.ndarray) -> np.ndarray:
        """Which bytes of lo..hi start a unit; ``opens`` are starts of texts."""
        before = np.empty(hi - lo, np.uint8)
        before[1:] = self.body[lo : hi - 1]
        before[0] = self.body[lo - 1] if lo else 10
        before[opens - lo] = 10
        return self.starts_unit(before, self.body[lo:hi])

    def cuts(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The place in ``body`` after the first ``ranks`` units of ``texts``; only the chunks that hold a cut are read again."""
        out = self.offsets[texts].copy()
        out[ranks >= self.units[texts]] = self.offsets[texts + 1][ranks >= self.units[texts]]
        out[ranks == 0] = self.offsets[texts][ranks == 0]
        inner = np.flatnonzero((ranks > 0) & (ranks < self.units[texts]))
        wanted = self.total[texts[inner]] + ranks[inner]
        owner = np.searchsorted(self.sums, wanted, side="right") - 1
        for i, chunk, rank in zip(inner.tolist(), owner.tolist(), (wanted - self.sums[owner]).tolist(), strict=True):
            lo, hi = int(self.starts[chunk]), int(self.ends[chunk])
            out[i] = lo + np.flatnonzero(self._marked(lo, hi, self.starts[chunk : chunk + 1][self.opens[chunk : chunk + 1]]))[rank]
        return out


def draws(doc_id: str = "doc_id", seed: int = 1) -> list[Column]:
    """Four integers under 2^32: the first 8-digit groups of the hex sha256 of seed, colon, and decimal id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, plain_from: int = 90, spm_below: int = 20, names: tuple[str, ...] = ("n", "form", "prefix_units", "middle_units", "output")) -> DataFrame:
    """``docs`` with the text put together for filling in: adds n, form, prefix_units, middle_units, output.

    The text has n units (``unit``: code points, words with the blanks after them, or lines). Draws h1
    to h4 come from the id alone (:func:`draws`). The prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units, the middle after the larger. Forms: plain, the text itself, if it is empty or
    holds a mark, or h3 % 100 >= ``plain_from``; else spm (suffix, prefix, middle) if h4 % 100 <
    ``spm_below``; else psm. Units of a part are null for plain. :func:`restored` undoes it.

    Each text is cut into chunks of 4,096 bytes that overlap by the one byte that tells whether a unit
    starts; all chunks of some 4 MB of texts are counted at once, prefix sums lead both ranks to their
    chunks, and those alone are read again. A row is one task's, as its output is; nothing is shuffled.

    Null text is empty; a null id draws like the empty one; rows that repeat an id and text come out
    alike; an empty table gives no rows. Other columns stay, whatever their names, but those named as
    results (``names``) give way.
    """
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    taken = docs.select(*[q for q, c in zip(quoted(docs), docs.columns, strict=True) if c in keep])
    width, h = len(keep), draws(seed=seed)
    at = keep.index("text")
    extra = [
        h[0], h[1], h[3] % 100 < spm_below,
        (h[2] % 100 >= plain_from) | (text_of() == "") | text_of().rlike("|".join(map(re.escape, MARKS)))]
    # by position, as names may hold dots and repeat these
    rows = docs.select(*quoted(taken), *extra).toDF(*[f"c{i}" for i in range(width + len(extra))])

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in MARKS)
        for whole in batches:
            for part in runs(whole, f"c{at}"):
                body, offsets = text_bytes(part.column(at))
                chunks = Chunks(body, offsets, unit)
                n = chunks.units
                ranks = np.stack([part.column(width + i).to_numpy() % (n + 1) for i in (0, 1)])
                is_spm, is_plain = (part.column(width + i).to_numpy(zero_copy_only=False) for i in (2, 3))
                a, b = ranks.min(0), ranks.max(0)
                cut = np.flatnonzero(~is_plain)
                places = chunks.cuts(np.concatenate([cut, cut]), np.concatenate([a[cut], b[cut]])).reshape(2, -1)
                raw = body.tobytes()
                out = [raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                for i, x, y in zip(cut.tolist(), places[0].tolist(), places[1].tolist(), strict=True):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    prefix, middle, suffix = raw[lo:x], raw[x:y], raw[y:hi]
                    out[i] = b"".join((s, suffix, p, prefix, m, middle) if is_spm[i] else (p, prefix, s, suffix, m, middle))
                form = np.where(is_plain, "plain", np.where(is_spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(a, mask=is_plain), pa.array(b - a, mask=is_plain), pc.cast(pa.array(out, pa.large_binary()), pa.large_string()).cast(pa.string())],
                    [f"c{i}" for i in range(width + 5)])

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(taken.schema)]
    added = [T.StructField(f"c{width + i}", t) for i, t in enumerate((T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()))]
    made = rows.mapInArrow(arrange, T.StructType(fields + added))
    return made.toDF(*keep, *names)


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`fill_in_middle` was given, from its output and form alone."""
    parts = F.split(output, "|".join(map(re.escape, MARKS)), -1)
    # psm has prefix, suffix, middle behind the marks, spm suffix, prefix, middle
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
