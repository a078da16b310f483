"""Token counts by a Viterbi search that keeps only the best score and its number of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import quoted
from factloom.llm.encoding import runs
from factloom.llm.spans import Known, sums_by_text, text_bytes

SPACE = "▁"
#: Below the lowest score of a piece, the score of a character that no piece of one character covers.
UNKNOWN = 10.0


class Counter:
    """Number of pieces and score of texts under a unigram vocabulary.

    The vocabulary is that of a SentencePiece file: its normal pieces with their scores as log
    probabilities. Normalisation is the file's own kind: a space before the text, spaces as U+2581,
    nothing else. An automaton lists every piece that ends at a character, longest first; the best
    path to that character is the first of the greatest score, so of equal scores the one whose last
    piece starts earlier wins, as in the library's own unigram search. A character without a piece of
    its own has the unknown score and counts as its UTF-8 bytes.

    No piece holds a space after another character or a line feed, so the search falls apart at such
    places; each distinct part is searched once for as long as it is known.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.whole = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)  # then texts can't be cut
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN
        self.known = Known()
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.counts, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def search(self, text: str) -> tuple[int, float]:
        """Pieces and score of a normalised text."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done = 0  # places up to here have their best path

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                if not single[done]:
                    score = best[done] + self.unknown
                    if best[done + 1] is None or score > best[done + 1]:
                        best[done + 1], count[done + 1] = score, count[done] + len(text[done].encode())
                done += 1

        single = bytearray(n)
        for last, (length, score) in self.machine.iter(text):
            end = last + 1
            close(last)
            if length == 1:
                single[last] = 1
            start = end - length
            score += best[start]
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[start] + 1
        close(n)
        return count[n], best[n]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.cast(pa.large_string()).fill_null("")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", column, ""))))
        body, offsets = text_bytes(column)
        cut = np.zeros(len(body) + 1, bool)
        cut[offsets] = True
        if not self.whole and len(body):
            mark = np.zeros(len(body), bool)  # where the text itself has the space's sign
            mark[2:] = (body[2:] == 0x81) & (body[1:-1] == 0x96) & (body[:-2] == 0xE2)
            cut[1:-1] |= (body[1:] == 32) & (body[:-1] != 32) & ~mark[:-1] | (body[1:] == 10) | (body[:-1] == 10)
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(body)) if len(starts) else starts
        if len(self.known.hashes) > self.known.most:
            self.clear()
        number, new = self.known.numbers(body, starts, ends)
        raw = body.tobytes()
        parts = lambda at: [self.search(raw[s:e].decode().replace(" ", SPACE)) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if number is None:  # two parts behind one hash
            self.clear()
            found = parts(np.arange(len(starts)))
            counts, scores = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found])
        else:
            found = parts(new)
            self.counts = np.concatenate([self.counts, np.array([x[0] for x in found], np.int64)])
            self.scores = np.concatenate([self.scores, np.array([x[1] for x in found], float)])
            counts, scores = self.counts[number], self.scores[number]
        text = np.searchsorted(offsets, starts, side="right") - 1
        return sums_by_text(counts, text, len(column)), sums_by_text(scores, text, len(column))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs`` with n_tokens (long) and token_score (double, the best path's log probability).

    Whole texts are searched. Null and empty texts have 0 tokens and the score 0; repeated rows are
    counted each; an empty table gives no rows. Columns of ``docs`` stay, but for those two names.
    """
    keep = [c for c in docs.columns if c.lower() not in ("n_tokens", "token_score")]
    at = keep.index("text")
    # by position, as names may hold dots
    rows = docs.select(*[q for q, c in zip(quoted(docs), docs.columns, strict=True) if c in keep]).toDF(*[f"c{i}" for i in range(len(keep))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in runs(whole, f"c{at}"):
                n, score = counter(vocabulary_path)(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(score)], names)

    names = [*rows.columns, "n", "score"]
    return rows.mapInArrow(count, rows.limit(0).withColumns({"n": F.lit(0).cast("long"), "score": F.lit(0.0)}).schema).toDF(*keep, "n_tokens", "token_score")
