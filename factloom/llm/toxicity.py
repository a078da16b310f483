"""Toxicity from class-conditional Kneser-Ney models with a shared backoff."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.fitting import NAMES, fitted, labelled, logistic, scored, sigmoid
from factloom.llm.spans import LOWER, mixed64, span_hashes, text_bytes

U = np.uint64
#: Taken off the counts of pairs, and of words: what a class has less often has the shared probability alone.
DISCOUNT, RARE = 4.0, 2.0
#: Share of a toxic text's words that come from the toxic model (e^-5); parts of the sample that are scored by the others.
SHARE, FOLDS = 0.0067, 3
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True


#: Bytes of the beginnings that a word backs off to, and last the word.
STEMS = (4, 5, 6, 7, 8, 10, 1 << 30)


class Words(NamedTuple):
    """Words of texts: lower-cased bytes of all, where each word starts and ends, its hash and text."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    whole: np.ndarray
    text: np.ndarray

    def only(self, mask: np.ndarray) -> Words:
        return Words(self.low, *(x[mask] for x in self[1:]))

    def stems(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the beginnings of the words ``at``, a row for each length of :data:`STEMS`; a row
        repeats the word's own hash from where the word has ended."""
        starts, ends, whole = self.starts[at], self.ends[at], self.whole[at]
        out = np.tile(whole, (len(STEMS), 1))
        for k, size in enumerate(STEMS[:-1]):
            longer = ends - starts > size
            out[k, longer] = span_hashes(self.low, starts[longer], starts[longer] + size)
        return out


def words(column: pa.Array) -> Words:
    """Runs of letters, digits and apostrophes, A-Z lower-cased."""
    body, offsets = text_bytes(column)
    solid = _WORD[body]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(body))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = LOWER[body]
    whole = ~span_hashes(low, starts, ends)  # never the hash of a beginning
    return Words(low, starts, ends, whole, np.searchsorted(offsets, starts, side="right") - 1)


def _pairs(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word with the one before (0 before the first), and the hash of that one."""
    before = np.zeros(len(hashes), U)
    before[1:] = np.where(text[1:] == text[:-1], hashes[:-1], U(0))
    return mixed64(before * U(0x9E3779B97F4A7C15) + hashes), before


def _look(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KneserNey:
    """Two bigram models, one a class, that back off to beginnings of words and to shared counts.

    P(w | h) = max(c(h, w) - D, 0) / c(h) + left(h) P(w), c(h, w) the distinct words that stand before
    the pair in the class and c(h) their sum. P(w) is a product down the word's
    beginnings s1 < s2 < ... < w, each given the one before:
    P(s | parent) = max(f(s) - R, 0) / f(parent) + left(parent) P0(s | parent).
    f counts the distinct pairs (word before, word) of the class, so copies of a document add
    nothing. P0 has the counts that the classes share, the smaller f of the two, with one more for
    every beginning and for unknown ones. So a rare word has the evidence of its stem, and a rare
    stem none. Pairs seen once in all are not stored and leave their mass to P.
    """

    def __init__(self, words: Words, label: np.ndarray):
        pair, before = _pairs(words.whole, words.text)
        which = label[words.text]
        distinct, first, again, total = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        _, example, word = np.unique(words.whole, return_index=True, return_inverse=True)
        word = word.reshape(-1)
        word_f = []
        for c in (0, 1):
            mine = np.flatnonzero(which == c)
            mine = mine[np.unique(pair[mine], return_index=True)[1]]
            word_f.append(np.bincount(word[mine], minlength=len(example)).astype(np.float64))
        del word
        stems = words.stems(example)
        parent, parent_f = np.zeros(len(example), np.int64), np.array([[max(1.0, f.sum())] for f in word_f])
        self.levels: list[tuple] = []
        for k in range(len(STEMS)):
            table, back = np.unique(stems[k], return_inverse=True)
            back = back.reshape(-1)
            f = np.stack([np.bincount(back, x, minlength=len(table)) for x in word_f])
            up = np.zeros(len(table), np.int64)
            up[back] = parent
            n_up = parent_f.shape[1]
            kept = np.maximum(f - RARE, 0)
            # a word that ended above is its own only child
            same = _look(self.levels[-1][0], table)[1] if k else np.zeros(len(table), bool)
            share = 2 * f.min(axis=0) + 1
            shares = np.bincount(up, share, minlength=n_up) + 1
            left = np.stack([1 - np.bincount(up, kept[c], minlength=n_up) / np.maximum(parent_f[c], 1) for c in (0, 1)])
            left = np.clip(left, 1e-9, 1)
            p = kept / np.maximum(parent_f[:, up], 1) + left[:, up] * (share / shares[up])
            log_p = np.where(same, 0.0, np.log(p))
            self.levels.append((table, log_p.astype(np.float32), np.log(left / shares).astype(np.float32)))
            parent, parent_f = back, f
        del stems
        often = np.flatnonzero(total >= 2)
        again = again.reshape(-1)
        self.heads, head_of = np.unique(before, return_inverse=True)
        head_of = head_of.reshape(-1)
        triple = np.zeros(len(pair), U)
        triple[1:] = np.where(words.text[1:] == words.text[:-1], pair[:-1], U(0))
        triple = mixed64(triple * U(0x9E3779B97F4A7C15) + words.whole)
        by_class, head_counts = np.zeros((2, len(often))), np.zeros((2, len(self.heads)))
        for c in (0, 1):
            mine = np.flatnonzero(which == c)
            mine = mine[np.unique(triple[mine], return_index=True)[1]]
            by_class[c] = np.bincount(again[mine], minlength=len(distinct))[often]
            head_counts[c] = np.bincount(head_of[mine], minlength=len(self.heads))
        del triple
        self.pairs = distinct[often]
        head = head_of[first[often]]
        disc = np.maximum(by_class - DISCOUNT, 0) / np.maximum(head_counts[:, head], 1)
        self.pair = disc.astype(np.float32)
        self.head_left = np.stack([1 - np.bincount(head, disc[c], minlength=len(self.heads)) for c in (0, 1)]).astype(np.float32)

    def log_p(self, hashes: np.ndarray) -> np.ndarray:
        """log P(word) in either class, up to what is the same in both for words with unknown ends."""
        out = np.zeros((2, hashes.shape[1]))
        open_ = np.ones(hashes.shape[1], bool)
        parent = np.zeros(hashes.shape[1], np.int64)
        for k, (table, log_p, log_new) in enumerate(self.levels):
            at, hit = _look(table, hashes[k])
            go = open_ & hit
            out[:, go] += log_p[:, at[go]]
            stop = open_ & ~hit
            out[:, stop] += log_new[:, parent[stop]]
            open_ &= hit
            parent = at
        return out

    def log_ratio(self, words: Words) -> np.ndarray:
        """log P(word | toxic model) - log P(word | ordinary model) of each word."""
        pair, before = _pairs(words.whole, words.text)
        _, first, back = np.unique(words.whole, return_index=True, return_inverse=True)
        p = np.exp(self.log_p(words.stems(first)))[:, back.reshape(-1)]
        at, hit = _look(self.heads, before)
        p = p * np.where(hit, self.head_left[:, at] if len(self.heads) else 1.0, 1.0)
        at, hit = _look(self.pairs, pair)
        p = p + np.where(hit, self.pair[:, at] if len(self.pairs) else 0.0, 0.0)
        return np.log(p[1]) - np.log(p[0])


def normalised(ratio: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The length-normalised comparison of each text, 0 for one without words.

    A toxic text is taken to have each word from the toxic model with the probability SHARE and from
    the ordinary one otherwise. The log-likelihood of that less the ordinary one, divided by the root
    of the number of words, so that chance moves long and short texts alike.
    """
    gain = np.log1p(SHARE * np.expm1(np.minimum(ratio, 50)))
    return np.bincount(text, gain, minlength=n) / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))


def _inputs(comparison: np.ndarray) -> np.ndarray:
    """What the calibration sees: a function of the comparison that rises everywhere (a logarithm above 0, a line below), and a constant."""
    rising = np.log(0.01 + np.maximum(comparison, 0)) + np.minimum(comparison, 0)
    return np.stack([rising, np.ones(len(comparison))], axis=1)


def fit_toxicity(rows: pd.DataFrame, sizes: dict[int, int]) -> dict:
    """Models from all the sample; the calibration from comparisons by models that did not see the text."""
    found = words(pa.array(rows["text"], pa.large_string()))
    text = found.text
    label = rows["label"].to_numpy()
    n = len(label)
    if len(set(label.tolist())) < 2:
        return {"models": None, "scale": np.array([0.0, 4.0 if label.mean() > 0.5 else -4.0])}
    fold, value = np.arange(n) % FOLDS, np.zeros(n)
    for k in range(FOLDS):
        if len(set(label[fold != k].tolist())) < 2:
            continue
        part = found.only((fold == k)[text])
        value[fold == k] = normalised(KneserNey(found.only((fold != k)[text]), label).log_ratio(part), part.text, n)[fold == k]
    sampled = np.bincount(label, minlength=2)
    weight = np.array([sizes.get(c, 0) / max(1, sampled[c]) for c in (0, 1)])[label]
    scale = logistic(_inputs(value), label.astype(float), weight / weight.mean(), 1e-4)
    return {"models": KneserNey(found, label), "scale": np.array([max(scale[0], 1e-6), scale[1]])}


def score_texts(model: dict | None, column: pa.Array) -> np.ndarray:
    n = len(column)
    if model is None:
        return np.full(n, 0.5)
    if model["models"] is None:
        return np.full(n, sigmoid(model["scale"][-1]))
    found = words(column)
    return sigmoid(_inputs(normalised(model["models"].log_ratio(found), found.text, n)) @ model["scale"])


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2500, threshold: float = 0.5, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic), predicted (1 from ``threshold`` on) and held_out.

    The score is a rising function of :func:`normalised` alone. Fits on at most ``per_class`` documents
    of each label, drawn by hash from the rows that may be
    learnt from, and scores every whole text. Only the text is looked at. Null and empty texts have
    no words and get the score of no evidence; without labels every score is 0.5; repeated rows are
    scored each; an empty table gives no rows. Columns of ``docs`` stay, but for the three ``names``.
    """
    sample, sizes = labelled(docs, labels, "toxic", per_class)
    model = fitted(sample, lambda rows: fit_toxicity(rows, sizes))
    return scored(docs, lambda column: score_texts(model, column), threshold, names)
