"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.fitting import NAMES, fitted, labelled, logistic, scored, sigmoid
from factloom.llm.spans import LOWER, mixed64, span_hashes, sums_by_text, text_bytes, word_spans

U = np.uint64
OWN = 13


def _classes() -> dict[str, np.ndarray]:
    out = {k: np.zeros(256, np.int32) for k in ("upper", "letter", "digit", "mark", "odd")}
    out["upper"][65:91] = 1
    out["letter"][[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 1
    out["digit"][48:58] = 1
    out["mark"][[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
    out["odd"][[*b"#$%&*@^~|<>{}[]\\/=+_!"]] = 1
    return out


_CLASS = _classes()


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs again, and the index of one occurrence of each."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice, head = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    head[1:] = ~same
    out = np.empty(len(keys), bool)
    out[order] = twice
    return out, order[head]


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the number of its text.

    Lines end at line feeds; lines without a word are left out, and a text without any other line
    has one empty line. Own features: length, shares of letters, capitals, digits, marks and odd
    marks, words' mean length, share of distinct words, of words that repeat the word before, of
    word pairs that stand elsewhere in the document too, of words with two marks at their end,
    whether the line repeats, and one for the first or last line. The features of the line before
    and after (zeros at the ends) follow, then a constant.
    """
    body, offsets = text_bytes(column)
    n = len(offsets) - 1
    starts, ends, text = word_spans(body, offsets)
    feeds = np.concatenate([[0], np.cumsum(body == 10)])
    line_of = feeds[starts] + text  # rises with every line feed and every text
    new = np.ones(len(starts), bool)
    new[1:] = line_of[1:] != line_of[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    rows = len(first)
    a, b, words = starts[first] if rows else starts, ends[last] if rows else ends, (last - first + 1).astype(float)
    size = (b - a).astype(float)
    where = np.cumsum(new) - 1
    by_line = lambda x: np.bincount(where, x, minlength=rows)[:rows]
    count = {}
    for k, table in _CLASS.items():
        sums = np.concatenate([[0], np.cumsum(table[body], dtype=np.int64)])
        count[k] = (sums[b] - sums[a]).astype(float)
    hashes = span_hashes(LOWER[body], starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    salt = mixed64(text.astype(U))
    pair = np.zeros(len(starts), U)
    pair[1:] = mixed64(hashes[:-1] * U(3) + hashes[1:]) ^ salt[1:]
    pair_again = np.zeros(len(starts))
    inside = np.zeros(len(starts), bool)
    inside[1:] = text[1:] == text[:-1]
    pair_again[inside] = _repeated(pair[inside])[0]
    own_word = mixed64(hashes ^ where.astype(U) * U(0x9E3779B97F4A7C15))
    distinct = np.zeros(len(starts))
    distinct[_repeated(own_word)[1]] = 1
    mark = _CLASS["mark"].astype(bool)
    tail = mark[body[ends - 1]] & mark[body[np.maximum(ends - 2, starts)]] & (ends - starts > 2) if len(starts) else np.zeros(0)
    line_text = text[first] if rows else text
    line_hash = span_hashes(body, a, b) ^ mixed64(line_text.astype(U))
    edge = np.zeros(rows)
    if rows:
        edge[np.append(True, line_text[1:] != line_text[:-1])] = 1
        edge[np.append(line_text[1:] != line_text[:-1], True)] = 1
    full = np.maximum(size, 1)
    own = np.stack([
        np.log1p(size) / 5, count["letter"] / full, count["upper"] / np.maximum(count["letter"], 1), count["digit"] / full,
        count["mark"] / full, count["odd"] / full, np.minimum(size / np.maximum(words, 1), 30) / 10, by_line(distinct) / np.maximum(words, 1),
        by_line(same) / np.maximum(words, 1), by_line(pair_again) / np.maximum(words, 1), by_line(tail.astype(float)) / np.maximum(words, 1),
        _repeated(line_hash)[0].astype(float), edge], axis=1) if rows else np.zeros((0, OWN))
    empty = np.setdiff1d(np.arange(n), line_text)
    if len(empty):
        line_text = np.concatenate([line_text, empty])
        order = np.argsort(line_text, kind="stable")
        own, size, line_text = np.concatenate([own, np.zeros((len(empty), OWN))])[order], np.concatenate([size, np.zeros(len(empty))])[order], line_text[order]
    before, after = np.zeros_like(own), np.zeros_like(own)
    joined = (line_text[1:] == line_text[:-1])[:, None]
    before[1:] = own[:-1] * joined
    after[:-1] = own[1:] * joined
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1), size, line_text


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms."""
    return np.logaddexp(a[:, :, :1] + b[:, None, 0], a[:, :, 1:] + b[:, None, 1])


def _running(m: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Product of all matrices of the group up to each one, in as many passes as the longest group doubles."""
    out, step = m.copy(), 1
    while step < len(m):
        at = np.flatnonzero(group[step:] == group[:-step]) + step
        if not len(at):
            break
        out[at] = _times(out[at - step], out[at])
        step *= 2
    return out


def marginals(odds: np.ndarray, text: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) by forward and backward sums, and the expected transitions of each kind.

    ``odds`` are the lines' own log-odds, ``text`` the ascending number of each line's text, ``chain``
    the 2 x 2 transition scores. Both sums are running products of 2 x 2 matrices, so a text of many
    lines takes as many passes as its number of lines doubles.
    """
    rows = len(odds)
    own = np.stack([np.zeros(rows), odds], axis=1)
    new = np.append(True, text[1:] != text[:-1])[:rows]
    end = np.append(new[1:], True)[:rows]
    # from line t - 1 to t, and a first line whatever was before
    steps = np.where(new[:, None, None], 0.0, chain) + own[:, None, :]
    forward = _running(steps, text)[:, 0, :]
    # the same from the end, with rows and columns exchanged
    after = np.zeros((rows, 2, 2))
    inside = np.flatnonzero(~end)
    after[inside] = (chain[None] + own[inside + 1][:, None, :]).transpose(0, 2, 1)
    last = np.flatnonzero(end)
    after[last] = np.array([[0.0, 0.0], [-np.inf, -np.inf]])
    with np.errstate(invalid="ignore"):
        backward = _running(after[::-1], text[::-1])[::-1][:, 0, :]
    both = forward + backward
    good = sigmoid(both[:, 1] - both[:, 0])
    total = np.logaddexp(both[inside, 0], both[inside, 1])
    nxt = own[inside + 1] + backward[inside + 1]
    expected = np.exp(forward[inside][:, :, None] + chain[None] + nxt[:, None, :] - total[:, None, None])
    return good, expected.sum(axis=0)


def _train(x: np.ndarray, y: np.ndarray, text: np.ndarray, weight: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient steps (Adam) on the penalised likelihood of ``y``."""
    w, chain = logistic(x, y, weight, 1e-4, 20), np.zeros((2, 2))
    inner = np.flatnonzero(text[1:] == text[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner + 1].astype(int)), 1.0)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        good, expected = marginals(x @ w, text, chain)
        grad = np.concatenate([x.T @ (good - y), (expected - seen).ravel()]) / len(y) + 1e-3 * np.concatenate([w, 10 * chain.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, chain = w - move[: len(w)], chain - move[len(w) :].reshape(2, 2)
    return w, chain


def document_odds(good: np.ndarray, size: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the mean of lines' marginals, weighted by length."""
    weight = np.maximum(size, 1)
    mean = sums_by_text(good * weight, text, n) / np.maximum(sums_by_text(weight, text, n), 1)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit_crf(rows: pd.DataFrame, sizes: dict[int, int], steps: int = 60) -> dict:
    """The model from texts with document labels.

    Lines first take their document's label; a first field then finds the lines of bad documents
    that look good, which are relabelled before the second fit. The logistic of the documents'
    odds is fitted last, with the classes weighted as they are in the whole table.
    """
    x, size, text = line_features(pa.array(rows["text"], pa.large_string()))
    label = rows["label"].to_numpy().astype(float)
    sampled = np.bincount(rows["label"], minlength=2)
    weight = np.array([sizes.get(c, 0) / max(1, sampled[c]) for c in (0, 1)])[rows["label"]]
    if len(set(label)) < 2:
        return {"w": np.zeros(x.shape[1]), "chain": np.zeros((2, 2)), "scale": np.array([0.0, 4.0 if label.mean() > 0.5 else -4.0])}
    balance = np.where(label == 1, 0.5 / max(1, sampled[1]), 0.5 / max(1, sampled[0])) * len(label)
    y = label[text]
    lines = np.bincount(text, minlength=len(label))
    per_line = (balance / np.maximum(lines, 1))[text]
    per_line *= len(per_line) / per_line.sum()
    w, chain = _train(x, y, text, per_line, steps // 2)
    y = np.where((y == 0) & (x @ w > 2), 1.0, y)
    w, chain = _train(x, y, text, per_line, steps)
    odds = document_odds(marginals(x @ w, text, chain)[0], size, text, len(label))
    return {"w": w, "chain": chain, "scale": logistic(np.stack([odds, np.ones(len(odds))], axis=1), label, weight, 1e-4)}


def score_texts(model: dict | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.full(len(column), 0.5)
    x, size, text = line_features(column)
    good, _ = marginals(x @ model["w"], text, model["chain"])
    odds = document_odds(good, size, text, len(column))
    return sigmoid(model["scale"][0] * odds + model["scale"][1])


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.3, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better), predicted (1 from ``threshold`` on) and held_out.

    Fits on at most ``per_class`` documents of each label, drawn by hash from the rows that may be
    learnt from; scores every whole text. Only the text is looked at. Null and empty texts get the
    score of one empty line; without labels every score is 0.5; repeated rows are scored each; an
    empty table gives no rows. Columns of ``docs`` stay, but for those of the three ``names``.
    """
    sample, sizes = labelled(docs, labels, "quality", per_class)
    model = fitted(sample, lambda rows: fit_crf(rows, sizes))
    return scored(docs, lambda column: score_texts(model, column), threshold, names)
