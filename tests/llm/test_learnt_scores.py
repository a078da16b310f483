"""The learnt scores against plain versions on small tables, and their held-out figures."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality_crf, toxicity as kn

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_model(texts, labels):
    """Class-conditional P(word | word before) by dictionaries, and the mass of unknown words."""
    tokens = [[w.lower() for w in re.findall("[A-Za-z0-9']+", t)] for t in texts]
    before, triples = (collections.defaultdict(lambda: [set(), set()]) for _ in range(2))
    times = collections.Counter()
    for t, c in zip(tokens, labels, strict=True):
        for i, w in enumerate(t):
            h, hh = (t[i - 1] if i else None), (t[i - 2] if i > 1 else None)
            before[w][c].add(h)
            triples[h, w][c].add((hh, h))
            times[h, w] += 1
    path = lambda w: [w[:n] if len(w) > n else f"{w}$" for n in kn.STEMS]
    f = [collections.Counter() for _ in range(2)]
    children, share = collections.defaultdict(set), {}
    for w, by in before.items():
        up = "root"
        for node in dict.fromkeys(path(w)):
            children[up].add(node)
            for c in (0, 1):
                f[c][node] += len(by[c])
            up = node
    for c in (0, 1):
        f[c]["root"] = max(1, sum(len(by[c]) for by in before.values()))
    share = {n: 2 * min(f[0][n], f[1][n]) + 1 for up in children for n in children[up]}
    shares = {up: sum(share[n] for n in children[up]) + 1 for up in children}
    kept = lambda c, n: max(f[c][n] - kn.RARE, 0)
    left = lambda c, up: min(1, max(1e-9, 1 - sum(kept(c, n) for n in children[up]) / max(f[c][up], 1)))

    def word(c, w):
        p, up = 1.0, "root"
        for node in dict.fromkeys(path(w)):
            if node not in children[up]:
                return p * left(c, up) / shares[up]
            p *= kept(c, node) / max(f[c][up], 1) + left(c, up) * share[node] / shares[up]
            up = node
        return p

    heads = collections.defaultdict(lambda: [0, 0])
    for (h, _), by in triples.items():
        for c in (0, 1):
            heads[h][c] += len(by[c])
    own = lambda c, h, w: max(len(triples[h, w][c]) - kn.DISCOUNT, 0) / max(heads[h][c], 1) if (h, w) in triples and times[h, w] > 1 else 0.0

    def given(c, h, w):
        if h not in heads:
            return word(c, w)
        return own(c, h, w) + (1 - sum(own(c, h, x) for g, x in list(triples) if g == h)) * word(c, w)

    def unknown(c):
        """What words never seen get, over all the places where they can leave the tree."""
        total, todo = 0.0, [("root", 1.0)]
        while todo:
            up, p = todo.pop()
            if not children[up]:
                continue
            total += p * left(c, up) / shares[up]
            todo += [(n, p * (kept(c, n) / max(f[c][up], 1) + left(c, up) * share[n] / shares[up])) for n in children[up]]
        return total

    return given, unknown, list(before)


def test_kneser_ney_by_brute_force():
    rng = random.Random(4)
    vocabulary = ["the", "stone", "stones", "stonework", "river", "riverside", "a", "an", "otherwise", "others", "it's", "90"]
    texts = [" ".join(rng.choice(vocabulary[: 12 if i % 2 else 9]) for _ in range(120)) for i in range(8)]
    labels = [i % 2 for i in range(8)]
    model = kn.KneserNey(kn.words(pa.array(texts, pa.large_string())), np.array(labels))
    given, unknown, known = plain_model(texts, labels)
    for c in (0, 1):
        for h in ("stone", "never", None):
            # unknown words share the head's remaining mass as all words do
            seen = sum(given(c, h, w) for w in known)
            back = (given(c, h, "zzz") / given(c, None if h == "never" else "never", "zzz")) if h != "never" else 1.0
            assert math.isclose(seen + back * unknown(c), 1, rel_tol=1e-6)
    asked = ["The stone, stonework! the otherworld", "unknown rivers", "stones a an", "90 the"]
    found = kn.words(pa.array(asked, pa.large_string()))
    want = []
    for t in asked:
        before = None
        for w in re.findall("[A-Za-z0-9']+", t.lower()):
            want.append(math.log(given(1, before, w)) - math.log(given(0, before, w)))
            before = w
    assert np.allclose(model.log_ratio(found), want, atol=1e-4)


def test_comparison_is_length_normalised():
    ratio, text = np.array([6.0, 0.0, 0.0, 0.0, 6.0, 6.0]), np.array([0, 0, 0, 0, 2, 2])
    got = kn.normalised(ratio, text, 4)
    one = math.log(1 + kn.SHARE * (math.exp(6) - 1))
    assert np.allclose(got, [one / 2, 0, 2 * one / math.sqrt(2), 0])


@pytest.mark.parametrize(("score", "label"), [(kn.toxicity, "toxic"), (quality_crf.quality, "quality")])
def test_held_out_figures(spark, score, label):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = score(documents, labels).where("held_out").join(labels, "doc_id").where(F.col(label).isNotNull())
    n = {(r[label], r.predicted): r["count"] for r in got.groupBy(label, "predicted").count().collect()}
    caught, missed, right, wrong = (n.get(k, 0) for k in ((1, 1), (1, 0), (0, 0), (0, 1)))
    assert caught >= 0.85 * (caught + missed) and right >= 0.9 * (right + wrong)


@pytest.mark.parametrize("score", [kn.toxicity, quality_crf.quality])
def test_repeated_rows_and_own_columns(spark, score):
    rows = [(1, "some words here\nand there", "en", "s", 1)] * 3 + [(None, None, None, None, None), (2, "x " * 200_000, "en", "s", 1), (3, "a\n" * 50_000, "en", "s", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumns({"predicted": F.lit("own"), "a.b": F.lit(1)})
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score(table, labels, names=("s1", "p1", "h1")).collect()
    assert len(got) == 6 and all(r.predicted == "own" and 0 <= r.s1 <= 1 for r in got)
    assert len({r.s1 for r in got if r.doc_id == 1}) == 1


def plain_lines(text):
    """Own features of each line with a word, and its length."""
    out = []
    lines = [x for x in text.split("\n") if x.split()]
    tokens = [x.split() for x in lines]
    lower = [w.lower() for t in tokens for w in t]
    pairs = collections.Counter(zip(lower, lower[1:], strict=False))
    stripped = [x.strip(" \t\r\x0b\x0c") for x in lines]
    odd, at = set("#$%&*@^~|<>{}[]\\/=+_!"), 0
    marks = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
    for i, (line, words) in enumerate(zip(stripped, tokens, strict=True)):
        low, size = [w.lower() for w in words], len(line)
        count = lambda test: sum(map(test, line))
        before = [lower[at - 1] if at else None, *low[:-1]]
        again = sum(pairs[b, w] > 1 for b, w in zip(before, low, strict=True) if b is not None)
        tail = sum(len(w) > 2 and w[-1] in marks and w[-2] in marks for w in words)
        letters = count(str.isalpha)
        out.append(([math.log1p(size) / 5, letters / size, count(str.isupper) / max(letters, 1), count(str.isdigit) / size, count(marks.__contains__) / size,
                     count(odd.__contains__) / size, min(size / len(words), 30) / 10, len(set(low)) / len(words), sum(a == b for a, b in zip(before, low, strict=True)) / len(words),
                     again / len(words), tail / len(words), float(stripped.count(line) > 1), float(i in (0, len(lines) - 1))], size))
        at += len(words)
    return out


def test_line_features_and_document_odds_by_hand():
    texts = ["The river runs.\n\n  the river RUNS on on 42 \nthe end!! {x}", "one line", "same\nsame\nother words here", "  \n "]
    x, size, text = quality_crf.line_features(pa.array(texts, pa.large_string()))
    want = [plain_lines(t) or [([0.0] * quality_crf.OWN, 0)] for t in texts]
    assert [int((text == k).sum()) for k in range(4)] == [len(w) for w in want]
    flat = [row for w in want for row in w]
    assert np.allclose(x[:, : quality_crf.OWN], [r[0] for r in flat]) and list(size) == [r[1] for r in flat] and (x[:, -1] == 1).all()
    first = np.append(True, text[1:] != text[:-1])
    assert (x[first][:, quality_crf.OWN : 2 * quality_crf.OWN] == 0).all()
    assert np.allclose(x[1:][~first[1:]][:, quality_crf.OWN : 2 * quality_crf.OWN], x[:-1][~first[1:]][:, : quality_crf.OWN])
    good = np.linspace(0.1, 0.9, len(text))
    odds = quality_crf.document_odds(good, size, text, 4)
    for k in range(4):
        w = np.maximum(size[text == k], 1)
        mean = (good[text == k] * w).sum() / w.sum()
        assert math.isclose(odds[k], math.log(mean / (1 - mean)), rel_tol=1e-9)


def test_marginals_of_many_lines():
    """Long chains agree with sums that go line by line."""
    rng = np.random.default_rng(0)
    text = np.sort(rng.integers(0, 20, 300))
    odds, chain = rng.standard_normal(300) * 3, rng.standard_normal((2, 2))
    good, expected = quality_crf.marginals(odds, text, chain)
    seen = np.zeros((2, 2))
    for t in np.unique(text):
        own = np.stack([np.zeros((text == t).sum()), odds[text == t]], axis=1)
        n = len(own)
        f, b = own.copy(), np.zeros((n, 2))
        for i in range(1, n):
            f[i] = own[i] + np.logaddexp(f[i - 1, 0] + chain[0], f[i - 1, 1] + chain[1])
        for i in range(n - 2, -1, -1):
            b[i] = np.logaddexp(chain[:, 0] + own[i + 1, 0] + b[i + 1, 0], chain[:, 1] + own[i + 1, 1] + b[i + 1, 1])
            seen += np.exp(f[i][:, None] + chain + (own[i + 1] + b[i + 1])[None] - np.logaddexp(*(f[i] + b[i])))
        assert np.allclose(good[text == t], 1 / (1 + np.exp(f[:, 0] + b[:, 0] - f[:, 1] - b[:, 1])))
    assert np.allclose(expected, seen)
