"""Language-model scoring with a probabilistic suffix tree over the whole training part."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import ASK, COUNT, answer_counts, ask_counts, bucket_of, count_buckets, pack, read, unpack, word_batches
from factloom.llm.common import saved
from factloom.llm.spans import mixed64, sums_by_text

U = np.uint64
END = np.array([0x9D39247E33776D41], U)
#: Occurrences a context needs to be a candidate; weight of the shorter context in a longer one's
#: distribution; nats that a context must gain; occurrences from which its followers are dealt.
LEAST, PRIOR, GAIN, HOT = 4, 2.0, 2.0, 1 << 18
#: Contexts that are tested by parts, of one length, are about so many at most.
MOST_HOT = 1 << 22
#: Bytes of a word's hash in questions about words and about followers.
WIDE, NARROW = 8, 6
#: Tokens of the longest contexts; bytes of text that a task walks at once.
DEPTH, BATCH = 3, 8_000_000
ALPHA = 0.1
#: Steps of a nat in which a follower's cost travels, a byte each.
COST = 4


class Batch(NamedTuple):
    """Positions of a batch: every word and one end for each document, as codes into ``words``."""

    words: np.ndarray
    code: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    train: np.ndarray
    n_docs: int


def load(row: pd.Series) -> Batch:
    words, codes = read(row["words"], U), read(row["codes"], np.uint32).astype(np.int64)
    counts, marks = read(row["counts"], np.int32).astype(np.int64), read(row["marks"], np.uint8).astype(bool)
    at = int(np.searchsorted(words, END[0]))
    words = np.insert(words, at, END[0])
    codes = codes + (codes >= at)
    code = np.insert(codes, np.cumsum(counts), at)
    length = counts + 1
    doc = np.repeat(np.arange(len(counts)), length)
    place = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    return Batch(words, code, doc, place, marks[doc], len(counts))


def gather_answers(rows: pd.DataFrame, column: str) -> bytes | list[bytes]:
    return list(rows.sort_values("bucket")[column])


class Pairs(NamedTuple):
    """Distinct (context, follower) pairs of a batch for one context length, sorted by context hash.

    ``contexts`` are the sorted hashes, ``n_follow`` the pairs of each, ``x`` the follower's code of
    each pair, ``of`` the pair of each position asked about (``at``).
    """

    contexts: np.ndarray
    n_follow: np.ndarray
    x: np.ndarray
    count: np.ndarray
    at: np.ndarray
    of: np.ndarray
    first: np.ndarray


def pairs(batch: Batch, ctx: np.ndarray, ok: np.ndarray) -> Pairs:
    """Pairs of the positions ``ok`` with the context hashes ``ctx``."""
    at = np.flatnonzero(ok)
    contexts, c = np.unique(ctx[at], return_inverse=True)
    both, first, of = np.unique(c.reshape(-1).astype(np.int64) << 32 | batch.code[at], return_index=True, return_inverse=True)
    count = np.bincount(of.reshape(-1), batch.train[at].astype(float), minlength=len(both)).astype(np.int64)
    return Pairs(contexts, np.bincount(both >> 32, minlength=len(contexts)), both & 0xFFFFFFFF, count, at, of.reshape(-1), at[first])


def slices(batch: Batch, p: Pairs, n_hot: np.ndarray, hot_from: int, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, contexts, pairs) of each bucket that the batch asks; the followers of hot contexts are
    dealt to the more buckets the more occurrences they have."""
    if not len(p.x):
        return []
    owner = np.repeat(np.arange(len(p.contexts)), p.n_follow)
    parts = np.clip(4 * n_hot // hot_from, 1, buckets)
    part = (batch.words[p.x] >> U(32)).astype(np.int64) % parts[owner]
    bucket = (bucket_of(p.contexts, buckets)[owner] + part * (buckets // parts)[owner]) % buckets
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
    out = []
    for i, j in zip(first, np.append(first[1:], len(order)), strict=True):
        mine = order[i:j]
        who = owner[mine]
        out.append((int(bucket[mine[0]]), who[np.append(True, who[1:] != who[:-1])], mine))
    return out


ASK_PAIRS = "bucket int, batch long, contexts binary, n_hot binary, n_follow binary, x binary, counts binary, cost binary"


def ask_pairs(number: int, batch: Batch, p: Pairs, n_hot: np.ndarray, parent: np.ndarray, hot_from: int, buckets: int) -> pd.DataFrame:
    """Questions: contexts, occurrences of the hot ones (0 of others), followers, training counts, and -log P(follower | shorter context) in quarters of nats,
    up to 63.75: no probability of a corpus under 10 ** 27 tokens is smaller."""
    cost = np.clip(np.round(-np.log(parent[p.first]) * COST), 0, 255).astype(np.uint8)
    rows = []
    owner = np.repeat(np.arange(len(p.contexts)), p.n_follow)
    for b, who, mine in slices(batch, p, n_hot, hot_from, buckets):
        n = np.diff(np.append(np.flatnonzero(np.append(True, owner[mine][1:] != owner[mine][:-1])), len(mine)))
        rows.append((b, number, p.contexts[who].tobytes(), pack(n_hot[who], 6), pack(n, 4), pack(batch.words[p.x[mine]], NARROW), pack(p.count[mine], COUNT), cost[mine].tobytes()))
    return pd.DataFrame(rows, columns=["bucket", "batch", "contexts", "n_hot", "n_follow", "x", "counts", "cost"])


def answer_pairs(asked: DataFrame) -> DataFrame:
    """Corpus counts of the pairs asked for, and which contexts the test keeps.

    The test is the divergence of a context's followers from the shorter context's distribution,
    each follower judged by the other occurrences alone: with N occurrences, the sum over followers
    of c * log(((c - 1) / (N - 1 + PRIOR)) / P(x | shorter)), and log(PRIOR / (N - 1 + PRIOR)) for
    followers seen once. A context stays if that reaches GAIN nats.

    A hot context's bucket sees only some of its followers: its occurrences come with the question, and
    a row without a batch holds such contexts as ``counts`` and their parts of the sum as ``kept``.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        contexts = [read(x, U) for x in rows["contexts"]]
        follow = [unpack(x, 4).astype(np.int64) for x in rows["n_follow"]]
        x = [unpack(v, NARROW) for v in rows["x"]]
        names, name = np.unique(np.concatenate(contexts), return_inverse=True)
        owner = np.repeat(name.reshape(-1), np.concatenate(follow))
        both, first, of = np.unique(mixed64(names[owner] ^ mixed64(np.concatenate(x))), return_index=True, return_inverse=True)
        of = of.reshape(-1)
        c = np.bincount(of, np.concatenate([unpack(v, COUNT) for v in rows["counts"]]).astype(float), minlength=len(both))
        who = owner[first]
        n_hot = np.zeros(len(names), np.int64)
        n_hot[name.reshape(-1)] = np.concatenate([unpack(v, 6) for v in rows["n_hot"]])
        n = np.where(n_hot > 0, n_hot, np.bincount(who, c, minlength=len(names)))[who]
        cost = np.concatenate([read(v, np.uint8) for v in rows["cost"]])[first] / COST
        rest = np.log(np.maximum(n - 1 + PRIOR, 1e-9))
        gain = np.where(c >= 2, c * (np.log(np.maximum(c - 1, 1)) - rest + cost), np.where(c == 1, np.log(PRIOR) - rest, 0.0))
        gain = np.bincount(who, gain, minlength=len(names))
        kept = ((gain >= GAIN) & (n_hot == 0))[name.reshape(-1)]
        ctx_edges, pair_edges = np.cumsum([0, *map(len, contexts)]), np.cumsum([0, *map(len, x)])
        cut = lambda e: list(zip(e, e[1:], strict=False))
        part = pd.DataFrame({"batch": [None], "bucket": rows["bucket"].iloc[:1].to_list(), "counts": [names[n_hot > 0].tobytes()], "kept": [gain[n_hot > 0].tobytes()]})
        found = pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "counts": [pack(c[of[i:j]].astype(np.int64), COUNT) for i, j in cut(pair_edges)],
                             "kept": [kept[i:j].tobytes() for i, j in cut(ctx_edges)]})
        return pd.concat([found.astype({"batch": object}), part]) if n_hot.any() else found

    return asked.groupBy("bucket").applyInPandas(add, "batch long, bucket int, counts binary, kept binary")


def hot_kept(found: DataFrame) -> np.ndarray:
    """Hot contexts that the test keeps, sorted: the sums of their parts over all buckets.

    There is at most one for every ``hot_from`` words of the corpus, so about MOST_HOT in all.
    """

    def parts(rows):
        for part in rows:
            for names, gain in zip(part["counts"], part["kept"], strict=True):
                yield pd.DataFrame({"context": read(names, np.int64), "gain": read(gain, float)})

    gains = found.where("batch is null").select("counts", "kept").mapInPandas(parts, "context long, gain double").groupBy("context").agg(F.sum("gain").alias("gain"))
    return np.sort(np.array([x.context for x in gains.where(F.col("gain") >= GAIN).collect()], np.int64).view(U))


class Totals(NamedTuple):
    n: int
    v: int


def walk(row: pd.Series, answers: pd.DataFrame, totals: Totals, depth: int, buckets: int, hot_from: int, tested: dict[int, np.ndarray]) -> dict:
    """Probabilities of all positions of a batch under contexts up to ``depth``, and the next question's parts."""
    batch = load(row)
    by_round = dict(tuple(answers.groupby("round"))) if len(answers) else {}
    count = np.concatenate([unpack(x, COUNT) for x in gather_answers(by_round[0], "counts")]) if 0 in by_round else np.zeros(len(batch.words), U)
    count = count.astype(np.int64)
    base = (count[batch.code] + ALPHA) / (totals.n + ALPHA * (totals.v + 1))
    p, used = base.copy(), np.zeros(len(base), np.int8)
    h = batch.words[batch.code]
    ctx, seen = np.zeros(len(h), U), np.zeros(len(h), np.int64)
    ctx[1:], seen[1:] = h[:-1], count[batch.code[:-1]]
    part, n_hot, extends = None, None, np.ones(len(h), bool)
    for k in range(1, depth + 1):
        ok = (batch.place >= k) & (seen >= LEAST) & extends
        part = pairs(batch, ctx, ok)
        owner = np.repeat(np.arange(len(part.contexts)), part.n_follow)
        n_ctx = np.zeros(len(part.contexts), np.int64)
        n_ctx[owner[part.of]] = seen[part.at]
        hot = n_ctx >= hot_from
        n_hot = np.where(hot, n_ctx, 0)
        if k not in tested:
            break
        c, kept = np.zeros(len(part.x), np.int64), hot & np.isin(part.contexts, tested[k])
        if k in by_round:
            got = by_round[k].set_index("bucket")
            for b, who, mine in slices(batch, part, n_hot, hot_from, buckets):
                c[mine] = unpack(got.at[b, "counts"], COUNT)
                kept[who] |= read(got.at[b, "kept"], bool)
        of = owner[part.of]
        use = kept[of]
        at = part.at[use]
        p[at] = (c[part.of[use]] + PRIOR * p[at]) / (n_ctx[of[use]] + PRIOR)
        used[at] = k
        pair_count = np.zeros(len(h), np.int64)
        pair_count[part.at] = c[part.of]
        longer, seen = np.zeros(len(h), U), np.zeros(len(h), np.int64)
        longer[1:], seen[1:] = mixed64(ctx[:-1] * U(0x9E3779B97F4A7C15) + h[:-1]), pair_count[:-1]
        ctx = longer
        if k > 1:
            extends = np.zeros(len(h), bool)
            extends[at] = True
    return {"batch": batch, "base": base, "count": count, "p": p, "used": used, "part": part, "n_hot": n_hot}


def suffix_tree_scores(docs: DataFrame, held_out: str | None = None, depth: int = DEPTH, hot_from: int = HOT) -> DataFrame:
    """Scores every whole text of ``docs`` by a suffix tree learnt from the rows not ``held_out``.

    Tokens are runs of non-blanks with A-Z lower-cased, and one end for each text. The root gives a
    token (c + 0.1) / (N + 0.1 (V + 1)). A context of up to ``depth`` tokens is a candidate from 4
    occurrences on; from three tokens on its suffix must have stayed as well, and what it has before its last
    token must have been a candidate. It stays by the test of :func:`answer_pairs`; its distribution adds 2 virtual
    occurrences shared out as its longest kept suffix does, so it sums to 1 over all tokens and the
    unknown one. Each token is scored in the longest kept suffix of what stands before it in the
    text. Lengths are asked about one after the other, until no text has a candidate of the next one.
    The followers of contexts from 262,144 occurrences on (``hot_from``, or the corpus' words / 2^22 if
    that is more) are dealt to several buckets and their parts of the test are added; the test is the same.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the
    text's probability), mean_depth (of the contexts used).

    All counts are over the whole training part and are joined by hash from bucketed answers;
    nothing that grows with the corpus is broadcast or collected but N, V and at most about 4 million
    kept contexts of ``hot_from`` occurrences on. Words are told apart by 64 bits, the followers of a
    context by 48. Null and empty texts
    consist of their end; repeated rows are scored and counted each; without training rows every
    token is unknown; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    learn = docs.select("doc_id", "text", ((~F.col(held_out)) if held_out else F.lit(True)).alias("_learn"))
    batches = word_batches(learn, "_learn", size=BATCH)
    buckets = count_buckets(batches)

    def ask_words(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            b = load(row)
            out.append(ask_counts(row["batch"], b.words, np.bincount(b.code, b.train.astype(float), minlength=len(b.words)).astype(np.int64), buckets, WIDE))
        return pd.concat(out)

    words = saved(answer_counts(batches.groupBy("batch").applyInPandas(ask_words, ASK), WIDE), "word_counts")
    sums = words.agg(F.sum("n_all").alias("n"), F.sum("n_keys").alias("v")).first()
    totals = Totals(int(sums["n"] or 0), int(sums["v"] or 0))
    hot_from = max(hot_from, totals.n // MOST_HOT)
    answers = words.select("batch", "bucket", "counts", F.lit(None).cast("binary").alias("kept"), F.lit(0).alias("round"))

    def asking(k: int):
        def ask(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, row in rows.iterrows():
                w = walk(row, got, totals, k, buckets, hot_from, tested)
                out.append(ask_pairs(row["batch"], w["batch"], w["part"], w["n_hot"], w["p"], hot_from, buckets))
            return pd.concat(out) if out else pd.DataFrame(columns=["bucket", "batch", "contexts", "n_hot", "n_follow", "x", "counts", "cost"])

        return ask

    tested: dict[int, np.ndarray] = {}
    for k in range(1, depth + 1):
        asked = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(asking(k), ASK_PAIRS)
        found = saved(answer_pairs(asked), "pair_counts")
        if found.isEmpty():
            break
        tested[k] = hot_kept(found)
        answers = answers.unionByName(found.where("batch is not null").withColumn("round", F.lit(k)))

    def score(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            w = walk(row, got, totals, depth, buckets, hot_from, tested)
            b = w["batch"]
            tokens = np.bincount(b.doc, minlength=b.n_docs)
            out.append(pd.DataFrame({
                "doc_id": list(row["doc_ids"]), "held_out": ~read(row["marks"], np.uint8).astype(bool), "n_tokens": tokens,
                "n_known": sums_by_text((w["count"][b.code] > 0).astype(np.int64), b.doc, b.n_docs), "train_tokens": totals.n,
                "base_score": np.bincount(b.doc, np.log10(w["base"]), minlength=b.n_docs), "score": np.bincount(b.doc, np.log10(w["p"]), minlength=b.n_docs),
                "mean_depth": np.bincount(b.doc, w["used"], minlength=b.n_docs) / tokens}))
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_depth"]
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_depth double"
    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(score, schema)
