"""Phrases whose words stand together more often than their parts would: collocations for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.batches import bucket_of, bucket_runs, pack, saved_by, unpack
from factloom.llm.common import saved, text_of
from factloom.llm.encoding import runs
from factloom.llm.spans import LOWER, gather, mixed64, span_hashes, text_bytes

#: Bytes of text in a shard, about.
SHARD = 6_000_000
#: Bytes of a key on its way to its bucket; keys that agree in them only let an n-gram go on that need not.
KEY = 3
#: Pieces end at these bytes, words at these and at a space or tab.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_SOLID = ~_BREAK
_SOLID[[32, 9]] = False


def shard_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and piece of each word; pieces are numbered through, a text's end ends a piece."""
    solid = _SOLID[body]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(body))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, text, np.cumsum(_BREAK[body])[starts] + text


def suffix_array(words: np.ndarray, piece: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of word ids in order of their first ``most`` words at least, by prefix doubling.

    A suffix ends with its piece. Returns the places in order, for each the words that it shares with
    the one before (up to ``most``), and the words left in its piece (up to ``most``).
    """
    n = len(words)
    last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if n else np.zeros(0, np.int64)
    left = np.minimum(np.repeat(last, np.diff(np.append(-1, last))) - np.arange(n) + 1, most)
    rank, ranks, width = words.astype(np.int64) + 1, [], 1  # 0 is past the end of a piece
    while True:
        ranks.append((width, rank))
        if width >= most:
            break
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        after[left <= width] = 0
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + after, return_inverse=True)
        rank, width = rank.reshape(-1) + 1, 2 * width
    order = np.argsort(rank, kind="stable")
    # words shared with the one before: greedily by halving widths, as ranks of equal prefixes are equal
    shared, a, b = np.zeros(n, np.int64), order[1:].copy(), order[:-1].copy()
    for width, rank in reversed(ranks):
        x, y = a + shared[1:], b + shared[1:]
        fits = (shared[1:] + width <= left[a]) & (shared[1:] + width <= left[b])
        same = np.zeros(max(0, n - 1), bool)
        same[fits] = rank[x[fits]] == rank[y[fits]]
        shared[1:][same] += width
    return order, np.minimum(shared, most), left[order]


def gram_counts(order: np.ndarray, shared: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each n-gram of ``length`` words: the intervals of suffixes that share so many."""
    long = np.flatnonzero(left >= length)
    if not len(long):
        return long, long
    # shorter suffixes stand before the longer ones that they begin, so an interval is broken by none of them
    head = np.flatnonzero(shared[long] < length)
    return order[long[head]], np.diff(np.append(head, len(long)))


def _mixed(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + other
    return x ^ (x >> np.uint64(29))


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """As ``gather``, about ``block`` bytes at a time, so that the places of all bytes are never held at once."""
    ends = np.cumsum(lengths)
    cuts = np.unique(np.searchsorted(ends, np.arange(block, int(ends[-1]) + 1, block))) if len(ends) else []
    edges = [0, *[int(c) for c in cuts if 0 < c < len(ends)], len(ends)]
    return np.concatenate([gather(flat, starts[i:j], lengths[i:j]) for i, j in zip(edges, edges[1:], strict=False)])


def pair_keys(hashes: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """64-bit keys of the n-grams of ``length`` words that start at ``place``."""
    key = hashes[place]
    for k in range(1, length):
        key = _mixed(key, hashes[place + k])
    return mixed64(key + np.uint64(length))


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """Texts as shards of about ``size`` bytes: ids of words, and the words.

    Columns: shard, langs and their words (totals), and as packed bytes: of each distinct word (of one
    lang) its hash, lang, bytes and their number; of the text the place of each word among these, and a
    bit for each word that begins a piece.
    """

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in rows:
            for part in runs(whole, "text", size):
                body, offsets = text_bytes(part.column("text"))
                body = LOWER[body]
                start, end, text, piece = shard_words(body, offsets)
                langs = part.column("lang").dictionary_encode()
                lang = langs.indices.to_numpy().astype(np.int64)[text]
                length = end - start
                flat = np.concatenate([[0], np.cumsum(length)])
                word = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(flat), pa.py_buffer(gather(body, start, length))]).dictionary_encode().indices.to_numpy()
                _, first, code = np.unique(word.astype(np.int64) * len(langs.dictionary) + lang, return_index=True, return_inverse=True)
                seed = mixed64(span_hashes(*_flat(langs.dictionary)))
                hashes = mixed64(span_hashes(body, start[first], end[first]) ^ seed[lang[first]])
                opens = np.append(True, piece[1:] != piece[:-1])[: len(piece)]
                out = (
                    number, langs.dictionary.to_pylist(), np.bincount(lang, minlength=len(langs.dictionary)).tolist(), hashes.tobytes(), lang[first].astype(np.int32).tobytes(),
                    gather(body, start[first], length[first]).tobytes(), length[first].astype(np.int32).tobytes(), pack(code.reshape(-1), 4), np.packbits(opens).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, _SHARD_TYPES, strict=True)], _SHARD_NAMES)
                number += 1

    rows = docs.select(text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return rows.mapInArrow(cut, _SHARD)


_SHARD = "shard long, langs array<string>, totals array<long>, hashes binary, word_lang binary, names binary, lengths binary, codes binary, opens binary"
_SHARD_NAMES = [x.split()[0] for x in _SHARD.split(", ")]
_SHARD_TYPES = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 6]


def _sequence(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of a shard, its text as places in them, and the piece of each word."""
    code = unpack(row["codes"], 4).astype(np.int64)
    return np.frombuffer(row["hashes"], np.uint64), code, np.cumsum(np.unpackbits(np.frombuffer(row["opens"], np.uint8))[: len(code)])


def asked_counts(content: DataFrame, buckets: int, least: int) -> DataFrame:
    """What each shard asks of every bucket of keys: shard, bucket, and packed the low three bytes of the keys
    of its distinct words and pairs that fall into the bucket, in order of the keys, and their counts, ``least`` at most."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                hashes, code, piece = _sequence(row)
                found = suffix_array(code, piece, 2)
                grams = [gram_counts(*found, k) for k in (1, 2)]
                keys = np.concatenate([pair_keys(hashes[code], place, k) for k, (place, _) in enumerate(grams, 1)])
                counts = np.minimum(np.concatenate([n for _, n in grams]), least)
                at = np.argsort(keys)
                keys, counts = keys[at], counts[at]
                cuts = bucket_runs(keys, buckets)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(cuts), pa.int64()), pa.array([b for b, _, _ in cuts], pa.int32()),
                    pa.array([pack(keys[i:j], KEY) for _, i, j in cuts], pa.binary()), pa.array([pack(counts[i:j], 4) for _, i, j in cuts], pa.binary())], ["shard", "bucket", "keys", "counts"])

    return content.select("shard", "hashes", "codes", "opens").mapInArrow(ask, "shard long, bucket int, keys binary, counts binary")


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body, offsets = text_bytes(words)
    return body, offsets[:-1], offsets[1:]


def frequent(asked: DataFrame, least: int) -> DataFrame:
    """For each shard and bucket, a bit for each key asked for: whether its count over all shards may reach ``least``.

    Two keys of a bucket that agree in their low three bytes are counted together, so the answer is yes for
    every key that reaches it; the strings decide later.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x, KEY) for x in rows["keys"]]
        edges = np.cumsum([0, *map(len, keys)])
        _, back = np.unique(np.concatenate(keys).astype(np.uint32), return_inverse=True)
        back = back.reshape(-1)
        total = np.bincount(back, np.concatenate([unpack(x, 4) for x in rows["counts"]]).astype(float))
        yes = (total >= least)[back]
        return pd.DataFrame({"shard": rows["shard"], "bucket": rows["bucket"], "kept": [np.packbits(yes[i:j]).tobytes() for i, j in zip(edges, edges[1:], strict=False)]})

    return asked.groupBy("bucket").applyInPandas(add, "shard long, bucket int, kept binary")


def gram_table(docs: DataFrame, most: int = 3, least: int = 10, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, phrase, f, k) of all n-grams of 1 to ``most`` words with f >= ``least``, and words (lang, n) of each lang.

    Each shard sorts its suffixes once for what it asks, words and pairs, and once for what it sends:
    an n-gram goes on only where all its words and pairs may reach ``least`` over the corpus, which
    every n-gram with that count does. What goes on travels packed, a row for each shard and bucket of
    keys, and is counted by its lang and words, whatever their hashes.
    """
    buckets = bucket_count(docs, size)
    content = saved_by(shards(docs, size), "shards", "shard")
    answers = frequent(asked_counts(content, buckets, least), least)
    totals = content.select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))

    def send(texts: pa.Table, kept: pa.Table) -> pa.Table:
        out = []
        bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for _, x in sorted(zip(kept.column("bucket").to_pylist(), kept.column("kept").to_pylist(), strict=True))]
        for row in texts.to_pylist():
            read = lambda c, t: np.frombuffer(row[c], t)  # noqa: B023, E731
            hashes, code, piece = _sequence(row)
            ends = np.cumsum(read("lengths", np.int32).astype(np.int64))
            names, begins = read("names", np.uint8), ends - read("lengths", np.int32)
            order, shared, left = suffix_array(code, piece, max(2, most))
            ones, twos = (gram_counts(order, shared, left, k) for k in (1, 2))
            keys = np.concatenate([pair_keys(hashes[code], p, k) for k, (p, _) in ((1, ones), (2, twos))])
            at = np.argsort(keys)
            # packed bits of a bucket are filled up to whole bytes
            runs_ = bucket_runs(keys[at], buckets)
            yes = np.empty(len(keys), bool)
            yes[at] = np.concatenate([b[: j - i] for b, (_, i, j) in zip(bits, runs_, strict=True)]).astype(bool) if runs_ else yes[at]
            # whether the pair (word) that starts at each place goes on, spread from the first of its interval to all
            word_ok = np.zeros(len(hashes), bool)
            word_ok[code[ones[0]]] = yes[: len(ones[0])]
            pair_ok = np.zeros(len(code), bool)
            members = order[left >= 2]
            pair_ok[members] = np.repeat(yes[len(ones[0]) :], twos[1])
            langs, lang = row["langs"], read("word_lang", np.int32)
            solid = np.concatenate([names, np.frombuffer(b" \n", np.uint8)])
            space, end, bucket, packed = len(names), len(names) + 1, [], []
            for k in range(1, most + 1):
                place, n = ones if k == 1 else twos if k == 2 else gram_counts(order, shared, left, k)
                good = word_ok[code[place]]
                for j in range(1, k):
                    good = good & word_ok[code[place + j]] & pair_ok[place + j - 1]
                place, n = place[good], n[good]
                # words and the spaces between them, a line feed at the end, one span after another
                words = np.stack([code[place + j] for j in range(k)], 1)
                starts = np.full((len(place), 2 * k), space, np.int64)
                starts[:, -1] = end
                sizes = np.ones((len(place), 2 * k), np.int64)
                starts[:, ::2], sizes[:, ::2] = begins[words], (ends - begins)[words]
                packed.append((gathered(solid, starts.ravel(), sizes.ravel()), sizes.sum(1), lang[words[:, 0]], n))
                bucket.append(bucket_of(pair_keys(hashes[code], place, k), buckets))
            if not sum(map(len, bucket)):
                continue
            bucket, (text, length, lang, n) = np.concatenate(bucket), (np.concatenate(x) for x in zip(*packed, strict=True))
            at = np.argsort(bucket, kind="stable")  # inside a bucket n-grams that begin alike stay together
            text = gathered(text, (np.cumsum(length) - length)[at], length[at])
            length, lang, n = length[at], lang[at].astype(np.int32), n[at]
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[at]) != 0)), len(at))
            edges = np.concatenate([[0], np.cumsum(length)])[cuts]
            for i, j, a, b in zip(cuts, cuts[1:], edges, edges[1:], strict=False):
                body = pack(lang[i:j].astype(np.int64), 4) + pack(n[i:j].astype(np.int64), 6) + text[a:b].tobytes()
                out.append((int(bucket[at[i]]), langs, int(j - i), len(body), pa.compress(body, "zstd", asbytes=True)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _GRAM_TYPES, strict=True)], _GRAM_NAMES)

    def add(rows: pa.Table) -> pa.Table:
        parts = []
        for row in rows.to_pylist():
            body, n = pa.decompress(row["grams"], row["bytes"], "zstd", asbytes=True), row["n"]
            phrase = pa.array(body[10 * n :].decode().split("\n")[:-1], pa.string())
            lang = pa.DictionaryArray.from_arrays(pa.array(unpack(body[: 4 * n], 4).astype(np.int32)), pa.array(row["langs"], pa.string())).dictionary_decode()
            parts.append(pa.table([lang, phrase, pa.array(unpack(body[4 * n : 10 * n], 6).astype(np.int64))], names=["lang", "phrase", "f"]))
        total = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        total = total.filter(pc.greater_equal(total["f_sum"], least))
        k = pc.add(pc.count_substring(total["phrase"], " "), 1).cast(pa.int32())
        return pa.table([total["lang"], total["phrase"], total["f_sum"], k], names=["lang", "phrase", "f", "k"])

    sent = content.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(send, _GRAMS)
    return saved(sent.groupBy("bucket").applyInArrow(add, "lang string, phrase string, f long, k int"), "grams"), totals


#: N-grams of one shard and bucket: how many, and their langs, counts and words, compressed.
_GRAMS = "bucket int, langs array<string>, n int, bytes long, grams binary"
_GRAM_NAMES = [x.split()[0] for x in _GRAMS.split(", ")]
_GRAM_TYPES = [pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.binary()]


def bucket_count(docs: DataFrame, size: int) -> int:
    """Buckets of keys, so that one gets those of about ``size`` / 3 bytes of text; grows with the corpus."""
    total = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    return int(max(8, total // (size // 3)))


def phrases(docs: DataFrame, fewest: int = 2, most: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000, size: int = SHARD) -> DataFrame:
    """Phrases of ``fewest`` to ``most`` words in the order of how much oftener they occur than their parts let expect.

    Columns: lang, rank (from 1), phrase, k (its words), a, l, r, n, score. All is per lang (null:
    ``und``). Texts, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces
    and tabs into words; n counts words, a the occurrences of a phrase within pieces, overlaps
    included. Candidates have a >= ``least``. A cut after the first words leaves parts that occur l
    and r times, and scores floor(1,000,000 a a / (l r)) in exact arithmetic; the lowest cut counts, of equal ones the first.
    A candidate goes if its words lie inside a longer one with a hundredth of ``inside`` times its
    count or more. Each lang's first ``top`` (None: all) by score, count and phrase stay.

    Counting: :func:`gram_table`. Null text is empty; an empty table gives no rows; repeated rows count
    each; other columns are not looked at. Texts, however long, lie in one shard each.
    """
    grams, totals = gram_table(docs, most, least, size)
    split = F.split("phrase", " ", -1)
    part = lambda words, start, length: F.array_join(F.slice(words, start, length), " ")
    longer = grams.where(F.col("k") >= fewest).select("lang", "phrase", F.col("f").alias("a"), "k", split.alias("words"))
    cuts = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    sides = F.explode(F.array(
        F.struct(F.lit("l").alias("side"), part(F.col("words"), F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit("r").alias("side"), part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part"))))
    asked = longer.where("k > 1").select("lang", "phrase", "a", "k", "words", cuts).select("lang", "phrase", "a", "k", "cut", sides.alias("half")).select("lang", "phrase", "a", "k", "cut", "half.side", "half.part")
    met = asked.join(grams.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    count = lambda side, k: F.max(F.when((F.col("side") == side) & (F.col("cut") == k), F.col("f"))).alias(f"{side}{k}")
    both = met.groupBy("lang", "phrase", "a", "k").agg(*[count(s, k) for k in range(1, most) for s in "lr"])
    exact = lambda k: F.expr(f"(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l{k} as decimal(38,0)) * cast(r{k} as decimal(38,0)))")
    lowest = F.array_min(F.filter(F.array(*[F.struct(exact(k).alias("score"), F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, most)]), lambda x: x["l"].isNotNull()))
    scored = both.select("lang", "phrase", "a", "k", lowest.alias("low")).select("lang", "phrase", "a", "k", "low.l", "low.r", "low.score")
    held = F.explode(F.flatten(F.transform(F.sequence(F.lit(fewest), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: part(F.col("words"), i, m)))))
    around = longer.where(F.col("k") > fewest).select("lang", "a", held.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = left.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "k", "a", "l", "r", "n", "score")
