"""Near-duplicates by consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.batches import ASK, COUNT, ask_counts, count_buckets, pack, read, unpack, word_batches
from factloom.llm.common import fresh_names, quoted, removed, saved
from factloom.llm.components import components
from factloom.llm.spans import mixed64

U = np.uint64
SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 8, 3
#: Members that are held against one copy of their centre in a task group.
GROUP = 64
#: Centres of a bucket in a round are so many times those of the round before; shingles of a group held as one table.
WIDER, TABLE = 16, 1 << 15
#: Bytes of text in a batch and words that a bucket gets about; the arrays of either are what a task holds.
BATCH, BUCKET = 10_000_000, 2_000_000
#: Bits of a text's sketch.
SKETCH = 32
#: Tasks that the members of one band are dealt to where they are joined with what is known of the band.
SALTS = 16
#: Weights are whole powers of this, kept in two bytes.
STEP = 1.005


def shingles(row: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a batch; and place in them, document and times of each distinct
    shingle of each document, in order of document and place.

    A shingle is five words in a row; a shorter text is one shingle; an empty one has none.
    """
    words, codes = read(row["words"], U), read(row["codes"], np.uint32)
    counts = read(row["counts"], np.int32).astype(np.int64)
    s = words[codes]
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(s))  # words from here to the text's end
    h = s
    for k in range(1, SHINGLE):
        rest = max(0, len(s) - k)  # words that another one follows k places on
        longer = s[:rest] * U(0x9E3779B97F4A7C15) + h[k:]
        longer ^= longer >> U(29)
        s = np.concatenate([np.where(left[:rest] > k, longer, s[:rest]), s[rest:]])
    start = (left >= SHINGLE) | (left == np.repeat(counts, counts))
    keys, code = np.unique(mixed64(s[start]), return_inverse=True)
    both = np.sort(doc[start] << 32 | code.reshape(-1))
    head = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    return keys, both[head] & 0xFFFFFFFF, both[head] >> 32, np.diff(np.append(head, len(both)))


def asked_pairs(keys: np.ndarray, code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (place of the shingle, sketch of its text) in one number each, and where each place begins in them.

    By a sort: numpy's unique without an inverse hashes, at many times the cost.
    """
    pair = np.sort(code << SKETCH | sketches(keys, code, doc))
    pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
    place = pair >> SKETCH
    return pair, np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])


def sketches(keys: np.ndarray, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of the text of each shingle, 32 bits of its least shingle hash (one min-hash)."""
    first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]
    least = mixed64(keys[code[first]]) >> U(64 - SKETCH)
    return least.astype(np.int64)[np.cumsum(first) - 1]


def kinds_of(distinct: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """How many kinds of texts left so many ``distinct`` sketches (linear counting), so none is lost to equal sketches."""
    cells = 2.0**bits
    return np.round(-cells * np.log1p(-np.minimum(distinct, cells - 1) / cells)).astype(np.int64)


def answer_kinds(asked: DataFrame) -> DataFrame:
    """Answers (batch, bucket, counts): of how many kinds of texts, over all batches, each shingle asked for is."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x, 6) for x in rows["keys"]]
        edges = np.cumsum([0, *map(len, keys)])
        flat, mark = np.concatenate(keys), np.concatenate([unpack(x, COUNT) for x in rows["counts"]])
        del keys
        names, back = np.unique(flat, return_inverse=True)
        back = back.reshape(-1)
        one = np.unique(mixed64(flat ^ mixed64(mark + U(1))), return_index=True)[1]
        kinds = kinds_of(np.bincount(back[one], minlength=len(names))).astype(U)
        return pd.DataFrame({"batch": rows["batch"], "bucket": rows["bucket"], "counts": [pack(kinds[back[i:j]], COUNT) for i, j in zip(edges, edges[1:], strict=False)]})

    return asked.groupBy("bucket").applyInPandas(add, "batch long, bucket int, counts binary")


def weigh(times: np.ndarray, df: np.ndarray, n_texts: int) -> np.ndarray:
    """TF-IDF, times * (1 + ln((1 + n) / (1 + df))), in steps of 0.5 %, df in kinds of texts."""
    idf = 1 + np.log((1 + n_texts) / (1 + np.maximum(df, 1)))
    return np.clip(np.round(np.log(times * np.maximum(idf, 1)) / np.log(STEP)), 0, 65535).astype(np.uint16)


def _uniform(x: np.ndarray, seed: int, third: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Two uniform numbers in (0, 1) of 24 bits for each hash, and on demand a third of the other 16."""
    y = mixed64(x ^ U(seed * 0xD6E8FEB86659FD93 % (1 << 64)))
    u = ((y.view(np.uint32) >> np.uint32(8)).view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
    if not third:
        return u[0::2], u[1::2], None
    low = (y >> U(24) & U(0xFF00) | y & U(0xFF)).astype(np.int32).astype(np.float32)
    return u[0::2], u[1::2], (low + np.float32(0.5)) * np.float32(2.0**-16)


def signatures(hashes: np.ndarray, doc: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted sampling: BANDS * ROWS samples (a hash each) of each document.

    For each shingle k and sample: r, c ~ Gamma(2, 1), b ~ U(0, 1); t = floor(ln w / r + b);
    ln y = r (t - b); ln a = ln c - ln y - r. The sample is (k, t) of the least a: two documents
    agree in it with the probability of their weighted Jaccard similarity.
    """
    out = np.zeros((n, BANDS * ROWS), U)
    log_w = (weights * np.log(STEP)).astype(np.float32)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    who = doc[first]
    size = np.diff(np.append(first, len(doc)))
    if not len(doc):
        return out
    block = 1 << 15
    log_a, t = np.empty(len(doc), np.float32), np.empty(len(doc), np.int32)
    for j in range(BANDS * ROWS):
        for at in range(0, len(doc), block):
            part = slice(at, at + block)
            u1, u2, b = _uniform(hashes[part], 2 * j + 1, True)
            u3, u4, _ = _uniform(hashes[part], 2 * j + 2)
            r, c = -np.log(u1 * u2), -np.log(u3 * u4)
            steps = np.floor(log_w[part] / r + b)
            t[part] = steps
            log_a[part] = np.log(c) - r * (steps - b + 1)
        least = np.repeat(np.minimum.reduceat(log_a, first), size)
        hit = np.flatnonzero(log_a == least)
        hit = hit[np.append(True, doc[hit][1:] != doc[hit][:-1])]
        out[who, j] = mixed64(hashes[hit] ^ mixed64(t[hit].astype(np.int64).view(U) + U(1)))
    return out


def _only(row: pd.Series, uids: pd.Series) -> pd.Series:
    """The batch ``row`` with the words of the documents ``uids`` alone."""
    counts, codes = read(row["counts"], np.int32), read(row["codes"], np.uint32)
    mine = np.zeros(len(counts), bool)
    mine[uids.astype(np.int64).to_numpy() - row["uid"]] = True
    return pd.Series({"words": row["words"], "codes": codes[np.repeat(mine, counts)].tobytes(), "counts": np.where(mine, counts, 0).astype(np.int32).tobytes()})


def _weighed(row: pd.Series, got: pd.DataFrame, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and weights of the shingles of the texts of a batch, from the answers ``got``."""
    keys, code, doc, times = shingles(_only(row, got["uid"].dropna()))
    answers = got[got["uid"].isna()].sort_values("bucket")["counts"]
    df = np.concatenate([unpack(x, COUNT) for x in answers]).astype(np.int64) if len(answers) else np.zeros(0, np.int64)
    # a shingle was asked about once for each of its sketches
    df = df[asked_pairs(keys, code, doc)[1]]
    return keys[code], doc, weigh(times, df[code], n_texts)


def _dealt(rows: DataFrame, salt: str = "salt") -> DataFrame:
    """``rows`` of (band, text) with a salt by the text, which spreads a band over several tasks."""
    return rows.withColumn(salt, F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))


def _every_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def near_groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The near-duplicate class of every document: doc_id, class_id, class_size, kept, uid (a number of the row).

    Weighted Jaccard similarity of TF-IDF shingles of five words (A-Z lower-cased) of ``similar`` or
    more links two documents; classes are the connected parts of verified links; class_id is the
    smallest doc_id and that document is kept.

    Documents with the same words in the same order (by two 64-bit hashes) are one text, and only one
    of them is compared. Document frequencies count texts over all documents, but texts that share
    their least shingle hash once: so a group of thousands of near copies does not make its own
    shingles common, and its members not unlike each other.

    Samples of :func:`signatures` in 8 bands of 3 propose: a pair of similarity 0.8 shares a band
    with probability 0.997. In each band's bucket one text is the centre and every other is held
    against it. Buckets whose members are still apart go on with 16
    times as many centres a round, drawn from all but their largest class, each held against all
    members of other classes that were no centre before. A bucket is done when those that were no
    centre are of one class, so every two documents that share a bucket are of one class or were held
    against each other. A bucket costs its size for each document outside its largest class.

    Null and empty texts have no shingles and are a class each; a text under five words is one
    shingle. Rows that repeat an id come out each, in their text's class; the first of them is kept,
    a null id before all others. An empty table gives no rows. Bands are joined by band and salt, a
    centre is copied for every 64 members, so no task gets a whole large bucket.
    """
    spark, paths = docs.sparkSession, []
    batches = word_batches(docs, paths=paths, size=BATCH)
    buckets = count_buckets(batches, BUCKET)
    places = F.posexplode("doc_ids").alias("place", "doc_id")
    named = batches.select("batch", F.col("uid").alias("first"), "same", places).select(
        "batch", (F.col("first") + F.col("place")).alias("uid"), "doc_id", F.element_at("same", 2 * F.col("place") + 1).alias("same1"), F.element_at("same", 2 * F.col("place") + 2).alias("same2"))
    named = saved(named, "named", paths)
    full = named.where("same1 != 0 or same2 != 0")
    texts = saved(full.groupBy("same1", "same2").agg(F.min(F.struct("uid", "batch")).alias("one")).select("same1", "same2", F.col("one.uid").alias("text"), F.col("one.batch").alias("batch")), "texts", paths)
    n_texts = texts.count()
    asked = texts.select("batch", F.col("text").alias("uid"))

    def ask(rows: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["bucket", "batch", "keys", "counts"])]
        for _, row in rows.iterrows():
            keys, code, doc, _ = shingles(_only(row, mine["uid"]))
            pair, _ = asked_pairs(keys, code, doc)
            out.append(ask_counts(row["batch"], keys[pair >> SKETCH], pair & (1 << SKETCH) - 1, buckets))
        return pd.concat(out)

    questions = batches.groupBy("batch").cogroup(asked.groupBy("batch")).applyInPandas(ask, ASK)
    counted: list[str] = []
    df = saved(answer_kinds(questions), "shingle_counts", counted)
    answers = df.withColumn("uid", F.lit(None).cast("long")).unionByName(asked, allowMissingColumns=True)  # texts in rows of their own

    def sample(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["text", "bands", "weights"])]
        for _, row in rows.iterrows():
            s, doc, w = _weighed(row, got, n_texts)
            mine = got["uid"].dropna().astype(np.int64).to_numpy() - row["uid"]
            bands = signatures(s, doc, w, len(row["doc_ids"]))[mine].reshape(len(mine), BANDS, ROWS)
            key = np.zeros((len(mine), BANDS), U)
            for r in range(ROWS):
                key = mixed64(key * U(0x9E3779B97F4A7C15) + bands[:, :, r] + U(r + 1))
            key = mixed64(key ^ mixed64(np.arange(BANDS).astype(U)))
            a, b = np.searchsorted(doc, mine), np.searchsorted(doc, mine, "right")
            out.append(pd.DataFrame({"text": mine + row["uid"], "bands": list(key.view(np.int64)), "weights": [w[i:j].tobytes() for i, j in zip(a, b, strict=True)]}))
        return pd.concat(out)

    signed = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(sample, "text long, bands array<long>, weights binary")
    signed = saved(signed, "signatures", paths)
    removed(spark, counted)
    banded = _dealt(signed.select("text", F.explode("bands").alias("band")))
    parts = banded.groupBy("band", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("centre"))
    heads = parts.groupBy("band").agg(F.sum("n").alias("n"), F.min("centre").alias("centre"), F.collect_set("salt").alias("salts")).where("n > 1")
    shared = saved(banded.join(heads.select("band", "centre", F.explode("salts").alias("salt")), ["band", "salt"]), "banded", paths)
    members = shared.select("text").distinct().join(texts.select("text", "batch"), "text").join(signed.select("text", "weights"), "text")
    sets = saved(weighted_sets(batches, members), "sets", paths)
    pairs = shared.where("text != centre").select("centre", "text").distinct()
    links = saved(verified(sets, saved(pairs, "pairs", paths), similar), "verified", paths)
    apart, turn = shared.where("text != centre").select("band", "text", "salt"), 0
    roots = shared.select(F.col("text").alias("node")).distinct().withColumn("root", F.col("node"))
    found = links
    while True:
        if not found.isEmpty():
            got = components(links)
            roots = saved(roots.select("node").join(got, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots", paths)
        placed = apart.join(roots, F.col("text") == F.col("node")).select("band", "text", "salt", "root")
        # who was a centre has met all others: a bucket is done when the rest of it is of one class
        classes = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("n", "root")).alias("most"))
        placed = saved(placed.join(_every_salt(classes.where("n > 1").select("band", F.col("most.root").alias("largest"))), ["band", "salt"]), "placed", paths)
        if placed.isEmpty():
            break
        turn += 1
        place = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("text", F.lit(turn)), "text"))
        centres = placed.where("root != largest").withColumn("_r", place).where(F.col("_r") <= WIDER**turn)
        centres = saved(centres.select("band", "text", "salt", "root"), "centres", paths)
        found = saved(tiled(sets, placed, centres, similar), "verified", paths)
        apart = placed.select("band", "text", "salt").join(centres.select("band", "text"), ["band", "text"], "left_anti")
        links = links.unionByName(found)
    out = full.select("uid", "doc_id", "same1", "same2").join(texts.select("same1", "same2", "text"), ["same1", "same2"])
    out = out.join(roots.withColumnRenamed("node", "text"), "text", "left").select("uid", "doc_id", F.coalesce("root", "text").alias("class"))
    alone = named.where("same1 = 0 and same2 = 0").select("uid", "doc_id", F.col("uid").alias("class"))
    every = saved(out.unionByName(alone), "classes")
    removed(spark, paths)
    best = saved(every.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("doc_id", "uid")).alias("best")), "best")
    return every.join(best, "class").select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "uid")


def weighted_sets(batches: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, keys, weights): the shingles of the texts ``wanted`` (text, batch, weights), six bytes a hash, with their weights.

    The weights are those that the signatures were drawn from, in the order of each text's shingles.
    """

    def send(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            if not len(asked):
                continue
            keys, code, doc, _ = shingles(_only(row, asked["text"]))
            s = keys[code]
            for uid, w in zip(asked["text"], asked["weights"], strict=True):
                a, b = np.searchsorted(doc, [uid - row["uid"], uid - row["uid"] + 1])
                out.append((uid, pack(s[a:b] >> U(16), 6), w))
        return pd.DataFrame(out, columns=["uid", "keys", "weights"])

    return batches.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInPandas(send, "uid long, keys binary, weights binary")


def verified(sets: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The ``pairs`` (centre, text) of at least ``similar``, as (a, b).

    A group holds a centre and at most about 64 of its members; a centre of more is in several.
    """
    size = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    dealt = pairs.join(size, "centre").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    members = dealt.select(F.col("text").alias("uid"), "centre", "part")
    heads = dealt.select(F.col("centre").alias("uid"), "centre", "part").distinct()
    met = members.unionByName(heads).join(sets, "uid")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        centre = int(rows["centre"].iloc[0])
        head = rows[rows["uid"] == centre].iloc[0]
        keys, w = unpack(head["keys"], 6), STEP ** read(head["weights"], np.uint16).astype(float)
        out = []
        for uid, k, v in zip(rows["uid"], rows["keys"], rows["weights"], strict=True):
            if uid == centre:
                continue
            other, ow = unpack(k, 6), STEP ** read(v, np.uint16).astype(float)
            at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
            hit = keys[at] == other
            both = np.minimum(w[at[hit]], ow[hit]).sum()
            if both >= (similar - 1e-9) * (w.sum() + ow.sum() - both):
                out.append((centre, int(uid)))
        return pd.DataFrame(out, columns=["a", "b"])

    return met.groupBy("centre", "part").applyInPandas(compare, "a long, b long")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) that join what no earlier pair has joined: all others change no class."""
    over: dict[int, int] = {}
    kept = []

    def top(x: int) -> int:
        while over.setdefault(x, x) != x:
            over[x] = over[over[x]]
            x = over[x]
        return x

    for place, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            over[x] = y
            kept.append(place)
    return np.array(kept, np.int64)


def tiled(sets: DataFrame, members: DataFrame, centres: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) of at least ``similar`` between ``centres`` and ``members`` (band, text, salt, root) of one band and different roots.

    A group holds about 64 of either, so a set travels once for about 64 comparisons. Of the links found in a
    group as many come out as its roots need to be of one class, fewer than it has roots.
    """
    n = lambda name: F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias(name)
    parts = _every_salt(members.groupBy("band").agg(n("rows")).join(centres.groupBy("band").agg(n("columns")), "band"))
    deal = lambda seed, by: F.pmod(F.xxhash64("text", F.lit(seed)), F.col(by)).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    across = members.join(parts, ["band", "salt"]).select("band", "text", "root", deal(1, "rows").alias("row"), each("columns").alias("column"), F.lit(False).alias("centre"))
    down = centres.join(parts, ["band", "salt"]).select("band", "text", "root", each("rows").alias("row"), deal(2, "columns").alias("column"), F.lit(True).alias("centre"))
    met = across.unionByName(down).join(sets.withColumnRenamed("uid", "text"), "text")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        centre, text, root = (rows[c].to_numpy() for c in ("centre", "text", "root"))
        heads, others = np.flatnonzero(centre), np.flatnonzero(~centre)
        both = np.zeros((len(others), len(heads)))
        keys = [unpack(k, 6) for k in rows["keys"]]
        w = [STEP ** read(v, np.uint16).astype(float) for v in rows["weights"]]
        known = np.unique(np.concatenate([keys[i] for i in heads])) if len(heads) else np.zeros(0, U)
        for at in range(0, len(known), TABLE):
            part = known[at : at + TABLE]
            table = np.zeros((len(part), len(heads)))
            for j, i in enumerate(heads):
                lo, hi = np.searchsorted(keys[i], part[0]), np.searchsorted(keys[i], part[-1], "right")
                table[np.searchsorted(part, keys[i][lo:hi]), j] = w[i][lo:hi]
            for j, i in enumerate(others):
                place = np.minimum(np.searchsorted(part, keys[i]), len(part) - 1)
                hit = part[place] == keys[i]
                both[j] += np.minimum(table[place[hit]], w[i][hit, None]).sum(0)
        total = np.array([x.sum() for x in w])
        near = (both >= (similar - 1e-9) * (total[others, None] + total[heads] - both)) & (root[others, None] != root[heads])
        i, j = np.nonzero(near)
        first = forest(root[others[i]], root[heads[j]])
        i, j = i[first], j[first]
        return pd.DataFrame({"a": text[heads[j]], "b": text[others[i]]})

    return met.groupBy("band", "row", "column").applyInPandas(compare, "a long, b long")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, columns as they were, whatever their names.

    Every row is judged by its own number, so rows that repeat an id or have none are told apart; of a
    class the row of the smallest id stays (a null id comes first), of several such the first by
    number. Texts without words are no copies of one another. An empty table gives no rows.
    """
    (row,) = fresh_names(docs, "row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_groups(rows.select(F.col(row).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias(row), "class_id")
    ids = found.join(rows.select(row, "doc_id"), row)
    kept = ids.groupBy("class_id").agg(F.min(F.struct("doc_id", row)).alias("best")).select(F.col(f"best.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*quoted(docs))
