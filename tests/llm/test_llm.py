"""Each operator against a brute-force version on small tables, and its edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import common, queries
from factloom.llm.encoding import encoded
from factloom.llm.exact_dedup import drop_exact_copies, exact_groups
from factloom.llm.mixing import mix, mixed, source_targets
from factloom.llm.near_dedup import drop_near_copies, near_groups
from factloom.llm.packing import hilbert_key, pack
from factloom.llm.quality_crf import marginals, quality
from factloom.llm.spans import span_hashes, text_bytes
from factloom.llm.suffix_tree import COST, DEPTH, GAIN, LEAST, PRIOR, suffix_tree_scores
from factloom.llm.token_counts import Counter, token_counts
from factloom.llm.token_store import find, mph_build, mph_find, read_store, write_store
from factloom.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, nulls, blanks, one very long text, a null and a repeated id."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(rng.randint(5, 120)) for _ in range(40)]
    texts = [*base, base[0], base[0] + " \n", base[1].upper(), base[2] + " one more", base[3] + " and", None, "", " \t", text(30_000), "x", "x"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, None) for i, t in enumerate(texts)]
    rows += [(None, base[5], None, "s1", 3), (3, base[3], "en", "s3", None), (3, base[3], "en", "s3", None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("own"), "target": F.lit(1), "kept": F.lit(2)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- exact dedup


def test_exact_groups_match_sql(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op9_exact_dedup"]).fetchall()
    got = exact_groups(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_groups_edges(spark, docs, empty):
    rows = exact_groups(docs).collect()
    of = lambda i: next(r for r in rows if r.doc_id == i)
    assert len(rows) == docs.count()
    assert of(0).keep_id == 41 and of(40).keep_id == 41 and of(41).kept and of(0).group_size == 3
    assert of(45).keep_id == 47 and of(46).keep_id == 47  # null, empty and blank are equal; the longest stays
    assert of(3).group_size == 3 and [r.kept for r in rows if r.doc_id == 3] == [True] * 3
    assert of(None).keep_id == 5 and of(5).kept and not of(None).kept
    assert exact_groups(empty).count() == 0 == drop_exact_copies(empty).count()
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 0 not in ids and 41 in ids and None not in ids and 5 in ids
    clash = docs.withColumns({c: F.lit("own") for c in ("_plain", "_row", "_key", "a.b")}).withColumn("doc_id", F.col("doc_id").cast("string"))
    kept = drop_exact_copies(clash)
    assert kept.columns == clash.columns and kept.where("_plain = 'own' and _row = 'own' and _key = 'own' and `a.b` = 'own'").count() == len(ids)
    assert exact_groups(clash).count() == len(rows)


def test_exact_groups_compare_bytes(spark, docs):
    """With a hash that all texts share, the bytes still tell them apart."""
    weak = lambda plain: F.substring(F.md5(plain), 1, 1)
    assert sorted(map(str, exact_groups(docs, weak).collect())) == sorted(map(str, exact_groups(docs).collect()))
    assert sorted(map(str, drop_exact_copies(docs, weak).collect())) == sorted(map(str, drop_exact_copies(docs).collect()))


def test_exact_groups_of_repeated_rows_match_sql(spark, docs):
    table = docs.where("doc_id is not null")
    con = duckdb.connect()
    documents = table.toPandas()  # noqa: F841
    con.execute("create table documents as select * from documents")
    want = con.sql(queries.oracle_sql()["op9_exact_dedup"]).fetchall()
    assert sorted(map(tuple, exact_groups(table).collect())) == sorted(want)


# ---- mixing


def test_targets_reach_a_fixed_point(spark):
    rows = [("a", 100, 1), ("b", 1000, 1), ("c", 10, 1), (None, 50, 1), ("d", 0, 1)]
    got = {r.source: r for r in source_targets(spark.createDataFrame(rows, "source string, source_size long, n_docs long")).collect()}
    assert [got[s].weight for s in ("a", "b", "c", "d", None)] == [3, 1, 2, 3, 1]
    assert math.isclose(sum(r.target for r in got.values()), 1.5 * 1160)
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in got.values())
    assert got["a"].target == 200 and got["c"].target == 20 and got["d"].target == 0


def test_mix_is_near_its_targets_and_repeats(spark, docs, empty):
    once, again = ({(r.doc_id, r.size): r for r in mix(d).collect()} for d in (docs, docs.repartition(3)))
    rate = {r.source: r.rate for r in once.values()}
    uniform = lambda r: int(hashlib.md5(f"mix/{'null' if r.doc_id is None else r.doc_id}/{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()[:12], 16) / 16**12
    want = sorted(math.floor(rate[r.source]) + (uniform(r) < rate[r.source] % 1) for r in docs.collect())
    assert sorted(r.repeats for r in mix(docs).collect()) == want
    assert {k: r.taken for k, r in once.items()} == {k: r.taken for k, r in again.items()}
    assert all(r.taken == r.repeats * r.size and r.taken <= 2 * r.size for r in once.values())
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.lit("one"))).collect():
        by[r.source][0] += r.taken
        by[r.source][1] = r.target
    assert all(abs(a - t) <= 0.05 * t for a, t in by.values())
    assert mix(empty).count() == 0 == mixed(empty).count()
    clash = docs.withColumns({c: F.lit("own") for c in ("_size", "_source", "_rate", "_repeats", "_copy", "size", "a.b")})
    assert mixed(clash).columns == clash.columns and mixed(clash).where("_size = 'own' and _copy = 'own'").count() == mixed(docs).count()
    assert mixed(docs).where("doc_id = 10").count() == next(r.repeats for k, r in once.items() if k[0] == 10)


# ---- ids


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.byte_bpe())
    plain.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", None, " ", "a  b", "x \n y", "it's o'k 12,5", "<|endoftext|> x", "　a　 b", "a\n\nb \nc"]
    texts += ["".join(rng.choice(" \n\té1a'., 　…“\x1c\x85") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    ids, n = encoded(queries.byte_bpe(), pa.array(texts), None)
    got = np.split(ids, np.cumsum(n)[:-1])
    assert [list(x) for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_span_hashes_in_blocks_agree():
    from factloom.llm import spans

    rng = np.random.default_rng(0)
    body = rng.integers(97, 100, 3_000_000).astype(np.uint8)
    starts = rng.integers(0, 2_999_000, 5000)
    ends = starts + rng.integers(0, 12, 5000)
    assert (span_hashes(body, starts, ends) == spans._hashes(body, starts, ends)).all()


def want_ids(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.byte_bpe())
    return [(r.doc_id, np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")) for r in docs.select("doc_id", "text").collect()]


def test_pack_covers_every_id_once(docs, empty):
    want = collections.defaultdict(list)
    for doc, ids in want_ids(docs.where("doc_id is not null and doc_id != 3")):
        want[doc].append(ids)
    pieces = pack(docs, queries.byte_bpe()).collect()
    sequences, seen = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        if p.doc_id in want:
            ids = want[p.doc_id][0]
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            assert (np.frombuffer(p.ids, "<u2") == ids[p.start : p.start + p.length]).all()
            seen[p.doc_id].append((p.start, p.length))
    for parts, full in [(sorted(x), None) for x in sequences.values()] + [(sorted(x), len(want[d][0])) for d, x in seen.items()]:
        at = 0
        for start, length in parts:
            assert start == at
            at += length
        assert at == full if full else (at == 1024 or at & (at - 1) == 0)
    assert set(seen) == set(want) and pack(empty, queries.byte_bpe()).count() == 0


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_store_round_trip(spark, docs, empty):
    path = write_store(docs, queries.byte_bpe())
    got = sorted(read_store(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(want_ids(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens) == (at, len(ids)) and (r.doc_id == 3 or r.ids_crc32 == zlib.crc32(ids.tobytes()) and list(r.ids) == list(ids))
        at += len(ids)
    some = spark.createDataFrame([(7, 0), (3, 2), (7, 1), (9999, 0)], "doc_id long, ordinal long")
    assert sorted((r.doc_id, r.ordinal) for r in find(spark, path, some).collect()) == [(3, 2), (7, 0)]
    assert read_store(spark, write_store(empty, queries.byte_bpe())).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64))
    assert sorted(mph_find(keys, *mph_build(keys))) == list(range(len(keys)))
    assert len(mph_find(keys[:3], *mph_build(keys[:0]))) == 3


def test_token_counts_equal_the_library(spark, docs, empty):
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_vocabulary())
    library = Tokenizer(Unigram(vocab=[(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    rng = random.Random(2)
    texts = ["", None, " ", "a", "\n", "a\n\nb", "你好 world 𐍈𐍈", "▁x ▁"] + ["".join(rng.choice("ab  \nthe▁é你𐍈.,'") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    n, score = Counter(queries.piece_vocabulary())(pa.array(texts))
    want = [len(library.encode(("▁" + t.replace(" ", "▁")) if t else "", add_special_tokens=False).ids) for t in texts]
    assert list(n) == want and score[0] == 0
    out = token_counts(docs, queries.piece_vocabulary())
    assert out.count() == docs.count() and out.columns == [*docs.columns, "n_tokens", "token_score"]
    assert token_counts(empty, queries.piece_vocabulary()).count() == 0
    clash = docs.withColumns({c: F.lit("own") for c in ("a.b", "N_tokens", "n", "c0")})
    out = token_counts(clash, queries.piece_vocabulary())
    assert out.columns == [*[c for c in clash.columns if c != "N_tokens"], "n_tokens", "token_score"] and out.where("`a.b` = 'own' and n = 'own' and c0 = 'own'").count() == docs.count()


# ---- learnt scores


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    odds, chain, text = rng.standard_normal(4), rng.standard_normal((2, 2)), np.array([0, 0, 0, 1])
    good, _ = marginals(odds, text, chain)
    total, hit = 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        p = math.exp(sum(o for o, v in zip(odds, y, strict=False) if v) + chain[y[0], y[1]] + chain[y[1], y[2]])
        total += p
        hit += p * np.array(y)
    assert np.allclose(good[:3], hit / total) and math.isclose(good[3], 1 / (1 + math.exp(-odds[3])))


@pytest.mark.parametrize("score", [quality, toxicity])
def test_scores_edges(score, docs, empty, labels):
    got = score(docs, labels)
    assert got.count() == docs.count() and set(docs.columns) - {"score"} <= set(got.columns)
    assert got.where("score between 0 and 1").count() == docs.count()
    assert got.where("doc_id = 45 or doc_id = 46").select("score").distinct().count() == 1  # null and empty
    assert score(empty, labels).count() == 0
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}


# ---- suffix tree


def brute_tree(rows, depth):
    """Scores by dictionaries: (doc_id, base, score) of each text, N, and kept contexts by length."""
    c, follow = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, held, t in rows:
        for i, w in enumerate(t if not held else ()):
            c[w] += 1
            for k in range(1, min(i, depth) + 1):
                follow[tuple(t[i - k : i])][w] += 1
    n, v = sum(c.values()), len(c)

    def root(w):
        return (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def stays(counts, shorter):
        m = sum(counts.values())
        gain = sum(k * (math.log(k - 1) - math.log(m - 1 + PRIOR) + round(-math.log(shorter(w)) * COST) / COST) if k > 1 else math.log(PRIOR / (m - 1 + PRIOR)) for w, k in counts.items())
        return gain >= GAIN

    kept, asked = {}, set()

    def p(context, w):
        """Probability in the longest kept suffix of ``context``."""
        if not context:
            return root(w)
        if context in kept:
            return (follow[context][w] + PRIOR * p(context[1:], w)) / (kept[context] + PRIOR)
        return p(context[1:], w)

    for k in range(1, depth + 1):
        for x in [x for x in follow if len(x) == k]:
            times = c[x[0]] if k == 1 else follow[x[:-1]][x[-1]]
            if times >= LEAST and (k == 1 or x[:-1] in asked) and (k < 3 or x[1:] in kept):
                asked.add(x)
                if stays(follow[x], lambda w, x=x: p(x[1:], w)):
                    kept[x] = sum(follow[x].values())
    out = []
    for doc, _, t in rows:
        used = [p(tuple(t[max(0, i - depth) : i]), w) for i, w in enumerate(t)]
        out.append((doc, sum(math.log10(root(w)) for w in t), sum(map(math.log10, used))))
    return out, n, collections.Counter(map(len, kept))


def test_suffix_tree_by_brute_force(spark, docs, empty):
    for table, depth in ((docs, DEPTH), (spark.read.parquet(f"{SF}/documents.parquet"), DEPTH), (spark.read.parquet(f"{SF}/documents.parquet"), 5)):
        table = table.withColumn("held_out", common.id_remainder("doc_id", 10) == 0)
        rows = [(r.doc_id, r.held_out, [*words(r.text), None]) for r in table.select("doc_id", "held_out", "text").collect()]
        want, n, kept = brute_tree(rows, depth)
        got = suffix_tree_scores(table, "held_out", depth).collect()
        key = lambda x: (x[0] is not None, x[0] or 0, round(x[1], 6))
        mine = sorted(((r.doc_id, r.base_score, r.score) for r in got), key=key)
        assert kept[1] > 0 and kept[2] > 0 and {r.train_tokens for r in got} == {n}
        for (a, b, s), (d, base, score) in zip(mine, sorted(want, key=key), strict=True):
            assert a == d and math.isclose(b, base, rel_tol=1e-9) and math.isclose(s, score, rel_tol=1e-9)
    assert suffix_tree_scores(empty).count() == 0


def test_suffix_tree_tests_hot_contexts_alike(spark):
    """A frequent word whose followers all differ fails the test, however its followers are dealt."""
    rows = [(i, f"the u{i} on and on", "en", "s", None) for i in range(60)]
    table = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.lit(False))
    want = {d: s for d, _, s in brute_tree([(i, False, [*words(t), None]) for i, t, *_ in rows], DEPTH)[0]}
    for hot_from in (8, 1 << 18):
        got = {r.doc_id: r.score for r in suffix_tree_scores(table, "held_out", hot_from=hot_from).collect()}
        assert all(math.isclose(got[d], s, rel_tol=1e-9) for d, s in want.items())


# ---- near duplicates


def test_near_groups_by_brute_force(spark):
    """Every pair of TF-IDF similarity 0.8 or more is of one class, and every class hangs together by such pairs."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens = {r.doc_id: tuple(words(r.text)) for r in table.collect()}
    counts = {t: collections.Counter(t[i : i + 5] for i in range(max(1, len(t) - 4))) for t in set(tokens.values()) if t}
    holders = collections.defaultdict(list)
    for t, s in counts.items():
        for x in s:
            holders[x].append(t)
    rank = {x: random.Random(repr(x)).random() for x in holders}
    least = {t: min(s, key=rank.get) for t, s in counts.items()}
    idf = {x: 1 + math.log((1 + len(counts)) / (1 + len({least[t] for t in h}))) for x, h in holders.items()}
    weights = {t: {x: k * idf[x] for x, k in s.items()} for t, s in counts.items()}
    total = {t: sum(w.values()) for t, w in weights.items()}
    sure, maybe = set(), set()
    for a, b in {(a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i]}:
        both = sum(min(w, weights[b][x]) for x, w in weights[a].items() if x in weights[b])
        jaccard = both / (total[a] + total[b] - both)
        (sure if jaccard >= 0.82 else maybe if jaccard >= 0.78 else set()).add((a, b))  # min-hashes are others here
    got = {r.doc_id: r.class_id for r in near_groups(table).collect()}
    by_text = collections.defaultdict(list)
    for d, t in tokens.items():
        by_text[t].append(d)
    assert len(got) == table.count() and all(len({got[d] for d in ids}) == 1 for t, ids in by_text.items() if t)
    one = {t: got[ids[0]] for t, ids in by_text.items()}
    assert sure and sum(one[a] == one[b] for a, b in sure) >= 0.99 * len(sure)
    root = {t: t for t in counts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in sure | maybe:
        root[top(a)] = top(b)
    classes = collections.defaultdict(set)
    for t in counts:
        classes[one[t]].add(top(t))
    assert all(len(x) == 1 for x in classes.values())


def test_near_groups_edges(docs, empty):
    got = [(r.doc_id, r.class_id, r.class_size, r.kept) for r in near_groups(docs).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == docs.count() and by[40][1] == by[41][1] == 0 and by[42][1] == 1
    assert by[45][2] == by[46][2] == by[47][2] == 1  # texts without words
    assert by[50][1] == by[49][1] == 49 and by[5][1] is None
    assert sum(r[3] for r in got if r[0] == 3) == 1
    assert drop_near_copies(docs).columns == docs.columns and near_groups(empty).count() == 0


def test_shingles_are_counted_and_weighed_once(spark, docs, monkeypatch):
    """The sets that are compared take the weights of the signatures, not the corpus counts again."""
    from factloom.llm import near_dedup

    read, tables, saved = {}, {}, near_dedup.saved

    def spied(df, name, *rest):
        read[name] = df.inputFiles()
        tables[name] = saved(df, name, *rest)
        if name in ("signatures", "sets"):
            tables[name] = tables[name].cache()
            tables[name].count()
        return tables[name]

    monkeypatch.setattr(near_dedup, "saved", spied)
    near_groups(docs).count()
    assert any("shingle_counts" in f for f in read["signatures"]) and not any("shingle_counts" in f for f in read["sets"])
    weights = {r.text: r.weights for r in tables["signatures"].collect()}
    sets = tables["sets"].collect()
    assert sets and all(weights[r.uid] == r.weights and len(r.keys) == 3 * len(r.weights) > 0 for r in sets)


def test_asked_pairs_are_distinct_and_sorted():
    from factloom.llm import near_dedup

    rng = np.random.default_rng(8)
    keys = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    both = np.unique(rng.integers(0, 40, 600) << 32 | rng.integers(0, 50, 600))
    code, doc = both & 0xFFFFFFFF, both >> 32
    pair, first = near_dedup.asked_pairs(keys, code, doc)
    expected = np.unique(code << 32 | near_dedup.sketches(keys, code, doc))
    assert pair.tolist() == expected.tolist() and first.tolist() == np.unique(expected >> 32, return_index=True)[1].tolist()
    none = np.zeros(0, np.int64)
    assert [x.tolist() for x in near_dedup.asked_pairs(keys[:0], none, none)] == [[], []]


def test_near_groups_beside_a_large_class(spark, monkeypatch):
    """Pairs and chains in one bucket with a large class of distinct near copies, and more classes than rounds once were."""
    from factloom.llm import near_dedup

    monkeypatch.setattr(near_dedup, "signatures", lambda hashes, doc, weights, n: np.zeros((n, near_dedup.BANDS * near_dedup.ROWS), np.uint64))
    text = lambda c, changed: " ".join(f"{c}{i}" if i >= changed else f"{c}{i}x{changed}" for i in range(400))
    rows = [(i, text("a", i)) for i in range(20)] + [(100 * c + i, text(f"c{c}w", i)) for c in range(1, 31) for i in range(2)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 * c + i] == (100 * c, 2) for c in range(1, 31) for i in range(2))
    assert {got[i] for i in range(20)} == {(0, 20)}


def test_rows_without_own_ids_are_judged_each(spark):
    text = lambda c, end: " ".join(f"{c}{i}" for i in range(80)) + f" {end}"
    rows = [(None, text(c, end), "en", "s", None) for c in "abcd" for end in ("x", "y", "z")] + [(7, text("e", end), "en", "s", None) for end in ("x", "y")]
    table = spark.createDataFrame(rows, DOCS)
    kept = [r.text[:2] for r in drop_near_copies(table).collect()]
    assert sorted(kept) == ["a0", "b0", "c0", "d0", "e0"]
    sizes = mix(table, share=0.5).agg(F.sum("taken")).first()[0]
    assert mixed(table, share=0.5).select(common.n_tokens().alias("n")).agg(F.sum("n")).first()[0] == sizes <= 0.6 * 81 * len(rows)


def test_text_bytes_of_slices():
    body, offsets = text_bytes(pa.array(["ab", None, "", "cde"])[1:])
    assert bytes(body) == b"cde" and list(offsets) == [0, 0, 0, 3]


# ---- all together


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, SF), name.replace(" ", "-"))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    full = {d: len(ids) for d, ids in want_ids(docs)}
    assert pieces.agg(F.sum("length")).first()[0] == sum(full[r.doc_id] for r in docs.collect())
