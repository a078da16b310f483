"""Phrases, WARC archives and filling in the middle, against brute force, SQL and broken input."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import fill_middle, phrases, queries, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def normal(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_warc_archives", "op13_fill_in_middle"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, "/root/testdata/sf0.01")
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.select(*want.columns).collect()) == normal(want.fetchall())


# ---- filling in the middle


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_by_brute_force(unit):
    rng = random.Random(1)
    texts = ["", "a", "é𐍈", "\n\n", " lead", "x" * 200, *("".join(rng.choice("ab é𐍈\n\t你") for _ in range(rng.randint(1, 90))) for _ in range(80))]
    starts = {"char": lambda t: range(len(t)), "word": lambda t: [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)], "line": lambda t: [m.start() for m in re.finditer(r"(?<![^\n]).", t, re.S)]}[unit]
    raw = [t.encode() for t in texts]
    body, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for size in (1, 3, 16, 4096):
        chunks = fill_middle.Chunks(body, offsets, unit, size)
        assert list(chunks.units) == [len(list(starts(t))) for t in texts]
        for i, t in enumerate(texts):
            at = [0, *list(starts(t))[1:], len(t)] if chunks.units[i] else [len(t)]
            ranks = np.arange(chunks.units[i] + 1)
            if chunks.units[i]:
                places = chunks.cuts(np.full(len(ranks), i), ranks) - offsets[i]
                assert list(places) == [len(t[:k].encode()) for k in at]


def test_fill_in_middle_edges(spark):
    long = "Ein sehr langer Text über 你好. " * 40_000
    rows = [(1, None), (2, ""), (3, "has <S> in it"), (4, "é"), (None, "no id at all"), (5, long), (5, long), (6, "<P<S>"), (7, "<M"), *((100 + i, f"text {i} 𐍈 <P {i} M>") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("N", "form", "a.b", "_text", "_h1")})
    got = fill_middle.fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "a.b", "_text", "_h1", "n", "form", "prefix_units", "middle_units", "output"]
    out = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows) and {r["a.b"] for r in out} == {"own"}
    for r in out:
        t = r.text or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
        a, b = sorted(x % (len(t) + 1) for x in h[:2])
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (r.n, r.form, r.output, r.back) == (len(t), form, want, t)
        assert (r.prefix_units, r.middle_units) == ((None, None) if form == "plain" else (a, b - a))
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    for unit in ("word", "line"):
        made = fill_middle.fill_in_middle(docs, unit)
        assert made.where(~fill_middle.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


# ---- WARC


PAGES = "page_id long, url string, html string"


def read_back(spark, pages, **options):
    path = warc.write_archives(pages, **options)
    return warc.read_archives(warc.archives_of(spark, path), path, with_payload=True)


def test_archives_round_trip(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abc é𐍈\r\n") for _ in range(50_000))
    rows = [(1, "http://a/\r\nb?q=ü", "x"), (2, None, None), (3, "u", ""), (4, "u", long), (5, "u", long), (6, "u", "x"), (7, "u", "0\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "x"), (8, "u", "same"), (8, "u", "same")]
    pages = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("own") for c in ("row", "key", "to_row", "a.b")}).repartition(3)
    got = read_back(spark, pages, segment=700, archive=2_000, chunk=100).collect()
    assert normal((r.page, r.uri, bytes(r.payload).decode(), r.payload_bytes, r.problem) for r in got) == normal((None if i is None else str(i), u, h or "", len((h or "").encode()), None) for i, u, h in rows)
    kinds = collections.defaultdict(list)
    for r in got:
        assert r.payload_digest == warc.base32_sha1(bytes(r.payload))
        kinds[r.page].append((r.record_type, r.refers_to_page))
    assert kinds["6"] == kinds["5"] == kinds["3"] == [("response", None)] and kinds["1"] == kinds[None] == [("revisit", "6")]
    assert kinds["4"] == [("revisit", "5")] and kinds["2"] == [("revisit", "3")] and sorted(kinds["8"], key=str) == sorted([("response", None), ("revisit", "8")], key=str)
    assert {r.record_type for r in read_back(spark, pages, least=10**9).collect()} == {"response"}
    few = [r for r in read_back(spark, pages, least=1).collect() if r.record_type == "revisit"]
    assert {r.page for r in few} == {"1", None, "4", "8"}
    assert read_back(spark, pages.limit(0)).count() == 0


def test_marks_by_shuffle_are_those_by_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"text {i % 5}") for i in range(60)], PAGES)
    want = normal((r.page, r.record_type, r.refers_to_page) for r in read_back(spark, pages).collect())
    monkeypatch.setattr(warc, "FEW", 0)
    assert normal((r.page, r.record_type, r.refers_to_page) for r in read_back(spark, pages).collect()) == want


def archive(spark, folder, *records, name="a.warc.gz"):
    """An archive of (fields, block), read whole."""
    with open(f"{folder}/{name}", "wb") as out:
        for fields, block in records:
            out.write(warc.record(list(fields.items()), block))
    return warc.read_archives(spark.createDataFrame([(name,)], "file string"), f"file://{folder}", with_payload=True)


def test_broken_archives_are_told(spark, tmp_path):
    http = lambda body, *fields: b"\r\n".join([b"HTTP/1.1 200 OK", *fields, b"", body])
    chunks = b"Transfer-Encoding: gzip, Chunked"
    response = lambda i, **f: {"WARC-Type": "response", "WARC-Record-ID": i, **{k.replace("_", "-"): v for k, v in f.items()}}
    more = lambda i, of, k, total=None: {"WARC-Type": "continuation", "WARC-Record-ID": i, "WARC-Segment-Origin-ID": of, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": total}
    got = {r.record_id: r for r in archive(
        spark, tmp_path,
        ({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"software: x"),
        (response("<plain>"), http(b"ab")),
        (response("<ext>"), http(b"3;name=v\r\nabc\r\n0\r\nTrailer: t\r\n\r\n", chunks)),
        (response("<short>"), http(b"9\r\nabc\r\n0\r\n\r\n", chunks)),
        (response("<nohead>"), b"just text"),
        (response("<digest>", WARC_Payload_Digest="sha1:AAAA"), http(b"ab")),
        # segments out of order, the last repeated
        (more("<c3>", "<cut>", 3, len(http(b"abcdef"))), b"ef"), (more("<c2>", "<cut>", 2), b"cd"), (response("<cut>", WARC_Segment_Number=1), http(b"ab")), (more("<c3b>", "<cut>", 3, len(http(b"abcdef"))), b"ef"),
        (response("<gap>", WARC_Segment_Number=1), http(b"ab")), (more("<g3>", "<gap>", 3, 99), b"ef"),
        (response("<total>", WARC_Segment_Number=1), http(b"ab")), (more("<t2>", "<total>", 2, 7), b"ef"),
        (response("<untold>", WARC_Segment_Number=1), http(b"ab")), (more("<u2>", "<untold>", 2), b"ef"),
        (response("<unlike>", WARC_Segment_Number=1), http(b"ab")), (more("<l2>", "<unlike>", 2, 7), b"ef"), (more("<l2b>", "<unlike>", 2, 7), b"xy"),
        (more("<o2>", "<orphan>", 2, 7), b"ef"),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<r0>", "WARC-Refers-To": "<cut>"}, b""),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<r1>", "WARC-Refers-To": "<cut>", "WARC-Payload-Digest": "sha1:AAAA"}, b""),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<r2>", "WARC-Refers-To": "<none>"}, b""),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<r3>", "WARC-Refers-To": "<gap>"}, b""),
    ).collect()}
    body = {k: r.payload and bytes(r.payload) for k, r in got.items()}
    assert body["<plain>"] == b"ab" and body["<ext>"] == b"abc" and body["<cut>"] == b"abcdef" == body["<r0>"]
    why = {k: r.problem for k, r in got.items() if r.problem}
    assert set(why) == {"<short>", "<nohead>", "<digest>", "<gap>", "<total>", "<untold>", "<unlike>", "<orphan>", "<r1>", "<r2>", "<r3>"}
    assert why["<gap>"] == "segment 2 is missing" == why["<r3>"] and why["<orphan>"] == "segment 1 is missing" and "twice" in why["<unlike>"]
    assert why["<r2>"] == "refers to no response here" and why["<r1>"] == "refers to a response of another payload" and all(body[k] is None for k in why)


@pytest.mark.parametrize("raw", [b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab", b"no archive\r\n\r\n", zlib.compress(b"x")])
def test_archives_that_break_off(raw, tmp_path):
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(raw)))


def test_plain_archives_and_small_reads():
    raw = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"x" * n) for n in (0, 5, 300_000))
    assert [len(b) for _, b in warc.records(pa.BufferReader(raw))] == [0, 5, 300_000]


# ---- phrases


def brute_phrases(rows, fewest, most, least, inside, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = collections.defaultdict(list)
    long = {x: a for x, a in f.items() if len(x[1]) >= fewest and a >= least}
    around = collections.Counter()
    for (lang, w), a in long.items():
        for k in range(fewest, len(w)):
            for i in range(len(w) - k + 1):
                around[lang, w[i : i + k]] = max(around[lang, w[i : i + k]], a)
    for (lang, w), a in long.items():
        score, _, le, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        if not 100 * around[lang, w] >= inside * a:
            found[lang].append((-score, -a, " ".join(w).encode(), le, r))
    return [(lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, x in found.items() for i, (s, a, p, le, r) in enumerate(sorted(x)[:top], 1)]


@pytest.mark.parametrize("fewest,most,least,inside,top", [(2, 3, 10, 50, 2000), (2, 3, 2, 50, 7), (2, 5, 2, 80, None), (3, 4, 3, 50, 100), (2, 2, 1, 50, None)])
def test_phrases_by_brute_force(spark, fewest, most, least, inside, top):
    rng = random.Random(3)
    vocabulary = ["The", "the", "x", "é", "你", "10%", "ß", "zz", "𐍈𐍈"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n"]) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" . \t", "fr"), (text(4000), "en"), ("the the the the the", "de")] + [("in spite of it all", "en")] * 30
    docs = spark.createDataFrame([(i, t, g, "s", None) for i, (t, g) in enumerate(rows)], DOCS).withColumns({"f": F.lit(1), "phrase": F.lit("own"), "a.b": F.lit(2)})
    want = brute_phrases(rows, fewest, most, least, inside, top)
    for parts, size in ((5, 300), (2, 6_000_000)):
        got = phrases.phrases(docs.repartition(parts), fewest, most, least, inside, top, size)
        assert normal(got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == normal(want)
    assert want


def test_phrases_edges(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.phrases(docs).count() == 0
    assert phrases.phrases(spark.createDataFrame([(1, None, None, "s", 1), (2, " .", "en", None, None)], DOCS)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    a, le, r = 3_000_000_007, 3_000_000_019, 5_000_000_029
    table = spark.createDataFrame([("en", "x y", a, 2), ("en", "x", le, 1), ("en", "y", r, 1)], "lang string, phrase string, f long, k int")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    monkeypatch.setattr(phrases, "gram_table", lambda *_: (table, totals))
    assert [r_.score for r_ in phrases.phrases(table).collect()] == [1_000_000 * a * a // (le * r)]


def test_suffixes_in_order():
    rng = np.random.default_rng(4)
    words, piece = rng.integers(0, 3, 300), np.cumsum(rng.random(300) < 0.2)
    for most in (1, 2, 3, 4, 6):
        order, shared, left = phrases.suffix_array(words, piece, most)
        cut = lambda i: tuple(words[i : i + most][piece[i : i + most] == piece[i]])  # noqa: B023, E731
        assert [cut(i) for i in order] == sorted(map(cut, range(300)))
        assert list(left) == [len(cut(i)) for i in order]
        for i, j, s in zip(order[1:], order[:-1], shared[1:], strict=True):
            a, b = cut(i), cut(j)
            assert s == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
