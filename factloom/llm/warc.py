"""WARC archives: pages written as records, long ones in segments, and read back whole."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import new_path, saved

#: Bytes of records after which a task begins a new archive, of a record's block before it goes on in
#: continuation records, and of a chunk of the transfer framing.
ARCHIVE, SEGMENT, CHUNK = 64_000_000, 32_768, 8_192
#: Rows that revisit another up to which these marks are broadcast; beyond, rows and marks are shuffled.
FEW = 500_000
_END = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for x in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing, extensions and trailers left out; ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(_END, at)
        if end < 0:
            raise ValueError("chunk without a length")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size < 0:
            raise ValueError("chunk of negative length")
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != _END:
            raise ValueError("chunk shorter or longer than it says")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its head, without transfer framing."""
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(_END)[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding", b"").split(b",")[-1].strip() == b"chunked" else body


def record(fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


class _Reader:
    """Bytes of a file, gzip members inflated as they come."""

    def __init__(self, source):
        self.source, self.z, self.held, self.at = source, None, b"", 0
        self.first = source.read(1 << 17)
        self.zipped = self.first[:2] == b"\x1f\x8b"

    def more(self) -> bool:
        data, self.first = self.first or self.source.read(1 << 17), b""
        if not data:
            if self.z is not None:
                raise ValueError("archive ends inside a record")
            return False
        out = [self.held[self.at :]]
        while data and self.zipped:
            self.z = self.z or zlib.decompressobj(31)
            out.append(self.z.decompress(data))
            data, self.z = (self.z.unused_data, None) if self.z.eof else (b"", self.z)
        self.held, self.at = b"".join([*out, data]), 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``; None at the end."""
        seen = self.at
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("archive ends inside a record")
                return None
        out, self.at = self.held[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left > len(self.held) - self.at:
            parts.append(self.held[self.at :])
            left, self.at = left - len(parts[-1]), len(self.held)
            if not self.more():
                raise ValueError("archive ends inside a record")
        parts.append(self.held[self.at : self.at + left])
        self.at += left
        return b"".join(parts)


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive, gzipped or not: fields by lower-case name, and the block."""
    reader = _Reader(source)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        lines = head.lstrip().decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = reader.take(int(fields["content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("record longer than it says")
        yield fields, block


def marked(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (row, page_id, url, html, key) with ``to_row``, the row that each revisits, or null.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id, then the
    largest row, is revisited by the others. A payload that a third of all rows share is one row of each
    task where they are grouped; the join by it, of narrow rows, is left to adaptive execution to split.
    """
    narrow = pages.select("row", "page_id", "key", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least)
    best = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "row")).alias("best")).where("n > 1")
    marks = narrow.join(best.select("key", F.col("best.row").alias("to_row")), "key").where("row != to_row").select("row", "to_row")
    marks = saved(marks, "revisits")
    return pages.join(F.broadcast(marks) if marks.count() <= FEW else marks, "row", "left")


def write_archives(pages: DataFrame, path: str | None = None, least: int = 0, segment: int = SEGMENT, archive: int = ARCHIVE, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes a record for each row of ``pages`` (page_id, url, html) under ``path`` and returns it.

    Equal payloads (the html in UTF-8) of at least ``least`` bytes are one response and revisits of it,
    see :func:`marked`; shorter ones are all responses. A response is an HTTP message with its payload
    in chunked framing. A block over ``segment`` bytes goes on in continuation records, which a task
    writes to archives of their own. ``archives/*.warc.gz`` holds one gzip member a record;
    ``manifest`` (Parquet) names the archives that count, as a task that runs twice names them anew.

    Null html is empty, a null page_id comes before all others, and ids of any type are kept as text;
    rows that repeat an id are records each; an empty table gives an archive-less folder. Other columns are not looked at.
    """
    spark = pages.sparkSession
    path, run = path or new_path(spark, "warc"), uuid.uuid4().hex
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = saved(rows.withColumn("key", F.sha2("html", 256)), "pages")
    name = lambda row: F.when(F.col(row).isNotNull(), F.md5(F.concat_ws("/", F.lit(run), F.col(row).cast("string")).cast("binary")))
    ready = marked(rows, least).select(
        name("row").alias("id"), F.col("page_id").cast("string").alias("page"), "url", name("to_row").alias("refers"), "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(path)
        files.create_dir(f"{root}/archives", recursive=True)
        part, done, open_ = TaskContext.get().partitionId(), [], {}

        def put(kind: str, fields: list, block: bytes) -> None:
            if kind in open_ and open_[kind][1] > archive:
                open_.pop(kind)[0].close()
            if kind not in open_:
                done.append([f"archives/{part:06d}-{kind}-{uuid.uuid4().hex}.warc.gz", 0])
                # a stream by this name, without a second compression
                open_[kind] = [files.open_output_stream(f"{root}/{done[-1][0]}", compression=None), 0, done[-1]]
            made = record(fields, block)
            open_[kind][0].write(made)
            open_[kind][1] += len(made)
            open_[kind][2][1] += 1

        try:
            for batch in batches:
                for row in range(batch.num_rows):
                    uid, page, url, refers, body = (batch.column(c)[row].as_py() for c in range(5))
                    fields = [
                        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", _urn(uid)), ("WARC-Date", date),
                        ("WARC-Target-URI", None if url is None else quote(url, safe="".join(map(chr, range(33, 127))))), ("X-Page-ID", None if page is None else quote(page)),
                        ("WARC-Payload-Digest", f"sha1:{base32_sha1(body)}"), ("Content-Type", "application/http;msgtype=response")]
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                    if refers:
                        put("main", [*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers))], head)
                        continue
                    block = head + chunked(body, chunk)
                    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
                    put("main", [*fields, ("WARC-Segment-Number", 1 if len(pieces) > 1 else None)], pieces[0])
                    for k, piece in enumerate(pieces[1:], 2):
                        put("more", [
                            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(uid), str(k))}>"), ("WARC-Date", date), ("WARC-Segment-Number", k),
                            ("WARC-Segment-Origin-ID", _urn(uid)), ("WARC-Segment-Total-Length", len(block) if k == len(pieces) else None)], piece)
        finally:
            for stream, *_ in open_.values():
                stream.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["file", "records"])

    ready.mapInArrow(write, "file string, records long").write.parquet(f"{path}/manifest")
    return path


def _urn(hex_id: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hex_id)}>"


_RECORD = pa.schema([
    ("type", pa.string()), ("id", pa.string()), ("page", pa.string()), ("uri", pa.string()), ("origin", pa.string()), ("segment", pa.int32()),
    ("total", pa.int64()), ("refers", pa.string()), ("digest", pa.string()), ("block", pa.binary())])


def read_records(files: DataFrame, root: str = "") -> DataFrame:
    """Every record of the archives that ``files`` (file) names, below ``root`` if that is given.

    Columns: type, id, page, uri, origin, segment, total, refers, digest, block. An archive is one
    task's, read as a stream; one that breaks off inside a record or is none raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                where, place = pafs.FileSystem.from_uri(f"{root}/{file}" if root else file)
                rows, size = [], 0
                with where.open_input_stream(place, compression=None) as source:
                    for f, block in records(source):
                        number = f.get("warc-segment-number")
                        page, uri = f.get("x-page-id"), f.get("warc-target-uri")
                        rows.append((f.get("warc-type"), f.get("warc-record-id"), unquote(page) if page else page, unquote(uri) if uri else uri, f.get("warc-segment-origin-id"), int(number) if number else None,
                                     int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f.get("warc-refers-to"), f.get("warc-payload-digest"), block))
                        size += len(block)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(_RECORD.names, r, strict=True)) for r in rows], _RECORD)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_RECORD.names, r, strict=True)) for r in rows], _RECORD)

    names = files.select("file")
    return names.repartition(max(1, names.count())).mapInArrow(
        read, "type string, id string, page string, uri string, origin string, segment int, total long, refers string, digest string, block binary")


def joined(segments: list[dict]) -> bytes:
    """The block of a record from its segments (segment, total, block); ValueError if it is not whole.

    A segment that comes twice with the same bytes counts once.
    """
    blocks: dict[int, bytes] = {}
    for s in segments:
        number = s["segment"] or 1
        if blocks.setdefault(number, s["block"]) != s["block"]:
            raise ValueError(f"segment {number} comes twice, unlike")
    if sorted(blocks) != list(range(1, len(blocks) + 1)):
        missing = min(set(range(1, max(blocks) + 1)) - set(blocks))
        raise ValueError(f"segment {missing} is missing")
    whole = b"".join(blocks[k] for k in sorted(blocks))
    totals = {s["total"] for s in segments if s["total"] is not None}
    if any(s["segment"] for s in segments) and totals != {len(whole)}:
        raise ValueError(f"segments have {len(whole)} bytes, not {', '.join(map(str, sorted(totals))) or 'a stated number'}")
    return whole


def read_archives(files: DataFrame, root: str = "", with_payload: bool = False, payload: Callable[[bytes], bytes] = http_payload) -> DataFrame:
    """Every response and revisit of the archives that ``files`` (file) names, whole.

    Columns: page (text), uri, record_type, record_id, refers_to_id, refers_to_page, payload_bytes,
    payload_digest (base32 SHA-1 of the payload), problem, and payload if asked for. Continuation
    records are grouped by the record that they go on, put in order of their numbers and held against the
    stated total length; chunked framing is decoded; a stated digest must be the payload's. A record
    that fails any of this comes out with the ``problem`` in words and without a payload; so does a
    continuation whose first segment is not there. Whole records are not shuffled. A revisit has bytes
    and digest of the response that it names.
    """
    got = read_records(files, root).where("type in ('response', 'revisit', 'continuation')")
    about = F.struct("type", "id", "page", "uri", "refers", "digest").alias("about")
    part = F.struct("segment", "total", "block").alias("part")
    whole = got.where("segment is null and type != 'continuation'").select(about, F.array(part).alias("parts"))
    cut = got.where("segment is not null or type = 'continuation'").select(F.coalesce("origin", "id").alias("origin"), about, part)
    first = F.max(F.when((F.col("part.segment") == 1) & (F.col("about.type") != "continuation"), F.col("about")))
    lost = F.struct(F.lit("continuation").alias("type"), F.col("origin").alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("page", "uri", "refers", "digest")])
    grouped = cut.groupBy("origin").agg(first.alias("first"), F.collect_list("part").alias("parts")).select(F.coalesce("first", lost).alias("about"), "parts")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            about = batch.column(0).to_pylist()
            size, digest, problem, body = [], [], [], []
            for k, a in enumerate(about):
                try:
                    block = joined(batch.column(1)[k].as_py())
                    if a["type"] == "continuation":
                        raise ValueError("segment 1 is missing")
                    data = payload(block) if a["type"] == "response" else b""
                    own = base32_sha1(data)
                    if a["type"] == "response" and a["digest"] and a["digest"].removeprefix("sha1:") != own:
                        raise ValueError("payload has another digest than stated")
                    size.append(len(data))
                    digest.append(own if a["type"] == "response" else (a["digest"] or "").removeprefix("sha1:") or None)
                    problem.append(None)
                    body.append(data)
                except ValueError as wrong:
                    size.append(None)
                    digest.append(None)
                    problem.append(str(wrong))
                    body.append(None)
            columns = [*([x[c] for x in about] for c in ("page", "uri", "type", "id", "refers")), size, digest, problem, *[body] * with_payload]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], [f"c{i}" for i in range(len(columns))])

    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    schema = "page string, uri string, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, problem string" + ", payload binary" * with_payload
    found = saved(whole.unionByName(grouped).mapInArrow(decode, schema), "records")
    added = ["payload_bytes", "payload_digest", *["payload"] * with_payload]
    answers = found.where("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page").alias("refers_to_page"), F.col("problem").alias("to_problem"), *[F.col(c).alias(f"to_{c}") for c in added])
    order = ["page", "uri", "record_type", "record_id", "refers_to_id", "refers_to_page", *added, "problem"]
    revisits = found.where("record_type = 'revisit'").join(answers, F.col("refers_to_id") == F.col("to"), "left")
    unlike = F.when(F.col("to").isNull(), "refers to no response here").when(F.col("to_problem").isNull() & (F.col("payload_digest") != F.col("to_payload_digest")), "refers to a response of another payload")
    problem = F.coalesce("problem", unlike, "to_problem")
    revisits = revisits.withColumn("problem", problem).withColumns({c: F.when(F.col("problem").isNull(), F.col(f"to_{c}")) for c in added})
    others = found.where("record_type != 'revisit'").withColumn("refers_to_page", F.lit(None).cast("string"))
    return others.select(*order).unionByName(revisits.select(*order))


def archives_of(spark: SparkSession, path: str) -> DataFrame:
    """The archives (file) that count of a folder that :func:`write_archives` made."""
    return spark.read.parquet(f"{path}/manifest").select("file")
