"""WARC archives: segmented writing and segment reassembly.

Writing: records with equal payloads of at least ``least`` bytes are found by digest, summed on the map side; the
smallest id is a response, the others revisit it. A response is an HTTP message with
chunked transfer framing, cut into segments of ``segment`` bytes: a first record and
continuation records that name it as their origin, the last with the total length. Spark's text
writer writes the records with the record terminator as its line separator, so any store that Spark can
write to can hold the archives.

Reading: each archive file is parsed in one task; files are bounded by records per file.
Segments are grouped by origin, ordered by number, their total length verified, and the
transfer framing decoded. A revisit takes the length of its payload from the record that it refers to.

Pages are read twice and numbered in the order of their files, so ``pages`` has to be a table, not the result of a shuffle.

Defined results: a null payload is empty; a null id is never the smallest of its payload unless all are null, and
stays null; rows equal in id and payload are each a record, both of them responses if the
id is the smallest; an unusable address is left out; broken archives give ``complete`` = false
with what is known; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakaudit.llm.common import materialise

SEGMENT_BYTES = 16384
CHUNK_BYTES = 4096
RECORDS_PER_FILE = 2000
PREFIX = "urn:x-record:"

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(p := payload[i : i + size]), p) for i in range(0, len(payload), size)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """What an HTTP message carries."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    framed = any(h.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for h in head.split(b"\r\n"))
    return unchunked(body) if framed else body


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block


def records(name: str, refers: str | None, url: str | None, date: str, payload: bytes, segment: int) -> Iterator[bytes]:
    """The records of one page, without the terminator."""
    uri = quote(url, safe="%:/?#[]@!$&'()*+,;=~-._") if url else None
    common = {"WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http;msgtype=response"}
    own = f"<{PREFIX}{name}>"
    if refers is not None:
        yield _record("revisit", {"WARC-Record-ID": own, **common, "WARC-Refers-To": f"<{PREFIX}{refers}>", "WARC-Profile": REVISIT_PROFILE}, HTTP_HEAD + b"\r\n")
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield _record("response", {"WARC-Record-ID": own, **common}, block)
        return
    for k, piece in enumerate(pieces, 1):
        last = len(block) if k == len(pieces) else None
        if k == 1:
            yield _record("response", {"WARC-Record-ID": own, **common, "WARC-Segment-Number": 1}, piece)
        else:
            fields = {"WARC-Record-ID": f"<{PREFIX}{name}:{k}>", "WARC-Date": date, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": last}
            yield _record("continuation", fields, piece)


def write_archives(
    pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES, least: int = 0, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", payload: str = "html"
) -> None:
    """Archives of all pages, as gzip files in ``folder``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    named = rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("print", F.concat(F.sha1("body"), F.length("body").cast("string")))
    order = F.struct(F.col("id").isNull(), "id", "seq")
    seen = materialise(named.select("id", "seq", "print", F.length("body").alias("n")), "seen")
    first = seen.where(F.col("n") >= least).groupBy("print").agg(F.min_by(F.struct("id", "seq"), order).alias("f"), F.count("*").alias("held"))
    later = seen.join(first.where("held > 1"), "print").where(~F.col("id").eqNullSafe(F.col("f.id")))
    refers = later.select(F.col("seq").alias("of"), F.concat_ws(":", F.coalesce(F.col("f.id").cast("string"), F.lit("null")), F.col("f.seq").cast("string")).alias("refers"))
    refers = materialise(refers, "refers")  # its size is known, so few revisits don't move the payloads

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for r in batch.to_pylist():
                name = f"{'null' if r['id'] is None else r['id']}:{r['seq']}"
                for record in records(name, r["refers"], r["url"], date, r["body"], segment):
                    out.append(record)
                    held += len(record)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = named.join(refers, F.col("seq") == F.col("of"), "left").select("id", "seq", "url", "body", "refers").mapInArrow(work, "value binary")
    writer = made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased header fields, block) of each record; stops where the archive is cut off."""
    at = 0
    while at < len(data):
        gap = data.find(b"\r\n\r\n", at)
        if gap < 0:
            return
        lines = data[at:gap].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            return
        start = gap + 4
        end = start + int(fields["content-length"])
        yield fields, data[start:end]
        at = end + 4


PARSED = "kind string, record string, origin string, number int, total long, digest string, refers string, block binary"
_PARSED = pa.schema([("kind", pa.string()), ("record", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])


def _bare(name: str | None) -> str | None:
    return None if name is None else name.strip("<>").removeprefix(PREFIX)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for f, block in parse(gzip.decompress(content.as_py())):
                    own = _bare(f.get("warc-record-id"))
                    origin = _bare(f.get("warc-segment-origin-id")) or own
                    total = f.get("warc-segment-total-length")
                    rows.append((f.get("warc-type"), own, origin, int(f.get("warc-segment-number", 0)), int(total) if total else None, f.get("warc-payload-digest"), _bare(f.get("warc-refers-to")), block))
                    held += len(block)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARSED.types)], schema=_PARSED)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PARSED.types)], schema=_PARSED)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(work, PARSED)


def reassemble(found: DataFrame) -> DataFrame:
    """One row per logical record: kind, record, digest, refers, payload, complete."""
    piece = F.struct("number", "total", "block")
    head = F.min_by(F.struct("kind", "digest", "refers"), F.struct(F.col("kind") == "continuation", "number"))
    joined = found.groupBy("origin").agg(head.alias("h"), F.collect_list(piece).alias("pieces"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "record", "digest", "refers", "payload", "complete"]
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for r in batch.slice(i, 500).to_pylist():
                    pieces = sorted(r["pieces"], key=lambda p: p["number"])
                    block = b"".join(p["block"] for p in pieces)
                    whole = len(pieces) == 1 and pieces[0]["number"] == 0
                    whole |= [p["number"] for p in pieces] == list(range(1, len(pieces) + 1)) and pieces[-1]["total"] == len(block)
                    payload = payload_of(block) if whole and r["kind"] == "response" else None
                    known = (r["digest"] or "").removeprefix("sha1:")
                    fine = whole and (r["kind"] == "revisit" or payload is not None and digest(payload) == known)
                    rows.append((r["kind"], r["origin"], known, r["refers"], payload, fine))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return joined.select("origin", "h.*", "pieces").mapInArrow(work, "kind string, record string, digest string, refers string, payload binary, complete boolean")


def inventory(pages: DataFrame) -> DataFrame:
    """Per logical record: id, payload_bytes, digest, kind, refers_to (id), complete."""
    table = materialise(pages.select("record", "refers", F.length("payload").cast("long").alias("n"), "digest", "kind", "complete"), "inventory")
    target = table.where("kind = 'response'").select(F.col("record").alias("target"), F.col("n").alias("full"))
    joined = table.join(target, F.col("refers") == F.col("target"), "left")
    number = lambda c: F.split(c, ":")[0].try_cast("long")
    return joined.select(
        number("record").alias("id"),
        F.coalesce("n", "full").alias("payload_bytes"),
        "digest",
        "kind",
        number("refers").alias("refers_to"),
        "complete",
    )
