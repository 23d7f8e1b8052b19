import gzip
from pathlib import Path

import pytest

from brute import SF, table
from leakaudit.llm import warc
from leakaudit.llm.common import documents


def expected(rows, least=0):
    by = {}
    for i, _, html in rows:
        by.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        known = [x for x in by[html or ""] if x is not None]
        first = min(known) if known else None
        revisit = i != first and len(data) >= least
        out.append((i, len(data), warc.digest(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def through(spark, rows, folder, **options):
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, seq string")
    warc.write_archives(pages, folder, **options)
    got = warc.inventory(warc.reassemble(warc.read_records(spark, folder))).collect()
    assert all(r.complete for r in got)
    return sorted(((r.id, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in got), key=str)


ROWS = [(i, f"http://x/{i}", "<p>" + "é" * (i * 50) + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n") for i in range(20)]
ROWS += [(30, None, None), (31, "http://x/a b\r\nX: y", ""), (32, "u", "x" * 200000), (5, "u", "x" * 200000), (33, "u", "same"), (33, "u", "same"), (None, "u", "same"), (None, "u", "alone")]


@pytest.mark.parametrize("options", [{}, {"segment": 300}, {"least": 1000, "segment": 5000}])
def test_there_and_back(spark, tmp_path, options):
    assert through(spark, ROWS, str(tmp_path / "a"), **options) == expected(ROWS, options.get("least", 0))


def test_no_pages(spark, tmp_path):
    assert through(spark, [], str(tmp_path / "a")) == []


def test_broken_archives_are_told(spark, tmp_path):
    made = [b"".join(r + b"\r\n\r\n" for r in warc.records("1:0", None, "u", "d", b"a" * 5000, 1000))]
    pieces = list(warc.records("2:0", None, "u", "d", b"b" * 5000, 1000))
    made.append(b"".join(r + b"\r\n\r\n" for r in pieces[:2] + pieces[3:]))  # a segment is missing
    made.append(b"".join(r + b"\r\n\r\n" for r in warc.records("3:0", None, "u", "d", b"c" * 500, 1000)).replace(b"ccc", b"cdc", 1))
    made.append((list(warc.records("4:0", None, "u", "d", b"d" * 500, 10000))[0])[:-100])  # cut off
    made.append(b"no archive")
    for k, data in enumerate(made):
        Path(tmp_path, f"part-{k}.gz").write_bytes(gzip.compress(data))
    got = {r.record: r.complete for r in warc.reassemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert got == {"1:0": True, "2:0": False, "3:0": False, "4:0": False}


def test_framing():
    for data in (b"", b"a", b"\r\n" * 5000):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"5\r\nabc") is None


def test_query(spark):
    import __spark_entry__ as entry

    rows = [(r["page_id"], r["url"], r["html"]) for r in table("pages")]
    got = entry.queries()["op5_warc"](spark, SF).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert documents(spark, SF, "pages").count() == len(got)
