import hashlib
import io

import pytest

from canopy.llm import legacy_archive as A
from tests.llm.cases import by_key


@pytest.mark.parametrize("version", [1, 2])
def test_records_by_declared_length(version):
    """Payloads that look like headers, hold line ends or nothing are not searched."""
    payloads = [b"", b"\n\nhttp://x 0.0.0.0 2024 text/html 5\n", b"WARC/1.1\r\n\r\n", "é".encode() * 9, b"filedesc://no"]
    data = A.arc_version_block(version, "n.arc", "20240101000000") + b"\n"
    for i, p in enumerate(payloads):
        data += A.arc_record(version, "n.arc", f"http://h/a b{i}", "20240101000000", p) + b"\n"
    got = list(A.read_arc(data))
    assert [p for _, _, p in got] == payloads
    assert [f["URL"] for f, _, _ in got] == [f"http://h/a%20b{i}" for i in range(len(payloads))]
    assert set(got[0][0]) == set(A.FIELDS[version].split(" "))


@pytest.mark.parametrize("data", [
    b"http://x 0.0.0.0 20240101000000 text/html 1\nx\n",  # no version block
    A.arc_version_block(1, "n", "2024") + b"http://x 0.0.0.0 20240101000000 text/html 99\nx\n",  # too short
    A.arc_version_block(2, "n", "2024") + b"http://x 0.0.0.0 20240101000000 text/html 1\nx\n",  # fields of version 1
    b"filedesc://n 0.0.0.0 2024 text/plain 6\n9 0 x\n\n",  # unknown version
])
def test_broken_archives(data):
    with pytest.raises(ValueError):
        list(A.read_arc(data))


def test_dates_and_ids():
    assert A.warc_date("20240229123456") == "2024-02-29T12:34:56Z"
    assert A.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert A.record_id("a", 1, "u") == A.record_id("a", 1, "u") != A.record_id("a", 2, "u")


def test_warc_blocks():
    blocks = [b"", b"\r\n\r\nWARC/1.1\r\n", b"x" * 5000]
    data = b"".join(A.warc_record([("WARC-Type", "response"), ("N", str(i))], b) + b"\r\n\r\n" for i, b in enumerate(blocks))
    assert [b for _, b in A.read_warc(io.BytesIO(data))] == blocks
    with pytest.raises(ValueError):
        list(A.read_warc(io.BytesIO(data[:-4000])))


def brute(rows):
    large = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            large.setdefault(data, []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        pages = large.get(data, [])
        first = max((p for p in pages if p is not None), default=None)
        kind = "response" if not pages or page == first else "revisit"
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), kind, first if kind == "revisit" else None))
    return by_key(out)


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(A, "ARCHIVE_RECORDS", 7)
    monkeypatch.setattr(A, "CONVERTED_BYTES", 500)
    big = "<p>é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(i, f"http://h/{i}", big) for i in range(40)] + [
        (50, None, "<b>" * 400), (51, "http://h/ q?x=#page=3", "short"), (52, "", "short"), (53, "u", None), (54, "u", ""),
        (-3, "u", "y" * 1000), (9, "u", "y" * 1000), (55, "u", "z" * 999), (56, "u", "z" * 999), (None, "u", big), (57, "é\n", "\n" * 1200),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, archive string, place int")
    got = A.archive_pages(df)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert by_key(got.select(*columns).collect()) == brute(rows)
    assert got.select("record_id").distinct().count() == len(rows)


def test_repeated_and_null_pages(spark):
    rows = [(5, "u", "k" * 1500), (5, "u", "k" * 1500), (None, "u", "m" * 1500), (None, "u", "m" * 1500)]
    got = A.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    kinds = sorted((str(x.page_id), x.record_type) for x in got.collect())
    assert kinds == [("5", "response"), ("5", "revisit"), ("None", "response"), ("None", "revisit")]


def test_no_pages(spark):
    assert A.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
