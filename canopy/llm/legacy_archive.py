"""Legacy archives (ARC) to WARC: header lines by version, declared lengths, synthesised records.

An ARC file starts with a version block whose header line has the name ``filedesc://``; it says
which version the header lines of all records after it have, and lists their fields. Version 1
has five fields, version 2 ten. A record is its header line, as many payload bytes as the line's
last field declares, and a newline; payloads are never searched for anything.

Each ARC record becomes a WARC record: the id is a name-based UUID of archive, offset and URL, so
that a second run gives the same; the 14-digit date becomes ISO 8601; the block's SHA-1 becomes
the payload digest. Of equal payloads of at least ``REVISIT_BYTES``, the one with the largest page
id is a response and the others are revisits of it, which name it and carry no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from canopy.llm.common import sliced
from canopy.session import scratch_path

REVISIT_BYTES = 1000
#: Records of a legacy archive, and bytes of legacy archives (compressed) aimed at in a WARC archive.
ARCHIVE_RECORDS = 1024
CONVERTED_BYTES = 4 << 20
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:legacy-archive")
#: Field names of the header lines of both versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# --- ARC ----------------------------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    told = f"{version} 0 canopy\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    line += f"{len(told)}\n" if version == 1 else f"200 - - 0 {name} {len(told)}\n"
    return line.encode() + told


def arc_record(version: int, name: str, url: str, date: str, payload: bytes) -> bytes:
    """Header line and payload. Fields may hold no blanks, so those of a URL are escaped."""
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) or "-"
    line = f"{url} 0.0.0.0 {date} text/html "
    line += f"{len(payload)}\n" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - 0 {name} {len(payload)}\n"
    return line.encode() + payload


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(fields, offset, payload) of the records after the version block, by declared lengths.

    Text before the first version block, unknown versions, and lines with a wrong number of
    fields fail: a length that is not known can't be skipped.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":  # blank lines part records
            at += 1
            continue
        stop = data.index(b"\n", at)
        values = data[at:stop].decode().rstrip("\r").split(" ")
        length = int(values[-1])
        payload = data[stop + 1 : stop + 1 + length]
        if len(payload) < length:
            raise ValueError(f"record at {at} declares {length} bytes and has {len(payload)}")
        if values[0].startswith("filedesc://"):
            version = int(payload.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            names = FIELDS[version].split(" ")
        elif names is None or len(values) != len(names):
            raise ValueError(f"header line at {at} has {len(values)} fields")
        else:
            yield dict(zip(names, values)), at, payload
        at = stop + 1 + length


# --- WARC ---------------------------------------------------------------------------------------


def warc_date(date: str) -> str:
    """14 digits to ISO 8601; missing digits of a short date take their least values."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {offset} {url}')}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC 1.1 record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name.strip()] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record ends before its declared length")
        yield headers, block


# --- Spark --------------------------------------------------------------------------------------

def _pages(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def _save(records: DataFrame, path: str, end: str, level: str, most: int = 0) -> None:
    """One gzipped archive for each partition, or for each ``most`` rows of it; ``level`` as zlib has them.

    The text sink writes bytes as they are, and ``end`` after each row.
    """
    writer = records.select(F.col("record").cast("string")).write.option("maxRecordsPerFile", most)
    writer.option("zlib.compress.level", level).text(path, compression="gzip", lineSep=end)


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Legacy archives of ``pages (page_id, url, html)`` in folder ``path``, both versions by turns.

    Pages are written where they are read. A version block goes before every ``ARCHIVE_RECORDS``
    records, and a file ends there, so each file is an archive. The page id travels in the URL's
    fragment, as the format has no field for it. Null HTML is an empty payload; null URLs are
    empty, null ids left out.
    """
    most = ARCHIVE_RECORDS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, written, version, name = TaskContext.get().partitionId(), 0, 1, ""
        for batch in sliced(batches, 256):
            records = []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if written % most == 0:
                    turn = written // most
                    version, name = 1 + (part + turn) % 2, f"legacy-{part:06d}-{turn:04d}.arc"
                    records.append(arc_version_block(version, name, date))
                written += 1
                fragment = f"#page={'' if page is None else page}"
                records.append(arc_record(version, name, url + fragment, date, html.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    _save(_pages(pages).mapInArrow(packed, "record binary"), path, "\n", "BEST_SPEED", most + 1)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the archives, each one read whole: their records are bounded when written."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of one archive after another."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read_arc_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``archive, place, page_id, url, date, content_type, digest, bytes, payload`` of a folder's records.

    ``digest`` is the payload's SHA-1, ``payload`` null where payloads are not asked for.
    """
    kinds = {
        "archive": pa.string(), "place": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "date": pa.string(),
        "content_type": pa.string(), "digest": pa.string(), "bytes": pa.int64(), "payload": pa.binary(),
    }
    schema = pa.schema(list(kinds.items()))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path_, content in _contents(batches):
                name = path_.rsplit("/", 1)[-1]
                for fields, offset, payload in read_arc(gzip.decompress(content)):
                    url, _, page = fields["URL"].rpartition("#page=")
                    yield (
                        name, offset, int(page) if page else None, url, fields["Archive-date"], fields["Content-type"],
                        hashlib.sha1(payload).hexdigest(), len(payload), payload if payloads else None,
                    )

        yield from _in_batches(rows(), schema)

    return _archives(spark, path).mapInArrow(
        parsed,
        "archive string, place long, page_id long, url string, date string, content_type string, digest string, "
        "bytes long, payload binary",
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = REVISIT_BYTES) -> None:
    """Legacy archives of one folder to gzipped WARC archives in another.

    Equal payloads are found on digests alone; payloads are shuffled once, to the archives they go
    to, whose number follows the bytes of the legacy ones.
    """
    size = spark.read.format("binaryFile").load(arc_path).agg(F.sum("length")).first()[0] or 0
    spread = max(1, -(-size // CONVERTED_BYTES))
    seen = read_arc_files(spark, arc_path, payloads=False).where(F.col("bytes") >= least)
    seen = seen.select("archive", "place", "page_id", "digest")
    # A null id is smaller than any other; equal largest ids go by archive and place.
    first = seen.groupBy("digest").agg(F.max(F.struct("page_id", "archive", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    told = (
        seen.join(first.where("n > 1").select("digest", "first"), "digest")
        .where("first.archive != archive or first.place != place")
        .select("archive", "place", F.lit(True).alias("revisit"), F.col("first.page_id").alias("of_page"))
    )
    deal = lambda df: df.repartition(spread, "archive", "place")
    rows = deal(read_arc_files(spark, arc_path)).join(deal(told), ["archive", "place"], "left")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in sliced(batches, 256):
            out = []
            for row in batch.to_pylist():
                if not begun:
                    out.append(_info_of(row))
                    begun = True
                out.append(_record_of(row))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    _save(rows.mapInArrow(packed, "record binary"), warc_path, "\r\n\r\n", "THREE")


def _info_of(row: dict) -> bytes:
    headers = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", record_id(row["archive"], row["place"], "warcinfo")),
        ("WARC-Date", warc_date(row["date"])),
        ("Content-Type", "application/warc-fields"),
    ]
    return warc_record(headers, b"software: canopy\r\nformat: WARC File Format 1.1\r\n")


def _record_of(row: dict) -> bytes:
    revisit = bool(row["revisit"])
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
    page = lambda x: "" if x is None else str(x)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["archive"], row["place"], row["url"])),
        ("WARC-Date", warc_date(row["date"])),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", digest),
        ("Content-Type", row["content_type"]),
        ("X-Page", page(row["page_id"])),
        ("X-Payload-Length", str(row["bytes"])),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page", page(row["of_page"])),
        ]
    return warc_record(headers, b"" if revisit else row["payload"])


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page: see ``archive_pages``. Digests of payloads are checked."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
         ("url", pa.string()), ("date", pa.string())]
    )
    number = lambda x: int(x) if x else None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, content in _contents(batches):
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
                    for h, block in read_warc(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if h["WARC-Type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
                            raise ValueError(f"the payload of {h['WARC-Record-ID']} does not have its digest")
                        yield (
                            number(h["X-Page"]), int(h["X-Payload-Length"]), digest, h["WARC-Type"],
                            number(h.get("X-Refers-To-Page")), h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"],
                        )

        yield from _in_batches(rows(), schema)

    return _archives(spark, path).mapInArrow(
        parsed,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, url string, date string",
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages to legacy archives, those converted to WARC, and the WARC archives read back.

    One row for each row of ``pages``: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` and the record's id, URL and date. Null HTML is an empty payload; a null page id
    stays null and is the response only among nulls; repeated rows are records of their own, of
    which one is the response; empty tables give no rows; other columns are left out.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "llm-arc"), scratch_path(spark, "llm-warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc_files(spark, warc)
