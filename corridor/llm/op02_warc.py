"""Operator 2: legacy ARC archives converted to WARC, with revisit records for repeated payloads.

``write_arc`` lays captures out as a version 1 or version 2 ARC file,
``parse_arc`` reads one by the field line of its version block and the declared
lengths, ``convert`` synthesises the WARC records (identifier, 14-digit date to
W3C date, type, digests), and ``read_warc`` reads a gzip-per-record WARC back.
``pages_to_warc`` does it for a table: archives are rows of a table in the
shared folder, so any store that Spark writes to will do.

Any ARC file of either version converts: a block that begins with an HTTP
status line is a ``response`` whose payload follows the header block, all else
(``dns:`` records, blocks without a header) is a ``resource`` that is payload as
a whole.  Identifiers are made from the archive's name and the record's place
in it, so no two records share one; a revisit names its original by target URI
and date, as its WARC profile has it.

Defined results: null html is an empty payload; a null url is
``urn:page:<page_id>``.  Payloads are equal if length and SHA-1 are.  Rows with
the group's largest page_id are all responses, also when that page_id is
repeated; a null page_id counts as smaller than any other, and a group in which
all are null is all responses.  Empty tables give no rows; extra columns are
ignored.  Payloads are kept whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import lean, materialise, table

DEDUP_BYTES = 1000  # smaller payloads are never revisits
ARCHIVE_BYTES = 1 << 20  # an archive is closed when it holds this much
SALTS = 8  # parts in which a payload's captures meet its response
DATE = "20240101000000"

#: fixed values: the field lines of the two ARC versions
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class ArcError(ValueError):
    pass


def arc_header(name: str, version: int, date: str = DATE) -> bytes:
    body = f"{version} 0 corridor\n{ARC_FIELDS[version]}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    if version == 2:
        line += f"200 - - 0 {name} "
    return f"{line}{len(body)}\n".encode() + body


def clean_url(url: str) -> str:
    """Blanks and control characters would end a field of the header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def arc_record(url: str, ip: str, date: str, mime: str, block: bytes, version: int, name: str, offset: int) -> bytes:
    line = f"{clean_url(url)} {ip} {date} {mime} "
    if version == 2:
        line += f"200 {zlib.crc32(block):08x} - {offset} {name} "
    return f"\n{line}{len(block)}\n".encode() + block


def parse_arc(data: bytes) -> Iterator[dict]:
    """The version block, then the records: fields by name, ``block`` and ``at`` (offset of the header line)."""

    def line(at: int) -> tuple[str, int]:
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no header line at {at}")
        return data[at:end].decode("utf-8", "surrogateescape"), end + 1

    def block(at: int, length: str) -> tuple[bytes, int]:
        if not length.isdigit() or at + int(length) > len(data):
            raise ArcError(f"declared length {length!r} at {at} does not fit")
        return data[at : at + int(length)], at + int(length)

    head, at = line(0)
    if not head.startswith("filedesc://"):
        raise ArcError("no version block")
    body, at = block(at, head.rsplit(" ", 1)[-1])
    first, names = [x.rstrip("\r") for x in body.decode("utf-8", "surrogateescape").split("\n")[:2]]
    version, fields = first.split(" ")[0], names.split()
    if version not in ("1", "2") or fields[0] != "URL" or fields[-1] != "Archive-length":
        raise ArcError(f"version {first!r} is not known")
    date = re.search(r" (\d{4,14}) ", head)
    yield {"version": int(version), "URL": head.split(" ", 1)[0], "Archive-date": date[1] if date else "", "block": body, "at": 0}
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        start = at
        head, at = line(at)
        values = head.rsplit(" ", len(fields) - 1)  # an old URL may itself hold blanks
        if len(values) != len(fields):
            raise ArcError(f"{len(values)} fields at {start}, {len(fields)} are declared")
        record = dict(zip(fields, values)) | {"version": int(version), "at": start}
        record["block"], at = block(at, record["Archive-length"])
        yield record


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(arc_date: str) -> str:
    """14 digits as a W3C date; month and day missing from a shorter one are the first, the time midnight."""
    d = arc_date + "00000101000000"[len(arc_date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """(header block, payload) of an HTTP response, or None."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [k + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (k := block.find(mark)) >= 0]
    cut = min(ends, default=len(block))
    return block[:cut], block[cut:]


def convert(record: dict, archive: str, original: tuple[int, str, str] | None = None) -> bytes:
    """The WARC record equivalent to a parsed ARC record; ``original`` (page, URI, ARC date) makes it a revisit."""
    block, own = record["block"], record_id(f"{archive}#{record['at']}")
    if "Archive-length" not in record:  # the version block
        body = f"software: corridor\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC/{record['version']}\r\n".encode()
        date = warc_date(record["Archive-date"] or DATE)
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], body)
    parts = http_parts(block)
    payload = block if parts is None else parts[1]
    kind, mime = ("resource", record["Content-type"]) if parts is None else ("response", "application/http; msgtype=response")
    headers = [
        ("WARC-Type", kind if original is None else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Date", warc_date(record["Archive-date"])),
        ("WARC-Target-URI", record["URL"]),
        ("WARC-IP-Address", record["IP-address"]),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("Content-Type", mime),
        ("X-Payload-Length", str(len(payload))),
    ]
    if original is not None:
        page, uri, date = original
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", warc_date(date)),
            ("X-Refers-To-Page", str(page)),
        ]
        block = b"" if parts is None else parts[0]
    return warc_record([*headers, ("WARC-Block-Digest", _sha1(block))], block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; digests and lengths are verified."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a record ends early")
            part = view[at : at + 65536]
            parts.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        raw = b"".join(parts)
        cut = raw.index(b"\r\n\r\n")
        lines = raw[:cut].decode("utf-8", "surrogateescape").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = raw[cut + 4 : cut + 4 + int(headers["Content-Length"])]
        if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != _sha1(block):
            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
        yield headers, block


ARCHIVES = T.StructType([T.StructField("archive", T.StringType()), T.StructField("arc_version", T.IntegerType()), T.StructField("content", T.BinaryType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def page_url(page: int | None, url: str | None) -> str:
    return url or f"urn:page:{'' if page is None else page}"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, count, size = TaskContext.get().partitionId(), 0, 0
    held: list[tuple[str, bytes]] = []
    originals: list[tuple | None] = [None]  # of the version block, then of the records

    def close() -> pa.RecordBatch:
        nonlocal count, size
        version, name = 1 + count % 2, f"part-{task:06d}-{count:06d}"
        data, at = [arc_header(f"{name}.arc", version)], 0
        while held:
            at += len(data[-1])
            url, block = held.pop(0)
            data.append(arc_record(url, "0.0.0.0", DATE, "text/html", block, version, f"{name}.arc", at))
        legacy = b"".join(data)
        data.clear()
        out = b"".join(convert(r, f"{name}.warc.gz", o) for r, o in zip(parse_arc(legacy), originals))
        del originals[1:]
        count, size = count + 1, 0
        return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([version], pa.int32()), pa.array([out], pa.binary())], names=ARCHIVES.names)

    for batch in batches:
        for row in range(batch.num_rows):
            page, url, html, ref, ref_url = (batch.column(c)[row].as_py() for c in ("page_id", "url", "html", "refers_to", "refers_url"))
            payload = (html or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n"
            held.append((page_url(page, url), head.encode() + payload))
            originals.append(None if ref is None else (ref, clean_url(page_url(ref, ref_url)), DATE))
            size += len(payload) + len(head) + 256  # records without a payload fill an archive too
            if size >= ARCHIVE_BYTES:
                yield close()
    if held:
        yield close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            rows = []
            for headers, block in read_warc(batch.column("content")[k].as_py()):
                if headers["WARC-Type"] == "warcinfo":
                    continue
                page = re.search(rb"\r\nX-Page-Id: ([^\r]*)", (http_parts(block) or (b"",))[0])
                digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
                if headers["WARC-Type"] != "revisit":
                    payload = (http_parts(block) or (b"", block))[1]
                    if hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{headers['WARC-Record-ID']} has another payload")
                ref = headers.get("X-Refers-To-Page")
                rows.append((int(page[1]) if page and page[1] else None, int(headers["X-Payload-Length"]), digest, headers["WARC-Type"], int(ref) if ref else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=RECORDS.names)


def with_references(pages: DataFrame, least: int = DEDUP_BYTES) -> DataFrame:
    """page_id, url, html, and page and url of the response that holds the same payload (``refers_to``, ``refers_url``), or nulls.

    Digests are pre-aggregated before the shuffle; payloads held once are not in the
    joined list.  A payload's captures are salted over ``SALTS`` tasks, and the rows
    with html are streamed past a hashed list: they are never sorted.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    large = F.octet_length(html) >= least
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    spread = F.xxhash64("page_id", "url")
    p = p.withColumn("payload", F.when(large, F.concat(F.sha1(html.cast("binary")), F.octet_length(html).cast("string"))).otherwise(F.concat(F.lit("small"), spread.cast("string"))))
    keep = p.where(large).groupBy("payload").agg(F.max(F.struct("page_id", "url")).alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response.page_id is not null")
    keep = keep.select("payload", "response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = p.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(keep.hint("shuffle_hash"), ["payload", "salt"], "left")
    other = ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    return out.select("page_id", "url", "html", *[F.when(other, F.col(f"response.{c}")).alias(a) for c, a in (("page_id", "refers_to"), ("url", "refers_url"))])


def pages_to_warc(pages: DataFrame) -> DataFrame:
    """A table of archives (name, version of the ARC file it came from, content)."""
    return materialise(with_references(pages).mapInArrow(lean(_write), ARCHIVES), "warc", "uncompressed")


def read_archives(archives: DataFrame) -> DataFrame:
    return archives.select("content").mapInArrow(lean(_read), RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(pages_to_warc(table(spark, sf_dir, "pages")))


QUERIES = {"op2_warc": op2_warc}
ORACLES = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        g AS (SELECT payload_digest AS dg, max(page_id) AS response FROM d WHERE payload_bytes >= {DEDUP_BYTES} GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN response IS NOT NULL AND response IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
        FROM d LEFT JOIN g ON dg = payload_digest AND payload_bytes >= {DEDUP_BYTES}
    """
}
