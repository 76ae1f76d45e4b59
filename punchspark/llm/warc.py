"""Legacy archive converter: ARC files, version 1 and 2, to WARC files, and back to rows.

Archives are written and read by Spark alone. A record that ends in a line feed is a line of
Spark's text writer, so a part file is a valid archive (gzip), and reading uses the binary
file source. Records are parsed as a stream by their declared lengths, never by looking for
separators, so payloads may hold anything. The source hands a worker each part file whole, so a
worker holds a file beside one record and one output block.

* ``write_arc``: a URL record per page (an HTTP response with the page's id in its header),
  behind a version block ("filedesc") that declares the fields of the header lines.
* ``read_arc``: header lines by the fields of the version block in force.
* ``convert``: WARC identifier (a UUID made from the archive's record), timestamp, type and
  digests for every ARC record. Of records with equal payloads (compared by length and
  SHA-256) the one with the largest page id is a response, and the others revisit it. Types
  are settled on light rows; payloads move once, joined by the unique record id, so a payload
  that a third of the records share is not gathered anywhere.
* ``write_warc`` and ``read_warc``: the records as WARC/1.0. A revisit has no payload; its
  length is that of the HTTP header, its digest the WARC-Payload-Digest.

Defined results: a null html counts as empty, a null url becomes "about:blank", white space in
a URL is percent-encoded. A null page id counts as the smallest. Rows that repeat a page are
records of their own. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punchspark.llm.common import BLOCK_BYTES, blocks
from punchspark.session import ensure_checkpoint_dir

ARC_DATE = "20240101000000"
ARCHIVE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
"""Fixed value of the WARC/1.0 format."""
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
"""Fixed values of the ARC formats: the header lines that a version block declares."""
SPACE = bytes(range(33))
RECORD = "record_id string, page_id long, url string, date string, http binary, payload binary, payload_bytes long, payload_digest string, payload_key string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _url(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) in SPACE else c for c in url or "") or "about:blank"


def _lines(rows: list[bytes]) -> pa.RecordBatch:
    """Records as lines of the text writer, which adds the line feed that each ends in."""
    return pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in rows], pa.binary())], ["value"])


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ARC records; a new archive with its version block, of the other version, every ``ARCHIVE_BYTES``."""
    place, archives, size = TaskContext.get().partitionId(), 0, ARCHIVE_BYTES
    for part in blocks(batches, "html"):
        out = []
        for page, url, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            if size >= ARCHIVE_BYTES:
                archives, size = archives + 1, 0
                version = 1 + (place + archives) % 2
                name = f"pages-{place:06d}-{archives:06d}.arc"
                body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
                extra = f"200 - - 0 {name} " if version == 2 else ""
                out.append(f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain {extra}{len(body)}\n".encode() + body + b"\n")
            payload = (html or "").encode()
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            extra = f"200 - - {size} {name} " if version == 2 else ""
            head = f"{_url(url)} 0.0.0.0 {ARC_DATE} text/html {extra}{len(http) + len(payload)}\n".encode()
            out.append(head + http + payload + b"\n")
            size += len(out[-1])
        yield _lines(out)


def write_arc(pages: DataFrame, path: str) -> None:
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(rows.mapInArrow(_arc_records, "value binary"), path)


def _write(lines: DataFrame, path: str) -> None:
    lines.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def arc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of the URL records of an ARC stream, whichever versions it declares."""
    fields = None
    while line := stream.readline():
        if line in (b"\n", b"\r\n"):
            continue
        values = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        content = stream.read(int(values[-1]))
        if len(content) < int(values[-1]):
            raise ValueError(f"ARC record of {values[0]} ends after {len(content)} of {values[-1]} bytes")
        if values[0].startswith("filedesc:"):
            fields = content.split(b"\n")[1].decode().split(" ")
        elif fields is None or len(values) != len(fields):
            raise ValueError(f"ARC header line with {len(values)} fields, not as its version block declares: {values[0]}")
        else:
            yield dict(zip(fields, values)), content


def _http(content: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(header with its blank line, payload, header fields in lower case)."""
    end = content.find(b"\r\n\r\n")
    cut = len(content) if end < 0 else end + 4
    head = dict(x.split(":", 1) for x in content[:cut].decode("latin-1").split("\r\n")[1:] if ":" in x)
    return content[:cut], content[cut:], {k.strip().lower(): v.strip() for k, v in head.items()}


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, io.BufferedIOBase]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("path")[k].as_py(), gzip.GzipFile(fileobj=io.BytesIO(batch.column("content")[k].as_py()))


def _in_blocks(rows: Iterator[tuple], weight, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) + 200
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _parse_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for path, stream in _files(batches):
            for k, (head, content) in enumerate(arc_records(stream)):
                http, payload, fields = _http(content)
                record = uuid.uuid5(uuid.NAMESPACE_URL, f"{path.rsplit('/', 1)[-1]} {k} {head['URL']}")
                page, d = fields.get("x-page-id", ""), head["Archive-date"]
                date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                key = f"{len(payload)} {hashlib.sha256(payload).hexdigest()}"
                yield f"<urn:uuid:{record}>", int(page) if page else None, head["URL"], date, http, payload, len(payload), base32_sha1(payload), key

    s, b, i = pa.string(), pa.binary(), pa.int64()
    names = [c.split()[0] for c in RECORD.split(", ")]
    yield from _in_blocks(rows(), lambda r: len(r[5]), pa.schema(list(zip(names, (s, i, s, s, b, b, i, s, s)))))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per URL record (RECORD)."""
    return _binary(spark, path).mapInArrow(_parse_arc, RECORD)


def convert(records: DataFrame) -> DataFrame:
    """The records with record_type and, for revisits, refers_id, refers_page and refers_url."""
    light = records.select("record_id", "page_id", "url", "payload_key")
    best = light.groupBy("payload_key").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "record_id", "url")).alias("best"))
    typed = light.join(best, "payload_key").select(F.col("record_id").alias("typed_id"), F.col("best"))
    both = records.join(typed, F.col("record_id") == F.col("typed_id"))
    own = F.col("record_id") == F.col("best.record_id")
    named = {"refers_id": "record_id", "refers_page": "page_id", "refers_url": "url"}
    return both.select(
        *records.columns,
        F.when(own, "response").otherwise("revisit").alias("record_type"),
        *[F.when(~own, F.col(f"best.{c}")).alias(name) for name, c in named.items()],
    )


def _warc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "payload"):
        out = []
        for r in part.to_pylist():
            revisit = r["record_type"] == "revisit"
            block = r["http"] if revisit else r["http"] + r["payload"]
            head = [
                "WARC/1.0",
                f"WARC-Type: {r['record_type']}",
                f"WARC-Target-URI: {r['url']}",
                f"WARC-Date: {r['date']}",
                f"WARC-Record-ID: {r['record_id']}",
                f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
                "Content-Type: application/http; msgtype=response",
                f"Content-Length: {len(block)}",
            ]
            if revisit:
                head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {r['refers_id']}", f"WARC-Refers-To-Target-URI: {r['refers_url']}"]
                head += [f"X-Refers-To-Page-Id: {r['refers_page']}"] * (r["refers_page"] is not None)
            out.append("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
        yield _lines(out)


def write_warc(records: DataFrame, path: str) -> None:
    _write(records.mapInArrow(_warc_records, "value binary"), path)


def warc_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a WARC stream."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        yield head, stream.read(int(head["Content-Length"]))


def _parse_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for path, stream in _files(batches):
            for head, block in warc_records(stream):
                if head["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
                    raise ValueError(f"block of {head['WARC-Record-ID']} does not have its digest")
                _, payload, fields = _http(block)
                page, refers = fields.get("x-page-id", ""), head.get("X-Refers-To-Page-Id")
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
                size = int(fields["content-length"]) if revisit else len(payload)
                yield int(page) if page else None, size, digest, head["WARC-Type"], int(refers) if refers else None, head["WARC-Target-URI"], head["WARC-Record-ID"], None if revisit else payload

    s, i = pa.string(), pa.int64()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "payload")
    yield from _in_blocks(rows(), lambda r: len(r[7] or b""), pa.schema(list(zip(names, (i, i, s, s, i, s, s, pa.binary())))))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to (page id), url, record_id, payload."""
    return _binary(spark, path).mapInArrow(_parse_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, payload binary")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages through ARC files and WARC files, read back from the latter; ``folder`` is a shared one."""
    spark = pages.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/archives-{uuid.uuid4()}"
    write_arc(pages, f"{folder}/arc")
    write_warc(convert(read_arc(spark, f"{folder}/arc")), f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")
