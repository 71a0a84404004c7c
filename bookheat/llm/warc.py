"""WARC archives: a distributed writer and a splittable reader.

Writer: every task writes one file of gzip members, one per record, with pyarrow's file systems, and
reports it in a manifest that Spark commits, so a repeated task leaves an unnamed file and no second
record. Of records with equal payloads of ``LEAST_BYTES`` and more, that with the largest id is a
response and the others revisit it.

Reader: files are cut into byte ranges, a row each. A task looks for the gzip magic in its range, decodes
the headers of each candidate to see that it is a record, checks the member to its end (length, CRC), and
owns the records that start inside its range, however far they reach beyond it. A member that is stored
inside another record's payload can look like a record to the task of a later range; records that start
inside an earlier record of their file are dropped at the end.

Cases: a null payload is empty; records with a null id are written and read with a null id, and take
part in the choice of the response only if no equal payload has an id; repeated rows with the largest id
are responses all; line breaks in a URL are percent-encoded; other columns are ignored; an empty table
gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookheat.llm.common import chunks, fan_out
from bookheat.session import scratch_path, stage

LEAST_BYTES = 1000
SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
_ID = re.compile(r"<urn:record:(-?\d+|null)>")


def file_system(path: str):
    """pyarrow's file system and path for a URI or a plain absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _urn(number: int | None) -> str:
    return f"<urn:record:{'null' if number is None else number}>"


def record(number: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(number)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def with_responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url``, ``html``, ``revisit`` and ``refers_to`` of every page."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= LEAST_BYTES, F.sha2(F.col("html").cast("binary"), 256)))
    same = rows.filter("digest is not null").groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(same.filter("n > 1").select("digest", "first"), "digest", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    return rows.select("id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Manifest (``path``, ``bytes``, ``records``) of the archive written to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = file_system(name)
        out, size, count = None, 0, 0
        for b in chunks(batches, "html"):
            if out is None:
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            for i, u, h, v, r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html", "revisit", "refers_to"))):
                member = record(i, u, h.encode(), r, v)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["path", "bytes", "records"])

    return stage(records.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


class _Bytes:
    """A file from ``start`` on, read as far as asked for."""

    def __init__(self, handle, start: int):
        self.handle, self.start, self.data, self.done = handle, start, bytearray(), False
        handle.seek(start)

    def upto(self, end: int) -> None:
        """Have the bytes before the position ``end`` of the file, if it has them."""
        while not self.done and self.start + len(self.data) < end:
            more = self.handle.read(max(READ_BYTES, end - self.start - len(self.data)))
            self.done = not more
            self.data += more


def _member(source: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The record (decoded) and the end of the member at ``at``; None if it is not a record."""
    unzip, out, pos = zlib.decompressobj(31), bytearray(), at
    while not unzip.eof:
        source.upto(pos + 65536)
        part = bytes(source.data[pos - source.start : pos - source.start + 65536])
        if not part:
            return None
        try:
            out += unzip.decompress(part)
        except zlib.error:
            return None
        if not b"WARC/1.".startswith(out[:7]) and out[:7] != b"WARC/1.":
            return None
        pos += len(part)
    return (bytes(out), pos - len(unzip.unused_data)) if out[:7] == b"WARC/1." else None


def parse(raw: bytes) -> dict | None:
    """Fields of a decoded record; None if headers or length are not those of a record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if not gap or not fields.get("Content-Length", "").isdigit() or len(rest) != int(fields["Content-Length"]) + 4 or "WARC-Type" not in fields:
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    said = re.search(rb"Content-Length: (\d+)", http)
    number, refers = (_ID.fullmatch(fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    return {
        "record_type": fields["WARC-Type"],
        "id": int(number[1]) if number and number[1] != "null" else None,
        "url": fields.get("WARC-Target-URI"),
        "refers_to": int(refers[1]) if refers and refers[1] != "null" else None,
        "payload": None if fields["WARC-Type"] == "revisit" else payload,
        "payload_bytes": int(said[1]) if said else len(payload),
        "payload_digest": base64.b32decode(digest).hex() if len(digest) == 32 else None,
        "intact": fields["WARC-Type"] == "revisit" or len(digest) != 32 or hashlib.sha1(payload).digest() == base64.b32decode(digest),
    }


_FIELDS = [("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()), ("id", pa.int64()), ("url", pa.string()),
           ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())]
RECORDS = "path string, offset long, end long, record_type string, id long, url string, refers_to long, payload binary, payload_bytes long, payload_digest string, intact boolean"


def scan(path: str, start: int, end: int) -> Iterator[dict]:
    """Records of the file at ``path`` that start in [start, end)."""
    system, name = file_system(path)
    with system.open_input_file(name) as handle:
        source, at = _Bytes(handle, start), start
        source.upto(end + len(MAGIC) - 1)
        while True:
            hit = source.data.find(MAGIC, at - source.start, end - source.start + len(MAGIC) - 1)
            if hit < 0:
                return
            at = source.start + hit
            got = _member(source, at)
            fields = parse(got[0]) if got else None
            if fields:
                yield {"path": path, "offset": at, "end": got[1]} | fields
            at = got[1] if fields else at + 1


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files of ``manifest`` (``path``, ``bytes``), by byte ranges of ``split_bytes``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = manifest.select("path", "bytes", starts.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stop in zip(*(b.column(c).to_pylist() for c in ("path", "start", "stop"))):
                rows, held = [], 0
                for r in scan(path, start, stop):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))

    found = ranges.repartition(fan_out(manifest.sparkSession), "path", "start").mapInArrow(run, RECORDS)
    before = W.partitionBy("path").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("end").over(before)).filter("_reach is null or _reach <= offset").drop("_reach")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Manifest of an archive of ``pages`` (``page_id``, ``url``, ``html``) in ``folder``."""
    return write(with_responses(pages), folder or scratch_path(pages.sparkSession, "warc"))
