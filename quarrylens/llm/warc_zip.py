"""WARC archives packaged in ZIP files, read by ranges.

An archive is a ZIP file of stored members: gzipped WARC records, each a gzip
member of its own, and an index with a line for each record. The reader finds
the end record of the ZIP directory (or its ZIP64 form), parses the central
directory, locates the stored members, and reads single records by the ranges
that the index names. Nothing is extracted.

Archives are written by tasks to the shared folder under names of their own, so
a task that runs again leaves the first one's file unused. They are at most
about ``ARCHIVE_BYTES`` long, built and read in bounded memory.

Of records with equal payloads of at least ``REVISIT_LEAST`` bytes the one with
the smallest page id is a response, the others are revisits of it.

Defined results: a null html is an empty payload; a null url is empty; rows that
share the smallest id of a payload are all responses; rows with a null id are
revisits where another id has the payload, else responses; an empty table gives
an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, small_batches

REVISIT_LEAST = 100
ARCHIVE_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:page:"

# ---- records ----------------------------------------------------------------------------------


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the response's HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_ID)
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """Type, page ids, and full payload's size and digest of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = _headers(lines[1:])
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http.decode().split("\r\n")[1:])["content-length"]), h["warc-payload-digest"].partition(":")[2]
    if h["warc-type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {h['warc-record-id']} does not match its header")
    return {"page_id": _page(h["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": h["warc-type"], "refers_to": _page(h.get("warc-refers-to")), "url": h["warc-target-uri"], "payload": payload}


# ---- ZIP directories --------------------------------------------------------------------------


class RangeFile:
    """Ranges of a file of any file system that pyarrow knows."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(length, start)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def directory(f: RangeFile) -> dict[str, tuple[int, int, int]]:
    """(header offset, size, method) of the members of a ZIP file, by name."""
    tail_at = max(0, f.size - (22 + 0xFFFF))
    tail = f.read(tail_at, f.size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    entries, size, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if entries == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = f.read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack("<Q", locator[8:16])
        wide = f.read(at, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        entries, size, start = struct.unpack("<QQQ", wide[32:56])
    data, at, found = f.read(start, size), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("broken ZIP directory")
        (method,) = struct.unpack("<H", data[at + 10 : at + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        (offset,) = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + 46 : at + 46 + n].decode()
        more, end_of = at + 46 + n, at + 46 + n + extra
        while more + 4 <= end_of:
            tag, length = struct.unpack("<HH", data[more : more + 4])
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                wide, field = data[more + 4 : more + 4 + length], 0
                if plain == 0xFFFFFFFF:
                    (plain,), field = struct.unpack("<Q", wide[field : field + 8]), field + 8
                if packed == 0xFFFFFFFF:
                    (packed,), field = struct.unpack("<Q", wide[field : field + 8]), field + 8
                if offset == 0xFFFFFFFF:
                    (offset,) = struct.unpack("<Q", wide[field : field + 8])
            more += 4 + length
        found[name] = (offset, packed, method)
        at = end_of + comment
    return found


def stored(f: RangeFile, entry: tuple[int, int, int]) -> tuple[int, int]:
    """(start, size) of a stored member's bytes within the file."""
    offset, size, method = entry
    if method != 0:
        raise ValueError("the member is compressed; only stored members can be read by ranges")
    local = f.read(offset, 30)
    if local[:4] != b"PK\3\4":
        raise ValueError("no member where the directory names one")
    name, extra = struct.unpack("<HH", local[26:30])
    return offset + 30 + name + extra, size


def records(uri: str) -> Iterator[dict]:
    """The records of an archive, each by a range read of its own."""
    with RangeFile(uri) as f:
        members = directory(f)
        data_at, data_size = stored(f, members[DATA])
        index_at, index_size = stored(f, members[INDEX])
        for line in f.read(index_at, index_size).decode().splitlines():
            entry = json.loads(line.partition("{")[1] + line.partition("{")[2])
            if entry["offset"] + entry["length"] > data_size:
                raise ValueError("the index points beyond the records")
            yield parse_record(gzip.decompress(f.read(data_at + entry["offset"], entry["length"])))


class ArchiveWriter:
    """Builds archives in memory and writes each at once."""

    def __init__(self, folder: str):
        self.folder = folder
        self.begin()

    def begin(self) -> None:
        self.data, self.index, self.count = io.BytesIO(), [], 0

    def add(self, page_id: int | None, url: str, packed: bytes, digest: str) -> None:
        entry = {"offset": self.data.tell(), "length": len(packed), "digest": f"sha256:{digest}", "record": page_id}
        self.index.append(f"{json.dumps(url)} {_DATE} {json.dumps(entry)}")
        self.data.write(packed)
        self.count += 1

    def full(self) -> bool:
        return self.data.tell() >= ARCHIVE_BYTES

    def finish(self) -> tuple[str, int, int]:
        """(path, records, bytes) of the archive just written."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, content in ((DATA, self.data.getvalue()), (INDEX, "\n".join(self.index).encode())):
                with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                    member.write(content)
        uri = f"{self.folder}/{uuid.uuid4().hex}.wacz"
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(out.getvalue())
        result = uri, self.count, len(out.getvalue())
        self.begin()
        return result


# ---- Spark stages -----------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html): (path, records, bytes) of the archives."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/op6-archives-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.replace("file:", "", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    first = cut(rows.where(F.octet_length("body") >= REVISIT_LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "op6-first")
    paired = rows.join(first.hint("merge"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = ArchiveWriter(folder), []
        for b in batches:
            for page_id, url, body, digest, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                data = record(page_id, url, body, digest, refers_to)
                writer.add(page_id, url, gzip.compress(data, 1, mtime=0), digest)
                if writer.full():
                    done.append(writer.finish())
        if writer.count:
            done.append(writer.finish())
        if done:
            path, count, size = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(count, pa.int64()), pa.array(size, pa.int64())], ["path", "records", "bytes"])

    written = paired.select("page_id", "url", "body", "digest", refers.alias("refers_to")).mapInArrow(run, "path string, records long, bytes long")
    return cut(written, "op6-written")  # the archives that count


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the archives named in ``archives`` (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *(["payload"] if with_payload else [])]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], k) for n, k in zip(names, kinds)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                held = []
                for r in records(path):
                    held.append(r)
                    if len(held) >= 500:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    parallel = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("path").repartition(4 * parallel).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of pages and read them back: a row for each page."""
    return read_archives(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
