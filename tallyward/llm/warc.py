"""WARC records in ZIP packages, written with revisit records and range-read without extraction.

A package holds two stored (uncompressed) members: archive/data.warc.gz, one gzip member per WARC
record, and indexes/index.cdxj, one line per record with its place. The reader parses the end of
the central directory (also ZIP64), the central directory and the local headers, takes the places
of records from the index, and reads ranges of the package; without an index it walks the records.

Null html is an empty payload; a null url is written as urn:no-url. Rows that repeat the largest
page_id of a payload are all responses, as are rows of a payload that has only null page_ids.
Empty tables make no package and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import Scratch, table

#: A package is closed beyond so many bytes; adjacent records are read together up to so many.
PACKAGE_BYTES, READ_BYTES = 128 << 20, 1 << 20
_DATE = "2000-01-01T00:00:00Z"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str, str]:
    """One WARC record, its payload digest and its type. A revisit has the HTTP headers only."""
    kind, sha = ("response" if refers_to is None else "revisit"), digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{sha}')}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url) if url else 'urn:no-url'}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", sha, kind


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Package:
    """A ZIP package under a name that no other attempt of the task uses."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, path = _fs(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz", (2000, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        data, sha, kind = record(page_id, url, payload, refers_to)
        data = _gzip(data)
        self.member.write(data)
        self.lines.append(f"{_clean(url or 'urn:no-url')} 20000101000000 " + json.dumps({"offset": self.at, "length": len(data), "digest": f"sha1:{sha}", "type": kind, "filename": "data.warc.gz"}))
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo("indexes/index.cdxj", (2000, 1, 1, 0, 0, 0)), "\n".join(self.lines))
        self.zip.close()
        self.sink.close()
        return self.uri, len(self.lines), self.at


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns the packages (package, records, bytes), lazily.

    Among equal payloads of min_bytes or more, the row of the largest page_id is the response.
    Save the result once and read that: a repeated run writes other packages, and files of lost
    attempts are in no manifest.
    """
    own = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    last = own.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("last"))
    joined = own.join(last, "sha", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in batches:
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in b.columns], strict=True):
                package = package or Package(folder)
                package.add(page_id, url, payload, refers_to)
                if package.at >= PACKAGE_BYTES:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["package", "records", "bytes"])

    return joined.mapInArrow(work, "package string, records long, bytes long")


# --- reading ------------------------------------------------------------------------------------


def members(source: pa.NativeFile) -> list[dict]:
    """Members of a ZIP package: name, method, offset of the data, size. Only directories are read."""
    size = source.size()
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # ZIP64 locator
        (at64,) = struct.unpack_from("<Q", tail, end - 12)
        record64 = source.read_at(56, at64)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    directory, at, found = source.read_at(length, start), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", directory, at + 10)
        packed, full, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name, extra = directory[at + 46 : at + 46 + n].decode("utf-8", "replace"), directory[at + 46 + n : at + 46 + n + m]
        i = 0
        while i + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, i)
            if tag == 1:  # ZIP64: only what does not fit above, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, i + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            i += 4 + width
        found.append({"name": name, "method": method, "local": local, "size": packed})
        at += 46 + n + m + k
    for x in found:
        head = source.read_at(30, x["local"])
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"broken local header of {x['name']}")
        n, m = struct.unpack_from("<HH", head, 26)
        x["offset"] = x["local"] + 30 + n + m
    return found


def _walk(source: pa.NativeFile, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Places of the gzip members between two offsets, for packages without an index."""
    while at < end:
        d, used = zlib.decompressobj(31), 0
        while not d.eof:
            data = source.read_at(min(READ_BYTES, end - at - used), at + used)
            if not data:
                raise ValueError("a record ends too early")
            d.decompress(data)
            used += len(data)
        used -= len(d.unused_data)
        yield at, used
        at += used


def locate(packages: DataFrame) -> DataFrame:
    """Blocks of adjacent records: package, offset, lengths; a block is READ_BYTES long at most, or one record."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = _fs(uri)
                rows: list[tuple[str, int, list[int]]] = []
                with fs.open_input_file(path) as source:
                    stored = {x["name"]: x for x in members(source) if x["method"] == 0}
                    archives = {n: x for n, x in stored.items() if re.fullmatch(r"archive/.*\.warc\.gz", n)}
                    places, indexed = [], set()
                    for name, x in stored.items():
                        if re.fullmatch(r"indexes/.*\.cdxj?", name):
                            for line in source.read_at(x["size"], x["offset"]).decode().splitlines():
                                if "{" in line:
                                    e = json.loads(line[line.index("{") :])
                                    own = archives[f"archive/{e['filename']}"]
                                    indexed.add(own["name"])
                                    places.append((own["offset"] + int(e["offset"]), int(e["length"])))
                    for name, x in archives.items():
                        if name not in indexed:
                            places += _walk(source, x["offset"], x["offset"] + x["size"])
                for at, n in sorted(places):
                    if rows and rows[-1][1] + sum(rows[-1][2]) == at and sum(rows[-1][2]) + n <= READ_BYTES:
                        rows[-1][2].append(n)
                    else:
                        rows.append((uri, at, [n]))
                if rows:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["package", "offset", "lengths"])

    return packages.select("package").mapInArrow(work, "package string, offset long, lengths array<long>")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
    sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
    full = int(re.search(rb"(?im)^Content-Length: (\d+)", http)[1])
    if h["WARC-Type"] == "response" and (digest(payload) != sha or len(payload) != full):
        raise ValueError(f"the payload of page {h.get('WARC-Page-ID')} does not match its digest")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("WARC-Page-ID"), "url": h["WARC-Target-URI"], "payload": payload, "payload_bytes": full, "payload_digest": sha, "record_type": h["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID")}


_FIELDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of the packages. Blocks are dealt out anew, so that one large package keeps many tasks busy."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, at, lengths in zip(*[c.to_pylist() for c in b.columns], strict=True):
                fs, path = _fs(uri)
                with fs.open_input_file(path) as source:
                    data = io.BytesIO(source.read_at(sum(lengths), at))
                rows = [parse_record(zlib.decompress(data.read(n), 31)) for n in lengths]
                yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    blocks = locate(packages)
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "package", "offset").mapInArrow(work, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = scratch.save(write_packages(pages, scratch.path("packages")), "manifest")
    return read_packages(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as s from p),
m as (select s, max(page_id) as last from d group by s),
b as (
  select page_id, payload_bytes, last,
    list_transform(range(8), lambda i: ('0x' || substr(s, (5 * i + 1)::int, 5))::bigint) as q
  from d join m using (s)
)
select page_id, payload_bytes,
  list_aggregate(list_transform(q, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::int + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::int + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::int + 1, 1)), 'string_agg', '') as payload_digest,
  case when page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from last then last end as refers_to
from b
"""

QUERIES = {"op10_warc_zip": op10_warc_zip}
SQL = {"op10_warc_zip": _SQL}
