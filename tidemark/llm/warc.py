"""WARC records in ZIP packages: writer, and a reader that range-reads records in place.

A package is a ZIP archive with only stored members: ``archive/data-*.warc.gz``, each record a
gzip member of its own, and ``indexes/index.cdxj`` with place and length of every record. The
reader parses the end record, ZIP64 records and central directory, finds stored members, reads
the index, and fetches records by ranges; nothing is extracted.

Writer tasks stream their rows into packages under names of their own and return them as a
manifest, written as a table; a retried task leaves a package that no manifest names. Reader
tasks get ranges of about ``RANGE_BYTES`` from the indexes, dealt evenly, so a large package
is read by many tasks.

Of equal payloads of at least ``least`` bytes, the record with the largest page id is the
response and the others are revisits that refer to it.

Defined results: a NULL payload is empty; a NULL url becomes ``urn:page:<id>``; rows that
repeat the largest page id of equal payloads are responses all; a NULL page id revisits like
any other but is never referred to; equal payloads without any page id are responses; an empty
table gives packages without records, and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import maybe_broadcast, new_folder, text_of, written

#: Bytes of a member before the next one begins, and of members before the next package does.
MEMBER_BYTES = 16 << 20
PACKAGE_BYTES = 1 << 30
#: Bytes that a reader fetches at once, unless one record is larger; and those of a reading task.
RANGE_BYTES = 1 << 20
TASK_BYTES = 64 << 20

INDEX_NAME = "indexes/index.cdxj"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAX_TAIL = 22 + 0xFFFF


# ---------------------------------------------------------------------------- ZIP reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Package:
    """Directory of a ZIP archive on any file system, read by ranges."""

    def __init__(self, path: str):
        system, place = _filesystem(path)
        self._file = system.open_input_file(place)
        self.length = self._file.size()
        self.members = {m.name: m for m in self._directory()}

    def __enter__(self) -> Package:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()

    def read(self, start: int, length: int) -> bytes:
        got = self._file.read_at(length, start) if length else b""
        if len(got) != length:
            raise ValueError(f"package ends at {self.length}, wanted {length} bytes at {start}")
        return got

    def _directory(self) -> Iterator[Member]:
        tail = self.read(max(0, self.length - _MAX_TAIL), min(self.length, _MAX_TAIL))
        at = self._end_record(tail)
        count, size, offset = struct.unpack_from("<HII", tail, at + 10)
        end = self.length - len(tail) + at
        if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
            mark, _, place, _ = struct.unpack("<4sIQI", self.read(end - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator before the end record")
            record = self.read(place, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, size, offset = struct.unpack_from("<QQQ", record, 32)
        directory, at = self.read(offset, size), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", directory, at + 20)
            (header,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
            packed, header = self._zip64(extra, plain, packed, header)
            yield Member(name, method, packed, header)
            at += 46 + name_n + extra_n + note_n

    @staticmethod
    def _end_record(tail: bytes) -> int:
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                return at
            at = tail.rfind(b"PK\x05\x06", 0, at)
        raise ValueError("no ZIP end record")

    @staticmethod
    def _zip64(extra: bytes, plain: int, packed: int, header: int) -> tuple[int, int]:
        """Sizes and offsets that did not fit, from extra field 1, in their fixed order."""
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                fields = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                if plain == 0xFFFFFFFF:
                    next(fields)
                if packed == 0xFFFFFFFF:
                    packed = next(fields)
                if header == 0xFFFFFFFF:
                    header = next(fields)
                break
            at += 4 + n
        return packed, header

    def start_of(self, name: str) -> int:
        """Offset of a stored member's first byte."""
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed: its records cannot be read by ranges")
        local = self.read(m.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        return m.header + 30 + sum(struct.unpack_from("<HH", local, 26))

    def index(self) -> Iterator[tuple[int, int]]:
        """Offset in the package and length of every record, in order."""
        starts: dict[str, int] = {}
        raw = self.read(self.start_of(INDEX_NAME), self.members[INDEX_NAME].size)
        for line in raw.split(b"\n"):
            if line:
                entry = json.loads(line.split(b" ", 2)[2])
                name = "archive/" + entry["filename"]
                if name not in starts:
                    starts[name] = self.start_of(name)
                yield starts[name] + int(entry["offset"]), int(entry["length"])


# ------------------------------------------------------------------------------- writing


class _Forward:
    """An output stream as ``zipfile`` wants it: forward only, with a position."""

    def __init__(self, stream):
        self._stream, self._at = stream, 0

    def write(self, data: bytes) -> int:
        self._stream.write(data)
        self._at += len(data)
        return len(data)

    def tell(self) -> int:
        return self._at

    def flush(self) -> None:
        self._stream.flush()

    def seekable(self) -> bool:
        return False


class PackageWriter:
    """Streams records into one package, holding at most one member."""

    def __init__(self, path: str):
        system, place = _filesystem(path)
        self._stream = system.open_output_stream(place)
        self._zip = zipfile.ZipFile(_Forward(self._stream), "w", zipfile.ZIP_STORED)
        self._member, self._index, self._number, self.size, self.records = bytearray(), [], 0, 0, 0

    def _name(self) -> str:
        return f"data-{self._number:05d}.warc.gz"

    def add(self, record: bytes, url: str, date: str, digest: str) -> None:
        packed = gzip.compress(record, 3, mtime=0)
        place = {"url": url, "digest": "sha1:" + digest, "filename": self._name(), "offset": len(self._member), "length": len(packed)}
        stamp = re.sub(r"\D", "", date)[:14]
        self._index.append(f"{re.sub(r'\s', '%20', url)} {stamp} {json.dumps(place)}\n")
        self._member += packed
        self.records += 1
        if len(self._member) >= MEMBER_BYTES:
            self._close_member()

    def _close_member(self) -> None:
        if self._member:
            self._put("archive/" + self._name(), bytes(self._member))
            self.size += len(self._member)
            self._member, self._number = bytearray(), self._number + 1

    def _put(self, name: str, data: bytes) -> None:
        self._zip.writestr(zipfile.ZipInfo(name), data)

    def close(self) -> None:
        self._close_member()
        self._put(INDEX_NAME, "".join(self._index).encode())
        self._zip.close()
        self._stream.close()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def warc_record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response with its payload, or a revisit with the payload's HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if revisit:
        fields |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page": str(refers_to)}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record; names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("record ends early")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    return fields, http, payload


# ----------------------------------------------------------------------------- operators


def _payload(column: str) -> Column:
    return text_of(column).cast("binary")


def with_revisits(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """``pages`` with ``_digest`` and ``_refers`` (NULL for responses). Only digests of repeated
    payloads are joined back; copies collapse before they are shuffled."""
    hashed = pages.withColumn("_digest", F.sha1(_payload(payload)))
    large = hashed.where(F.length(_payload(payload)) >= least).select("_digest", F.col(key).alias("_key"))
    repeated = large.groupBy("_digest").agg(F.max("_key").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = written(repeated.where(F.col("_n") > 1).select("_digest", "_first"), "repeated-payloads")
    joined = hashed.join(maybe_broadcast(repeated, repeated.count(), 100), "_digest", "left")
    return joined.withColumn("_refers", F.when(~F.col(key).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def write_packages(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 1000,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write every row as a record; returns the manifest: ``path`` and ``records``."""
    system, place = _filesystem(folder)
    system.create_dir(place, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, path = None, ""
        for batch in batches:
            rows = zip(batch["_k"].tolist(), batch["_url"], batch["_payload"], batch["_digest"], batch["_refers"].tolist())
            for k, u, data, digest, refers in rows:
                if writer is None:
                    path = f"{folder}/pages-{uuid.uuid4().hex}.zip"
                    writer = PackageWriter(path)
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", u if u is not None else f"urn:page:{k}")
                writer.add(warc_record(k, address, data, digest, refers, date), address, date, digest)
                if writer.size >= PACKAGE_BYTES:
                    writer.close()
                    yield pd.DataFrame({"path": [path], "records": [writer.records]})
                    writer = None
        if writer is not None:
            writer.close()
            yield pd.DataFrame({"path": [path], "records": [writer.records]})

    marked = with_revisits(pages.select(F.col(key), F.col(url), F.col(payload)), key, payload, least)
    rows = marked.select(
        F.col(key).cast("string").alias("_k"),
        F.col(url).cast("string").alias("_url"),
        _payload(payload).alias("_payload"),
        "_digest",
        F.col("_refers").cast("string").alias("_refers"),
    )
    return written(rows.mapInPandas(run, "path string, records long"), "package-manifest")


def read_packages(spark: SparkSession, packages: DataFrame, key_type: str = "long", with_payload: bool = False) -> DataFrame:
    """Records of the packages named in column ``path``: ``page_id``, ``url``,
    ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (``payload`` too where
    asked for; a revisit has none). A response whose payload does not fit its digest fails."""

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with Package(path) as package:
                    rows, start, lengths = [], 0, []
                    for at, n in package.index():
                        if lengths and (at != start + sum(lengths) or sum(lengths) + n > RANGE_BYTES):
                            rows.append((path, start, lengths))
                            lengths = []
                        start = start if lengths else at
                        lengths.append(n)
                    if lengths:
                        rows.append((path, start, lengths))
                yield pd.DataFrame(rows, columns=["path", "start", "lengths"])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, lengths in zip(batch["path"], batch["start"].tolist(), batch["lengths"]):
                with Package(path) as package:
                    raw = package.read(start, int(sum(lengths)))
                rows, at = [], 0
                for n in map(int, lengths):
                    rows.append(_row(gzip.decompress(raw[at : at + n]), with_payload))
                    at += n
                yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    found = packages.select("path").mapInPandas(ranges, "path string, start long, lengths array<long>")
    places = written(found, "package-ranges")
    # By the bytes of the archives: adaptive execution would see only those of this list.
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, n: total + n)
    held = places.agg(F.sum(size)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-held // TASK_BYTES))
    spread = places.repartition(tasks, "path", "start")
    records = spread.mapInPandas(fetch, schema + ", payload binary" * with_payload)
    return records.withColumns({c: F.col(c).cast(key_type) for c in ("page_id", "refers_to")})


def _row(record: bytes, with_payload: bool) -> tuple:
    fields, http, payload = parse_record(record)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not fit its digest")
    size = len(payload) if kind == "response" else int(http["content-length"])
    row = (fields.get("x-page-id"), fields["warc-target-uri"], size, digest, kind, fields.get("x-refers-to-page"))
    return row + ((payload if kind == "response" else None,) if with_payload else ())


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000) -> DataFrame:
    """Write ``pages`` into packages in the shared folder and read their records back."""
    spark = pages.sparkSession
    manifest = write_packages(pages, new_folder(spark, "warc"), key, url, payload, least)
    records = read_packages(spark, manifest, pages.schema[key].dataType.simpleString())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
