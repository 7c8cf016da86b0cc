"""WARC records in ZIP packages: written as stored members with an index, read back by ranges.

Each task writes its rows into packages of its own in the shared folder: members archive/data-NNNNN.warc.gz (a gzip
stream for each record, so that every record can be read alone), indexes/index.cdxj and datapackage.json, all stored.
The reader parses the end records, the ZIP64 ones where present, the central directory and the local headers; finds the
index; and reads each record by its range, without extraction. Records of equal payloads are a response (that of the
largest page_id) and revisits.

Defined cases: a null html is an empty payload; a null url leaves out the target URI; a null page_id has no id header,
comes back as null and never is the response of a group that has another id; rows that repeat the largest page_id and
payload are all responses; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, maybe_broadcast, scratch_path, ship
from .workers import tidy

MEMBER = 16 << 20
PACKAGE = 512 << 20
KINDS = ("response", "resource", "conversion", "revisit")
DATE = "2000-01-01T00:00:00Z"
READ_AHEAD = 1 << 20
_M32, _M16 = 0xFFFFFFFF, 0xFFFF


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class PackageWriter:
    """A ZIP file of stored members, with ZIP64 records where a size, an offset or a count needs them (or if forced)."""

    def __init__(self, out, force_zip64: bool = False) -> None:
        self.out, self.at, self.force, self.entries = out, 0, force_zip64, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = self.force or n >= _M32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        self.entries.append((raw, crc, n, self.at))
        shown = _M32 if wide else n
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        self._write(data)

    def close(self) -> None:
        start = self.at
        for raw, crc, n, at in self.entries:
            wide_n, wide_at = self.force or n >= _M32, self.force or at >= _M32
            body = (struct.pack("<QQ", n, n) if wide_n else b"") + (struct.pack("<Q", at) if wide_at else b"")
            extra = struct.pack("<HH", 1, len(body)) + body if body else b""
            shown = _M32 if wide_n else n
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if body else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _M32 if wide_at else at) + raw + extra)
        size, count = self.at - start, len(self.entries)
        if self.force or count >= _M16 or size >= _M32 or start >= _M32:
            end = self.at
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
            self._write(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
            count, size, start = _M16, _M32, _M32
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, start, 0))


class PackageReader:
    """Members of a ZIP file from its directories; range reads with read-ahead."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self._start, self._buffer = 0, b""
        self.members: dict[str, tuple[int, int, int, int]] = {}  # method, packed size, size, local header
        self._directory()

    def at(self, offset: int, length: int) -> bytes:
        inside = offset - self._start
        if inside < 0 or inside + length > len(self._buffer):
            self.file.seek(offset)
            self._buffer, self._start, inside = self.file.read(min(max(length, READ_AHEAD), self.size - offset)), offset, 0
        out = self._buffer[inside : inside + length]
        if len(out) != length:
            raise ValueError(f"the package ends before {offset + length}")
        return bytes(out)

    def _directory(self) -> None:
        tail = min(self.size, 22 + _M16)
        data = self.at(self.size - tail, tail)
        k = len(data) - 22
        while True:
            k = data.rfind(b"PK\x05\x06", 0, k + 4)
            if k < 0:
                raise ValueError("no end of central directory")
            if k + 22 + struct.unpack_from("<H", data, k + 20)[0] == len(data):
                break
            k -= 1
        count, size, start = struct.unpack_from("<HII", data, k + 10)
        if _M16 == count or _M32 in (size, start):
            where = self.size - tail + k - 20
            if where >= 0 and (loc := self.at(where, 20))[:4] == b"PK\x06\x07":
                end = self.at(struct.unpack_from("<Q", loc, 8)[0], 56)
                if end[:4] != b"PK\x06\x06":
                    raise ValueError("no ZIP64 end of central directory")
                count, size, start = struct.unpack_from("<QQQ", end, 32)
        data, p = self.at(start, size), 0
        for _ in range(count):
            sig, _, _, _, method, _, _, _, packed, whole, n, m, c, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, p)
            if sig != 0x02014B50:
                raise ValueError("broken central directory")
            name = data[p + 46 : p + 46 + n].decode()
            extra = data[p + 46 + n : p + 46 + n + m]
            q = 0
            while q + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, q)
                if tag == 1:
                    values = list(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                    whole = values.pop(0) if whole == _M32 else whole
                    packed = values.pop(0) if packed == _M32 else packed
                    local = values.pop(0) if local == _M32 else local
                q += 4 + length
            self.members[name] = (method, packed, whole, local)
            p += 46 + n + m + c

    def _data(self, name: str) -> tuple[int, int, int]:
        method, packed, _, local = self.members[name]
        head = self.at(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, method

    def member(self, name: str) -> bytes:
        """A whole member (an index), stored or deflated."""
        start, packed, method = self._data(name)
        data = self.at(start, packed)
        return data if method == 0 else zlib.decompress(data, -15)

    def ranges(self, name: str, spans: list[tuple[int, int]]) -> Iterator[bytes]:
        """Ranges (offset, length) of a stored member."""
        start, packed, method = self._data(name)
        if method:
            raise ValueError(f"{name} isn't stored")
        for offset, length in spans:
            if offset + length > packed:
                raise ValueError(f"{name} ends before {offset + length}")
            yield self.at(start + offset, length)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, as a gzip stream."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload if kind == "response" else http + b"\r\n"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%-._"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}:{digest}')}>", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and payload of a record, as a gzip stream or bare."""
    raw = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {name.strip().lower(): value.strip() for name, _, value in fields}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def index_entries(name: str, data: bytes) -> Iterator[dict]:
    """The JSON entries of a CDXJ index, bare or gzipped (several streams); lines of other kinds hold none."""
    if name.endswith(".gz"):
        data = gzip.decompress(data)
    for line in data.decode("utf-8", "replace").splitlines():
        _, brace, rest = line.partition("{")
        if brace and not line.startswith("!"):
            entry = json.loads(brace + rest)
            if "filename" in entry and "offset" in entry:
                yield entry


class _Package:
    """One package being written."""

    def __init__(self, base: str) -> None:
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path, recursive=True)
        self.name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.wacz"
        self.out = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.zip = PackageWriter(self.out)
        self.member, self.count, self.records = io.BytesIO(), 0, 0
        self.index: list[str] = []
        self.resources: list[dict] = []

    def add(self, data: bytes, page_id: int | None, url: str | None, kind: str) -> None:
        where = {"filename": f"data-{self.count:05d}.warc.gz", "offset": self.member.tell(), "length": len(data), "type": kind, "page_id": page_id}
        self.index.append(f"{quote(url or '-', safe='!#$&()*+,/:;=?@[]~%-._')} 20000101000000 {json.dumps(where)}")
        self.member.write(data)
        self.records += 1
        if self.member.tell() >= MEMBER:
            self._flush()

    def _store(self, name: str, data: bytes) -> None:
        self.zip.add(name, data)
        self.resources.append({"name": name.rpartition("/")[2], "path": name, "hash": f"sha256:{hashlib.sha256(data).hexdigest()}", "bytes": len(data)})

    def _flush(self) -> None:
        if self.member.tell():
            self._store(f"archive/data-{self.count:05d}.warc.gz", self.member.getvalue())
            self.member, self.count = io.BytesIO(), self.count + 1

    def close(self) -> tuple[str, int, int]:
        self._flush()
        self._store("indexes/index.cdxj", "".join(f"{x}\n" for x in sorted(self.index)).encode())
        self.zip.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": self.resources}).encode())
        self.zip.close()
        self.out.close()
        return self.name, self.records, self.zip.at


def write(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Packages of all pages under path (by default in the shared folder); a written row for each: path, records, bytes."""
    spark = pages.sparkSession
    ship(spark)
    base = path or scratch_path(spark, "wacz")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    marks = rows.select("page_id", F.unhex(F.sha1("payload")).alias("sha"), F.length("payload").alias("size"))
    same = marks.groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select(F.col("sha").alias("s"), F.col("size").alias("z"), "last")
    same = materialize(same, "equal-payloads")
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    rows = rows.join(maybe_broadcast(same, same.count()), (rows.sha == F.col("s")) & (F.length("payload") == F.col("z")), "left").select("page_id", "url", "payload", "sha", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            ids, urls, shas, lasts = (batch.column(k).to_pylist() for k in ("page_id", "url", "sha", "last"))
            payloads = batch.column("payload")
            for r in range(batch.num_rows):
                package = package or _Package(base)
                again = lasts[r] is not None and lasts[r] != ids[r]
                kind = "revisit" if again else "response"
                package.add(record(kind, ids[r], urls[r], payloads[r].as_py(), base64.b32encode(shas[r]).decode(), lasts[r] if again else None), ids[r], urls[r], kind)
                if package.zip.at >= PACKAGE:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{base}/{n}" for n, _, _ in done], pa.string()), "records": pa.array([k for _, k, _ in done], pa.int64()), "bytes": pa.array([b for _, _, b in done], pa.int64())})

    return materialize(rows.mapInArrow(tidy(run), "path string, records long, bytes long"), "packages")


def read(packages: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the packages (column path): page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Packages of other writers too: bare or gzipped indexes and records, headers in any case. Records without a payload
    of their own or a digest by SHA-1 get what can be computed, else null; other types (request, warcinfo) are passed over.
    A response whose payload doesn't have the digest or the length of its headers raises an error.
    """
    ship(packages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as f:
                    package = PackageReader(f, f.size())
                    entries: dict[str, list[dict]] = {}
                    for name in package.members:
                        if name.startswith("indexes/") and not name.endswith(".idx"):
                            for e in index_entries(name, package.member(name)):
                                entries.setdefault(f"archive/{e['filename'].removeprefix('archive/')}", []).append(e)
                    rows: list[tuple] = []
                    size = 0
                    for name in sorted(entries):
                        spans = sorted({(int(e["offset"]), int(e["length"])) for e in entries[name]})
                        for data in package.ranges(name, spans):
                            h, payload = parse(data)
                            kind = h["warc-type"]
                            if kind not in KINDS:
                                continue
                            whole = kind != "revisit"
                            method, _, digest = h.get("warc-payload-digest", "").rpartition(":")
                            n = int(h["warc-x-payload-length"]) if "warc-x-payload-length" in h else len(payload) if whole else None
                            if whole and (len(payload) != n or (method == "sha1" and digest32(payload) != digest.upper())):
                                raise ValueError(f"{path}, {name}: a payload differs from its digest")
                            digest = digest.upper() if method == "sha1" else digest32(payload) if whole else None
                            page, refers = h.get("warc-x-page-id"), h.get("warc-x-refers-to-page-id")
                            url = unquote(h["warc-target-uri"].strip("<>")) if "warc-target-uri" in h else None
                            rows.append((page and int(page), n, digest, kind, refers and int(refers), url, payload if with_payload else None))
                            size += len(payload) * with_payload
                            if len(rows) >= 4096 or size > MEMBER:
                                yield _batch(rows, with_payload)
                                rows, size = [], 0
                    if rows:
                        yield _batch(rows, with_payload)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    return packages.select("path").mapInArrow(tidy(run), schema)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()} | ({"payload": pa.binary()} if with_payload else {})
    return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read all packages back."""
    packages = write(pages)
    return read(packages.repartition(max(1, packages.count())))
