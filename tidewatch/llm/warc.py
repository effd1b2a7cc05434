"""WARC records in ZIP packages: written per task, read back by byte ranges.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdx``
(one CDX line per record), both stored without compression, so a record is one range of the package
file.  The reader finds all members under ``archive/`` and ``indexes/`` through the central directory,
with its ZIP64 form, and unpacks nothing but the records that the index lines name; archives that
no line names are walked record by record.

A response holds the page behind an HTTP head, as its type asks; a revisit holds the head alone,
with the length of the page it stands for.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.storage import shared_folder, staged

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Fixed values of the ZIP format: signatures, and the marks that a field is in the ZIP64 extra field.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Archive bytes after which a task begins a new package.
PACKAGE_BYTES = 64 << 20
#: Tasks at most that read packages.
READERS = 20_000
#: The fields of an index line.
CDX = " CDX N b a m s k r M S V g"
#: Stands for the time of capture where it is not known.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (``file:///x`` and ``file:/x`` alike)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


# --- writing ------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, kind: str, refers_to: int | None, date: str = UNKNOWN_DATE) -> bytes:
    """One WARC/1.1 record.  A revisit carries the HTTP head and the digest of the payload, not the payload."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body += payload if kind == "response" else b""
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if refers_to is not None:
        headers.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def index_line(url: str, date: str, digest: str, kind: str, size: int, offset: int, name: str) -> str:
    """The CDX line of a record; fields that are unknown are dashes."""
    where = "%20".join(url.split()) or "-"
    stamp = "".join(c for c in date if c.isdigit())
    mime = "text/html" if kind == "response" else "warc/revisit"
    return f"{where.lower()} {stamp} {where} {mime} 200 {digest} - - {size} {offset} {name}\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Package:
    """A ZIP file written front to back with stored members."""

    def __init__(self, stream, zip64: bool = True):
        self.stream, self.zip64, self.at, self.members = stream, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A local header whose sizes follow in a descriptor, as they are not known yet."""
        self.name, self.start, self.crc, self.size = name, self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0) if self.zip64 else b""
        size = FULL32 if self.zip64 else 0
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 8, 0, 0, 0x21, 0, size, size, len(name), len(extra)))
        self._put(name.encode() + extra)

    def add(self, data: bytes) -> int:
        """Append to the member; returns where in the member it begins."""
        at = self.size
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)
        return at

    def finish(self) -> None:
        self._put(struct.pack("<II" + ("QQ" if self.zip64 else "II"), 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        start = self.at
        for name, crc, size, offset in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if self.zip64 else b""
            short = (FULL32, FULL32, FULL32) if self.zip64 else (size, size, offset)
            self._put(struct.pack(
                "<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, short[0], short[1], len(name), len(extra), 0, 0, 0, 0, short[2]
            ))
            self._put(name.encode() + extra)
        size, count = self.at - start, len(self.members)
        if self.zip64:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, count, count, size, start, 0))


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``payload``, ``record_type`` and ``refers_to``.

    Of equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is the
    response and the others refer to it; smaller payloads are all responses.  Of rows that repeat
    both, one is the response.  Rows without page_id are left out.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.filter(F.col("page_id").isNotNull()).select(
        "page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("key", F.sha2("payload", 256))
    # only digests are counted; payloads move once, and only for the join
    counted = rows.groupBy("key").agg(
        F.max("page_id").alias("first"), F.sum(F.when(F.length("payload") >= min_bytes, 1).otherwise(0)).alias("n")
    ).filter("n > 1")
    found = rows.join(counted, "key", "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return found.select(
        "page_id", "url", "payload", F.when(refers.isNotNull(), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        refers.alias("refers_to"),
    )


def write_packages(
    rows: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES, zip64: bool = True, date: str = UNKNOWN_DATE,
) -> DataFrame:
    """Write ``page_id, url, payload, record_type, refers_to`` as packages; returns ``path, records``.

    A package is written under a name of its own and listed only when complete, so what a failed
    or repeated task leaves behind is never read.
    """
    system, base = opened(folder)
    system.create_dir(base, recursive=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened(folder)
        stream = package = None
        lines: list[str] = []

        def close() -> pd.DataFrame:
            package.finish()
            package.begin(INDEX)
            package.add("".join(lines).encode())
            package.finish()
            package.close()
            stream.close()
            return pd.DataFrame({"path": [name], "records": [len(lines) - 1]})

        for frame in frames:
            for row in frame.itertuples(index=False):
                if package is None:
                    name, lines = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz", []
                    lines.append(CDX + "\n")
                    stream = system.open_output_stream(f"{base}/{name.rpartition('/')[2]}")
                    package = Package(stream, zip64)
                    package.begin(ARCHIVE)
                refers = None if pd.isna(row.refers_to) else int(row.refers_to)
                payload = bytes(row.payload)
                data = _gzip(record(row.page_id, row.url, payload, row.record_type, refers, date))
                at = package.add(data)
                lines.append(index_line(row.url, date, digest_of(payload), row.record_type, len(data), at, ARCHIVE.rpartition("/")[2]))
                if package.size >= package_bytes:
                    yield close()
                    package = None
        if package is not None:
            yield close()

    return staged(rows.mapInPandas(write, "path string, records long"), "packages")


# --- reading ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class Reader:
    """Byte ranges of a ZIP file: its directory, its stored members and parts of them."""

    def __init__(self, path: str):
        system, plain = opened(path)
        self.file = system.open_input_file(plain)
        self.length = self.file.size()
        self.members = {m.name: m for m in self._directory()}

    def range(self, start: int, size: int) -> bytes:
        if start < 0 or size < 0 or start + size > self.length:
            raise ValueError("the range lies outside the package")
        return self.file.read_at(size, start)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.length - 22 - FULL16)
        tail = self.range(tail_at, self.length - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        if at < 0 or len(tail) - at < 22:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack("<HII", tail[at + 10:at + 20])
        if count == FULL16 or FULL32 in (size, start):
            mark, _, end64, _ = struct.unpack("<IIQI", self.range(tail_at + at - 20, 20))
            if mark != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            head = self.range(end64, 56)
            if struct.unpack("<I", head[:4])[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack("<QQQ", head[32:56])
        directory, at = self.range(start, size), 0
        for _ in range(count):
            (mark, _, _, _, method, _, _, _, packed, full, name_n, extra_n, note_n, _, _, _, header) = struct.unpack(
                "<IHHHHHHIIIHHHHHII", directory[at:at + 46]
            )
            if mark != CENTRAL:
                raise ValueError("broken central directory")
            name = directory[at + 46:at + 46 + name_n].decode()
            extra = directory[at + 46 + name_n:at + 46 + name_n + extra_n]
            at += 46 + name_n + extra_n + note_n
            # the 64-bit fields come in this order, each only if its short form is full
            wide = _extra(extra, 1)
            values = []
            for short in (full, packed, header):
                if short == FULL32:
                    short, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
                values.append(short)
            yield Member(name, method, values[1], values[2])

    def start_of(self, name: str) -> int:
        """Where the data of a stored member begins."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
        head = self.range(member.header, 30)
        if struct.unpack("<I", head[:4])[0] != LOCAL:
            raise ValueError("no local header")
        name_n, extra_n = struct.unpack("<HH", head[26:30])
        return member.header + 30 + name_n + extra_n

    def within(self, folder: str) -> list[str]:
        return sorted(name for name in self.members if name.startswith(f"{folder}/") and not name.endswith("/"))

    def index(self) -> dict[str, list[tuple[int, int]]]:
        """Offset and size of each record, by archive member, out of all index members."""
        found: dict[str, list[tuple[int, int]]] = {}
        for member in self.within("indexes"):
            if not member.endswith(".cdx"):
                continue
            fields: list[str] = CDX.split()[1:]
            for line in self.range(self.start_of(member), self.members[member].size).decode().splitlines():
                if line.startswith(" CDX "):
                    fields = line.split()[1:]
                elif line.strip():
                    row = dict(zip(fields, line.split(" ")))
                    found.setdefault(f"archive/{row['g'].rpartition('/')[2]}", []).append((int(row["V"]), int(row["S"])))
        missing = sorted(set(found) - set(self.members))
        if missing:
            raise ValueError(f"the index names archives that are not there: {missing[:3]}")
        return found

    def walk(self, name: str, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Offset and size of each gzip member of an archive without index lines."""
        start, size = self.start_of(name), self.members[name].size
        begun = at = 0
        unpacker = zlib.decompressobj(31)
        while at < size:
            data = self.range(start + at, min(step, size - at))
            at += len(data)
            while data:
                unpacker.decompress(data)
                if not unpacker.eof:
                    break
                data = unpacker.unused_data
                yield begun, at - len(data) - begun
                begun, unpacker = at - len(data), zlib.decompressobj(31)

    def records(self) -> Iterator[tuple[str, int, int]]:
        """Archive member, offset and size of every record."""
        listed = self.index()
        for name in self.within("archive"):
            for offset, size in listed.get(name) or self.walk(name):
                yield name, offset, size

    def close(self) -> None:
        self.file.close()


def _extra(extra: bytes, kind: int) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        found, size = struct.unpack("<HH", extra[at:at + 4])
        if found == kind:
            return extra[at + 4:at + 4 + size]
        at += 4 + size
    return b""


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


def _page_of(urn: str | None) -> int | None:
    """The number of a page's record, null for records of other names."""
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload of a record, and its full length as the HTTP head states it."""
    if not headers.get("Content-Type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    stated = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return body, int(stated[0]) if stated else len(body)


def read_packages(packages: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_digest, payload_bytes, body`` of every record.

    ``packages`` has the column ``path``, one package each; packages are dealt to a task each.  The digest of
    a response is recomputed from its payload; the size and digest of a revisit are those it states for
    the full payload.  Records that are neither response, revisit nor resource are passed over.
    """
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                reader = Reader(path)
                starts = {name: reader.start_of(name) for name in reader.within("archive")}
                out, held = [], 0
                for name, offset, size in reader.records():
                    headers, block = parse_record(zlib.decompress(reader.range(starts[name] + offset, size), 31))
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    body, length = payload_of(headers, block)
                    stated = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    digest = stated if kind == "revisit" else digest_of(body)
                    if stated and digest != stated:
                        raise ValueError("a payload does not match its digest")
                    out.append((
                        _page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI", ""), kind,
                        _page_of(headers.get("WARC-Refers-To")), digest, length if kind == "revisit" else len(body), body,
                    ))
                    held += len(body)
                    if held > 8 << 20:
                        yield _records(out)
                        out, held = [], 0
                reader.close()
                if out:
                    yield _records(out)

    # a number of its own: small paths would else be merged into one task
    tasks = max(1, min(packages.count(), READERS))
    return packages.select("path").repartition(tasks, "path").mapInPandas(read, RECORD)


RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, body binary"
)


def _records(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[part.split(" ")[0] for part in RECORD.split(", ")])
    return frame.assign(refers_to=frame["refers_to"].astype("Int64"))


def package_folder(spark: SparkSession) -> str:
    return shared_folder(spark, "warc")
