"""WARC records in ZIP-packaged archives, written and read back by ranges.

One archive is a ZIP file of stored (uncompressed) members: ``archive/data.warc.gz`` with one record
after the other, each a gzip member of its own as is usual for WARC files, and ``indexes/index.cdx`` with a line per record (id, offset and length within the
WARC member, digest, type).  Sizes and offsets beyond 32 bits are written and read through ZIP64
fields, and the ZIP64 end records are written always.

The reader opens an archive at its end: end record, ZIP64 end record, central directory, the
member's local header (whose name and extra lengths give the start of its data).  Records are read
by seeking to the offsets that the index states, in bounded ranges; nothing is extracted.

Which record carries a payload is settled before writing: of records with equal payloads the one
with the smallest id is the response and the others are revisits that name it.  Archives are files
of a shared folder, reached through ``pyarrow.fs`` by the folder's URI (local paths, HDFS, S3); each
is written under a name of its task's attempt and renamed when complete, so a retried or
speculative task cannot leave a torn file.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches, stored
from hourglass.session import scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Bytes of records after which a task begins another archive, and bytes of one read.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 4 << 20
#: Smaller payloads than this are never revisits.
MIN_PAYLOAD = 0
_DATE = "2024-01-01T00:00:00Z"
_FULL = 0xFFFFFFFF


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder's URI (a plain path is local)."""
    if uri.startswith("file:"):
        uri = uri[5:]
        return pafs.LocalFileSystem(), "/" + uri.lstrip("/")
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the payload but not the payload."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Target-URI", uri), ("WARC-Date", _DATE),
            ("WARC-Payload-Digest", f"sha1:{sha}"), ("Page-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    body = payload if refers_to is None else b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return headers, rest[:size]


class ZipWriter:
    """Stored members written in one pass; ``out`` needs only write()."""

    def __init__(self, out, limit: int = _FULL):
        self.out, self.at, self.entries, self.limit = out, 0, [], limit

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        """A member whose size and CRC follow its data (ZIP64 descriptor)."""
        raw = name.encode()
        self.entries.append([raw, 0, 0, self.at])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, _FULL, _FULL, len(raw), len(extra)) + raw + extra)

    def write(self, raw: bytes) -> None:
        e = self.entries[-1]
        e[1] = zlib.crc32(raw, e[1])
        e[2] += len(raw)
        self._write(raw)

    def end(self) -> None:
        _, crc, size, _ = self.entries[-1]
        self._write(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, crc, size, at in self.entries:
            big = [v for v in (size, size, at) if v >= self.limit]
            extra = struct.pack(f"<HH{len(big)}Q", 1, 8 * len(big), *big) if big else b""
            small = [v if v < self.limit else _FULL for v in (size, size, at)]
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, small[0], small[1],
                                    len(name), len(extra), 0, 0, 0, 0, small[2]) + name + extra)
        size, n = self.at - start, len(self.entries)
        end64 = self.at
        self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
        self._write(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
        cut = [min(v, m) for v, m in ((n, 0xFFFF), (size, _FULL), (start, _FULL))]
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, cut[0], cut[0], cut[1], cut[2], 0))


class ZipRangeReader:
    """Members of a ZIP file by ranges; ``file`` needs size() and read_at(length, offset)."""

    def __init__(self, file):
        self.file = file
        self.members = self._directory()

    def _read(self, offset: int, length: int) -> bytes:
        raw = self.file.read_at(length, offset)
        if len(raw) != length:
            raise ValueError("the archive ends early")
        return raw

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name -> (offset of the local header, size, CRC) of each stored member."""
        total = self.file.size()
        back = min(total, 22 + 0xFFFF)
        tail = self._read(total - back, back)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end record: not a ZIP file")
        n, size, start = struct.unpack_from("<HII", tail, at + 10)
        end = total - back + at
        if end >= 20:
            locator = self._read(end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                where = struct.unpack_from("<Q", locator, 8)[0]
                record64 = self._read(where, 56)
                if record64[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 end record is not where its locator says")
                n, size, start = struct.unpack_from("<QQQ", record64, 32)
        raw, at, out = self._read(start, size), 0, {}
        for _ in range(n):
            if raw[at:at + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method, = struct.unpack_from("<H", raw, at + 10)
            crc, packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", raw, at + 16)
            offset, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46:at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name:at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values, only for the fields that are full
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    plain = next(wide) if plain == _FULL else plain
                    packed = next(wide) if packed == _FULL else packed
                    offset = next(wide) if offset == _FULL else offset
                extra = extra[4 + length:]
            at += 46 + n_name + n_extra + n_note
            if method != 0 or packed != plain:
                raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
            out[name] = (offset, plain, crc)
        return out

    def start(self, name: str) -> int:
        """Offset of the first byte of a member's data."""
        offset = self.members[name][0]
        local = self._read(offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("the local header is not where the directory says")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return offset + 30 + n_name + n_extra

    def read(self, name: str, offset: int, length: int, start: int | None = None) -> bytes:
        if offset < 0 or offset + length > self.members[name][1]:
            raise ValueError("the range leaves its member")
        return self._read((self.start(name) if start is None else start) + offset, length)

    def lines(self, name: str) -> Iterator[str]:
        """Lines of a text member, in reads of bounded size."""
        start, size, rest = self.start(name), self.members[name][1], b""
        for at in range(0, size, READ_BYTES):
            *whole, rest = (rest + self._read(start + at, min(READ_BYTES, size - at))).split(b"\n")
            yield from (x.decode() for x in whole)
        if rest:
            yield rest.decode()


def roles(pages: DataFrame, id_col: str, html_col: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(id, sha, refers_to) of the rows that are revisits: equal payloads of at least ``min_payload`` bytes
    refer to the smallest id among them.  Rows without an id are never revisits or referred to; an id
    that repeats with another payload has a role for each."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    thin = stored(pages.where(F.col(id_col).isNotNull() & (F.octet_length(payload) >= min_payload)).select(
        F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("sha")), "warc-digests")
    first = thin.groupBy("sha").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return (thin.join(first, "sha").where("id <> refers_to").select("id", "sha", "refers_to").distinct())


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write a record for every row into archives below ``folder``: (path, records, bytes) of each.

    Null html is an empty payload; a null url an empty target; rows that repeat an id and payload are
    written each.  An empty table writes no archive.
    """
    bounded_batches(pages.sparkSession)
    told = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    told = told.withColumn("sha", F.sha1("payload")).join(roles(pages, id_col, html_col), ["id", "sha"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, k = task.partitionId(), 0
        out = writer = None
        index: list[str] = []
        done = []

        def close():
            nonlocal out, writer, k
            writer.end()
            writer.begin(INDEX)
            for at in range(0, len(index), 10_000):
                writer.write("".join(index[at:at + 10_000]).encode())
            writer.end()
            writer.close()
            out.close()
            name = f"{base}/part-{part:06d}-{k:04d}.wacz"
            fs.move(draft, name)
            done.append((name.rsplit("/", 1)[1], len(index), writer.at))
            index.clear()
            out = writer = None
            k += 1

        for b in batches:
            for i, url, payload, ref in zip(*(b.column(n) for n in ("id", "url", "payload", "refers_to"))):
                if writer is None:
                    draft = f"{base}/.draft-{part}-{k}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                    out = fs.open_output_stream(draft)
                    writer = ZipWriter(out)
                    writer.begin(DATA)
                body = payload.as_py()
                sha = digest(body)
                raw = gzip.compress(record(i.as_py(), url.as_py(), body, sha, ref.as_py()), mtime=0)
                at = writer.entries[-1][2]
                writer.write(raw)
                index.append(f"{i.as_py()} {at} {len(raw)} sha1:{sha} {'revisit' if ref.is_valid else 'response'}\n")
                if writer.at >= ARCHIVE_BYTES:
                    close()
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    return stored(told.mapInArrow(run, "path string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record.

    ``archives`` lists their paths; each is read through its directory and index by ranges.  The
    payload of a revisit is null; its length and digest are those of the payload it refers to.
    A digest or length that contradicts the block raises an error.
    """
    bounded_batches(archives.sparkSession)
    names = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(urn: str) -> int | None:
        text = urn[len("<urn:page:"):-1]
        return int(text) if text else None

    def records(fs, path: str):
        with fs.open_input_file(path) as file:
            archive = ZipRangeReader(file)
            start = archive.start(DATA)
            span: list[tuple[int, int]] = []

            def load():
                """Records that lie one after the other are read in one range."""
                first, last = span[0][0], span[-1][0] + span[-1][1]
                raw = archive.read(DATA, first, last - first, start)
                for at, size in span:
                    yield raw[at - first:at - first + size]
                span.clear()

            for line in archive.lines(INDEX):
                _, at, size, _, _ = line.split(" ")
                at, size = int(at), int(size)
                if span and (span[-1][0] + span[-1][1] != at or at + size - span[0][0] > READ_BYTES):
                    yield from load()
                span.append((at, size))
            if span:
                yield from load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for raw in records(fs, f"{base}/{path}"):
                    head, block = parse_record(gzip.decompress(raw))
                    own = head["WARC-Type"] == "response"
                    sha, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["Page-Payload-Length"])
                    if own and (digest(block) != sha or len(block) != size):
                        raise ValueError(f"{path}: a payload contradicts its digest")
                    rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"],
                                 None if own else number(head["WARC-Refers-To"]), size, sha, block if own else None))
                    held += len(block)
                    if held > READ_BYTES or len(rows) >= 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    n = max(1, min(10_000, archives.count()))  # a task per archive
    return archives.select("path").repartition(n).mapInArrow(
        run, "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All pages written to archives in the shared folder and read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, id_col, url_col, html_col), folder)
