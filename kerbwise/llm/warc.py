"""WARC archives: writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.llm.store import fresh_path, numbered, small, stored

ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 18
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Every record has each of these once; a second one in a header is that of another record.
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a Hadoop-style path of the shared folder."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# Writing --------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP header of the full payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: "" if i is None else i
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name(page_id)}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{name(refers_to)}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, revisit_min_bytes: int = 0) -> DataFrame:
    """Write (page_id, url, html) to ``.warc.gz`` files, one gzip member a record; returns path, records.

    Of records with equal payloads of at least ``revisit_min_bytes`` bytes the one with the largest
    page_id (null smallest) is the response and the others revisit it; where rows repeat that page_id
    one of them is the response. Null html is an empty payload. A task's files carry a name of their
    own for each attempt, and only those of the attempts that succeeded are in the returned manifest.
    """
    source = numbered(pages, "row", F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    source = source.withColumn("sha1", F.sha1("html"))
    long_enough = source.filter(F.octet_length("html") >= revisit_min_bytes)
    best = F.max(F.struct("page_id", (-F.col("row")).alias("row"))).alias("best")
    groups = long_enough.groupBy("sha1").agg(best, F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "best")
    groups = small(stored(groups, "payloads"))
    marked = source.join(groups, "sha1", "left").select(
        "page_id", "url", "html", F.col("best.page_id").alias("refers_to"),
        F.coalesce(F.col("best.row") != -F.col("row"), F.lit(False)).alias("revisit"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        part, out, done, records = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name = f"{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, records = system.open_output_stream(f"{base}/{name}", compression=None), 0
                payload = html.encode()
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(member.compress(record(page_id, url, payload, payload_digest(payload), refers_to, revisit)) + member.flush())
                records += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return stored(marked.mapInArrow(write, "path string, records long"), "manifest")


# Reading --------------------------------------------------------------------


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if "msgtype=response" in self.headers.get("content-type", "") else self.block

    @property
    def payload_length(self) -> int:
        """Of a revisit, the length that its HTTP header states."""
        if self.headers.get("warc-type") != "revisit":
            return len(self.payload)
        stated = re.search(rb"(?i)\r\ncontent-length: *(\d+)", self.block)
        return int(stated[1]) if stated else 0


@dataclass
class Gap:
    """A quarantined range of bytes and the check that failed at its start."""

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None  # within a gzip member: the range of its inflated bytes


class Damaged(Exception):
    pass


class _Window:
    """Random access to a seekable file through one block at a time."""

    def __init__(self, stream) -> None:
        self.stream, self.size = stream, stream.size() if hasattr(stream, "size") else stream.seek(0, 2)

    def read(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(n)

    def find(self, start: int) -> int:
        """First member or version line at or after ``start``, else the file's end."""
        keep = len(VERSION) - 1
        while start < self.size:
            block = self.read(start, BLOCK)
            hits = [i for i in (block.find(MEMBER), block.find(VERSION)) if i >= 0]
            if hits:
                return start + min(hits)
            if start + len(block) >= self.size:
                break
            start += len(block) - keep
        return self.size


def _parse(head: bytes) -> tuple[dict[str, str], int]:
    """Headers of the record that starts ``head`` and where its block starts."""
    if not head.startswith(VERSION):
        raise Damaged("no version line")
    end = head.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("header without end")
    version, *lines = head[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", version):
        raise Damaged("no version line")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        key = name.strip().lower().decode("utf-8", "replace")
        if b"\r" in line or b"\n" in line or (key in MANDATORY and key in headers):
            raise Damaged("another record within the header")
        headers[key] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    return headers, end + 4


def _checked(start: int, end: int, headers: dict[str, str], block: bytes, sound: bool = True) -> Record:
    """The record if its digests agree. Within bytes that failed a check (not ``sound``) a block digest must be stated."""
    found = Record(start, end, headers, block)
    if not sound and not headers.get("warc-block-digest", "").startswith("sha1:"):
        raise Damaged("no block digest in a damaged member")
    for name, data in (("warc-block-digest", block), ("warc-payload-digest", None if headers.get("warc-type") == "revisit" else found.payload)):
        stated = headers.get(name, "")
        if stated.startswith("sha1:") and data is not None and stated[5:] != payload_digest(data):
            raise Damaged(f"{name} does not agree")
    return found


def _deflated(window: _Window, start: int) -> int:
    """Where the compressed bytes of the gzip member at ``start`` begin: after its header and the optional fields."""
    head = window.read(start, BLOCK)
    try:
        flags, at = head[3], 10
        if flags & 4:  # extra field
            at += 2 + int.from_bytes(head[at : at + 2], "little")
        for flag in (8, 16):  # name, comment
            at = head.index(0, at) + 1 if flags & flag else at
    except (IndexError, ValueError):
        raise Damaged("member header without end") from None
    if flags & 0xE0:
        raise Damaged("member header with unknown flags")
    return start + at + (2 if flags & 2 else 0)


def _inflated(window: _Window, start: int) -> Generator[bytes, None, int]:
    """Inflated pieces of at most a block of the gzip member at ``start``; returns its end. What comes before damage is given first."""
    at, waiting, check, size = _deflated(window, start), b"", 0, 0
    inflate = zlib.decompressobj(-zlib.MAX_WBITS)
    while not inflate.eof:
        if not waiting:
            waiting = window.read(at, BLOCK)
            if not waiting:
                raise Damaged("member without end")
            at += len(waiting)
        before = inflate.copy()
        try:
            piece = inflate.decompress(waiting, BLOCK)
        except zlib.error as error:
            with contextlib.suppress(zlib.error):
                while one := before.decompress(waiting, 1):  # byte by byte up to the failure
                    waiting = before.unconsumed_tail
                    yield one
            raise Damaged(f"member: {error}") from None
        waiting = inflate.unconsumed_tail
        if piece:
            check, size = zlib.crc32(piece, check), size + len(piece)
            yield piece
    at -= len(inflate.unused_data)
    if window.read(at, 8) != check.to_bytes(4, "little") + (size & 0xFFFFFFFF).to_bytes(4, "little"):
        raise Damaged("member: checksum or length does not agree")
    return at + 8


def _member_end(window: _Window, start: int) -> int:
    """End of the gzip member at ``start``, whose checksum is verified on the way."""
    pieces = _inflated(window, start)
    while True:
        try:
            next(pieces)
        except StopIteration as stop:
            return stop.value


def _inside(window: _Window, start: int, end: int, sound: bool) -> Iterator[Record | Gap]:
    """Records of the gzip member at ``start`` that pass their checks, one in memory at a time, and the gaps between them.

    After a failed check the next version line in the inflated bytes is searched for.
    """
    pieces, held, base, failed, more = _inflated(window, start), bytearray(), 0, None, True

    def fill() -> None:
        nonlocal more
        try:
            held.extend(next(pieces))
        except (StopIteration, Damaged):
            more = False

    while held or more:
        try:
            while more and len(held) < 16 * BLOCK and held.find(b"\r\n\r\n") < 0:
                fill()
            if not held:
                break
            headers, body = _parse(bytes(held[: held.find(b"\r\n\r\n") + 4]))
            stop = body + int(headers["content-length"])
            while more and len(held) < stop + 4:
                fill()
            if held[stop : stop + 4] != b"\r\n\r\n":
                raise Damaged("block of another length")
            found = _checked(start, end, headers, bytes(held[body:stop]), sound)
            stop += 4
        except Damaged as error:
            failed, found, stop = failed or (base, str(error)), None, 1
        if found:
            if failed:
                yield Gap(start, end, failed[1], (failed[0], base))
                failed = None
            yield found
        del held[:stop]
        base += stop
        while failed and (held or more):
            hit = held.find(VERSION)
            drop = hit if hit >= 0 else max(0, len(held) - len(VERSION) + 1) if more else len(held)
            del held[:drop]
            base += drop
            if hit >= 0:
                break
            if more:
                fill()
    if failed:
        yield Gap(start, end, failed[1], (failed[0], base))


def _plain(window: _Window, start: int) -> tuple[list[Record], int]:
    """The uncompressed record at ``start`` and where it ends."""
    head = window.read(start, BLOCK)
    while b"\r\n\r\n" not in head and start + len(head) < window.size and len(head) < 16 * BLOCK:
        head += window.read(start + len(head), BLOCK)
    headers, body = _parse(head)
    length = int(headers["content-length"])
    if start + body + length + 4 > window.size:
        raise Damaged("block of another length")
    block = window.read(start + body, length + 4)
    if block[length:] != b"\r\n\r\n":
        raise Damaged("block of another length")
    return [_checked(start, start + body + length + 4, headers, block[:length])], start + body + length + 4


def salvage(stream) -> Iterator[Record | Gap]:
    """All records of a plain or gzipped WARC file that pass their checks, and the gaps between them.

    After a failed check (gzip checksum, version line, lengths, digests) the next member or version line
    that opens a valid record is searched for; the bytes up to it are one gap. A gzip member may hold any number of
    records: a damaged one costs only itself, and of a member that is torn or fails its checksum the records
    with agreeing digests are kept, with the member as a gap beside them. A record's range in the file is that of its member.
    """
    window, at, broken = _Window(stream), 0, None  # broken: start, reason, whether a torn member with intact records starts there

    def quarantined(until: int) -> Iterator[Record | Gap]:
        if broken:
            start, reason, saved = broken
            if saved:
                yield from (x for x in _inside(window, start, until, False) if isinstance(x, Record))
            yield Gap(start, until, reason)

    while at < window.size:
        gzipped = window.read(at, 3) == MEMBER
        try:
            records, end = ([], _member_end(window, at)) if gzipped else _plain(window, at)
        except Damaged as error:
            if gzipped and any(isinstance(x, Record) for x in _inside(window, at, at, False)):
                yield from quarantined(at)
                broken = (at, str(error), True)
            broken = broken or (at, str(error), False)
            at = window.find(at + 1)
            continue
        yield from quarantined(at)
        broken = None
        yield from _inside(window, at, end, True) if gzipped else records
        at = end
    yield from quarantined(window.size)


RECORD_SCHEMA = (
    "path string, start long, end long, kind string, reason string, page_id long, url string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read the files of ``manifest`` (path): a row per record, and one of kind ``gap`` per quarantined range.

    Each file is read by one task, a record at a time (a gzip member is inflated twice: its checksum first); files are bounded by the writer's ``archive_bytes``.
    An empty manifest gives no rows; a page without id has null.
    """

    def number(text: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text)
        return int(found[1]) if found else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("reason", pa.string()), ("page_id", pa.int64()),
            ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        rows, held = [], 0
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            system, name = file_system(path)
            with system.open_input_file(name) as stream:
                for x in salvage(stream):
                    if isinstance(x, Gap):
                        reason = f"{x.reason}, inflated bytes {x.inner[0]} to {x.inner[1]}" if x.inner else x.reason
                        rows.append((path, x.start, x.end, "gap", reason, None, None, x.end - x.start, None, None, None))
                    else:
                        h, revisit = x.headers, x.headers.get("warc-type") == "revisit"
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else payload_digest(x.payload)
                        rows.append((
                            path, x.start, x.end, h.get("warc-type"), None, number(h.get("warc-record-id", "")), h.get("warc-target-uri"), x.payload_length,
                            digest, number(h.get("warc-refers-to", "")) if revisit else None, x.payload if with_payload and not revisit else None,
                        ))
                        held += len(rows[-1][-1] or b"")
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = manifest.count()
    return manifest.select("path").repartition(max(1, files), "path").mapInArrow(read, RECORD_SCHEMA)


def read_back(manifest: DataFrame) -> DataFrame:
    """The records of the archives just written. An error if there are not as many as the manifest states."""
    records = stored(read_archives(manifest).filter("kind != 'gap'").drop("payload"), "records")
    written, read = manifest.agg(F.sum("records")).first()[0] or 0, records.count()
    if read != written:
        raise RuntimeError(f"{written} records were written and {read} read back")
    return records


def archive_folder(df: DataFrame) -> str:
    return fresh_path(df.sparkSession, "warc")
