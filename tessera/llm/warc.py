"""Web archives in ZIP packages: writing WARC records, and reading them back by ranges without extraction.

Writing: payloads are digested by built-in functions, the response of every group of equal payloads is found by a combining aggregate, and
each task streams its records into packages of about ``PACKAGE`` bytes: a stored member of gzip members (one per record), a stored index
of (offset, length, member) and a small description.  Payloads are equal when SHA-1 and SHA-256 both are, as collisions of SHA-1 alone
are public.  Payloads move only where the groups of two and more are too many to be sent to every task.  The manifest of finished packages is
checkpointed; a task that runs again writes new files, and only files in the manifest count.

Reading: each package's central directory (ZIP64 too) is parsed; stored members below ``archive/`` hold the records, those below
``indexes/`` tell where.  Every record that an index knows is read by its own range; an archive member that none knows is scanned, gzip member
after gzip member.  Packages are dealt to as many tasks as there are packages.

Defined results: a null html is the empty payload, a null url gives no target; of equal payloads the largest page_id is the
response (rows that repeat that id are all responses), null ids are the smallest; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, few, fresh_dir, map_arrow
from tessera.llm.zip_archive import Archive, Member, filesystem

PACKAGE, LEVEL, DATE = 64 << 20, 1, "2000-01-01T00:00:00Z"
#: Bytes that a scan reads at once, and tasks that read packages at most.
PIECE, READERS = 1 << 20, 8192
DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response, or a revisit where ``refers_to`` is given; a revisit keeps the HTTP head, so the payload's length too."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _heads(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}, rest


def parse_record(raw: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """page_id, url, payload's length, digest, type, page_id that a revisit refers to, payload (of a response)."""
    if not raw.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    fields, rest = _heads(raw)
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, payload = _heads(block)
    size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    page = lambda x: int(x[10:-1]) if len(x) > 11 else None
    if fields["warc-type"] == "response":
        if len(payload) != size or _sha1(payload) != digest:
            raise ValueError("a payload differs from its digest")
        return page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, "response", None, payload
    return page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, "revisit", page(fields["warc-refers-to"]), None


class _Package:
    """A package being written."""

    def __init__(self, folder: str, task: int, number: int):
        self.path = f"{folder}/part-{task:05d}-{number:04d}-{uuid.uuid4().hex[:12]}.wacz"
        store, path = filesystem(self.path)
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, raw: bytes) -> None:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.data.write(packed)
        self.index.append(f"{self.at} {len(packed)} {DATA}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.index))
        self.zip.writestr(ABOUT, f'{{"profile": "data-package", "wacz_version": "1.1.1", "records": {len(self.index)}}}')
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.at


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, package: int = PACKAGE) -> DataFrame:
    """Writes all rows below ``folder``; the manifest, in the columns of ``MANIFEST``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("of"))
    groups = rows.groupBy("digest", "of").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    shared = cut(groups.select(F.col("digest").alias("other"), F.col("of").alias("other_of"), "keeper"))
    listed = few(shared)
    joined = rows.join(shared if listed is None else listed, (F.col("digest") == F.col("other")) & (F.col("of") == F.col("other_of")), "left")
    refers = F.when((F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        task, done, now = TaskContext.get().partitionId(), [], None
        for b in parts:
            for page_id, url, html, digest, refers_to in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                now = now or _Package(folder, task, len(done))
                now.add(record(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to))
                if now.at >= package:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 3, [pa.string(), pa.int64(), pa.int64()], strict=True)], ["path", "records", "bytes"])

    return cut(map_arrow(joined.select("page_id", "url", "html", "digest", refers.alias("refers_to")), write, MANIFEST))


def scanned(archive: Archive, member: Member) -> Iterator[bytes]:
    """The records of a stored member without an index: its gzip members in order."""
    start, at, unpack, parts = archive.start(member), 0, zlib.decompressobj(31), []
    while at < member.size:
        piece = archive.range(member, at, min(PIECE, member.size - at), start)
        at += len(piece)
        while piece:
            parts.append(unpack.decompress(piece))
            piece = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError(f"{member.name} ends within a record")


def raw_records(archive: Archive) -> Iterator[bytes]:
    """Every record of a package, those that an index knows by their ranges."""
    stored = [m for name, m in archive.members.items() if name.startswith("archive/") and not name.endswith("/")]
    known: dict[str, list[tuple[int, int]]] = {}
    for name in archive.members:
        if name.startswith("indexes/") and name.endswith(".cdx"):
            for line in archive.read(name).decode().split("\n")[:-1]:
                offset, length, of = line.split(" ", 2)
                known.setdefault(of, []).append((int(offset), int(length)))
    for member in stored:
        if member.name in known:
            start = archive.start(member)
            for offset, length in known[member.name]:
                yield zlib.decompress(archive.range(member, offset, length, start), 31)
        else:
            yield from scanned(archive, member)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all packages, in the columns of ``RECORDS``; without ``payloads`` that column is null."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for path in b.column(0).to_pylist():
                store, inner = filesystem(path)
                with store.open_input_file(inner) as handle:
                    out, size = [], 0
                    for raw in raw_records(Archive(handle, handle.size())):
                        out.append(parse_record(raw))
                        size += len(raw)
                        if len(out) >= 512 or size >= PACKAGE // 4:
                            yield _records_batch(out, payloads)
                            out, size = [], 0
                    if out:
                        yield _records_batch(out, payloads)

    tasks = max(1, min(READERS, manifest.count()))  # a number that is given isn't merged by adaptive execution
    return map_arrow(manifest.select("path").repartition(tasks), read, RECORDS)


def _records_batch(out: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    rows = out if payloads else [(*r[:6], None) for r in out]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Every page as read back from archives written into the shared folder."""
    manifest = write_archives(pages, fresh_dir(pages.sparkSession, "warc"), min_bytes)
    return read_archives(manifest, payloads=False).drop("payload")
