"""WARC archives: a writer with payload deduplication and a splittable reader.

Every record is a gzip member of its own. The reader gives each task a byte range: it scans for the
gzip magic, takes a candidate for a member only if its first bytes inflate to a WARC version line, and
owns the members that start inside its range, reading past the end for the last of them. So an archive
of any size is read by as many tasks as it has ranges, and no range depends on another. Other archives
are read whole, by fewer tasks: one gzip stream of many records by the task at its start, a plain file
by one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_HEADER_BYTES = 1 << 16


@dataclass(frozen=True)
class WarcOptions:
    """``min_revisit_bytes``: smaller payloads are always stored. ``salts`` spread a payload that many pages share.

    ``max_tasks``: an archive is read by as many tasks as it has ranges of ``split_bytes``, up to this many.
    """

    min_revisit_bytes: int = 0
    gzip_level: int = 6
    file_bytes: int = 1 << 30
    split_bytes: int = 16 << 20
    chunk_bytes: int = 1 << 20
    date: str = "2020-01-01T00:00:00Z"
    salts: int = 16
    max_tasks: int = 50_000


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, options: WarcOptions) -> bytes:
    """One gzip member. A revisit holds the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + (payload if refers_to is None else b"")
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {options.date}"
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(options.gzip_level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n") + pack.flush()


def _marked(pages: DataFrame, options: WarcOptions) -> DataFrame:
    """Adds ``refers_to``: the smallest page_id with the same payload, null for a response.

    Only digests cross the aggregation; payloads cross the shuffle once, next to their salted digest.
    """
    picked = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    picked = picked.withColumns({"digest": F.unhex(F.sha1("payload")), "salt": F.pmod(F.xxhash64("page_id"), F.lit(options.salts)).cast("int")})
    large = picked.where(F.length("payload") >= options.min_revisit_bytes)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "first_id", F.explode(F.array(*map(F.lit, range(options.salts)))).alias("salt"))
    joined = picked.join(first, ["digest", "salt"], "left")
    again = (F.length("payload") >= options.min_revisit_bytes) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder``; returns the manifest ``(path, bytes, records, split_bytes, split_records)``.

    ``split_records`` counts the records that start in each range of ``split_bytes``, for the reader to compare.

    A null html has an empty payload. Of pages with equal payloads, all rows with the smallest page_id
    are responses and the others revisit it; pages without an id come last, and are responses among
    themselves. Each task writes files of its own under fresh names and reports them; readers go by the
    manifest, so what a lost or repeated attempt left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        done: list[tuple[str, int, list[int]]] = []
        out, name, size, counts = None, "", 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                if out is None:
                    name, size, counts = f"pages-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), options)
                out.write(member)
                counts += [0] * (size // options.split_bytes + 1 - len(counts))
                counts[-1] += 1
                size += len(member)
                if size >= options.file_bytes:
                    out.close()
                    done.append((name, size, counts))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, counts))
        if done:
            names, sizes, split = zip(*done, strict=True)
            columns = [
                pa.array([f"{folder}/{n}" for n in names]), pa.array(sizes, pa.int64()), pa.array(map(sum, split), pa.int64()),
                pa.array([options.split_bytes] * len(done), pa.int64()), pa.array(split, pa.list_(pa.int64()))
            ]
            yield pa.record_batch(columns, names=["path", "bytes", "records", "split_bytes", "split_records"])

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return cut(_marked(pages, options).mapInArrow(run, "path string, bytes long, records long, split_bytes long, split_records array<long>"))


def _records(pieces: Iterator[bytes], where: str) -> Iterator[bytes]:
    """The records, header and block, of a stream of them; a stream that isn't records to its end is an error."""
    held, need, head = bytearray(), 0, -1
    for piece in pieces:
        held += piece
        while True:
            if head < 0:
                while held[:2] == b"\r\n":  # what ends the record before
                    del held[:2]
                if held == b"\r":
                    break
                if not b"WARC/1.".startswith(bytes(held[:7])):
                    raise ValueError(f"{where}: no record where one should start")
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                need = head + 4 + int(_fields(bytes(held[:head])).get("content-length", "0"))
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            head = -1
    if held.strip(b"\r\n"):
        raise ValueError(f"{where}: the last record is cut short")


class _Members:
    """Records of the gzip members that start in ``[start, end)`` of a file, each with its member's offset."""

    def __init__(self, source, start: int, end: int, chunk: int):
        self.source, self.start, self.end, self.chunk = source, start, end, chunk
        self.buffer, self.at = b"", start  # bytes of the file from ``at`` on

    def _more(self) -> bool:
        self.source.seek(self.at + len(self.buffer))
        piece = self.source.read(self.chunk)
        self.buffer += piece
        return bool(piece)

    def _drop(self, n: int) -> None:
        self.buffer, self.at = self.buffer[n:], self.at + n

    def _decode(self) -> Iterator[bytes]:
        """What the member at the head of the buffer holds, piece by piece, the buffer moving behind it.

        Nothing if it isn't a member with a WARC record. Once its first bytes are a version line, damage is an error.
        """
        offset, inflate, total = self.at, zlib.decompressobj(31), b""
        fed = 0
        try:
            while len(total) < 7 and not inflate.eof:
                if fed == len(self.buffer) and not self._more():
                    break
                piece = self.buffer[fed : fed + self.chunk]
                total += inflate.decompress(piece, 7 - len(total))  # no further, so that later damage is told from no member
                fed += len(piece) - len(inflate.unconsumed_tail)
                if not b"WARC/1.".startswith(total[:7]):
                    return
        except zlib.error:
            return
        if len(total) < 7:
            if total and not inflate.eof:
                raise ValueError(f"the member at {offset} is cut short")
            return
        self._drop(fed - len(inflate.unused_data))
        yield total
        try:
            while not inflate.eof:
                if not self.buffer and not self._more():
                    raise ValueError(f"the member at {offset} is cut short")
                piece = self.buffer[: self.chunk]
                part = inflate.decompress(piece)
                self._drop(len(piece) - len(inflate.unused_data))
                yield part
        except zlib.error as e:
            raise ValueError(f"the member at {offset} is damaged: {e}") from e

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self.at < self.end:
            found = self.buffer.find(MAGIC)
            if found < 0:
                self._drop(max(0, len(self.buffer) - len(MAGIC) + 1))
                if self.at >= self.end or not self._more():
                    return
                continue
            self._drop(found)
            if self.at >= self.end:
                return
            offset = self.at
            for member in _records(self._decode(), f"the member at {offset}"):
                yield offset, member
            if self.at == offset:
                self._drop(1)


def _archive(source, start: int, split: int, chunk: int) -> Iterator[tuple[int, bytes]]:
    """Records of one range of an archive; those of a plain file all belong to its first range."""
    source.seek(0)
    first = source.read(7)
    if first and first[:3] != MAGIC and first != b"WARC/1.":
        raise ValueError("neither gzip nor WARC")
    if first == b"WARC/1.":
        source.seek(0)
        offset = 0
        for member in _records(iter(lambda: source.read(chunk), b""), "plain file") if start == 0 else ():
            yield offset, member
            offset += len(member) + 4
    else:
        yield from _Members(source, start, start + split, chunk)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name (the version line as ``""``) and the block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = int(fields.get("content-length", "0"))
    if len(rest) < size:
        raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
    return fields, rest[:size]


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


_READ = "path string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(manifest: DataFrame, options: WarcOptions = WarcOptions(), with_payload: bool = True) -> DataFrame:
    """One row per record of the files in ``(path, bytes)``; plain ``.warc`` files too.

    Damage after a valid start of a record stops the job, and so does a range with another number of
    records than a manifest of :func:`write` counts. ``offset`` is that of the record's gzip member.

    Digest and length of a response are taken from its payload, and a digest that disagrees with the
    record's header stops the job; a revisit has them from its headers. ``with_payload=False`` leaves the
    payload column null. Other kinds of records (warcinfo, request, ...) keep their type and whole block.
    """
    counted = "split_records" in manifest.columns
    split, counts = (F.col("split_bytes"), F.col("split_records")) if counted else (
        F.lit(options.split_bytes).cast("long"), F.lit(None).cast("array<long>")
    )
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = manifest.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), last, split)).alias("start"), split.alias("split"), counts.alias("counts")
    )
    expected = F.coalesce(F.get("counts", (F.col("start") / F.col("split")).cast("int")), F.when(F.col("counts").isNotNull(), 0)).cast("long")
    ranges = ranges.select("path", "start", "split", expected.alias("expected"))
    # a stated number of tasks, as adaptive execution would put these small rows into one; whole rows are dealt in turn
    tasks = ranges.agg(F.count("*")).first()[0]
    ranges = ranges.repartition(max(1, min(tasks, options.max_tasks)))

    def rows_of(path: str, start: int, split: int, expected: int | None) -> Iterator[tuple]:
        store, name = fs.FileSystem.from_uri(path)
        n = 0
        with store.open_input_file(name) as source:
            for offset, member in _archive(source, start, split, options.chunk_bytes):
                n += 1
                fields, block = parse_record(member)
                kind, payload = fields.get("warc-type", ""), block
                stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                http, sep, body = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"", block)
                if sep:
                    payload = body
                if kind == "revisit":
                    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    size, digest, payload = int(sizes[0]) if sizes else None, stated, None
                else:
                    size, digest = len(payload), payload_digest(payload)
                    if kind == "response" and stated and digest != stated:
                        raise ValueError(f"payload of {fields.get('warc-record-id')} in {path} at {offset} has digest {digest}, not {stated}")
                yield path, offset, _page(
                    fields.get("warc-record-id")
                ), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), size, digest, payload if with_payload else None
        if expected is not None and n != expected:
            raise ValueError(f"{path} has {n} records from {start} on, not {expected}")

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for one in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for row in rows_of(*one):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if len(held) >= 2000 or size >= 16 << 20:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return ranges.mapInArrow(run, _READ)


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A manifest of existing archives, for :func:`read`: paths are URIs of files or folders."""
    found = []
    for path in paths:
        store, name = fs.FileSystem.from_uri(path)
        info = store.get_file_info(name)
        every = store.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
        scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
        found += [(scheme + x.path, x.size) for x in every if x.is_file and x.path.endswith((".warc.gz", ".warc"))]
    return spark.createDataFrame(found, "path string, bytes long")


def round_trip(pages: DataFrame, folder: str | None = None, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Writes ``pages`` and reads the archives back: one row per page, payloads left out."""
    folder = folder or scratch(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    back = read(write(pages, folder, options), options, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 takes four letters from every five hexadecimal digits.
ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, i // 4 * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p
"""
