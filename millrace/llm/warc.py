"""WARC archives: written by the tasks that hold the records, read back as a table of chunks.

An archive is a sequence of gzip members, one per record. Payloads are compressed, parsed and digested piece by piece;
a record that is read becomes rows of (record, chunk number), each with the digest of the payload up to there, so that
no task ever holds an uncompressed record beyond one piece. Archives lie in the folder that driver and executors share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_at_end, id_of, key_of, materialize, shared_dir

#: Groups of equal payloads up to which they are broadcast; beyond, the pages are shuffled to them.
BROADCAST_GROUPS = 500_000
PIECE = 1 << 20
_ARCHIVE_BYTES = 256 << 20
_MANIFEST = "path string, records long, bytes long"
_CHUNKS = "key long, url string, record_type string, refers_key long, chunk long, data binary, seen long, digest string, last boolean, stated string"
_DATE = "2024-01-01T00:00:00Z"


def _urn(key: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=key + 2**64)}>"


def _key(urn: str) -> int:
    return uuid.UUID(urn.removeprefix("<urn:uuid:").removesuffix(">")).int - 2**64


def _header(key: int, url: str | None, digest: str, size: int, refers: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(0x21, 0x7F)))).replace("%25", "%"))
        lines.append("X-Target-URI-Hex: " + url.encode().hex())
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, records = None, "", 0

        def closed() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            columns = [batch.column(n) for n in ("key", "url", "payload", "digest", "keep")]
            for i in range(batch.num_rows):
                key, url, payload, digest, keep = (c[i] for c in columns)
                if out is None:
                    path, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                key, keep = key.as_py(), keep.as_py()
                view = memoryview(payload.as_buffer())
                refers = keep if keep is not None and keep != key else None
                member = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(member.compress(_header(key, url.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), len(view), refers)))
                for at in range(0, len(view) if refers is None else 0, PIECE):
                    out.write(member.compress(view[at : at + PIECE]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                records += 1
                if out.tell() >= _ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, *, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the written archives.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is a response and the
    others are revisits of it; smaller payloads are all responses. Rows that repeat the page_id of the response are
    responses too. A null html is an empty payload, a null page_id counts as the smallest, a null url is left out.

    Returns path, records and bytes of each archive, as a table in the shared folder; archives without a ``folder`` of
    the caller's go when the application ends. An archive of a task that failed
    is not in it, so its file is never read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(key_of("page_id").alias("key"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("n"), F.xxhash64("payload").alias("x"))
    groups = materialize(rows.groupBy("digest", "n", "x").agg(F.max("key").alias("keep"), F.count("*").alias("rows")).where((F.col("rows") > 1) & (F.col("n") >= min_bytes)).drop("rows"))
    few = groups.count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if few else groups, ["digest", "n", "x"], "left")
    where = folder or f"{shared_dir(pages.sparkSession)}/millrace-warc-{uuid.uuid4().hex}"
    written = materialize(joined.select("key", "url", "payload", "digest", "keep").mapInArrow(_write(where), _MANIFEST))
    if folder is None:
        delete_at_end(pages.sparkSession, where)
    return written.withColumn("folder", F.lit(where))


class _Reader:
    """Bytes of an archive's records in order, decompressed as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.inflate, self.raw, self.ready = stream, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Decompresses up to a piece; False at the end."""
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    return False
            got = self.inflate.decompress(self.raw, PIECE)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            if got:
                self.ready += got
                return True

    def head(self) -> bytes | None:
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        head, self.ready = self.ready[:end], self.ready[end + 4 :]
        return head

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.more():
                raise ValueError("the archive ends within a record")
            piece, self.ready = self.ready[: min(size, PIECE)], self.ready[min(size, PIECE) :]
            size -= len(piece)
            yield piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def records(stream, with_data: bool) -> Iterator[tuple]:
    """Rows of the chunk table of one archive."""
    reader = _Reader(stream)
    while (head := reader.head()) is not None:
        f = _fields(head)
        key, refers = _key(f["warc-record-id"]), f.get("warc-refers-to")
        url = bytes.fromhex(f["x-target-uri-hex"]).decode() if "x-target-uri-hex" in f else f.get("warc-target-uri")
        stated = f["warc-payload-digest"].removeprefix("sha1:")
        http = reader.head()
        size = int(f["content-length"]) - len(http) - 4
        front = (key, url, f["warc-type"], _key(refers) if refers else None)
        sha, seen, chunk = hashlib.sha1(), 0, 0
        held = None
        for piece in reader.body(size):
            if held is not None:
                yield (*front, chunk, held if with_data else None, seen, _b32(sha), False, stated)
                chunk += 1
            sha.update(piece)
            seen += len(piece)
            held = piece
        if refers:
            yield (*front, chunk, None, int(f["x-payload-length"]), stated, True, stated)
        else:
            yield (*front, chunk, held if with_data else None, seen, _b32(sha), True, stated)
        reader.head()  # the empty lines after a record


def _b32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _read(with_data: bool):
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string())
    names = [x.split()[0] for x in _CHUNKS.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(folder)
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in records(stream, with_data):
                        rows.append(row)
                        size += len(row[5] or b"")
                        if len(rows) >= 4096 or size >= 8 * PIECE:
                            yield table(rows)
                            rows, size = [], 0
                    if rows:
                        yield table(rows)

    return run


def read_chunks(archives: DataFrame, *, with_data: bool = True) -> DataFrame:
    """The chunk table of archives: page_id, url, record_type, refers_to, chunk, data (null without ``with_data``), seen
    and digest (of the payload up to this chunk, base32 SHA-1), last, and the digest stated in the record's header.

    A revisit has one row without data, whose length and digest are the full payload's, from its header.
    """
    spread = archives.repartition(max(1, archives.count()), "path")
    chunks = spread.select("path", "folder").mapInArrow(_read(with_data), _CHUNKS)
    return chunks.select(id_of().alias("page_id"), "url", "record_type", id_of("refers_key").alias("refers_to"), "chunk", "data", "seen", "digest", "last", "stated")


def archive_roundtrip(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives, reads them back and gives a row per record.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and intact (the digest of what was read
    is the one in the header). See ``write_archives`` for nulls and ties; an empty table gives an empty result.
    """
    chunks = read_chunks(write_archives(pages, min_bytes=min_bytes), with_data=False).where("last")
    return chunks.select("page_id", "url", F.col("seen").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", (F.col("digest") == F.col("stated")).alias("intact"))
