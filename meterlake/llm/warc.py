"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records, followed by
a seek table (sizes of all frames) in a skippable frame. The index maps each record to its bundle, its
frame and its offset within the frame's content, so that reading a record costs one seek and the
decompression of one frame.

Each task writes its own bundles under names that no other attempt uses. Only the index rows of
committed tasks are kept, so files of lost attempts are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The seekable format's skippable frame, its magic numbers and empty descriptor.
_SKIPPABLE_MAGIC, _SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_SEEK_FOOTER = struct.Struct("<IBI")
_SEEK_ENTRY = struct.Struct("<II")

LEAST_BYTES = 100
INDEX = ("page_id long, record_id string, bundle string, frame int, frame_offset long, frame_bytes long, "
         "record_offset long, record_bytes long")
RECORD = ("page_id long, record_id string, record_type string, refers_to long, url string, payload binary, "
          "payload_bytes long, payload_digest string")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """Identifier and bytes of one record; a revisit carries headers only."""
    name = f"urn:page:{'null' if page_id is None else page_id}"
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&' + chr(39) + '()*+,;=~')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("No WARC record starts here.")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(headers["content-length"])
    return headers, data[stop + 4: stop + 4 + size], stop + 8 + size


class Bundle:
    """Writer of one seekable file; `add` returns where the record went once its frame is closed."""

    def __init__(self, folder: str, level: int):
        self.path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.zst"
        self.store, inner = fs.FileSystem.from_uri(self.path)
        self.store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.out = self.store.open_output_stream(inner, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.written = 0
        self.open: list[bytes] = []
        self.open_rows: list[tuple] = []
        self.open_bytes = 0

    def add(self, page_id: int | None, name: str, data: bytes) -> None:
        self.open_rows.append((page_id, name, self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)

    def close_frame(self) -> list[tuple]:
        if not self.open:
            return []
        packed = self.packer.compress(b"".join(self.open))
        self.out.write(packed)
        rows = [(p, n, self.path, len(self.frames), self.written, len(packed), at, size) for p, n, at, size in self.open_rows]
        self.frames.append((len(packed), self.open_bytes))
        self.written += len(packed)
        self.open, self.open_rows, self.open_bytes = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.close_frame()
        table = b"".join(_SEEK_ENTRY.pack(*f) for f in self.frames) + _SEEK_FOOTER.pack(len(self.frames), 0, _SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return rows


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(offset, compressed, uncompressed) of each frame, read from the end of a bundle."""
    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        size = f.size()
        f.seek(size - _SEEK_FOOTER.size)
        count, _, magic = _SEEK_FOOTER.unpack(f.read(_SEEK_FOOTER.size))
        if magic != _SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table.")
        f.seek(size - _SEEK_FOOTER.size - count * _SEEK_ENTRY.size)
        entries, at, out = f.read(count * _SEEK_ENTRY.size), 0, []
    for packed, plain in _SEEK_ENTRY.iter_unpack(entries):
        out.append((at, packed, plain))
        at += packed
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()),
                          ("frame_offset", pa.int64()), ("frame_bytes", pa.int64()), ("record_offset", pa.int64()), ("record_bytes", pa.int64())])
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                           ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every row.

    Among rows with equal payloads of at least 100 bytes the smallest page_id is the response; rows
    with another or a null id revisit it. Equal rows with that id are all responses, as are rows whose
    payload occurs under null ids only. A null html is the empty payload.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= LEAST_BYTES
    # Only payloads seen twice are joined; a hot one is a single row here.
    firsts = (rows.filter(long_enough).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1 AND first IS NOT NULL").drop("n"))
    # Short payloads get keys that match nothing, so that they do not meet in one task.
    key = F.when(long_enough, F.col("digest")).otherwise(F.concat(F.lit("short-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    return (rows.withColumn("same", key).join(firsts, "same", "left")
            .select("page_id", "url", "payload", "digest",
                    F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")))


def write(pages: DataFrame, folder: str, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, level: int = 3,
          date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all rows of `with_revisits` into bundles below `folder`; returns the index of records.

    Store the index before reading it, since each evaluation writes anew. A frame ends after
    `frame_bytes` of records, a bundle after `bundle_bytes` of compressed frames.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                bundle = bundle or Bundle(folder, level)
                bundle.add(page_id, *_record(page_id, url, payload, digest, refers_to, date))
                if bundle.open_bytes >= frame_bytes:
                    rows += bundle.close_frame()
                    if bundle.written >= bundle_bytes:
                        rows += bundle.close()
                        bundle = None
            yield from _rows(rows, _INDEX_ARROW)
        if bundle:
            yield from _rows(bundle.close(), _INDEX_ARROW)

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(pack, INDEX)


def read(index: DataFrame, tasks: int, payloads: bool = True) -> DataFrame:
    """The records of an index, each by its offset; frames are dealt to tasks and read once each.

    Size and digest of a response are those of the payload as read; those of a revisit are its
    headers'. `payloads=False` leaves the payload column null.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file, at, frame = None, None, None, b""
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held = [], 0
            for r in batch.to_pylist():
                if r["bundle"] != opened:
                    if file:
                        file.close()
                    store, inner = fs.FileSystem.from_uri(r["bundle"])
                    opened, file, at = r["bundle"], store.open_input_file(inner), None
                if r["frame_offset"] != at:
                    at = r["frame_offset"]
                    file.seek(at)
                    frame = plain.decompress(file.read(r["frame_bytes"]))
                headers, block, end = parse_record(frame, r["record_offset"])
                if headers["warc-record-id"] != f"<{r['record_id']}>" or end - r["record_offset"] != r["record_bytes"]:
                    raise ValueError(f"{r['bundle']}: the index does not fit the archive.")
                kind = headers["warc-type"]
                stop = block.index(b"\r\n\r\n") + 4
                payload = block[stop:] if kind == "response" else None
                refers_to = headers.get("warc-refers-to")
                if payload is None:
                    size = int(block[:stop].decode().lower().split("content-length: ")[1].split("\r\n")[0])
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                rows.append((r["page_id"], r["record_id"], kind, int(refers_to.strip("<>").rsplit(":", 1)[1]) if refers_to else None,
                             headers.get("warc-target-uri"), payload if payloads else None, size, digest))
                held += len(payload or b"") if payloads else 0
                if held > 1 << 23:
                    yield from _rows(rows, _RECORD_ARROW)
                    rows, held = [], 0
            yield from _rows(rows, _RECORD_ARROW)
        if file:
            file.close()

    dealt = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame_offset", "record_offset")
    return dealt.mapInArrow(unpack, RECORD)


def read_tasks(index: DataFrame, bytes_per_task: int = 1 << 25) -> int:
    """Tasks to read an index with: one per so many compressed bytes, and two per core at least."""
    total = index.dropDuplicates(["bundle", "frame"]).agg(F.sum("frame_bytes")).first()[0] or 0
    return max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-total // bytes_per_task))
