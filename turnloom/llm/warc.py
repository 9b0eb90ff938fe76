"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with a seek table in a skippable frame (each frame's compressed
and raw size, then the frame count and a magic number), so a reader finds any frame from the end of the file. The index
maps each record to its bundle, frame and offset within the raw frame, so one record costs one frame.

Pages with equal payloads of at least ``min_bytes`` are written once: the smallest page_id is the response, others
revisit it. Decisions are taken on digests alone. Digests that several pages share are broadcast while they are few, so
html is written where it is read; beyond that html meets its page's decision on the page's own id and a salt, so a
payload that a third of all pages share is never gathered.

Reading takes frames: each task reads some of a bundle's, found by the seek table, and tasks grow with the bytes.

Tasks write bundles under names of their own attempt into the shared folder; only those in the committed index count, so
a lost or repeated attempt leaves nothing but an unread file.

Cases. Null html is an empty payload; null urls have no target header. Null page_ids are written without a number, never
revisit targets unless nothing else has the payload. Repeated rows are records of their own: all rows of the smallest
page_id are responses. An empty table gives no bundle and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir, small_arrow_batches

# Fixed values of the seekable Zstandard format and of WARC.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_BYTES = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 25

#: Compressed bytes of the frames that one task reads.
READ_BYTES = 1 << 22

#: Shared digests that may be broadcast, at about 60 bytes each, and the parts of a page_id's rows beyond that.
SHARED_ROWS = 1_000_000
SALTS = 16
RECORD_DATE = "1970-01-01T00:00:00Z"

INDEX = "bundle string, frame int, frame_at long, frame_bytes long, record_at long, record_bytes long, page_id long, record_type string"
RECORDS = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, html string"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "none"
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC record; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record in a raw frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        n = int(head["Content-Length"])
        yield at, head, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


class BundleWriter:
    """Writes frames to one file and closes it with the seek table."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.out, self.sizes, self.at = fs.open_output_stream(path, compression=None), [], 0

    def frame(self, raw: bytes) -> tuple[int, int, int]:
        """(number, offset, compressed size)."""
        packed = zstandard.ZstdCompressor(level=3).compress(raw)
        self.out.write(packed)
        self.sizes.append((len(packed), len(raw)))
        self.at += len(packed)
        return len(self.sizes) - 1, self.at - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC))
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, raw size) of each frame, read from the end of the file."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * entry)
    table, frames, at = file.read(n * entry), [], 0
    for k in range(n):
        packed, raw = struct.unpack_from("<II", table, k * entry)
        frames.append((at, packed, raw))
        at += packed
    return frames


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        task, part = context.taskAttemptId(), context.partitionId()
        bundle, name, count, pending, held, rows = None, "", 0, [], 0, []

        def flush() -> None:
            nonlocal bundle, name, count, held
            if not pending:
                return
            if bundle is None:
                name = f"part-{part:05d}-{task}-{count}.warc.zst"
                count += 1
                bundle = BundleWriter(fs, f"{base}/{name}")
            number, at, packed = bundle.frame(b"".join(r for r, _, _ in pending))
            offset = 0
            for r, page_id, kind in pending:
                rows.append({"bundle": name, "frame": number, "frame_at": at, "frame_bytes": packed, "record_at": offset, "record_bytes": len(r), "page_id": page_id, "record_type": kind})
                offset += len(r)
            pending.clear()
            held = 0
            if bundle.at >= bundle_bytes:
                bundle.close()
                bundle = None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(rows, schema=_INDEX_ARROW)
            rows.clear()
            return batch

        for batch in batches:
            for x in batch.to_pylist():
                payload = None if x["record_type"] == "revisit" else (x["html"] or "").encode()
                r = record(x["page_id"], x["url"], payload, x["digest"], x["n_bytes"], x["refers_to"])
                pending.append((r, x["page_id"], x["record_type"]))
                held += len(r)
                if held >= frame_bytes:
                    flush()
            if rows:
                yield out()
        flush()
        if bundle is not None:
            bundle.close()
        if rows:
            yield out()

    return write


_INDEX_ARROW = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("record_at", pa.int64()), ("record_bytes", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())])
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("html", pa.string())])


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """page_id, url, html (null for revisits), digest, n_bytes, record_type, refers_to."""
    html = F.coalesce("html", F.lit(""))
    digested = pages.select("page_id", "url", "html", F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    narrow = digested.where(F.col("n_bytes") >= min_bytes).select("page_id", F.unhex("digest").alias("s_digest"))
    shared = narrow.groupBy("s_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n")
    shared = materialise(shared, "warc-shared")
    same = F.unhex("digest") == F.col("s_digest")
    if shared.count() <= shared_rows:
        # only shared digests are there, and they are all long enough
        met = digested.join(F.broadcast(shared), same, "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r_salt")
        revisits = narrow.join(shared, "s_digest").select(F.col("page_id").alias("r_id"), "s_digest", "first_id").distinct().select("r_id", "s_digest", "first_id", salts)
        salted = digested.withColumn("salt", F.pmod(F.xxhash64("url") + F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        met = salted.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & same & (F.col("salt") == F.col("r_salt")), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select(
        "page_id", "url", F.when(~again, F.col("html")).alias("html"), "digest", "n_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> tuple[str, DataFrame]:
    """Write the bundles and return (folder, index); the index holds one row per record."""
    spark = pages.sparkSession
    small_arrow_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return folder, materialise(decide(pages, min_bytes).mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX), "warc-index")


def _record_row(head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    response = head["WARC-Type"] == "response"
    if response and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    return {
        "page_id": _page(head["WARC-Record-ID"]), "record_type": head["WARC-Type"], "refers_to": _page(head.get("WARC-Refers-To")),
        "url": head.get("WARC-Target-URI"), "payload_digest": digest, "payload_bytes": length, "html": payload.decode() if response else None,
    }


def read_archive(folder: str, index: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """All records of the index's bundles, checked against their digests; a task takes some frames, one at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, file, table = None, None, []
        for batch in batches:
            for x in batch.to_pylist():
                if x["bundle"] != name:
                    if file is not None:
                        file.close()
                    name = x["bundle"]
                    file = fs.open_input_file(f"{base}/{name}")
                    table = seek_table(file)
                at, packed, raw = table[x["frame"]]
                file.seek(at)
                frame = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=raw)
                yield pa.RecordBatch.from_pylist([_record_row(h, b) for _, h, b in parse_records(frame)], schema=_RECORDS_ARROW)
        if file is not None:
            file.close()

    frames = index.groupBy("bundle", "frame").agg(F.first("frame_bytes").alias("packed"))
    whole = frames.agg(F.sum("packed")).first()[0] or 0
    # a fixed number: the rows are tiny and would otherwise be put together, though each stands for a frame
    tasks = max(1, -(-whole // read_bytes))
    return frames.select("bundle", "frame").repartition(tasks, "bundle", F.floor(F.col("frame") / 8)).sortWithinPartitions("bundle", "frame").mapInArrow(read, RECORDS)


def fetch(folder: str, wanted: DataFrame) -> DataFrame:
    """The records of some index rows only: for each, its frame is read at its offset and cut at the record's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                with fs.open_input_file(f"{base}/{x['bundle']}") as file:
                    file.seek(x["frame_at"])
                    frame = zstandard.ZstdDecompressor().decompress(file.read(x["frame_bytes"]))
                part = frame[x["record_at"] : x["record_at"] + x["record_bytes"]]
                rows += [_record_row(h, b) for _, h, b in parse_records(part)]
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS_ARROW)

    return wanted.select("bundle", "frame_at", "frame_bytes", "record_at", "record_bytes").mapInArrow(read, RECORDS)
