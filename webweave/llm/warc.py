"""WARC records in seekable Zstandard bundles: independent frames and a seek table at the end."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweave.llm.common import partitions
from webweave.session import checkpoint_dir, materialize

# The seekable format's skippable frame, its footer's mark, and the record profile.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema([
    ("file", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()),
    ("offset", pa.int64()), ("length", pa.int64()),
])
_RECORDS = pa.schema([
    ("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
_RECORDS_DDL = (
    "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}').urn}>"


def _line(text: str) -> str:
    """A header's value: no line ends inside."""
    return "".join(f"%{ord(c):02X}" if c < " " else c for c in text)


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that has the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": "urn:x-no-url" if url is None else _line(url),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields; of a revisit, size and digest are those of the payload it stands for."""
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, payload = block[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        digest, payload = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), None
    ids = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    return {
        "page_id": ids["X-Page-Id"], "record_id": fields["WARC-Record-ID"], "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"], "refers_to": ids["X-Refers-To-Page-Id"],
        "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


def _records(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        length = int(raw[at:end].partition(b"\r\nContent-Length: ")[2].partition(b"\r\n")[0])
        yield raw[at : (at := end + 4 + length + 4)]


class BundleWriter:
    """One file; ``add`` returns where a record will be: (frame, offset in the frame's content)."""

    def __init__(self, sink, frame_bytes: int) -> None:
        self.sink, self.frame_bytes = sink, frame_bytes
        self.sizes: list[tuple[int, int]] = []
        self.frame: list[bytes] = []
        self.filled = self.written = 0
        self.pack = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        if self.frame and self.filled + len(record) > self.frame_bytes:
            self._end_frame()
        place = len(self.sizes), self.filled
        self.frame.append(record)
        self.filled += len(record)
        return place

    def _end_frame(self) -> None:
        packed = self.pack.compress(b"".join(self.frame))
        self.sink.write(packed)
        self.sizes.append((len(packed), self.filled))
        self.written += len(packed)
        self.frame, self.filled = [], 0

    def close(self) -> None:
        if self.frame:
            self._end_frame()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.sizes)
        table += struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.sink.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Finds frames by the table at the file's end and unpacks only those asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 9)
        frames, _, mark = struct.unpack("<IBI", source.read(9))
        if mark != _SEEKABLE:
            raise ValueError("no seek table at the end")
        source.seek(size - 9 - 8 * frames)
        self.frames, at = [], 0
        for packed, raw in struct.iter_unpack("<II", source.read(8 * frames)):
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, raw = self.frames[number]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=raw)


def _open(uri: str, write: bool = False):
    system, path = fs.FileSystem.from_uri(uri)
    if not write:
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # the records are packed already


def with_record_types(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000
) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): ``refers_to`` is null for responses.

    Of equal payloads of at least ``least_bytes`` the row with the largest id is the response. Equal
    means equal SHA-256 and length. Groups are counted before any payload moves; a hot group sits on
    the join's splittable side.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_sha", F.sha2("payload", 256))
    groups = materialize(
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("_sha")
        .agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
        .where("_n > 1 AND _response IS NOT NULL").select("_sha", "_response")
    )
    return rows.join(groups, "_sha", "left").select(
        "page_id", "url", "payload", F.sha1("payload").alias("sha1"),
        F.when(~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 1000, frame_bytes: int = 262_144, file_bytes: int = 67_108_864,
    date: datetime = datetime(2020, 1, 1, tzinfo=timezone.utc),
) -> DataFrame:
    """Write a WARC record per row; (file, record_id, page_id, frame, offset, length): where each is.

    Every task writes files of its own of about ``file_bytes`` below ``folder``, a URI that all
    machines share (default: a new folder below spark.checkpoint.dir). Files have new names for each
    attempt and only files in the returned, stored index count, so lost executors leave no doubles.

    Null html: an empty payload. Null url: ``urn:x-no-url``. A null id has no X-Page-Id. Rows that
    repeat are written each; of those with the group's largest id all are responses. Empty table: no
    files. A frame holds records of about ``frame_bytes`` or one longer record.
    """
    folder = folder or f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(_open(name, write=True), frame_bytes)
                record = make_record(*(row[c] for c in ("page_id", "url", "payload", "sha1", "refers_to")), stamp)
                frame, offset = writer.add(record)
                rows.append((name, record_id(row["page_id"]), row["page_id"], frame, offset, len(record)))
                if writer.written >= file_bytes:
                    writer.close()
                    writer = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _INDEX.types)], schema=_INDEX)
                rows = []
        if writer is not None:
            writer.close()

    records = with_record_types(pages, id_col, url_col, html_col, least_bytes)
    return materialize(records.mapInArrow(
        write, "file string, record_id string, page_id long, frame int, offset long, length long"
    ))


def _batches(rows: Iterator[dict], payloads: bool, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, filled = [], 0
    for row in rows:
        filled += len(row["payload"] or b"")
        held.append(row if payloads else row | {"payload": None})
        if filled >= size or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)
            held, filled = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_RECORDS)


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the files in ``index``, read by their seek tables, a frame at a time.

    (page_id, record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload); size
    and digest of a response are taken from the payload read, those of a revisit from its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for name in batch.column("file").to_pylist():
                    with _open(name) as source:
                        bundle = BundleReader(source)
                        for number in range(len(bundle.frames)):
                            yield from map(parse_record, _records(bundle.frame(number)))

        yield from _batches(rows(), payloads)

    # not by the file's name: the distinct rows are dealt by it already, and few bytes of names end in one task
    files = index.select("file").distinct().repartition(partitions(index.sparkSession))
    return files.mapInArrow(read, _RECORDS_DDL)


def look_up(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows only: their frames are unpacked, nothing else is read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            source, at, name, number, raw = None, None, None, None, b""
            for batch in batches:
                for row in batch.to_pylist():
                    if row["file"] != name:
                        name, number = row["file"], None
                        if source is not None:
                            source.close()
                        source = _open(name)
                        at = BundleReader(source)
                    if row["frame"] != number:
                        number = row["frame"]
                        raw = at.frame(number)
                    yield parse_record(raw[row["offset"] : row["offset"] + row["length"]])
            if source is not None:
                source.close()

        yield from _batches(rows(), payloads)

    spread = index.select("file", "frame", "offset", "length").repartition("file", "frame")
    return spread.sortWithinPartitions("file", "frame", "offset").mapInArrow(read, _RECORDS_DDL)
