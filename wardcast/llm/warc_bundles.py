"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole records, that ends with a seek table in a
skippable frame, so any Zstandard reader can read all of it and a reader of the table can fetch one frame.
An index maps a record's identifier to its bundle, frame and place within the frame's content.

Every task writes bundles of its rows as they stream by; a bundle's size is bounded. Bundles are kept as rows
of a table in the folder that all executors share, since that folder need not be a mounted file system;
``exported`` writes the same bytes as files where it is one.

A record whose payload equals that of a record with a smaller identifier is a revisit without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
BUNDLES = "bundle string, content binary, records array<struct<id:string,frame:int,offset:int,length:int>>"
RECORDS = "id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def classified(pages: DataFrame, *, id: str, payload: str, least: int = 0) -> DataFrame:
    """The rows with ``sha1`` (hex) of the payload and ``original``, the smallest id with an equal payload.

    Payloads under ``least`` bytes are their own originals. The smallest id is found by partial aggregation, so
    a payload that a third of the rows share is combined before the shuffle.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.withColumn("sha1", F.sha1(body))
    first = rows.groupBy("sha1").agg(F.min(id).alias("original"))
    out = rows.join(first, "sha1")
    return out.withColumn("original", F.when(F.octet_length(body) >= least, F.col("original")).otherwise(F.col(id)))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(id: str, url: str, date: str, payload: bytes, original: str | None) -> bytes:
    """One WARC record; a revisit of ``original`` if that is another one."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = original is not None and original != id
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:record:{id}>"]
    lines += [f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{_digest(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:record:{original}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins there and where the next one does."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(x.split(": ", 1) for x in lines)
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    split = block.index(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", block[:split])[1])
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[split + 4 :] if kind == "response" else None
    if payload is not None and (len(payload), _digest(payload)) != (full, digest):
        raise ValueError(f"record {head['WARC-Record-ID']} does not match its digest")
    name = lambda key: head[key][len("<urn:record:") : -1] if key in head else None
    out = {"id": name("WARC-Record-ID"), "record_type": kind, "url": head["WARC-Target-URI"], "refers_to": name("WARC-Refers-To")}
    return out | {"payload_bytes": full, "payload_digest": digest, "payload": payload}, end + 8 + size


class _Writer:
    def __init__(self, level: int):
        self.level = level
        self.clear()

    def clear(self) -> None:
        self.frames, self.sizes, self.open, self.open_size, self.index = [], [], [], 0, []

    def add(self, id: str | None, data: bytes) -> None:
        self.index.append({"id": id, "frame": len(self.frames), "offset": self.open_size, "length": len(data)})
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(zstandard.ZstdCompressor(level=self.level).compress(b"".join(self.open)))
            self.sizes.append((len(self.frames[-1]), self.open_size))
            self.open, self.open_size = [], 0

    @property
    def size(self) -> int:
        return sum(c for c, _ in self.sizes)

    def bundle(self, name: str) -> pa.RecordBatch:
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        content = b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table
        kind = pa.list_(pa.struct([("id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
        columns = [pa.array([name]), pa.array([content], pa.binary()), pa.array([self.index], kind)]
        self.clear()
        return pa.RecordBatch.from_arrays(columns, names=["bundle", "content", "records"])


def bundles(rows: DataFrame, *, id: str, url: str, payload: str, date: str, level: int = 3) -> DataFrame:
    """(bundle, content, records) of the rows of ``classified``: each content is a whole seekable file.

    A null payload is empty, a null URL too. A row without an id has an empty identifier and is never referred to;
    it is a revisit if another record with an id has its payload. Rows that repeat an id with its payload are
    all written, as responses if that id is the smallest. A record larger than a frame has a frame of its own.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    picked = rows.select(
        F.spark_partition_id().alias("part"),
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.col("original").cast("string").alias("original"),
        body.alias("payload"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done, part = _Writer(level), 0, 0
        for batch in batches:
            for part, own, where, original, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(own, record(own, where, date, data, original))
                if writer.size >= BUNDLE_BYTES:
                    yield writer.bundle(f"{part:06d}-{done:06d}")
                    done += 1
        if writer.index:
            yield writer.bundle(f"{part:06d}-{done:06d}")

    return picked.mapInArrow(write, BUNDLES)


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the table at the end."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    at, start, out = len(content) - 9 - width * count, 0, []
    for i in range(count):
        packed, size = struct.unpack_from("<II", content, at + width * i)
        out.append((start, packed, size))
        start += packed
    return out


def _frame(content: bytes, place: tuple[int, int, int]) -> bytes:
    start, packed, size = place
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=size)


def _rows(found: list[dict], extra: dict | None = None) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    names = ["id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    columns = [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def records(archives: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame; payloads are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                content = content.as_py()
                for place in seek_table(content):
                    data, at, found = _frame(content, place), 0, []
                    while at < len(data):
                        one, at = parsed(data, at)
                        found.append(one)
                    yield _rows(found)

    return archives.select("content").mapInArrow(read, RECORDS)


def index(archives: DataFrame) -> DataFrame:
    """(bundle, id, frame, offset, length) of every record."""
    return archives.select("bundle", F.inline("records"))


def fetched(archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ids ``wanted`` (id) names: only the frames that hold them are decompressed."""
    ids = wanted.select(F.col("id").cast("string").alias("id")).distinct()
    places = index(archives).join(ids, "id").groupBy("bundle", "frame")
    places = places.agg(F.collect_list("offset").alias("offsets"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, frame, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _frame(content, seek_table(content)[frame])
                yield _rows([parsed(data, at)[0] for at in sorted(offsets)])

    return archives.join(places, "bundle").select("content", "frame", "offsets").mapInArrow(read, RECORDS)


def exported(archives: DataFrame, folder: str) -> DataFrame:
    """Write each bundle to ``folder``/<bundle>.warc.zst, a folder mounted on every executor; (file, size).

    A file appears under its name only when it is whole, and writing it again gives the same bytes, so tasks may
    be repeated.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{os.getpid()}.part", "wb") as out:
                    out.write(content)
                os.replace(out.name, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)])], names=["file", "size"])

    return archives.select("bundle", "content").mapInArrow(write, "file string, size long")
