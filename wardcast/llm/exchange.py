"""Asking the whole corpus about hashed keys.

Texts are dealt into chunks by a hash of their identifier and text, so that rows without an identifier, or with a
repeated one, are dealt too; only rows equal in both are sure to share a chunk. A chunk sends each of its distinct keys
once to the bucket that owns it; the bucket answers every chunk in the order it asked. A key that a
third of all texts hold therefore costs one entry per chunk, and no task sees more than its share of
the keys. Chunks and buckets number ``spark.sql.shuffle.partitions``, which grows with the input.

Keys are uniform 64-bit values. A bucket is a range of them, so keys in ascending order are in bucket
order. Where a false alarm does no harm, 32 bits per key are sent: how often two keys of a bucket
agree by chance depends on the bucket's size alone, not on the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.llm.memory import lean, let_go

#: Rows, or bytes of them, that are dealt into chunks at once: the fewer, the more and smaller parts a chunk has.
PACK_ROWS, PACK_BYTES = 10_000, 32 << 20
ASKED = "chunk int, bucket int, kind int, keys binary"


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def chunks(docs: DataFrame, n: int) -> DataFrame:
    """All columns of the rows (id, text, ...), packed and compressed per chunk, one chunk in each of n partitions.

    A chunk's rows come in no fixed order. Read them with ``unpacked``.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            order = np.argsort(chunk := batch.column(0).to_numpy(), kind="stable")
            edges = np.searchsorted(chunk[order], np.arange(n + 1))
            rows = pa.Table.from_batches([batch]).drop(["chunk"])
            for c in np.flatnonzero(np.diff(edges)).tolist():
                blob = pa.array([packed(rows.take(pa.array(order[edges[c] : edges[c + 1]])))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), blob], names=["chunk", "packed"])

    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")
    dealt = docs.select(chunk.alias("chunk"), *docs.columns)
    return dealt.mapInArrow(lean(pack), "chunk int, packed binary").repartitionById(n, F.col("chunk"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``PACK_ROWS`` or ``PACK_BYTES``, however few arrive at once; larger ones stay whole."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield _one(held)
            held, rows, size = [], 0, 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The rows of all batches, which are let go."""
    out = held[0] if len(held) == 1 else pa.concat_batches(held)
    held.clear()
    return out


def unpacked(blobs) -> pa.Table | None:
    """The rows in packed parts (an Arrow column of them)."""
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in blobs]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def per_chunk(dealt: DataFrame, each: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``each`` on every chunk's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            yield from each(table["chunk"][0].as_py(), unpacked(table["packed"]))

    return dealt.mapInArrow(lean(run), schema)


def with_answers(
    dealt: DataFrame, answers: DataFrame, n: int, each: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``each`` on every chunk's rows and the answers to it."""

    def run(rows: pa.Table, got: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            yield from each(rows["chunk"][0].as_py(), unpacked(rows["packed"]), got)

    def whole(rows: pa.Table, got: pa.Table) -> pa.Table:
        let_go()
        parts = list(run(rows, got))
        let_go()
        return pa.Table.from_batches(parts) if parts else empty

    empty = _empty(schema)
    back = answers.repartitionById(n, F.col("chunk"))
    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(whole, schema)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows in packed tables, as rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                yield from pa.ipc.open_stream(blob.as_buffer()).read_all().to_batches()

    return df.select(column).mapInArrow(lean(read), schema)


def _empty(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place among them of each key.

    Each key is sorted with its number in place of its low bits, which takes a fraction of looking every key up; where that
    leaves two keys in the wrong order, the numbers are sorted by whole keys.
    """
    if len(keys) == 0:
        return keys, np.zeros(0, np.int64)
    low = np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys)
        ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def asked(chunk: int, kind: int, keys: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket with the keys (in order) that it owns, as the bytes of all columns."""
    edges = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
    rows = [(b, x, y) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([chunk] * len(rows), pa.int32()),
            pa.array([b for b, _, _ in rows], pa.int32()),
            pa.array([kind] * len(rows), pa.int32()),
            pa.array([b"".join(c[x:y].tobytes() for c in columns) for _, x, y in rows], pa.binary()),
        ],
        names=["chunk", "bucket", "kind", "keys"],
    )


def answered(table: pa.Table, kind: int) -> list[bytes]:
    """The answers of that kind to one chunk, in bucket order."""
    rows = table.filter(pa.compute.equal(table["kind"], kind)).sort_by("bucket")
    return [x.as_py() for x in rows["keys"]]


def by_bucket(asks: DataFrame, n: int, answer: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Every bucket's answers, in the layout of the requests, dealt back to the chunks; None is not sent."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        kinds, buckets = table["kind"].to_numpy(), table["bucket"].to_numpy()
        blobs = [x.as_py() for x in table["keys"]]
        out: list[bytes | None] = [None] * len(blobs)
        for kind, bucket in sorted(set(zip(kinds.tolist(), buckets.tolist(), strict=True))):
            mine = np.flatnonzero((kinds == kind) & (buckets == bucket)).tolist()
            for i, x in zip(mine, answer([blobs[i] for i in mine]), strict=True):
                out[i], blobs[i] = x, b""
        columns = [table["chunk"], table["bucket"], table["kind"], pa.array(out, pa.binary())]
        said = pa.Table.from_arrays(columns, names=["chunk", "bucket", "kind", "keys"])
        yield from said.filter(said["keys"].is_valid()).to_batches(max_chunksize=512)

    return asks.repartitionById(n, F.col("bucket")).mapInArrow(lean(each), ASKED)


def narrow(keys: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of the keys, for ``asked``."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :width]


def widened(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def repeated(width: int) -> Callable[[list[bytes]], list[bytes]]:
    """An answer to keys of so many bytes: one bit per key, set if another chunk asked about the same key."""

    def answer(blobs: list[bytes]) -> list[bytes]:
        sent = [widened(x, width) if width != 4 else np.frombuffer(x, np.uint32) for x in blobs]
        keys, counts = distinct(np.concatenate(sent))
        twice = keys[counts > 1]
        return [np.packbits(among(x, twice)).tobytes() for x in sent]

    return answer


def among(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which keys are among the ordered ones."""
    if len(ordered) == 0:
        return np.zeros(len(keys), bool)
    at = np.searchsorted(ordered, keys)
    at[at == len(ordered)] = 0
    return ordered[at] == keys


def bits(blobs: list[bytes], keys: np.ndarray, n: int) -> np.ndarray:
    """The bits that the buckets sent back, one for each of the keys that were asked about."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    _, sizes = np.unique(bucket_of(keys, n), return_counts=True)
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=c) for x, c in zip(blobs, sizes, strict=True)]).astype(bool)
