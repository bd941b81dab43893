"""Token-ID output: bit-plane shuffled, zstandard-compressed shards with a chunk index.

A shard is one file: the magic, the compressed planes of its chunks, an index and a
footer.  A chunk is a fixed number of ids, transposed into bit planes (or byte planes);
each plane is compressed by itself, so planes that are nearly constant (the high bits)
shrink to almost nothing, and a plane of zeros is not stored at all.  The index lists
where every chunk's planes lie and where every document starts, so a reader can fetch
any range of ids by touching only the chunks that hold it.

``write_tokens`` range-partitions documents by id, tokenizes and encodes them in that
order and writes one shard per partition, of about ``SHARD_BYTES`` of the input.  Every attempt
of a task writes a file of its own, and only the file of the attempt that Spark accepted
is named in what ``write_tokens`` returns; what a lost attempt left is never read.  Memory
is bounded by one chunk, one document and the shard's index.  Null and empty texts are documents
of the end id alone; rows that repeat a doc_id stay separate documents next to each other,
ordered by content, and may fill several shards unless their texts are equal too.  Rows
without a doc_id come first, by content.  Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes
from .tokens import encoder

MAGIC = b"TGPLANE1"
CHUNK_IDS = 1 << 16
END_ID = 0
LEVEL = 3
#: Bytes of the input, as the optimizer knows its files, for each shard.
SHARD_BYTES = 16 << 20


def to_planes(ids: np.ndarray, unit: str = "bit") -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first, without the empty ones on top."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if unit == "byte":
        parts = ids.view(np.uint8).reshape(-1, 4)
        width = 4 if not len(ids) else max(1, -(-int(ids.max()).bit_length() // 8))
        return [parts[:, b].tobytes() for b in range(width)]
    width = int(ids.max()).bit_length() if len(ids) else 0
    parts = ids.view(np.uint8).reshape(-1, 4)
    planes = []
    for b in range(width):
        column = np.ascontiguousarray(parts[:, b // 8])
        planes.append(np.packbits((column >> (b % 8)) & 1).tobytes())
    return planes


def from_planes(planes: list[bytes], count: int, unit: str = "bit") -> np.ndarray:
    """The ids back from their planes."""
    parts = np.zeros((count, 4), dtype=np.uint8)
    for b, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if unit == "byte":
            parts[:, b] = raw
        else:
            parts[:, b // 8] |= np.unpackbits(raw, count=count) << (b % 8)
    return parts.reshape(-1).view("<u4")


class ShardWriter:
    """Appends documents to one shard."""

    def __init__(self, sink, unit: str = "bit", chunk_ids: int = CHUNK_IDS) -> None:
        self._sink, self._unit, self._chunk_ids = sink, unit, chunk_ids
        self._compress = zstandard.ZstdCompressor(level=LEVEL)
        self._waiting: list[bytes] = []
        self._held = 0
        self._at = sink.write(MAGIC)
        self._chunks: list[list] = []
        self._docs: list[tuple[int | None, int]] = []
        self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id, self.total))
        self._waiting.append(ids)
        self._held += len(ids) // 4
        self.total += len(ids) // 4
        if self._held >= self._chunk_ids:
            self._drain(False)

    def _drain(self, last: bool) -> None:
        held = np.frombuffer(b"".join(self._waiting), dtype="<u4")
        whole = len(held) if last else len(held) // self._chunk_ids * self._chunk_ids
        for at in range(0, whole, self._chunk_ids):
            block = held[at : min(at + self._chunk_ids, whole)]
            sizes = []
            for plane in to_planes(block, self._unit):
                packed = self._compress.compress(plane)
                self._sink.write(packed)
                sizes.append(len(packed))
            self._chunks.append([self._at, len(block), sizes])
            self._at += sum(sizes)
        self._waiting, self._held = [held[whole:].tobytes()], len(held) - whole

    def close(self) -> None:
        if self._held:
            self._drain(True)
        ids = [d for d, _ in self._docs]
        index = {
            "unit": self._unit, "total": self.total, "chunks": self._chunks,
            "docs": ids, "starts": [s for _, s in self._docs],
        }
        packed = self._compress.compress(json.dumps(index, separators=(",", ":")).encode())
        self._sink.write(packed)
        self._sink.write(len(packed).to_bytes(8, "little") + MAGIC)


@dataclass(frozen=True)
class Shard:
    """An open shard; reads touch only the chunks that are asked for."""

    source: pa.NativeFile
    unit: str
    total: int
    chunks: list
    docs: list
    starts: list

    @classmethod
    def open(cls, source: pa.NativeFile) -> Shard:
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard, or one cut short")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        index = json.loads(zstandard.ZstdDecompressor().decompress(source.read(length)))
        return cls(source, index["unit"], index["total"], index["chunks"], index["docs"], index["starts"])

    def chunk(self, number: int) -> np.ndarray:
        at, count, sizes = self.chunks[number]
        self.source.seek(at)
        packed, planes, begin = self.source.read(sum(sizes)), [], 0
        unpack = zstandard.ZstdDecompressor()
        for size in sizes:
            planes.append(unpack.decompress(packed[begin : begin + size]))
            begin += size
        return from_planes(planes, count, self.unit)

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start, ids) of every document in order, holding one chunk besides the document."""
        ends = [*self.starts[1:], self.total]
        held, base, number = np.empty(0, dtype="<u4"), 0, 0
        for doc_id, start, end in zip(self.docs, self.starts, ends, strict=True):
            parts, at = [], start
            while at < end:
                if at >= base + len(held):
                    base += len(held)
                    held = self.chunk(number)
                    number += 1
                    continue
                stop = min(end, base + len(held))
                parts.append(held[at - base : stop - base].tobytes())
                at = stop
            yield doc_id, start, b"".join(parts)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(
    df: DataFrame, folder: str, vocabulary: str, keeps_space: bool, id_col: str = "doc_id", text_col: str = "text",
    unit: str = "bit", shards: int | None = None,
) -> DataFrame:
    """Write every document into ``folder`` and return (shard, total, path), one row per shard in order.

    ``folder`` is a uri that the driver and all executors share.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not shards:
        shards = max(spark.sparkContext.defaultParallelism, -(-input_bytes(df, text_col) // SHARD_BYTES))
    place = ["doc_id", F.xxhash64("text")]
    ordered = narrow.repartitionByRange(shards, *place).sortWithinPartitions(*place)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        disk, root = _filesystem(folder)
        disk.create_dir(root, recursive=True)
        path = f"{root}/shard-{number:06d}-{uuid.uuid4().hex}.tgp"
        encode, end = encoder(vocabulary, keeps_space), np.array([END_ID], dtype="<u4").tobytes()
        sink = disk.open_output_stream(path)
        writer = ShardWriter(sink, unit)
        for block in (b for batch in batches for b in encode.encode_rows(batch)):
            for doc_id, ids in block:
                writer.add(doc_id, ids + end)
        writer.close()
        sink.close()
        yield pa.RecordBatch.from_pydict({"shard": [number], "total": [writer.total], "path": [path]})

    return ordered.mapInArrow(write, "shard bigint, total bigint, path string")


def read_tokens(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """(doc_id, start, tokens) of every document, from the files; tokens are little-endian ids.

    ``written`` is what ``write_tokens`` returned.  One short row per shard is read on
    the driver to number the ids over all shards.
    """
    rows = sorted(written.collect(), key=lambda r: r["shard"])
    before, placed = 0, []
    for row in rows:
        placed.append((row["path"], before))
        before += row["total"]
    files = spark.createDataFrame(placed, "path string, base bigint").repartition(max(1, len(placed)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = _filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with disk.open_input_file(path) as source:
                    held: list[tuple[int | None, int, bytes]] = []
                    size = 0
                    for doc_id, start, ids in Shard.open(source).documents():
                        held.append((doc_id, base + start, ids))
                        size += len(ids)
                        if size >= 4 << 20:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    return files.mapInArrow(read, "doc_id bigint, start bigint, tokens binary")


def _rows(held: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    ids, starts, tokens = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.binary())],
        names=["doc_id", "start", "tokens"],
    )
