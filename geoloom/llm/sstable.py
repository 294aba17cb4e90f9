"""Token ids in sorted-string-table shards.

A shard file holds documents by ascending key (the doc_id as 8 bytes, ordered)
in blocks of about ``block_bytes``. Within a block each entry stores how many
bytes of its key it shares with the one before, the rest of the key, and the
ids; blocks are compressed. A sparse index holds each block's last key, place
and number of ids, a Bloom filter tells most absent keys, and a footer of fixed
size at the end of the file says where both lie. A lookup reads the footer,
asks the filter, searches the index by halving, and reads one block.

Documents are dealt to shards by ranges of doc_id; each task writes one file in
the shared folder under a name of its own and then renames it, so a task that
is run again replaces its file by an equal one.

Defined cases: a null or empty text has the end id alone; a null doc_id has the
empty key, which sorts first; documents that repeat a doc_id follow one another
in the order of their texts; an empty table makes no shard and gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import new_folder, written
from .textblocks import blocks, file_encoder, small_batches, with_end

MAGIC = b"TOKSST01"
FOOTER = "<QQQQQQB7x8s"  # index at, index size, filter at, filter size, documents, ids, bytes an id, magic
ENTRY = "<BBI"  # shared key bytes, further key bytes, value bytes
PLACE = "<BQIQQ"  # key bytes, block at, block size, documents before, ids before


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def probes(key: bytes, bits: int, times: int = 7) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(times)]


class ShardWriter:
    def __init__(self, out, id_bytes: int, block_bytes: int = 1 << 18):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.out, self.id_bytes, self.block_bytes = out, id_bytes, block_bytes
        self.at = self.docs = self.ids = 0
        self.keys: list[bytes] = []
        self.first: int | None = None
        self.places: list[bytes] = []
        self.new_block()

    def new_block(self) -> None:
        self.block, self.size, self.last, self.before = [], 0, b"", (self.docs, self.ids)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        shared = next((i for i, (a, b) in enumerate(zip(self.last, key, strict=False)) if a != b), min(len(self.last), len(key))) if self.block else 0
        self.block.append(struct.pack(ENTRY, shared, len(key) - shared, len(value)) + key[shared:] + value)
        self.last, self.size = key, self.size + len(self.block[-1])
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        self.keys.append(key)
        if self.first is None:
            self.first = id_of(key)
        if self.size >= self.block_bytes:
            self.end_block()

    def end_block(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.places.append(struct.pack(PLACE, len(self.last), self.at, len(data), *self.before) + self.last)
            self.at += len(data)
        self.new_block()

    def close(self) -> None:
        self.end_block()
        index = b"".join(self.places)
        bits = max(64, 10 * len(self.keys))
        marks = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in probes(key, bits):
                marks[p >> 3] |= 1 << (p & 7)
        marks = struct.pack("<Q", bits) + marks.tobytes()
        self.out.write(index + marks)
        self.out.write(struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(marks), self.docs, self.ids, self.id_bytes, MAGIC))


class Shard:
    """A shard file, open for lookups and scans."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        at, length, self.filter_at, self.filter_size, self.docs, self.ids, self.id_bytes, magic = struct.unpack(FOOTER, self.read(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("this is no shard")
        self.marks: bytes | None = None  # the filter, read at the first lookup
        self.keys, self.places, index, i = [], [], self.read(at, length), 0
        while i < length:
            n, *place = struct.unpack_from(PLACE, index, i)
            i += struct.calcsize(PLACE) + n
            self.keys.append(index[i - n : i])
            self.places.append(place)

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, size, *_ = self.places[block]
        data = self.read(at, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        data, key, i = self.unpack(data[:-4]), b"", 0
        while i < len(data):
            shared, more, n = struct.unpack_from(ENTRY, data, i)
            i += struct.calcsize(ENTRY)
            key = key[:shared] + data[i : i + more]
            i += more
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", n // self.id_bytes, i)
            i += n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.places)):
            yield from self.entries(block)

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of the first document of this key."""
        if self.marks is None:
            self.marks = self.read(self.filter_at, self.filter_size)
        marks = self.marks
        bits = struct.unpack_from("<Q", marks)[0]
        if not all(marks[8 + (p >> 3)] >> (p & 7) & 1 for p in probes(key, bits)):
            return None
        block = bisect_left(self.keys, key)
        return next((ids for k, ids in self.entries(block) if k == key), None) if block < len(self.keys) else None


def opened(path: str):
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def write_shards(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write the shards; one row for each: shard, path, first doc_id that is not null, docs, ids. The shards' order is that of doc_id."""
    folder = new_folder(docs.sparkSession, "shards")
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        number = TaskContext.get().partitionId()
        store, top = fs.FileSystem.from_uri(folder)
        encode = writer = name = None
        try:
            for block in blocks(batches, "text", 12 << 20):
                if writer is None:
                    encode, size = file_encoder(tokenizer)
                    store.create_dir(top, recursive=True)
                    name = f"{top}/.{uuid.uuid4().hex}"
                    writer = ShardWriter(store.open_output_stream(name), 2 if max(size, end + 1) <= 1 << 16 else 4)
                ids, offsets = with_end(*encode(block.column("text")), end)
                bounds = offsets.tolist()
                for i, doc_id in enumerate(block.column("doc_id").to_pylist()):
                    writer.add(key_of(doc_id), ids[bounds[i] : bounds[i + 1]])
            if writer:
                writer.close()
                writer.out.close()
                store.move(name, f"{top}/{number:08d}.sst")
        except BaseException:
            if writer:  # a failed attempt leaves no file
                writer.out.close()
                store.delete_file(name)
            raise
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, f"{folder}/{number:08d}.sst", writer.first, writer.docs, writer.ids)], schema=schema)

    ordered = small_batches(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "shard long, path string, first long, docs long, ids long"), "shard-list")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, read back from the files, one shard a task at most."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    listed = shards.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = []
                with opened(path) as file:
                    for key, ids in Shard(file).scan():
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    n = max(1, shards.count())
    return listed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def looked_up(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (null if absent) for each row of wanted; a shard is opened for its own keys only."""
    firsts = [(r["shard"], r["first"]) for r in shards.select("shard", "first").orderBy("shard").collect()]  # a row for each shard
    bounds = F.array(*[F.lit(first).cast("long") for _, first in firsts if first is not None])
    place = F.greatest(F.lit(0), F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))) - 1)
    numbers = F.array(*[F.lit(n).cast("long") for n, first in firsts if first is not None])
    asked = wanted.select("doc_id", F.get(numbers, place).alias("shard")).join(F.broadcast(shards.select("shard", "path")), "shard", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file = shard = None
        for batch in batches:
            keys, found = batch.column("doc_id").to_pylist(), []
            for key, path in zip(keys, batch.column("path").to_pylist(), strict=True):
                if path != name:
                    if file:
                        file.close()
                    file = opened(path) if path else None
                    name, shard = path, Shard(file) if file else None
                ids = shard.get(key_of(key)) if shard else None
                found.append(None if ids is None else ids.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return asked.repartition("shard").sortWithinPartitions("shard", "doc_id").select("doc_id", "path").mapInArrow(run, "doc_id long, ids array<int>")
