"""Sequences of fixed context sizes, packed hierarchically.

Each document's ids are cut at the longest context size; whole windows stand
alone, and the rest is routed to the tier of the smallest context size that
holds it. Tiers are packed from the longest: a window takes one piece of its
tier, then the longest shorter pieces that still fit, and last the head of one
more piece, cut so that the window is full. A window that can't be filled
gives its pieces back for the next block of documents; what is left at the end
of a partition is cut into windows of powers of two, so nothing is padded.

A partition packs its own rows, block by block, without a shuffle: memory is
bounded by a block (or by the longest single text), and a task that is run again
gives the same sequences, whose ids hold the partition's number. The pieces are
written; then the windows of one size are numbered through all partitions (by
the count of each partition and size, a small table) and dealt in that order to
step groups of equal token counts: only the last group of a size may be short.

Defined cases: a null or empty text has the end id alone; a null doc_id is kept;
repeated rows are packed each for itself; an empty table gives no piece; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .textblocks import blocks, file_encoder, small_batches, with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, nth long"


class Piece:
    """A run of one document's ids: start counts from the document's first id."""

    __slots__ = ("doc_id", "ids", "of", "start")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, of: int):
        self.doc_id, self.start, self.ids, self.of = doc_id, start, ids, of

    def __lt__(self, other: Piece) -> bool:
        return len(self.ids) < len(other.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.of), Piece(self.doc_id, self.start + n, self.ids[n:], self.of)


class Packer:
    def __init__(self, tiers: tuple[int, ...], partition: int):
        self.tiers = sorted(tiers, reverse=True)
        self.first = partition << 40
        self.made = 0
        self.per_window: dict[int, int] = {}
        self.waiting: list[Piece] = []
        self.rows: list[tuple] = []

    def emit(self, window: int, pieces: list[Piece]) -> None:
        nth = self.per_window.get(window, 0)
        self.per_window[window] = nth + 1
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.of, self.first + self.made, offset, window, nth))
            offset += len(p.ids)
        self.made += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        longest, n = self.tiers[0], len(ids)
        whole = n - n % longest
        for at in range(0, whole, longest):
            self.emit(longest, [Piece(doc_id, at, ids[at : at + longest], n)])
        if whole < n:
            self.waiting.append(Piece(doc_id, whole, ids[whole:].copy(), n))

    def pack(self) -> None:
        """Fill windows from the pieces that wait; those of windows left open go on waiting."""
        pool = sorted(self.waiting)  # ascending by length
        left: list[Piece] = []
        for window, shorter in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            while pool and len(pool[-1].ids) > shorter:
                pieces, gap = [pool.pop()], window
                gap -= len(pieces[0].ids)
                while gap and pool:
                    at = bisect_left(pool, gap, key=lambda p: len(p.ids))
                    if at < len(pool) and len(pool[at].ids) == gap:
                        piece = pool.pop(at)
                    elif at:
                        piece = pool.pop(at - 1)
                    else:
                        piece, rest = pool.pop(0).cut(gap)
                        insort(pool, rest)
                    pieces.append(piece)
                    gap -= len(piece.ids)
                if gap:
                    left += pieces
                else:
                    self.emit(window, pieces)
        self.waiting = left

    def finish(self) -> None:
        self.pack()
        total = sum(len(p.ids) for p in self.waiting)
        rest = self.waiting[::-1]
        for bit in reversed(range(total.bit_length())):
            window, pieces, gap = 1 << bit, [], 1 << bit
            if not total & window:
                continue
            while gap:
                piece = rest.pop()
                if len(piece.ids) > gap:
                    piece, tail = piece.cut(gap)
                    rest.append(tail)
                pieces.append(piece)
                gap -= len(piece.ids)
            self.emit(window, pieces)
        self.waiting = []

    def taken(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def grouped(pieces: DataFrame, group_tokens: int) -> DataFrame:
    """pieces with step_group in the place of nth, the number of a window among those of its size in its partition."""
    rows = pieces.withColumn("part", F.shiftright("sequence_id", 40))
    counts = rows.groupBy("part", "window").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("window").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = counts.select("part", "window", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.expr(f"(before + nth) * window div {group_tokens}")
    size = F.expr("shiftleft(cast(length(bin(window)) as long), 48)")
    return rows.join(counts, ["part", "window"]).withColumn("step_group", size + number).select(*[c for c in pieces.columns if c != "nth"], "step_group")


def packed(docs: DataFrame, tokenizer: str, end: int = 1, tiers: tuple[int, ...] = (2048, 1024, 512, 256), group_tokens: int = 1 << 16) -> DataFrame:
    """One row per piece; tokenizer is the path of a tokenizers file, tiers are powers of two."""
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(SCHEMA.split(", "), types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what an earlier task of this process held
        encode, _ = file_encoder(tokenizer, cached=200_000)
        packer = Packer(tiers, TaskContext.get().partitionId())
        for block in blocks(batches, "text", 6 << 20):
            ids, offsets = with_end(*encode(block.column("text")), end)
            bounds = offsets.tolist()
            for i, doc_id in enumerate(block.column("doc_id").to_pylist()):
                packer.add(doc_id, ids[bounds[i] : bounds[i + 1]])
            packer.pack()
            yield packer.taken(schema)
        packer.finish()
        yield packer.taken(schema)

    return grouped(written(small_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA), "pieces"), group_tokens)
