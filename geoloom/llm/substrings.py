"""Repeated passages, found by FM-indexes over shards of the corpus.

Every window of ``window`` words has an anchor: the smallest hash of its word
6-grams. Equal windows have equal anchors, so a window need only be compared
with those of its anchor's shard, and consecutive windows of one anchor travel
together as a segment. Only anchors that occur in two documents go on.

A shard holds the anchors of one hash value. For it the distinct segments are indexed
(suffixes sorted by the window's length, the Burrows-Wheeler transform in a
wavelet matrix), its documents' segments are streamed against the index by
backward search, which gives for each position whether the match reaches the
threshold, and the interval of suffixes that match. The smallest doc_id of an
interval is the first document of that window. Words covered by a window that
starts in a document of a smaller doc_id are removed.

What is shuffled: a number for each anchor and block of documents (a block
sends one row of an anchor, however many of its documents hold it), the texts
of documents with a candidate, compressed, and the distinct segments of each
block. A shard has about ``most_words`` words; runs of one anchor are split at
``most_windows`` windows. A shard of over four times as many, as an anchor in
very many different surroundings makes it, is cut once more by the hash of each
window, where equal windows still meet, and its parts go to tasks of their own.

Defined cases: null and empty texts have no word; rows of a null doc_id lose
nothing and remove nothing; rows that repeat a doc_id do not remove from one
another; a table of fewer words than a window loses nothing; an empty table
gives an empty result; further columns are kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fm_index import FMIndex
from .storage import written
from .textblocks import blocks, bytes_of, mixed, ragged, small_batches, span_hashes, window_hashes, words

GRAM = 6
RUN_WORDS = 18  # about: a run has five windows


def slot_of(anchor: np.ndarray) -> np.ndarray:
    """31 well-spread bits of an anchor."""
    return (mixed(anchor.view(np.uint64)) >> np.uint64(33)).astype(np.int64)


def digests(text: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of XXH3 for each text[a:b]."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(text[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Runs:
    """The runs of consecutive windows of one anchor in the texts of a block."""

    def __init__(self, texts: pa.Array, window: int, most_windows: int, marked: int = 0):
        self.data, offsets = bytes_of(texts)
        self.starts, self.ends, self.first_word = words(self.data, offsets)
        spelled = span_hashes(self.data, self.starts, self.ends)
        grams = window_hashes(spelled, GRAM)
        width, least = window - GRAM + 1, grams
        done = 1
        while done < width:  # the least of done grams, from those of half as many
            more = min(done, width - done)
            least = np.minimum(least[: len(least) - more], least[more:])
            done += more
        sizes = np.diff(self.first_word)
        windows = np.maximum(sizes - window + 1, 0)
        of = np.repeat(np.arange(len(sizes)), windows)
        at = ragged(self.first_word[:-1], windows)  # the first word of each window, within the block
        anchor = least[at] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(at)))
        parts = -(-lengths // most_windows)
        within = ragged(np.zeros(len(parts), np.int64), parts) * most_windows
        starts = np.repeat(starts, parts) + within
        self.windows = np.minimum(np.repeat(lengths, parts) - within, most_windows)
        self.anchor, self.of, self.at = anchor[starts].view(np.int64), of[starts], at[starts]
        if marked:
            # For one run in marked, by its words: its anchor's slot (31 bits) and 32 bits of a hash of its words; for the others 0.
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(spelled), dtype=np.uint64)])
                own = mixed(sums[np.minimum(self.at + self.windows + window - 1, len(spelled))] - sums[self.at])
            mark = (slot_of(self.anchor) << 32) | (own >> np.uint64(32)).astype(np.int64) | 1
            self.mark = np.where(own % np.uint64(marked) == 0, mark, 0)
        counts = np.bincount(self.of, minlength=len(sizes))
        self.first_run = np.concatenate([[0], np.cumsum(counts)])
        self.number = np.arange(len(starts)) - self.first_run[self.of]


def anchors(docs: DataFrame, window: int, most_windows: int, marked: int) -> DataFrame:
    """(route, doc_id, key, run, mark, known): the runs of all documents. known: the block itself has the anchor in two documents; one of its rows is routed by the anchor, the others anywhere."""
    schema = pa.schema([("route", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("run", pa.int32()), ("mark", pa.int64()), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            runs = Runs(block.column("text"), window, most_windows, marked)
            ids, keys = block.column("doc_id").to_numpy(), block.column("key").to_numpy()
            doc = ids[runs.of]
            order = np.lexsort((doc, runs.anchor))
            a, d = runs.anchor[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(a)))
            known = np.repeat(d[first] != d[first + sizes - 1], sizes)
            head = np.zeros(len(a), bool)
            head[first] = True
            spread = mixed(a.view(np.uint64) + np.arange(len(a), dtype=np.uint64)).view(np.int64)
            route = np.where(known & ~head, spread, a)
            of, number = runs.of[order], runs.number[order]
            back = np.argsort(order)  # rows of one document together: they compress better
            columns = [route[back], d[back], keys[of[back]], number[back].astype(np.int32), runs.mark[order][back], known[back]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "route long, doc_id long, key long, run int, mark long, known boolean")


def shared(runs: DataFrame) -> DataFrame:
    """(doc_id, key, run, mark) of the runs whose anchor occurs in two documents."""
    sorted_ = runs.repartition("route").sortWithinPartitions("route").select("route", "doc_id", "key", "run", "mark", "known")
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("run", pa.int32()), ("mark", pa.int64())])

    def told(held: list[list[np.ndarray]], cut: int | None) -> tuple[pa.RecordBatch, list[list[np.ndarray]], bool]:
        route, doc, key, number, mark, known = (np.concatenate(c) for c in zip(*held, strict=True))
        to = len(route) if cut is None else int(np.searchsorted(route, route[-1]))
        first = np.flatnonzero(np.concatenate([[True], route[1:to] != route[: to - 1]])) if to else np.zeros(0, np.int64)
        if to:
            sizes = np.diff(np.append(first, to))
            several = (np.minimum.reduceat(doc[:to], first) != np.maximum.reduceat(doc[:to], first)) | np.logical_or.reduceat(known[:to], first)
            keep = np.flatnonzero(np.repeat(several, sizes))
        else:
            keep = np.zeros(0, np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (doc, key, number, mark)], schema=schema)
        return out, [[c[to:] for c in (route, doc, key, number, mark, known)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("route", "doc_id", "key", "run", "mark", "known")]
            if not batch.num_rows:
                continue
            if held and held[0][0][0] == columns[0][-1]:
                # One anchor fills the batch: of what is held, rows that are known to be shared can go, but for one that tells so.
                held.append(columns)
                doc = np.concatenate([c[1] for c in held])
                if doc.min() != doc.max() or any(c[5].any() for c in held):
                    rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[i][:-1]) for i in (1, 2, 3, 4)], schema=schema)
                    held = [[c[-1:] for c in rows[:5]] + [np.ones(1, bool)]]
                continue
            held.append(columns)
            out, held = told(held, 1)
            yield out
        if held:
            yield told(held, None)[0]

    return sorted_.mapInArrow(run, "doc_id long, key long, run int, mark long")


def keyed(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """doc_id, text and 64 bits of the text's hash, which tells rows apart that repeat a doc_id; the columns of rest in one of this name."""
    more = [] if rest is None else [F.struct(F.lit(0).alias("_"), *[docs[c] for c in rest]).alias("rest")]
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"), *more)


def compressed(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """keyed() with the text compressed: less to shuffle."""
    rows = keyed(docs, rest)
    schema = StructType([f for f in rows.schema if f.name != "text"]).add("absent", "boolean").add("packed", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for block in blocks(batches, "text"):
            data, offsets = bytes_of(block.column("text"))
            data, at = data.tobytes(), offsets.tolist()
            packed = [pack(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
            names = [c for c in block.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(block.column, names), block.column("text").is_null(), pa.array(packed, pa.binary())], names=[*names, "absent", "packed"])

    return rows.mapInArrow(run, schema)


def unpacked(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches with a column text in the place of packed, in blocks of about most packed bytes."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        at = 0
        sizes = np.cumsum([len(x) for x in batch.column("packed").to_pylist()])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            some = batch.slice(at, to - at)
            texts = pa.array([unpack(x) for x in some.column("packed").to_pylist()], pa.large_binary())
            names = [c for c in some.schema.names if c != "packed"]
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in names], texts], names=[*names, "text"])
            at = to


def segments(texts: DataFrame, wanted: DataFrame, shards: int, window: int, most_windows: int) -> DataFrame:
    """The segments of the wanted runs. Rows of a shard have a block's segments for it: compressed, each once, with the smallest doc_id that has it in the block. Rows without one have each place, with the segment's hashes alone."""
    names = ["shard", "packed", "h1", "h2", "doc_id", "key", "at"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for block in unpacked((b.filter(b.column("runs").is_valid()) for b in batches), 2 << 20):
            runs = Runs(block.column("text"), window, most_windows)
            lists = block.column("runs")
            chosen = lists.flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = runs.first_run[of] + chosen
            fits = at < runs.first_run[of + 1]
            at = np.unique(at[fits])
            of = runs.of[at]
            ids, keys = block.column("doc_id").to_numpy(), block.column("key").to_numpy()
            # The words of the segment, each with one space behind it.
            sizes = runs.ends - runs.starts + 1
            text = np.append(runs.data, np.uint8(32))[ragged(runs.starts, sizes)]
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            text[bounds[1:] - 1] = 32
            a, b = bounds[runs.at[at]], bounds[runs.at[at] + runs.windows[at] + window - 1]
            h1, h2 = digests(text.tobytes(), a, b)
            doc, shard = ids[of], shard_of(slot_of(runs.anchor[at]), shards)
            order = np.lexsort((doc, h2, h1, shard))
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (shard, h1, h2)])
            one = order[new]
            first = np.flatnonzero(np.diff(shard[one], prepend=-1))
            packed = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(one)], strict=True):
                own = one[i:j]
                packed.append(packed_of(doc[own], text, a[own], b[own], pack))
            columns = [shard[one][first], packed, None, None, None, None, None]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(first), t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            columns = [None, None, h1, h2, doc, keys[of], (runs.at[at] - runs.first_word[of]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    # A left join, and no filter: so that Spark shuffles the texts once for this join and that of kept_words().
    joined = with_texts(texts, wanted, "runs")
    return joined.mapInArrow(run, "shard long, packed binary, h1 long, h2 long, doc_id long, key long, at int")


def shard_of(slot, shards: int):
    return slot * shards >> 31


def with_texts(texts: DataFrame, more: DataFrame, *columns: str) -> DataFrame:
    """compressed() texts with columns of another table, null where it has no row for the text."""
    more = more.select(F.col("doc_id").alias("doc_"), F.col("key").alias("key_"), *columns)
    return texts.join(more, (F.col("doc_id") == F.col("doc_")) & (F.col("key") == F.col("key_")), "left").drop("doc_", "key_")


class Held:
    """The segments of packed rows: owner, digest and bytes of each, and a sort that brings equal ones together, the smallest owner first."""

    def __init__(self, packed: list[bytes]):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        docs, lengths, texts = [], [], []
        for raw in map(unpack, packed):
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            docs.append(np.frombuffer(raw, "<i8", n, 8))
            lengths.append(np.frombuffer(raw, "<i4", n, 8 + 8 * n))
            texts.append(np.frombuffer(raw, np.uint8, -1, 8 + 12 * n))
        self.doc, self.length, self.data = map(np.concatenate, (docs, lengths, texts))
        self.bounds = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        self.h1, self.h2 = digests(self.data.tobytes(), self.bounds[:-1], self.bounds[1:])

    def distinct(self) -> np.ndarray:
        order = np.lexsort((self.doc, self.h2, self.h1))
        new = np.ones(len(order), bool)
        new[1:] = (self.h1[order][1:] != self.h1[order][:-1]) | (self.h2[order][1:] != self.h2[order][:-1])
        return order[new]


def packed_of(doc: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray, pack) -> bytes:
    """The spans data[a:b] and their documents, compressed, as Held reads them."""
    head = np.array([len(doc)], "<i8").tobytes() + doc.astype("<i8").tobytes() + (b - a).astype("<i4").tobytes()
    return pack(head + data[ragged(a, b - a)].tobytes())


def firsts_of(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments: the number of windows of each, and the smallest document of each window, by an FM-index of them all that they are streamed against."""
    ends = np.append(0, np.flatnonzero(data == 32) + 1)  # words, each with its space
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    coded = spelled.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) + 1
    first = np.searchsorted(ends, bounds)
    sizes = np.diff(first)
    text = np.insert(number, first[1:], 0)
    starts = first[:-1] + np.arange(len(doc))
    fm = FMIndex(text, len(coded.dictionary) + 1, window, np.repeat(doc, sizes + 1))
    windows = sizes - window + 1
    return windows, fm.owners(fm.matching(text, starts, sizes)[ragged(starts, windows)])


def by_group(rows: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """make(first row's group, packed values) for the packed values of each group of rows; rows: columns, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for batch in batches:
            groups = zip(*[batch.column(c).to_pylist() for c in columns], strict=True)
            for group, packed in zip(groups, batch.column("packed").to_pylist(), strict=True):
                if held and group != last:
                    yield make(held)
                    held = []
                last = group
                held.append(packed)
        if held:
            yield make(held)

    return rows.repartition(*columns).sortWithinPartitions(*columns).select(*columns, "packed").mapInArrow(run, schema)


def searched(segments_: DataFrame, large: DataFrame, window: int) -> DataFrame:
    """(h1, h2, firsts): for each distinct segment the smallest doc_id of each of its windows. large: the shards to be searched in parts."""
    rows = segments_.filter("packed is not null").select("shard", "packed")

    def index(packed: list[bytes]) -> pa.RecordBatch:
        held = Held(packed)
        one = held.distinct()
        length = held.length[one]
        data = held.data[ragged(held.bounds[:-1][one], length)]
        windows, firsts = firsts_of(data, np.concatenate([[0], np.cumsum(length, dtype=np.int64)]), held.doc[one], window)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows)]), pa.int32()), pa.array(firsts))
        return pa.RecordBatch.from_arrays([pa.array(held.h1[one]), pa.array(held.h2[one]), lists], names=["h1", "h2", "firsts"])

    kind = "h1 long, h2 long, firsts array<long>"
    if large.isEmpty():
        return by_group(rows, ["shard"], index, kind)
    whole = by_group(rows.join(large, "shard", "left_anti"), ["shard"], index, kind)
    return whole.unionByName(searched_in_parts(rows.join(large, "shard"), window))


def searched_in_parts(rows: DataFrame, window: int) -> DataFrame:
    """searched() for shards cut by the hash of each window, so that one anchor's windows are dealt to several tasks. rows: shard, packed, parts."""
    names = ["shard", "part", "packed", "h1", "h2", "nth", "w1", "w2"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for shard, packed, parts in zip(*[batch.column(c).to_pylist() for c in ("shard", "packed", "parts")], strict=True):
                held = Held([packed])
                ends = np.append(0, np.flatnonzero(held.data == 32) + 1)
                first = np.searchsorted(ends, held.bounds)
                windows = np.diff(first) - window + 1
                of = np.repeat(np.arange(len(windows)), windows)
                nth = ragged(np.zeros(len(windows), np.int64), windows)
                at = first[of] + nth
                a, b = ends[at], ends[at + window]
                w1, w2 = digests(held.data.tobytes(), a, b)
                part = (mixed(w1.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((held.doc[of], w2, w1, part))
                new = np.ones(len(order), bool)
                new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (part, w1, w2)])
                one = order[new]
                begins = np.flatnonzero(np.diff(part[one], prepend=-1))
                own = [packed_of(held.doc[of[one[i:j]]], held.data, a[one[i:j]], b[one[i:j]], pack) for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(one)], strict=True)]
                for n, columns in ((len(own), [np.full(len(own), shard), part[one][begins], own, None, None, None, None, None]), (len(of), [None, None, None, held.h1[of], held.h2[of], nth, w1, w2])):
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def index(packed: list[bytes]) -> pa.RecordBatch:
        held = Held(packed)
        one = held.distinct()
        data = held.data[ragged(held.bounds[:-1][one], held.length[one])]
        _, firsts = firsts_of(data, np.concatenate([[0], np.cumsum(held.length[one], dtype=np.int64)]), held.doc[one], window)
        return pa.RecordBatch.from_arrays([pa.array(held.h1[one]), pa.array(held.h2[one]), pa.array(firsts)], names=["w1", "w2", "first"])

    found = rows.mapInArrow(cut, "shard long, part long, packed binary, h1 long, h2 long, nth int, w1 long, w2 long")
    firsts = by_group(found.filter("packed is not null").select("shard", "part", "packed"), ["shard", "part"], index, "w1 long, w2 long, first long")
    # A window may stand in shards of several anchors' segments only with one anchor, so in one shard; a segment has most_windows of them at most.
    places = found.filter("packed is null").select("h1", "h2", "nth", "w1", "w2").distinct().join(firsts, ["w1", "w2"])
    listed = places.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("nth", "first"))).alias("l"))
    return listed.select("h1", "h2", F.transform("l", lambda x: x["first"]).alias("firsts"))


def large_shards(wanted: DataFrame, shards: int, most_words: int, marked: int) -> DataFrame:
    """(shard, parts) of the shards whose distinct runs have over four times most_words words, as one run in marked tells."""
    marks = wanted.select(F.explode("marks").alias("mark")).distinct()
    counts = marks.groupBy(F.expr(f"shiftright(shiftright(mark, 32) * {shards}L, 31)").alias("shard")).agg(F.count("*").alias("n"))
    parts = F.expr(f"cast(ceil(n * {marked * RUN_WORDS} / {most_words}) as long)")
    return written(counts.filter(F.col("n") * marked * RUN_WORDS > 4 * most_words).select("shard", parts.alias("parts")), "large-shards")


def removed_spans(docs: DataFrame, window: int = 13, most_windows: int = 32, most_words: int = 500_000, marked: int = 16, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, spans): the windows to remove, as (at, hit) for those from the word at; only documents that lose words. texts: compressed() docs."""
    texts = compressed(docs) if texts is None else texts
    known = keyed(docs).filter("doc_id is not null")
    runs = shared(anchors(known, window, most_windows, marked))
    listed = F.collect_list(F.struct("run", "mark"))  # as many as a document has
    wanted = written(runs.groupBy("doc_id", "key").agg(listed.alias("l")).select("doc_id", "key", F.transform("l", lambda x: x["run"]).alias("runs"), F.filter(F.transform("l", lambda x: x["mark"]), lambda x: x != 0).alias("marks")), "shared-runs")
    words_ = RUN_WORDS * (wanted.agg(F.sum(F.size("runs"))).first()[0] or 0)
    shards = max(1, -(-words_ // most_words))
    found = segments(texts, wanted.select("doc_id", "key", "runs"), shards, window, most_windows)
    places = found.filter("packed is null").select("h1", "h2", "doc_id", "key", "at")
    hits = places.join(searched(found, large_shards(wanted, shards, most_words, marked), window), ["h1", "h2"])
    hits = hits.select("doc_id", "key", "at", F.transform("firsts", lambda d: d < F.col("doc_id")).alias("hit")).filter(F.exists("hit", lambda x: x))
    return hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "hit")).alias("spans"))


def kept_words(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of all compressed() texts; or, if they have the column rest, doc_id, rest and the kept text."""
    rows = with_texts(texts, spans, "spans")
    digest = "rest" not in texts.columns
    others = [c for c in rows.columns if c != "spans"]
    rows = rows.select(*others, F.transform("spans", lambda x: x["at"]).alias("ats"), F.transform("spans", lambda x: F.array_join(F.transform(x["hit"], lambda h: h.cast("int").cast("string")), "")).alias("hits"))
    schema = StructType().add("doc_id", "long")
    if digest:
        schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    else:
        schema = schema.add(rows.schema["rest"]).add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches):
            data, offsets = bytes_of(block.column("text"))
            raw, bounds = data.tobytes(), offsets.tolist()
            counts, removed, sums, kept = [], [], [], []
            ats, hits, absent = (block.column(c).to_pylist() for c in ("ats", "hits", "absent"))
            for i in range(len(bounds) - 1):
                text = raw[bounds[i] : bounds[i + 1]]
                own = text.split()
                counts.append(len(own))
                if ats[i]:
                    change = np.zeros(len(own) + 1, np.int64)
                    for at, hit in zip(ats[i], hits[i], strict=True):
                        start = at + np.flatnonzero(np.frombuffer(hit.encode(), np.uint8) == ord("1"))
                        np.add.at(change, start, 1)
                        np.add.at(change, start + window, -1)
                    own = [own[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                removed.append(counts[-1] - len(own))
                if digest:
                    sums.append(hashlib.sha256(b" ".join(own)).hexdigest())
                else:
                    kept.append(None if absent[i] else (b" ".join(own) if ats[i] else text).decode())
            if digest:
                columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
            else:
                columns = [block.column("rest"), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeats(docs: DataFrame, window: int = 13, **how) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    texts = compressed(docs)
    return kept_words(texts, removed_spans(docs, window, texts=texts, **how), window)


def without_repeats(docs: DataFrame, window: int = 13, **how) -> DataFrame:
    """docs with the removed words cut out of the text (words then joined by one space; a text that loses nothing stays as it is) and n_chars, if there, counted anew."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    texts = compressed(docs, rest)
    out = kept_words(texts, removed_spans(docs, window, texts=texts, **how), window)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | ({"n_chars": F.char_length("kept")} if "n_chars" in rest else {})
    return out.select(*[made.get(c, F.col("rest").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
