"""Near duplicates by bottom-k sketches of word shingles, confirmed on full sets.

A document's set holds the hashes of its distinct shingles of five words; its
sketch is the ``SKETCH`` = 64 smallest of them, by one hash function. Equal sets
are one entry from there on.

* Inverted lists: of two sets with a Jaccard similarity of 0.85, each of the 64
  smallest hashes of their union is in both with a chance of 0.85, and then in
  both sketches; so the sketches share at least ``least_shared()`` hashes but
  for one pair in 10**9 (sets of up to 54 shingles are wholly in the sketch, and
  there the bound is exact). Hashes are put in one order for all sets, the
  rarest first, and a set is entered in the lists of as many of its first as the
  bound lets it miss, plus one. Hashes that one set alone has come first: a
  document without near copies is in no list, and a passage that many documents
  share makes no list of those that share nothing else.
* Overlaps: in a list, pairs of like size whose sketches share enough are
  estimated by the sketch of their union: how many of its 64 hashes both have.
  Of a list only a spanning forest of what passes is sent on, and pairs that are
  connected already are not looked at again. A long list is cut by size, as sets
  that differ more than 0.85 in size are never near, then in blocks, each pair
  of blocks a list of its own.
* Confirmation: the estimate's components are small groups around true ones.
  Their texts are read again, and within a group the full sets are compared
  until what is connected is known: 100 * intersection >= 85 * union. Groups of
  over ``most_values`` hashes are cut in blocks like lists.

Defined cases: null texts and texts without a word have an empty set, are linked
with nothing and kept; a text of one to four words is one shingle; rows of a
null doc_id have the component of their set if a row with an id is in it, else
none, and then are kept; rows that repeat a doc_id are each an entry by their
text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import settle, text_hash
from .storage import written
from .textblocks import blocks, bytes_of, small_batches, span_hashes, window_hashes, words

SKETCH, WORDS_EACH, PERCENT = 64, 5, 85
NONE = np.iinfo(np.int32).max  # fills up short sketches
SIGNATURE = 512


@cache
def least_shared(k: int = SKETCH, percent: int = PERCENT, loss: float = 1e-9) -> int:
    """The most hits that k draws, each a hit with a chance of percent, have but for a chance of loss."""
    p, total = percent / 100, 0.0
    for hits in range(k + 1):
        total += math.comb(k, hits) * p**hits * (1 - p) ** (k - hits)
        if total > loss:
            return hits
    return k


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS_EACH) -> list[np.ndarray]:
    """For each text the sorted hashes (63 bits) of its distinct shingles; A-Z lower-cased."""
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    windows = window_hashes(hashes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = windows[a : b - k + 1] if b - a >= k else window_hashes(hashes[a:b], b - a) if b > a else windows[:0]
        out.append(np.unique(own >> np.uint64(1)).astype(np.int64))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (128 bits of XXH3 over the set) and posts (the sketch) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for block in blocks(batches, "text"):
            sets = shingle_sets(*bytes_of(block.column("text")))
            names = ["doc_id", "text_hash", "n_shingles", "set_id", "posts"]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            posts = [s[:SKETCH] for s in sets]
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in posts])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(posts) if posts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), listed], names=names)

    rows = small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), docs["text"])
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id binary, posts array<long>")


def entries(sets: DataFrame) -> DataFrame:
    """(key, id, n, sketch): the inverted lists that hold more than one set. sets: id, n, posts."""
    each = sets.select("id", F.explode("posts").alias("v"))
    shared = written(each.groupBy("v").agg(F.count("*").alias("sets")).filter("sets > 1"), "shared-hashes")
    held = each.join(shared, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("sets", "v"))).alias("held"))  # at most a sketch's hashes
    size = F.size("posts")
    # A set of up to 54 is whole in its sketch, and so are those near it.
    may_miss = F.when(F.col("n") * 100 <= SKETCH * PERCENT, F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).otherwise(size - F.least(size, F.lit(least_shared())))
    alone = size - F.size("held")  # hashes that no other set has are the rarest
    rows = sets.join(held, "id").withColumn("held", F.slice("held", F.lit(1), F.greatest(F.lit(0).cast("long"), may_miss + 1 - alone).cast("int")))
    sketch = F.transform("posts", lambda x: F.shiftright(x, 32).cast("int")).alias("sketch")
    return rows.select("id", "n", sketch, F.explode("held").alias("h")).select("id", "n", "sketch", F.col("h.v").alias("key"), F.col("h.sets").alias("sets"))


def dealt(rows: DataFrame, most: int, total: str, own: F.Column) -> DataFrame:
    """rows with the column part: those with a total over most are cut in blocks, and each pair of blocks is a part."""
    n = F.expr(f"cast(ceil({total} / {most / 2}) as long)")
    block = F.pmod(own, n)
    others = F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: j != block)
    pair = F.transform(others, lambda j: F.least(block, j) * n + F.greatest(block, j))
    return rows.withColumn("part", F.explode(F.when(F.col(total) <= most, F.array(F.lit(-1).cast("long"))).otherwise(pair)))


def by_size(rows: DataFrame, most: int) -> DataFrame:
    """Long lists cut by the logarithm of the sets' sizes: a set is in the list of its own size class and in the next, so that sets of like size meet."""
    class_ = F.floor(F.log(F.col("n").cast("double")) / -math.log(PERCENT / 100) + 1e-9)
    classes = F.when(F.col("sets") > most, F.array(class_, class_ + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    return rows.withColumn("class", F.explode(classes))


def signatures(sketch: np.ndarray) -> np.ndarray:
    """512 bits for each sketch, in which what two share can be counted from above."""
    bits = np.zeros((len(sketch), SIGNATURE // 8), np.uint8)
    row, column = np.nonzero(sketch != NONE)
    place = (sketch[row, column].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64)
    np.bitwise_or.at(bits, (row, place >> 3), (1 << (place & 7)).astype(np.uint8))
    return bits.view(np.uint64)


class Sketches:
    """The sketches of the rows of one task's lists."""

    def __init__(self, n: np.ndarray, sketch: np.ndarray):
        self.n, self.sketch, self.signature = n, sketch, signatures(sketch)
        # Bits of a signature that several hashes share count once.
        held = np.bitwise_count(self.signature).sum(1).astype(np.int64)
        self.hidden = (sketch != NONE).sum(1) - held

    def near(self, p: np.ndarray, q: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
        """Whether the pairs may have the similarity, by the sketch of the union."""
        least = np.minimum(least_shared(), (np.minimum(np.minimum(self.n[p], self.n[q]), SKETCH) * PERCENT + 99) // 100)
        shared = np.bitwise_count(self.signature[p] & self.signature[q]).sum(1) + np.minimum(self.hidden[p], self.hidden[q])
        out = shared >= least - 1
        at = np.flatnonzero(out)
        for i in range(0, len(at), at_once):
            some = at[i : i + at_once]
            out[some] = self.estimated(p[some], q[some])
        return out

    def estimated(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        both = np.sort(np.concatenate([self.sketch[p], self.sketch[q]], axis=1), axis=1)
        real = both != NONE
        twice = np.zeros(both.shape, bool)
        twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
        rank = np.cumsum(~twice & real, axis=1)
        hits, size = (twice & (rank <= SKETCH)).sum(1), np.minimum(rank[:, -1], SKETCH)
        whole = (self.n[p] <= SKETCH) & (self.n[q] <= SKETCH)
        all_ = twice.sum(1)
        # One more for two hashes of a set that agree in the bits that are kept.
        exact = 100 * (all_ + 1) >= PERCENT * (self.n[p] + self.n[q] - all_ - 1)
        return np.where(whole, exact, hits + 1 >= np.minimum(least_shared(), (size * PERCENT + 99) // 100))


def connected(keys: np.ndarray, n: np.ndarray, near, short: int = 64) -> np.ndarray:
    """For rows sorted by key and size: the smallest index of a row that each is linked to within its list. near(p, q) tells which pairs are links; pairs that are connected are not asked about."""
    label = np.arange(len(keys))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(keys)))
    small = np.repeat(sizes <= short, sizes)

    def ask(p: np.ndarray, q: np.ndarray) -> None:
        keep = (label[p] != label[q]) & (100 * n[p] >= PERCENT * n[q])  # n[p] is the smaller
        p, q = p[keep], q[keep]
        if len(p):
            hit = near(p, q)
            settle(label, [(p[hit], q[hit])])

    for lag in range(1, int(sizes[sizes <= short].max(initial=1))):
        at = np.flatnonzero(small[:-lag] & (keys[lag:] == keys[:-lag]))
        ask(at, at + lag)
    for a, size in zip(first[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
        own, i, step = n[a : a + size], 0, 1
        while i < size - 1:
            rows = np.arange(i, min(size, i + step))
            end = np.searchsorted(own, own[rows] * 100 // PERCENT, "right")
            count = np.maximum(end - rows - 1, 0)
            p = np.repeat(rows, count)
            q = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + p + 1
            ask(p + a, q + a)
            i += step
            step = max(1, min(2 * step, (1 << 20) // size))
    return label


def grouped_rows(batches: Iterator[pa.RecordBatch], key_of) -> Iterator[pa.Table]:
    """Tables of whole groups, of rows that come sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = key_of(batch)
        last = key[-1]
        if key_of(held[0])[0] == last:
            continue  # one group goes on beyond this batch
        cut = int(np.flatnonzero(key != last)[-1]) + 1 if (key != last).any() else 0
        whole = [*held[:-1], batch.slice(0, cut)]
        # Of the batches before, those that hold the last group alone belong to it.
        while whole and (not whole[-1].num_rows or key_of(whole[-1])[-1] == last):
            whole.pop()
        if not whole:
            continue
        yield pa.Table.from_batches(whole)
        held = [x for x in [*held[len(whole) :][:-1], batch.slice(cut)] if x.num_rows] if len(whole) < len(held) else [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """rows with one number, g, for their group."""
    return rows.withColumn("g", F.xxhash64(*key))


def candidates(sets: DataFrame, most: int = 4096) -> DataFrame:
    """Links (a, b) between sets that may be near: a forest for each list."""
    rows = by_size(entries(sets), most)
    long = rows.filter(F.col("class") >= 0).groupBy("key", "class").agg(F.count("*").alias("rows"))
    rows = rows.join(long, ["key", "class"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rows = numbered(dealt(rows, most, "rows", F.xxhash64("id")), "key", "class", "part")
    rows = rows.select("g", "n", "id", "sketch").repartition("g").sortWithinPartitions("g", "n", "id")
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_rows(batches, lambda b: b.column("g").to_numpy()):
            table = table.combine_chunks()
            n, ids, key = (table.column(c).to_numpy() for c in ("n", "id", "g"))
            listed = table.column("sketch").combine_chunks()
            size = np.diff(listed.offsets.to_numpy())
            sketch = np.full((len(n), SKETCH), NONE, np.int32)
            sketch[np.arange(SKETCH) < size[:, None]] = listed.flatten().to_numpy()
            root = connected(key, n, Sketches(n, sketch).near)
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=names)

    return rows.mapInArrow(run, "a long, b long")


class Sets:
    """Full sets of a group: sorted hashes, one set after the other."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, most_bits: int = 1 << 29):
        self.n, self.bounds = np.diff(bounds), bounds
        _, self.column, count = np.unique(values, return_inverse=True, return_counts=True)
        several = count > 1  # what one set alone has is in no intersection
        number = np.cumsum(several) - 1
        kept = several[self.column]
        before = np.concatenate([[0], np.cumsum(kept)])
        self.column, self.bounds = number[self.column[kept]], before[bounds]
        self.width = int(several.sum())
        self.bits = None
        if len(self.n) * self.width <= most_bits:
            self.bits = np.zeros((len(self.n), (self.width + 63) // 64), np.uint64)
            row = np.repeat(np.arange(len(self.n)), np.diff(self.bounds))
            np.bitwise_or.at(self.bits, (row, self.column >> 6), np.uint64(1) << (self.column & 63).astype(np.uint64))

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        if self.bits is not None:
            step = max(1, (1 << 20) // max(1, self.bits.shape[1]))
            for i in range(0, len(p), step):
                out[i : i + step] = np.bitwise_count(self.bits[p[i : i + step]] & self.bits[q[i : i + step]]).sum(1)
            return out
        for row in np.unique(p).tolist():
            mark = np.zeros(self.width + 1, bool)
            mark[self.column[self.bounds[row] : self.bounds[row + 1]]] = True
            for i in np.flatnonzero(p == row).tolist():
                out[i] = np.count_nonzero(mark[self.column[self.bounds[q[i]] : self.bounds[q[i] + 1]]])
        return out

    def near(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        common = self.common(p, q)
        return 100 * common >= PERCENT * (self.n[p] + self.n[q] - common)


def confirmed(docs: DataFrame, sets: DataFrame, groups: DataFrame, most_values: int = 1 << 20) -> DataFrame:
    """Links (a, b) of sets with the similarity, a forest for each group. sets: id, n, place; groups: id, component."""
    members = groups.join(sets.select("id", "n", "place"), "id")
    totals = members.groupBy("component").agg(F.sum("n").alias("total"))
    members = members.join(totals, "component").select("id", "component", "total", F.col("place.doc_id").alias("doc_id_"), F.col("place.text_hash").alias("text_hash_"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), docs["text"])
    rows = rows.join(members, (F.col("text_hash") == F.col("text_hash_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_"))).select("id", "component", "total", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets_ = shingle_sets(*bytes_of(block.column("text")))
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("id", "component", "total")), pa.array([len(s) for s in sets_], pa.int64()), pa.array([s.tobytes() for s in sets_], pa.binary())], names=["id", "component", "total", "n", "hashes"])

    full = small_batches(rows).mapInArrow(hashed, "id long, component long, total long, n long, hashes binary")
    full = numbered(dealt(full, most_values, "total", F.xxhash64("id")), "component", "part")
    full = full.select("g", "n", "id", "hashes").repartition("g").sortWithinPartitions("g", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_rows(batches, lambda b: b.column("g").to_numpy()):
            key = table.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = table.slice(a, b - a).combine_chunks()
                n, ids = own.column("n").to_numpy(), own.column("id").to_numpy()
                raw, offsets = bytes_of(own.column("hashes").combine_chunks().cast(pa.large_binary()))
                values = np.frombuffer(raw.tobytes(), np.int64)
                root = connected(np.zeros(b - a, np.int64), n, Sets(values, offsets // 8).near)
                at = np.flatnonzero(ids != ids[root])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=["a", "b"])

    return full.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, most: int = 4096, most_values: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document. most: rows of a list, most_values: hashes of a group, beyond which several tasks share it."""
    prints = written(sketches(docs), "sketches")
    known = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    sets = prints.filter("n_shingles > 0").groupBy("set_id", F.col("n_shingles").alias("n"), "posts").agg(F.min(known).alias("place"))
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "sets")  # the numbers are fixed by being written
    groups = components(candidates(sets, most))
    found = components(confirmed(docs, sets, groups, most_values))
    named = sets.select("set_id", "id", F.col("place.doc_id").alias("least")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("set_id", "component_id")
    rows = prints.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_id").join(named, "set_id").select("doc_id", "n_shingles", "component_id")
    rows = rows.unionByName(prints.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
