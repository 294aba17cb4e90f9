"""Near duplicates by SimHash fingerprints.

A fingerprint has 64 bits, each set if over half of the text's shingle hashes
have it. Two fingerprints that differ in at most ``bits`` = 4 bits differ in at
most 4 of their 8 bytes, so they share at least 4 bytes at the same positions.
The inverted index has a list for each value of three byte positions, for the
20 triples out of which every four positions hold at least one; so every such
pair meets in some list. There the shared bytes of each pair are tallied, pairs
with the guaranteed four are retained, and their differing bits are counted.
Equal fingerprints are one entry of the index. In a long list, only entries that
share a fourth byte are compared; a list of over ``most`` entries is split in
this way before it is sent to tasks. What is longer still is cut in blocks, and
each pair of blocks is a list of its own, so no task holds more than about
``most`` entries of a list, however many there are. Of a list only a spanning
forest of its links is passed on, never all its pairs.

Defined cases: null and empty texts have no word and the fingerprint zero, and
are linked like any other; a text of fewer words than a shingle is one shingle;
rows of a null doc_id have a fingerprint and no component unless another row
has the same fingerprint; repeated rows share a component; an empty table gives
an empty result; further columns are kept by ``keep_one_of_each`` and ignored
otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .textblocks import blocks, bytes_of, small_batches, words

BYTES, SHARED = 8, 4


def triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 positions such that any 4 positions hold one of them (the Turan system of three groups)."""
    group = [p % 3 for p in range(BYTES)]
    return [t for t in combinations(range(BYTES), 3) if sorted(c := [group[p] for p in t]) == [c[0]] * 3 or any(c.count(g) == 2 and c.count((g + 1) % 3) == 1 for g in range(3))]


def fingerprint_of(text: bytes, starts: np.ndarray, ends: np.ndarray, k: int, table: np.ndarray) -> int:
    """text: lower-cased words joined by one space; starts and ends of its words."""
    import xxhash

    if not len(starts):
        return 0
    n = max(1, len(starts) - k + 1)
    last = min(k, len(starts)) - 1
    digest, counts = xxhash.xxh64_digest, np.zeros(BYTES * 256, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        hashes = b"".join([digest(text[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)])
        values = np.frombuffer(hashes, np.uint8).reshape(-1, BYTES) + np.arange(0, BYTES * 256, 256)
        counts += np.bincount(values.ravel(), minlength=BYTES * 256)
    set_in = counts.reshape(BYTES, 256) @ table
    return int.from_bytes(np.packbits(2 * set_in.ravel() > n).tobytes(), "big", signed=True)


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, text_hash and fingerprint (long) of each document, from word shingles of k words, A-Z lower-cased, hashed by XXH64 with seed 42."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
        for block in blocks(batches, "text"):
            data, offsets = bytes_of(block.column("text"))
            starts, ends, first = words(data, offsets)
            sizes = ends - starts
            raw, bounds, made = data.tobytes(), offsets.tolist(), []
            for i in range(len(bounds) - 1):
                own = sizes[first[i] : first[i + 1]]
                stops = np.cumsum(own + 1) - 1
                made.append(fingerprint_of(b" ".join(raw[bounds[i] : bounds[i + 1]].lower().split()), stops - own, stops, k, table))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), block.column("text_hash"), pa.array(made, pa.int64())], names=["doc_id", "text_hash", "fingerprint"])

    return small_batches(docs).select("doc_id", text_hash(docs).alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Pairs that share the guaranteed number of bytes and differ in at most bits bits."""
    x = x ^ y
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    zero = ~(((x & low) + low) | x | low)  # the top bit of each byte that both share
    return (np.bitwise_count(zero) >= SHARED) & (np.bitwise_count(x) <= bits)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(keys)))


def linked(keys: np.ndarray, prints: np.ndarray, bits: int, short: int = 64) -> np.ndarray:
    """For rows sorted by key: the index of a row of the same list that each row is linked to, at whatever remove, the smallest.

    In a list of over short rows only those meet that share one more byte: its
    members agree in three positions, so a pair with the guaranteed four agrees
    in one of the others as well.
    """
    label, edges = np.arange(len(keys)), []

    def link(p: np.ndarray, q: np.ndarray) -> None:
        edges.append((p, q))
        if sum(len(e[0]) for e in edges) > 4 << 20:
            settle(label, edges)
            edges.clear()

    def meet(rows: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> None:
        own, run = prints[rows], np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= short, sizes)
        for lag in range(1, int(sizes[sizes <= short].max(initial=1))):
            at = np.flatnonzero(small[:-lag] & (run[lag:] == run[:-lag]))
            at = at[near(own[at], own[at + lag], bits)]
            link(rows[at], rows[at + lag])
        for a, size in zip(first[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
            some, at = own[a : a + size], rows[a : a + size]
            values = some.view(np.uint8).reshape(-1, BYTES)
            free = np.flatnonzero(values.min(0) != values.max(0))
            if BYTES - len(free) < SHARED:
                for p in free:
                    order = np.argsort(values[:, p], kind="stable")
                    meet(at[order], *runs(values[order, p]))
            else:
                each_with_each(some, at)

    def each_with_each(some: np.ndarray, at: np.ndarray) -> None:
        step = max(1, (1 << 20) // len(some))
        for i in range(0, len(some), step):
            p, q = np.nonzero(near(some[i : i + step, None], some[None, i:], bits))
            keep = q > p
            link(at[p[keep] + i], at[q[keep] + i])

    meet(label.copy(), *runs(keys))
    settle(label, edges)
    return label


def settle(label: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Lower each label to the smallest of its component, in place."""
    if not edges:
        return
    p, q = (np.concatenate(x) for x in zip(*edges, strict=True))
    while len(p):
        least = np.minimum(label[p], label[q])
        np.minimum.at(label, label[p], least)
        np.minimum.at(label, label[q], least)
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        while (label[label] != label).any():
            label[:] = label[label]
        open_ = label[p] != label[q]
        p, q = p[open_], q[open_]


def postings(prints: DataFrame) -> DataFrame:
    """(key, id, fingerprint): the inverted index, a list for each triple of byte positions and the values there."""
    byte = [F.expr(f"shiftrightunsigned(fingerprint, {56 - 8 * p}) & 255L") for p in range(BYTES)]
    keys = [F.lit(n << 24) + byte[a] * 65536 + byte[b] * 256 + byte[c] for n, (a, b, c) in enumerate(triples())]
    return prints.select("id", "fingerprint", F.explode(F.array(*keys)).alias("key"))


def long_lists(lists: DataFrame, most: int) -> DataFrame:
    return written(lists.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most), "long-lists")


def dealt(lists: DataFrame, most: int) -> DataFrame:
    """The index with its lists of over most entries dealt to tasks.

    Such a list is split by the byte at each of the other five positions: an
    entry goes to five lists, one of which it shares with any near entry. What
    still has over most entries is cut in blocks, and each pair of its blocks is
    a list of its own. New lists are named by hashes; should two have one name,
    they are compared in vain, and no link is lost or made by it.
    """
    long = long_lists(lists, most)
    if long.isEmpty():
        return lists
    others = F.array(*[F.array(*[F.lit(p) for p in range(BYTES) if p not in t]) for t in triples()])
    byte = lambda p: F.call_function("shiftrightunsigned", F.col("fingerprint"), 56 - 8 * p).bitwiseAND(255)
    by_byte = F.transform(others[F.shiftright("key", 24).cast("int")], lambda p: F.xxhash64("key", p, byte(p)))
    split = lists.join(long, "key", "left").select("id", "fingerprint", F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(by_byte)).alias("key"))
    n = F.expr(f"cast(ceil(n / {most / 2}) as long)")
    own = F.pmod(F.xxhash64("id"), n)
    pair = lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j))
    pairs = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: j != own), pair)
    parts = F.when(F.col("n").isNull(), F.array("key")).otherwise(pairs)
    return split.join(long_lists(split, most), "key", "left").select("id", "fingerprint", F.explode(parts).alias("key"))


def links(prints: DataFrame, bits: int = 4, most: int = 8192) -> DataFrame:
    """Links (a, b) between ids whose fingerprints are near: for each list a forest. prints: id, fingerprint, each fingerprint once. most: entries of a list, beyond which it is dealt to several tasks."""
    lists = dealt(postings(prints), most).repartition("key").sortWithinPartitions("key", "fingerprint")
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "fingerprint", "id")]
            held.append(columns)
            key = columns[0]
            if not len(key) or held[0][0][0] == key[-1]:
                continue  # one list goes on beyond this batch
            key, fingerprint, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            yield found(key[:cut], fingerprint[:cut], ids[:cut])
            held = [[key[cut:], fingerprint[cut:], ids[cut:]]]
        if held:
            yield found(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def found(key: np.ndarray, fingerprint: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        root = linked(key, fingerprint.view(np.uint64), bits)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]])], names=names)

    return lists.select("key", "fingerprint", "id").mapInArrow(run, "a long, b long")


def classes_of(prints: DataFrame, bits: int, most: int = 8192) -> DataFrame:
    """(fingerprint, component_id) of each fingerprint that a row with an id has."""
    if not 0 <= bits <= BYTES - SHARED:
        raise ValueError("bits must be from 0 to 4")
    distinct = prints.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    parts = components(links(distinct, bits, most))
    return distinct.join(parts, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each document; bits is 4 at most."""
    prints = written(fingerprints(docs, k), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(classes_of(prints, bits), "fingerprint", "left").select("doc_id", digits, "component_id")


def keep_one_of_each(docs: DataFrame, k: int = 4, bits: int = 4) -> DataFrame:
    """docs with one row of each component, one of the smallest doc_id; a row of a null doc_id goes if another row has its fingerprint, else it stays."""
    prints = written(fingerprints(docs, k), "fingerprints")
    judged = prints.join(classes_of(prints, bits), "fingerprint", "left")
    first = judged.filter("doc_id is null and component_id is null or doc_id = component_id")
    # A row is told by its id and its text; of rows that agree in both, or in id and class, one stays.
    places = first.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("n"))
    places = written(places.unionByName(first.filter("doc_id is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n")).distinct()), "near-kept")
    places = places.select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "n")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs["doc_id"].cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"))
    found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")))
    if places.filter("n > 1").isEmpty():
        return found.select("whole.*")
    return found.filter("n = 1").select("whole.*").unionByName(found.filter("n > 1").dropDuplicates(["doc_id"]).select("whole.*"))
