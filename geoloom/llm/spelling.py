"""Spelling variants: the words of a corpus that differ by one letter, grouped under the most frequent.

Words are counted in Arrow tasks and summed by Spark. Each word's neighbourhood
is probed: every deletion and every replacement of one letter (an insertion is
the other word's deletion) is looked for in blocked Bloom filters, one for each
length of words, which are broadcast. Only edits that the filters know are
shuffled, to an exact join with the vocabulary, which drops the false ones. The
filters' size is bounded by ``filter_bytes``: a larger vocabulary makes them
denser, so that more edits are shuffled, and never loses one.

Words are runs of Latin letters up to U+00FF, so each is a row of bytes in
Latin-1, and an edit's hash is found from its word's: a hash is the sum of its
letters' numbers, each times a power of an odd base.

Defined cases: null texts have no words; a null doc_id is written as nothing
before the colon; repeated rows count again; an empty table gives an empty
result; further columns are ignored; a word may be of any length, its edits are
made in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textblocks import blocks, bytes_of, mixed, small_batches

CHAR_LENGTH, EVERY = 6, 199
BLOCK_BITS, BITS_EACH, LANES = 512, 14, 8
SHARDS = 48  # words of that many letters or more share a filter
#: The letters that a word may have, by their Latin-1 byte: a-z and U+00C0 to U+00FF.
LATIN = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each span, going on from that of what stands before it."""
    table = crc_table()
    crc = ~before.astype(np.uint32)
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    sizes = (ends - starts)[order]
    at = starts[order]
    crc = crc[order]
    for i in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -i, "left"))  # those longer than i
        crc[:n] = table[(crc[:n] ^ data[at[:n] + i]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def letter_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data with A-Z lower-cased, and starts and ends of the runs of letters, none across two texts."""
    upper = (data >= 0x41) & (data <= 0x5A)
    data = np.where(upper, data + 0x20, data).astype(np.uint8)
    lead = data == 0xC3
    letter = ((data >= 0x61) & (data <= 0x7A)) | lead
    letter[1:] |= lead[:-1]  # what follows a lead byte is its second byte
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner], last[inner - 1] = letter[inner], letter[inner - 1]
    return data, np.flatnonzero(first), np.flatnonzero(last) + 1


def word_counts(docs: DataFrame, shortest: int = CHAR_LENGTH, every: int = EVERY) -> DataFrame:
    """(word, n) of each block of texts, for words of at least shortest code points, one letter of one in ``every`` runs deleted."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = bytes_of(block.column("text"))
            if not len(data):
                continue
            data, starts, ends = letter_spans(data, offsets)
            ids = ["" if i is None else str(i) for i in block.column("doc_id").to_pylist()]
            prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            crc = crc32_of(data, starts, ends, prefix[np.searchsorted(offsets, starts, "right") - 1])
            hit = crc % np.uint32(every) == 0
            changed = []
            for a, b, h in zip(starts[hit].tolist(), ends[hit].tolist(), crc[hit].tolist(), strict=True):
                run_ = data[a:b].tobytes().decode()
                k = h % len(run_)
                if len(run_) > shortest:
                    changed.append(run_[:k] + run_[k + 1 :])
            second = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data == 0xC3, out=second[1:])
            long = ~hit & ((ends - starts) - (second[ends] - second[starts]) >= shortest)
            starts, ends = starts[long], ends[long]
            mark = np.zeros(len(data) + 1, np.int8)
            mark[starts] += 1
            mark[ends] -= 1
            own = np.ascontiguousarray(data[np.cumsum(mark[:-1]) > 0])
            bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(own))
            counted = pa.concat_arrays([whole, pa.array(changed, pa.large_string())]).value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.string()), counted.field("counts").cast(pa.int64())], names=["word", "n"])

    return small_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, least: int = 5) -> DataFrame:
    """(word, n) of the words that occur at least so often."""
    return word_counts(docs).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words' letters as Latin-1 bytes, and where each word starts, with the end."""
    data, bounds = bytes_of(words)
    lead = data == 0xC3
    data = data.copy()
    data[1:][lead[:-1]] += 0x40  # the second byte 80..BF of the letters C0..FF
    kept = ~lead
    before = np.concatenate([[0], np.cumsum(kept)])
    return data[kept], before[bounds]


def numbers() -> np.ndarray:
    """A 64-bit number for each letter."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


def base_powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(out, out=out)
    return out


def prefix_sums(letters: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers()[letters] * base_powers(len(letters)))])


def word_hashes(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of number(letter i) * BASE**i of each word."""
    if not len(letters):
        return np.zeros(len(bounds) - 1, np.uint64)
    sums, back = prefix_sums(letters), np.full(len(letters) + 1, INVERSE, np.uint64)
    back[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(back, out=back)
        return (sums[bounds[1:]] - sums[bounds[:-1]]) * back[bounds[:-1]]


class Filter:
    """A blocked Bloom filter: a hash has one block of 512 bits, and one bit in each of its eight lanes."""

    def __init__(self, lanes: np.ndarray):
        self.lanes = lanes  # blocks x 8, unsigned 64-bit

    @staticmethod
    def places(spread: np.ndarray, n_blocks: int | np.ndarray) -> np.ndarray:
        return ((spread >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def bits(spread: np.ndarray, lane: int) -> np.ndarray:
        """One bit of a lane: from the lower half of the spread hash for the first five lanes, which reject nearly all, and from a further spreading for the others."""
        if lane >= 5:
            spread, lane = mixed(spread), lane - 5
        return np.uint64(1) << ((spread >> np.uint64(6 * lane)) & np.uint64(63))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that may be in the filter."""
        spread = mixed(hashes)
        place = self.places(spread, len(self.lanes))
        at = np.flatnonzero(self.lanes[place, 0] & self.bits(spread, 0))
        for lane in range(1, LANES):
            at = at[(self.lanes[place[at], lane] & self.bits(spread[at], lane)) != 0]
        return at


def shard_of(length: Column) -> Column:
    return F.least(length, F.lit(SHARDS))


def filters(words: DataFrame, filter_bytes: int = 64 << 20, segment: int = 1 << 14) -> dict[int, np.ndarray]:
    """The filter of each shard. words: word, n. Tasks make pieces of segment blocks each; all pieces together are at most about filter_bytes, which is what the driver holds and sends out."""
    sized = words.select(F.char_length("word").alias("length")).groupBy(shard_of(F.col("length")).alias("shard")).agg(F.count("*").alias("n"))
    sizes = {r["shard"]: r["n"] for r in sized.collect()}  # SHARDS rows at most
    total = sum(sizes.values())
    each = min(BITS_EACH, filter_bytes * 8 / max(total, 1))
    n_blocks = {s: max(1, int(n * each / BLOCK_BITS)) for s, n in sizes.items()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, bounds = letters_of(batch.column("word"))
            spread = mixed(word_hashes(letters, bounds))
            shard = np.minimum(np.diff(bounds), SHARDS)
            place = Filter.places(spread, np.array([n_blocks[s] for s in shard.tolist()], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(place // segment), pa.array(place % segment), pa.array(spread.view(np.int64))], names=["shard", "segment", "place", "spread"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            shard, part, place, spread = (batch.column(c).to_numpy() for c in ("shard", "segment", "place", "spread"))
            for s, p in set(zip(shard.tolist(), part.tolist(), strict=True)):
                own = (shard == s) & (part == p)
                lanes = held.setdefault((s, p), np.zeros((min(segment, n_blocks[s] - p * segment), LANES), np.uint64))
                for lane in range(LANES):
                    np.bitwise_or.at(lanes, (place[own], lane), Filter.bits(spread[own].view(np.uint64), lane))
        if held:
            keys, pieces = list(held), [x.tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array(pieces, pa.binary())], names=["shard", "segment", "lanes"])

    pieces = small_batches(words).select("word").mapInArrow(hashed, "shard int, segment long, place long, spread long").repartition("shard", "segment").mapInArrow(made, "shard int, segment long, lanes binary")
    out: dict[int, list[tuple[int, bytes]]] = {}
    for r in pieces.toLocalIterator():
        out.setdefault(r["shard"], []).append((r["segment"], bytes(r["lanes"])))
    return {s: np.frombuffer(b"".join(x for _, x in sorted(parts)), np.uint64).reshape(-1, LANES) for s, parts in out.items()}


def edits(words: DataFrame, shards: dict[int, np.ndarray], at_once: int = 1 << 16, each: int = 20_000) -> DataFrame:
    """(word, n, edit, shorter): the deletions and replacements of one letter that the filters know. A task has about each words: each of them is probed several hundred times."""
    context = words.sparkSession.sparkContext
    words = words.repartition(max(context.defaultParallelism, words.count() // each))
    sent = context.broadcast(shards)
    used = LATIN

    def spelled(letters: np.ndarray) -> str:
        return letters.tobytes().decode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: Filter(x) for s, x in sent.value.items()}
        number, choices = numbers(), np.array(used, np.uint8)
        for batch in batches:
            letters, bounds = letters_of(batch.column("word"))
            if not len(letters):
                continue
            n = batch.column("n").to_numpy()
            sizes, powers = np.diff(bounds), base_powers(int(np.diff(bounds).max()))
            hashes = word_hashes(letters, bounds)
            # All words of one length are edited together; a long word's places in pieces.
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                step = max(1, at_once // (len(choices) * min(size, 4096)))
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    for low in range(0, size, 4096):
                        yield from found(letters, bounds[some], hashes[some], n[some], size, low, min(size, low + 4096), known, number, choices, powers)

    def found(letters, starts, hashes, n, size, low, high, known, number, choices, powers) -> Iterator[pa.RecordBatch]:
        place = np.arange(low, high)
        own = letters[starts[:, None] + place]
        out: list[tuple[int, str, bool]] = []
        with np.errstate(over="ignore"):
            same = known.get(min(size, SHARDS))
            if same is not None:
                without = hashes[:, None] - number[own] * powers[place]
                made = without[:, :, None] + number[choices] * powers[place][:, None]
                at = same.known(made.ravel())
                w, p, c = np.unravel_index(at, made.shape)
                for i, j, k in zip(w.tolist(), p.tolist(), c.tolist(), strict=True):
                    if choices[k] != own[i, j]:
                        word = letters[starts[i] : starts[i] + size].copy()
                        word[low + j] = choices[k]
                        out.append((i, spelled(word), False))
            less = known.get(min(size - 1, SHARDS))
            if less is not None and size > 1:
                # Hash without letter p: what stands before it, and what follows, one place nearer.
                once = max(1, (1 << 20) // size)
                for i in range(0, len(starts), once):
                    words_ = letters[starts[i : i + once, None] + np.arange(size)]
                    sums = np.zeros((len(words_), size + 1), np.uint64)
                    np.cumsum(number[words_] * powers[:size], axis=1, out=sums[:, 1:])
                    made = sums[:, place] + (sums[:, -1:] - sums[:, place + 1]) * INVERSE
                    # Of a run of equal letters the first alone is deleted: the others give the same word.
                    first = np.ones(made.shape, bool)
                    inner = place > 0
                    first[:, inner] = words_[:, place[inner]] != words_[:, place[inner] - 1]
                    at = np.flatnonzero(first)
                    w, p = np.unravel_index(at[less.known(made.ravel()[at])], made.shape)
                    for k, j in zip(w.tolist(), p.tolist(), strict=True):
                        out.append((i + k, spelled(np.delete(words_[k], low + j)), True))
        if out:
            rows, made_, shorter = zip(*out, strict=True)
            at = np.array(rows)
            mine = [spelled(letters[starts[i] : starts[i] + size]) for i in rows]
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(n[at]), pa.array(made_), pa.array(shorter)], names=["word", "n", "edit", "shorter"])

    return small_batches(words).select("word", "n").mapInArrow(run, "word string, n long, edit string, shorter boolean")


def near_words(words: DataFrame, filter_bytes: int = 64 << 20) -> DataFrame:
    """(word, other, other_n): each word with the words of the vocabulary that differ from it by one letter."""
    positives = edits(words, filters(words, filter_bytes))
    pairs = positives.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    ways = F.array(F.struct(F.col("word").alias("word"), F.col("edit").alias("other"), F.col("edit_n").alias("other_n")), F.when(F.col("shorter"), F.struct(F.col("edit").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(F.explode(F.array_compact(ways)).alias("x")).select("x.*")


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) and the last word that forms lead to. Each step doubles what a word has followed; n grows fivefold with each form, so the steps are few."""
    reached = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        reached = written(reached, "roots")
        ahead = reached.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = reached.join(ahead, "root", "left")
        if further.filter("next is not null").isEmpty():
            return reached
        reached = further.select("word", F.coalesce("next", "root").alias("root"))


def grouped(docs: DataFrame, least: int = 5, ratio: int = 5, filter_bytes: int = 64 << 20) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of the vocabulary. A word's form is its most frequent near word, the first in code-point order of several, if that is at least ratio times as frequent."""
    words = written(vocabulary(docs, least), "vocabulary")
    near = near_words(words, filter_bytes).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    out = words.join(near, "word", "left")
    fits = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    forms = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    return forms.join(with_roots(forms), "word").select("word", "n", "n_near", "form", "form_n", "root")
