"""Texts of Arrow batches as byte arrays: what the operators share that work on them within tasks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = np.zeros(256, bool)
MARK[list(b".,!?;:")] = True


def binary(texts: pa.Array) -> pa.LargeBinaryArray:
    """UTF-8 bytes; null as empty."""
    if pa.types.is_large_binary(texts.type):
        return texts
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    return texts.cast(pa.large_binary())


def small_batches(docs: DataFrame) -> DataFrame:
    """docs itself. Batches to and from tasks are limited by bytes, as texts may be long, so that memory is bounded."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return docs


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows, in blocks of about most bytes of text; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.frombuffer(binary(batch.column(column)).buffers()[1], np.int64)[: batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a block, and where each text starts, with the end."""
    texts = binary(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the first word of each text, with the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~WHITE[data]
    before = np.empty(len(ink), bool)
    before[0] = False
    before[1:] = ink[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(ink & ~before)
    after = np.empty(len(ink), bool)
    after[-1] = False
    after[:-1] = ink[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def kept_in_process(key: tuple, make):
    """make()'s result, made once in the life of a worker process, which runs many tasks."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("geoloom_kept_in_process", ModuleType("geoloom_kept_in_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread bits of each 64-bit number."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span: a polynomial in an odd base, from prefix sums."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), _ODD), out=sums[1:])
        back = powers(len(data) + 1, _ODD_INVERSE)
        return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words_: np.ndarray, k: int) -> np.ndarray:
    """A hash of the words i to i + k - 1, for each i that has as many."""
    n = len(words_) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _ODD + words_[i : i + n]
    return mixed(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Pieces of the texts that pre-tokenizers treat apart, and the first piece of each text, with the end.

    A cut stands before a white-space character that a character other than
    white space follows: the pattern "\\s+(?!\\S)" leaves just that one
    character of a run, and no alternative of the patterns begins before it and
    goes on beyond it. Where the next character is white space outside ASCII (or
    a control character that some tables call so), there is no cut; a missing
    cut does no harm.
    """
    n = len(data)
    white = WHITE[data]
    odd = white | ((data >= 0x1C) & (data <= 0x1F))
    for lead, tails in ((0xC2, {(0x85,), (0xA0,)}), (0xE1, {(0x9A, 0x80)}), (0xE2, {(0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)} | {(0x81, 0x9F)}), (0xE3, {(0x80, 0x80)})):
        at = np.flatnonzero(data == lead)
        for tail in tails if len(at) else ():
            hit = at[at + len(tail) < n]
            for i, x in enumerate(tail):
                hit = hit[data[hit + 1 + i] == x]
            odd[hit] = True
    cut = np.zeros(n, bool)
    if n:
        cut[:-1] = white[:-1] & ~odd[1:]
        inside = offsets[(offsets > 0) & (offsets <= n)]
        cut[inside - 1] = False  # the last character of a text has no next one
        cut[offsets[offsets < n]] = True
        # A run of letters ends before these marks, and what follows begins with them.
        cut[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
    bounds = np.append(np.flatnonzero(cut), n)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(bounds, offsets)


#: The pattern of byte-level tokenizers whose matches chunks() leaves whole.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for a pattern that drops white space.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def structure(spec: dict) -> tuple[bool, bool]:
    """Whether texts may be cut by chunks() for a tokenizers file, and whether it takes no heed of white space around a piece and of the case of A-Z. Neither for files of another structure than the two known."""
    cutter, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True) and normalizer is None:
        return True, False
    parts, steps = cutter.get("pretokenizers") or [], (normalizer or {}).get("normalizers") or []
    if cutter.get("type") == "Sequence" and len(parts) == 2 and [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"]:
        split, level = parts
        words_ = split.get("type") == "Split" and split.get("pattern") == {"Regex": WORD_LEVEL} and split.get("behavior") == "Removed" and split.get("invert")
        spaces = steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
        if words_ and spaces and level.get("type") == "ByteLevel" and not level.get("use_regex", True) and not level.get("add_prefix_space", True):
            return True, True
    return False, False


def separator(spec: dict) -> tuple[bytes, int] | None:
    """A special token of a tokenizers file, and its id, that keeps strings apart which it is put between: the library looks for special tokens first and treats what lies between them as texts of their own. None if there is no such token."""
    added, vocab = spec.get("added_tokens") or [], (spec.get("model") or {}).get("vocab")
    if spec.get("truncation") or spec.get("padding") or not isinstance(vocab, dict):
        return None
    known = {*vocab.values()}
    for x in added:
        own = x["content"]
        plain = own and x["id"] not in known and not any(x.get(k) for k in ("normalized", "lstrip", "rstrip", "single_word"))
        # No special token may begin in what is before and end in own, or be the beginning of one another.
        alone = own.rfind(own[:1]) == 0 and all(y["content"].rfind(own[:1]) <= 0 and (y is x or y["id"] != x["id"] and not y["content"].startswith(own) and not own.startswith(y["content"])) for y in added)
        if plain and alone:
            return own.encode(), x["id"]
    return None


class PieceEncoder:
    """Ids of texts by way of their distinct pieces, each encoded once for a block, or once while it stays in the cache.

    encode: from a list of strings to an iterable of id sequences. cut: texts may
    be cut by chunks(), else each is a piece. folded: encode takes no heed of
    white space around a piece and of the case of A-Z. special: strings that
    encode looks for in the whole text; a text that holds one is encoded whole.
    apart: as separator() gives it; pieces are then encoded many in a string.
    """

    def __init__(self, encode, cut: bool = True, folded: bool = False, special: tuple[bytes, ...] = (), cached: int = 350_000, at_once: int = 2048, apart: tuple[bytes, int] | None = None):
        self.encode, self.cut, self.folded, self.special, self.cached, self.at_once, self.apart = encode, cut, folded, special, cached, at_once, apart
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def each(self, pieces: list[bytes], together: int = 64) -> list[bytes]:
        """The ids of each piece."""
        if not self.apart:
            return [array("I", ids).tobytes() for ids in self.encode([p.decode() for p in pieces])]
        mark, own = self.apart
        strings = [b"".join(p + mark for p in pieces[i : i + together]).decode() for i in range(0, len(pieces), together)]
        ids = np.fromiter(chain.from_iterable(self.encode(strings)), np.uint32)
        ends = np.flatnonzero(ids == own)
        held, ends = ids.tobytes(), (4 * ends).tolist()
        return [held[a + 4 : b] for a, b in pairwise([-4, *ends])]

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        found = [self.young.get(p) or self.old.get(p) for p in pieces]
        missing = (i for i, x in enumerate(found) if x is None)
        while some := list(islice(missing, self.at_once)):
            new = [p for p in dict.fromkeys(pieces[i] for i in some) if p not in self.young]
            made = dict(zip(new, self.each(new), strict=True))
            self.young.update((p, ids) for p, ids in made.items() if len(p) <= 64)
            for i in some:
                found[i] = made[pieces[i]] if pieces[i] in made else self.young[pieces[i]]
        if len(self.young) > self.cached:
            self.old, self.young = self.young, {}
        return found

    def fold(self, piece: bytes) -> bytes:
        out = piece.strip().lower()
        return piece if any(x in out for x in self.special) else out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start, with the end."""
        texts = binary(texts)
        holds = np.zeros(len(texts), bool)
        for x in self.special:
            holds |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self.pieced(texts)
        ids, starts = self.pieced(pc.if_else(pa.array(holds), pa.scalar(b"", pa.large_binary()), texts))
        at = np.flatnonzero(holds)
        own = dict(zip(at.tolist(), self.encode([texts[i].as_py().decode() for i in at.tolist()]), strict=True))
        runs = [np.array(own[i], np.uint32) if i in own else ids[starts[i] : starts[i + 1]] for i in range(len(texts))]
        return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])])

    def pieced(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = bytes_of(texts)
        if self.cut:
            pieces, first = chunks(data, offsets)
        else:
            pieces, first = texts, np.arange(len(texts) + 1)
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = pieces.dictionary_encode()
        values, bounds = bytes_of(coded.dictionary)
        values, bounds = values.tobytes(), bounds.tolist()
        values = [values[a:b] for a, b in pairwise(bounds)]
        each = self.lookup([self.fold(v) for v in values] if self.folded else values)
        coded_ids = pa.array(each, pa.large_binary()).take(coded.indices)
        starts = np.frombuffer(coded_ids.buffers()[1], np.int64)[: len(coded_ids) + 1] // 4
        held = coded_ids.buffers()[2]
        return np.frombuffer(held, np.uint32, starts[-1]) if held is not None else np.zeros(0, np.uint32), starts[first]


def file_encoder(path: str, cached: int = 350_000) -> tuple[PieceEncoder, int]:
    """An encoder by a tokenizers file with add_special_tokens=False, and its vocabulary's size. As in the library's plain call, strings of special tokens in a text are found there."""

    def make() -> tuple[PieceEncoder, int]:
        import json
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already; the library's threads spin while they wait
        model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut, folded = structure(spec)
        special = tuple(x["content"].encode() for x in spec.get("added_tokens") or [])
        return PieceEncoder(lambda xs: [e.ids for e in model.encode_batch_fast(xs, add_special_tokens=False)], cut, folded, special, cached, apart=separator(spec) if cut else None), model.get_vocab_size()

    return kept_in_process(("tokenizers", path, cached), make)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text, and the new starts."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
