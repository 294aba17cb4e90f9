"""Byte-level BPE encoding and decoding over Arrow batches.

The ranks of a tiktoken file become a model of the tokenizers library: each byte
is mapped to a printable character, and each way to split a token in two known
ones becomes a merge of the token's rank. Token boundaries are given in bytes
and in characters of the original text. Decoding reads each token's bytes off
its spelling in the model's vocabulary by the reversed byte table; a character whose bytes lie in several tokens comes out whole where the tokens
are decoded together, and begins with the token that holds its first byte.

Defined cases: a null text counts as empty and has no id; repeated rows are
encoded each for itself; a null doc_id is kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textblocks import BYTE_LEVEL, PieceEncoder, blocks, bytes_of, kept_in_process, small_batches


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def tokenizer_of(ranks: dict[bytes, int], pattern: str):
    """A Tokenizer that merges as the ranks say, within each match of pattern."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    text = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(text[t[:i]], text[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    out = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id, read off its spelling by the reversed byte table."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for spelled, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in spelled)
    return out


class ByteBPE:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        model = tokenizer_of(ranks, pattern)
        self.encode = PieceEncoder(lambda xs: [e.ids for e in model.encode_batch_fast(xs, add_special_tokens=False)], cut=pattern == BYTE_LEVEL)
        by_id = token_bytes(model.get_vocab())
        self.tokens = pa.array(by_id, pa.large_binary())
        self.lengths = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.decimals = pa.array([f"{i},".encode() for i in range(len(by_id))], pa.large_binary())

    @staticmethod
    def joined(values: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
        """values[id] of all ids in a row, and where those of each text start."""
        data, starts = bytes_of(values.take(pa.array(ids)))
        return data.tobytes(), starts[offsets].tolist()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
        return self.joined(self.tokens, ids, offsets)

    def token_starts(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte and the character of its text at which each token starts; within a split character, that character."""
        data, bounds = bytes_of(texts)
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        chars = np.cumsum((data & 0xC0) != 0x80)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        before = np.concatenate([[0], chars])[bounds]
        return begins - bounds[of], chars[begins] - 1 - before[of]


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids, byte_starts and char_starts (arrays) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("ids", "byte_starts", "char_starts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_process(("ranks", ranks_path, pattern), lambda: ByteBPE(read_ranks(ranks_path), pattern))
        for block in blocks(batches, "text"):
            ids, offsets = bpe.encode(block.column("text"))
            lists = [ids, *bpe.token_starts(block.column("text"), ids, offsets)]
            arrays = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.astype(np.int32))) for x in lists]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), *arrays], schema=schema)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, byte_starts array<int>, char_starts array<int>")


def decoded(rows: DataFrame, ranks_path: str, pattern: str = BYTE_LEVEL) -> DataFrame:
    """doc_id and text (bytes that are no UTF-8 become U+FFFD) of each row of doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_process(("ranks", ranks_path, pattern), lambda: ByteBPE(read_ranks(ranks_path), pattern))
        for batch in batches:
            lists = batch.column("ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            data, at = bpe.decode(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]))
            texts = [data[a:b].decode(errors="replace") if known else None for a, b, known in zip(at, at[1:], lists.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas and of the bytes decoded from them, n_split (tokens that begin within a character) and last_start (the character at which the last token begins, null if there is none)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64()), ("last_start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept_in_process(("ranks", ranks_path, pattern), lambda: ByteBPE(read_ranks(ranks_path), pattern))
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for block in blocks(batches, "text", 12 << 20):
            ids, offsets = bpe.encode(block.column("text"))
            sums = []
            for values, less in ((bpe.decimals, 1), (bpe.tokens, 0)):
                data, at = bpe.joined(values, ids, offsets)
                data = memoryview(data)
                sums.append([sha(data[a : max(a, b - less)]) for a, b in zip(at, at[1:], strict=False)])
            begins, chars = bpe.token_starts(block.column("text"), ids, offsets)
            text, bounds = bytes_of(block.column("text"))
            of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            within = (text[begins + bounds[of]] & 0xC0) == 0x80
            last = offsets[1:] - 1
            starts = pa.array(chars[last] if len(chars) else np.zeros(len(last), np.int64), pa.int64(), mask=np.diff(offsets) == 0)
            counts = pa.array(np.bincount(of[within], minlength=len(last)), pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), *map(pa.array, sums), counts, starts], schema=schema)

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long, last_start long")
