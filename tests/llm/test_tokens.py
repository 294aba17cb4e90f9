import hashlib
import json
import os
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from geoloom.llm import bytebpe, packing, sstable, textblocks

from .fixtures import prose, rows


def encoder(name):
    model = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: model.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


SPECIAL = ["<|endoftext|> hi", "<|ENDOFTEXT|> hi  <|endoftext|>", "a<|startoftext|>b", "x <|start", "oftext|> y", "", "  two  Spaces, here. And\u00a0there ", "É <|endoftext|>é", "a \u0308b C\u0327 ΑΣ σας"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens(name):
    """Strings of special tokens, whole or nearly, among other texts: as the library's plain call gives them."""
    encode, own = encoder(name), textblocks.file_encoder(public_tokenizers.path(name))[0]
    assert own.cut and own.folded == name.startswith("word")
    for texts in (SPECIAL, [x for x in SPECIAL if "<|" not in x], ["<|endoftext|>"], [""], []):
        ids, starts = own(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [encode(x) for x in texts]


def test_unknown_structure():
    """A file of another structure is not cut: each text is encoded whole."""
    spec = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    assert textblocks.structure(spec) == (True, False)
    assert textblocks.structure(spec | {"pre_tokenizer": {"type": "Whitespace"}}) == (False, False)
    assert textblocks.structure(spec | {"normalizer": {"type": "NFKC"}}) == (False, False)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = textblocks.PieceEncoder(lambda xs: [e.ids for e in model.encode_batch(xs, add_special_tokens=False)], cut=False)
    ids, starts = whole(pa.array(SPECIAL))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [model.encode(x, add_special_tokens=False).ids for x in SPECIAL]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_together(name, monkeypatch):
    """Pieces go to the library many in a string, on one thread, and have the ids of each text alone; a small cache changes nothing."""
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encode, own = encoder(name), textblocks.file_encoder(public_tokenizers.path(name), cached=1_501)[0]
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    given, plain = [], own.encode
    monkeypatch.setattr(own, "encode", lambda xs: given.extend(xs) or plain(xs))
    texts = [" ".join(prose(seed, 500)) + odd for seed, odd in enumerate(["", " <|", "<|endoftext", "|> x", "  \n", "ß" * 3000, " '", "'s", "<", ">\u0338<\u0338"])]
    for _ in range(2):
        ids, starts = own(pa.array([*texts, None, ""]))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [encode(x) for x in [*texts, "", ""]]
    pieces = sum(len({x.strip() for x in t.split()}) for t in texts)
    assert pieces > 2000 and 0 < len(given) < pieces / 16
    given.clear()
    ids, starts = own(pa.array([*texts, *SPECIAL]))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [encode(x) for x in [*texts, *SPECIAL]]


def test_separator():
    """A token that would take heed of what is beside it, or whose id can come from a text, keeps nothing apart."""
    spec = json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text())
    first, second = spec["added_tokens"]
    assert textblocks.separator(spec) == (b"<|startoftext|>", first["id"])
    for k in ("normalized", "lstrip", "rstrip", "single_word"):
        assert textblocks.separator(spec | {"added_tokens": [first | {k: True}, second]}) == (b"<|endoftext|>", second["id"])
    assert textblocks.separator(spec | {"added_tokens": [first, second | {"content": "b<|"}]}) == (b"b<|", second["id"])
    for odd in ("<|startoftext|>>", "b<|b"):
        assert textblocks.separator(spec | {"added_tokens": [first, second | {"content": odd}]}) is None
    assert textblocks.separator(spec | {"added_tokens": [first | {"content": "<<"}]}) is None
    assert textblocks.separator(spec | {"added_tokens": [first | {"id": 7}]}) is None
    assert textblocks.separator(spec | {"added_tokens": []}) is None
    assert textblocks.separator(spec | {"truncation": {"max_length": 9}}) is None
    assert textblocks.separator(spec | {"model": {"vocab": [["a", 0.0]]}}) is None


def test_packing(spark, docs, empty):
    encode = encoder("byte_bpe_50k.json")
    want = {r[0]: [*encode(r[1]), 1] for r in rows()}
    got = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    pieces, sequences = {}, {}
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.ids_crc32 == crc(ids) and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.window))
    copies = {r[0]: sum(x[0] == r[0] for x in rows()) for r in rows()}
    for i, own in pieces.items():
        assert sum(n for _, n in own) == copies[i] * len(want[i])
    assert set(pieces) == set(want)
    for own in sequences.values():
        at = 0
        for offset, n, window in sorted(own):
            assert offset == at
            at += n
        assert at == window <= 2048 and window & (window - 1) == 0
    groups, small = {}, packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), group_tokens=4096).collect()
    for w, q, g in {(r.window, r.sequence_id, r.step_group) for r in small}:
        groups.setdefault(w, {}).setdefault(g, []).append(q)
    for w, own in groups.items():  # equal token counts, but for the last group of a size
        sizes = sorted(len(x) * w for x in own.values())
        assert all(n == 4096 for n in sizes[1:]) and sizes[0] <= 4096
    assert len({r.sequence_id >> 40 for r in small}) > 1 and max(map(len, groups.values())) > 2
    assert packing.packed(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs, "", tiers=(100,))


def test_shards(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = encoder("word_bpe_49k.json")
    at, want = 0, []
    for r in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*encode(r[1]), 2]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    shards = sstable.write_shards(docs, path)
    got = sorted((tuple(r) for r in sstable.read_shards(shards).collect()), key=lambda r: r[1])
    assert got == want
    asked = spark.createDataFrame([(9,), (2,), (-5,), (10**12,)], "doc_id long")
    texts = {r[0]: r[1] for r in rows()}
    assert {r.doc_id: r.ids for r in sstable.looked_up(shards, asked).collect()} == {9: [*encode(texts[9]), 2], 2: [2], -5: None, 10**12: None}
    none = sstable.write_shards(empty, path)
    assert none.count() == 0 and sstable.read_shards(none).count() == 0 and sstable.looked_up(none, asked).filter("ids is not null").count() == 0


def test_shard_file(tmp_path):
    """Blocks, filter and index of one file; a changed byte is noticed."""
    from pyarrow import fs

    store, rng, path = fs.LocalFileSystem(), np.random.default_rng(0), str(tmp_path / "s")
    held = {i * 7: rng.integers(0, 40_000, rng.integers(1, 300)) for i in range(-200, 800)}
    with store.open_output_stream(path) as out:
        writer = sstable.ShardWriter(out, 2, block_bytes=5000)
        for i, ids in held.items():
            writer.add(sstable.key_of(i), ids)
        writer.close()
    with store.open_input_file(path) as file:
        shard = sstable.Shard(file)
        assert len(shard.places) > 20 and shard.docs == len(held)
        assert all((shard.get(sstable.key_of(i)) == ids).all() for i, ids in held.items())
        assert all(shard.get(sstable.key_of(i)) is None for i in range(3, 600, 7))
        assert [sstable.id_of(k) for k, _ in shard.scan()] == list(held)
    data = bytearray(open(path, "rb").read())
    data[100] ^= 1
    open(path, "wb").write(data)
    with store.open_input_file(path) as file, pytest.raises(ValueError):
        list(sstable.Shard(file).scan())


def test_byte_bpe(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    want = {r[0]: other.encode_ordinary(r[1] or "") for r in rows()}
    texts = {r[0]: r[1] or "" for r in rows()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = bytebpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[i].encode())) for i, ids in want.items()}
    starts = {i: other.decode_with_offsets(ids)[1] for i, ids in want.items()}
    inside = {i: sum(other.decode_single_token_bytes(t)[0] & 0xC0 == 0x80 for t in ids) for i, ids in want.items()}
    assert {r.doc_id: (r.n_split, r.last_start) for r in got} == {i: (inside[i], starts[i][-1] if starts[i] else None) for i in want} and any(inside.values())
    full = bytebpe.encoded(docs, path, public_tokenizers.PATTERN)
    for r in full.collect():
        assert r.ids == want[r.doc_id]
        _, starts = other.decode_with_offsets(r.ids)
        assert r.char_starts == starts
    assert {r.doc_id: r.text for r in bytebpe.decoded(full, path).collect()} == texts
    part = spark.createDataFrame([(1, other.encode_ordinary("日")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert [r.text for r in bytebpe.decoded(part, path).orderBy("doc_id").collect()][1] is None
    assert bytebpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0
