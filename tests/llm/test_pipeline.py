"""Each stage of the pipeline on its predecessor's output, against brute force."""

import re
from itertools import combinations

import corpus_pipeline
import public_tokenizers
from geoloom.llm import quality
from tokenizers import Tokenizer

from .test_dedup import fingerprint


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["quality rules"]
    assert ids(after) == ids(quality.judged(before).filter("kept")) and len(ids(after)) < before.count()

    before, after = seen["exact dedup"]
    best = {}
    for i, text in texts(before).items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[norm] = min(best.get(norm, (1, 0)), (-len(text), i))
    assert ids(after) == sorted(i for _, i in best.values())

    before, after = seen["simhash near-dedup"]
    prints = {i: fingerprint(text) for i, text in texts(before).items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert ids(after) == sorted({find(i) for i in prints})

    before, after = seen["substring dedup"]
    first, old, new = {}, texts(before), texts(after)
    for i in sorted(old):
        words, gone = old[i].split(), set()
        for j in range(len(words) - 12):
            if first.setdefault(tuple(words[j : j + 13]), i) < i:
                gone |= set(range(j, j + 13))
        assert new[i] == (" ".join(w for j, w in enumerate(words) if j not in gone) if gone else old[i])

    before, after = seen["packing"]
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {i: len(model.encode(text, add_special_tokens=False).ids) + 1 for i, text in texts(before).items()}
    pieces = {}
    for r in after.collect():
        assert r.doc_tokens == size[r.doc_id]
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, n in size.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == n
    rows = lambda df: sorted(map(str, df.select("doc_id", "start", "length").collect()))
    assert len(rows(corpus_pipeline.run(spark, sf_dir))) == len(rows(after))
