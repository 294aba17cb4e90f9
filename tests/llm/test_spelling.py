import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from geoloom.llm import spelling


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 5}
    blanks = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            blanks[w[:i] + "\0" + w[i + 1 :]].add(w)
            blanks[w[:i] + w[i + 1 :]].add(w)
    near = {}
    for w in words:
        found = set()
        for i in range(len(w)):
            found |= blanks[w[:i] + "\0" + w[i + 1 :]]
            found |= {w[:i] + w[i + 1 :]} & words.keys()
        near[w] = (found | {x for x in blanks[w] if len(x) == len(w) + 1}) - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def check(spark, docs, **how):
    got = spelling.grouped(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **how).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute(docs)
    assert len({r.word for r in got}) == len(got)
    return {r.word: r for r in got}


def test_small(spark):
    """Insertions, deletions, replacements at both ends, repeated letters, letters of Latin-1, ties, chains of forms."""
    many = lambda word, n: " ".join([word] * n)
    docs = [
        (1, " ".join([many("kitten", 200), many("kittens", 30), many("ittens", 6), many("Kitteens", 5), many("sitten", 8), many("mitten", 8)])),
        (2, " ".join([many("ÀÉÎõüÿ", 40), many("àéîõüÿ", 5), many("ÀÉÎõüÿ×÷", 5), many("ÀÉÎõüÿ×", 7), many("short", 90), many("shorts", 7)])),
        (3, None), (None, many("aaaaaa", 9) + "-" + many("aaaaaaa", 50) + "7aaaaaaaa"), (4, ""), (5, "日本語 ñandúes"), (5, many("x" * 5000, 5) + " " + many("x" * 4999 + "y", 30) + " " + many("x" * 4998 + "y", 6)),
    ]
    got = check(spark, docs)
    assert got["ittens"].root == "kitten" and got["sitten"].form == "kitten" and got["kittens"].form == "kitten"
    check(spark, docs, filter_bytes=8)  # filters that know nearly everything lose nothing


def test_many(spark):
    rng = np.random.default_rng(5)
    stems = ["".join(rng.choice(list("abcdé"), 6 + i % 4)) for i in range(400)]
    docs = [(i, " ".join(rng.choice(stems, 600, p=np.r_[np.full(20, 0.03), np.full(380, 0.4 / 380)]))) for i in range(60)]
    assert len(check(spark, docs)) > 300


def test_empty(spark, empty, docs):
    assert spelling.grouped(empty).count() == 0
    clash = docs.withColumnsRenamed({"key": "word", "run": "n", "packed": "edit", "words": "form"})
    ordered = lambda rows: sorted(map(tuple, spelling.grouped(rows).collect()))
    assert ordered(clash) == ordered(docs)


def test_parts():
    rng = np.random.default_rng(1)
    words = pa.array(["".join(rng.choice(list("abéÿ"), rng.integers(1, 30))) for _ in range(300)])
    letters, bounds = spelling.letters_of(words)
    assert [letters[a:b].tobytes().decode("latin-1") for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == words.to_pylist()
    hashes = spelling.word_hashes(letters, bounds)
    assert len(set(hashes.tolist())) == len(set(words.to_pylist()))
    data = np.frombuffer(b"xxabcdefyz", np.uint8)
    assert spelling.crc32_of(data, np.array([2, 0, 4]), np.array([5, 10, 4]), np.array([0, zlib.crc32(b"7:"), 9], np.uint32)).tolist() == [zlib.crc32(b"abc"), zlib.crc32(b"7:xxabcdefyz"), 9]
