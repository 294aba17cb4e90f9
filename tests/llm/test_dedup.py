import hashlib
import re
from itertools import combinations

import numpy as np
import xxhash

from geoloom.llm import components, exact, fm_index, simhash, substrings
from geoloom.llm.fm_index import FMIndex

from .fixtures import rows, split


def test_exact(spark, docs, empty):
    groups = {}
    for r in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    want = {}
    for norm, members in groups.items():
        best = min((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]) for r in members)[3]
        for r in members:
            want[r[0]] = (best, len(members), hashlib.sha256(norm.encode()).hexdigest())
    for how in ({}, {"bucket_rows": 1, "max_depth": 5}):
        got = exact.exact_groups(docs, **how).collect()
        assert len(got) == len(rows())
        assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
        assert sorted(str(r.doc_id) for r in got if r.kept) == sorted({str(w[0]) for w in want.values()})  # one of each group, of repeated rows too
    assert max(r.depth for r in got) > 1
    assert all(r.bucket >> (max(x.depth for x in got) - r.depth) << (max(x.depth for x in got) - r.depth) == r.bucket for r in got)
    for how in ({}, {"bucket_rows": 1, "max_depth": 5}):
        kept = exact.drop_exact_copies(docs, **how)
        assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(w[0]) for w in want.values()})
    assert exact.exact_groups(empty).count() == 0 and exact.drop_exact_copies(empty).count() == 0


def test_exact_repeated_and_null_ids(spark):
    """Rows without an id, or of one id, are told apart by their texts; of equal rows one stays."""
    rows_ = [(None, "a b"), (None, "a  b"), (None, "c"), (None, "c"), (3, "c"), (3, "c"), (3, "d"), (3, None), (5, ""), (-(2**63), "e"), (6, "e"), (None, "f")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = exact.exact_groups(docs, bucket_rows=1, max_depth=3).collect()
    assert len(got) == len(rows_) and sum(r.kept for r in got) == 6
    kept = sorted(((r.doc_id is not None, r.doc_id or 0), r.text) for r in exact.drop_exact_copies(docs).fillna("null", "text").collect())
    assert kept == sorted([((False, 0), "a  b"), ((True, 3), "c"), ((True, 3), "d"), ((True, 3), "null"), ((True, -(2**63)), "e"), ((False, 0), "f")])


def test_directory_routes(spark):
    """Buckets are split until they fit; every slot has one; without the directory's buckets no row finds its entry."""
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id % 1000 as string) as text").union(spark.range(2000).selectExpr("id + 5000", "'hot'"))
    index, rows_ = exact.indexed(docs, 100, 16)
    size = {r.bucket: (r.depth, r["count"]) for r in rows_.join(index.select("bucket", "depth").distinct(), "bucket").groupBy("bucket", "depth").count().collect()}
    depth = max(d for d, _ in size.values())
    assert all(n <= 100 or d == 16 for d, n in size.values()) and sum(n for _, n in size.values()) == 5000
    found = exact.buckets(rows_.selectExpr("cast(shiftrightunsigned(key, 48) as int) as prefix"), 100, 16)
    slots = exact.directory(found, depth).collect()
    assert sorted(r.slot for r in slots) == list(range(1 << depth)) or {r.bucket for r in slots} == set(size)
    assert rows_.withColumn("bucket", rows_.bucket + 1).join(index, ["bucket", "key", "digest"]).count() == 0


def test_stage_looks_up_by_bucket(spark, monkeypatch):
    """A row that the directory sends to another bucket than its text's finds nothing to stay by."""
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)], "doc_id long, text string")
    assert exact.drop_exact_copies(docs, 5, 8).count() == 40
    own = exact.built

    def astray(*args):
        index, rows_, slots, place = own(*args)
        return index, rows_, slots.withColumn("bucket", slots.bucket + 1_000_000), place

    monkeypatch.setattr(exact, "built", astray)
    assert exact.drop_exact_copies(docs, 5, 8).count() == 0


def fingerprint(text):
    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))


def test_simhash(spark, docs, empty):
    prints = {r[0]: fingerprint(r[1]) for r in rows()}
    ids = sorted(i for i in prints if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", None if i is None else find(i)) for i, f in prints.items()}
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, {None, *map(find, ids)}))
    again = [(5, "x y z"), (5, "x y z"), (5, "one two three four five six"), (7, "x y z"), (None, "x y z"), (None, "alone"), (4, "one two three four five six")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(again, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("4", "one two three four five six"), ("5", "x y z"), ("None", "alone")]
    assert simhash.near_duplicates(empty).count() == 0


def test_triples_cover_four_positions():
    assert len(simhash.triples()) == 20
    assert all(any(set(t) <= set(f) for t in simhash.triples()) for f in combinations(range(8), 4))


def test_dense_fingerprints(spark):
    """Many fingerprints within four bits of one another, in lists longer than a block."""
    rng = np.random.default_rng(0)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))} | {int(x) for x in rng.integers(1 << 62, size=300)})
    prints = spark.createDataFrame(list(enumerate(values)), "id long, fingerprint long")
    lists = {r.key: r["count"] for r in simhash.postings(prints).groupBy("key").count().collect()}
    dealt = {r.key: r["count"] for r in simhash.dealt(simhash.postings(prints), 50).groupBy("key").count().collect()}
    assert max(lists.values()) > 100 and max(dealt.values()) < 100 and dealt.keys() - lists.keys()
    assert dict(lists.items() & dealt.items()) == {k: n for k, n in lists.items() if n <= 50}
    got = {r.id: r.component for r in components.components(simhash.links(prints)).collect()}
    assert got == {r.id: r.component for r in components.components(simhash.links(prints, most=50)).collect()}
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.arange(len(v))
    for _ in range(len(v)):
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    assert [got.get(i, i) for i in range(len(v))] == label.tolist()


def test_linked_by_a_fourth_byte():
    """Long lists of rows that agree in three bytes, in four, in none; every pair against every pair."""
    rng = np.random.default_rng(3)
    for free in ((0, 1, 2, 3, 4), (4, 5, 6, 7), (0, 1, 2, 3, 4, 5, 6, 7), (2,)):
        mask = sum(255 << 8 * int(p) for p in free)
        seeds = rng.integers(1 << 63, size=250, dtype=np.uint64) & np.uint64(mask)
        flips = np.uint64(1) << (8 * rng.choice(free, (900, 4)) + rng.integers(0, 8, (900, 4))).astype(np.uint64)
        prints = np.unique(seeds[rng.integers(0, 250, 900)] ^ np.bitwise_xor.reduce(flips, axis=1))
        prints = np.concatenate([prints, prints ^ np.uint64(1 << 63)])
        keys = np.repeat([0, 1], len(prints) // 2)
        want = np.arange(len(prints))
        simhash.settle(want, [np.nonzero((keys[:, None] == keys) & (np.bitwise_count(prints[:, None] ^ prints) <= 4))])
        for short in (1, 8, 64):
            assert simhash.linked(keys, prints, 4, short).tolist() == want.tolist()
    assert simhash.linked(keys[:0], prints[:0], 4).tolist() == []


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in pairs for i in (a, b) if a != b}


def test_fm_index():
    rng = np.random.default_rng(2)
    for length in (2, 3, 5, 8, 13):
        held = [rng.integers(1, 4, rng.integers(length, 40)) for _ in range(30)]
        text = np.concatenate([np.append(s, 0) for s in held])
        fm = FMIndex(text, 4, length, np.arange(len(text)))
        asked = [*held, *[rng.integers(1, 4, rng.integers(0, 40)) for _ in range(30)]]
        stream = np.concatenate([np.append(s, 0) for s in asked])
        sizes = np.array([len(s) for s in asked])
        starts = np.cumsum(sizes + 1) - sizes - 1
        got = fm.matching(stream, starts, sizes)
        known = {tuple(s[i : i + length].tolist()) for s in held for i in range(len(s) - length + 1)}
        for a, n in zip(starts, sizes, strict=True):
            for i in range(n):
                window = tuple(stream[a + i : a + i + length].tolist()) if i + length <= n else None
                assert (got[a + i] >= 0) == (window in known)
                if got[a + i] >= 0:
                    at = fm.owners(got[a + i : a + i + 1])[0]  # the first place that has it
                    assert tuple(text[at : at + length].tolist()) == window


def test_bit_vector():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 65, 1000):
        bits = rng.random(n) < 0.3
        own = fm_index.BitVector(bits)
        assert own.rank(np.arange(n + 1)).tolist() == [int(bits[:i].sum()) for i in range(n + 1)]
        assert own.select(np.arange(int(bits.sum()))).tolist() == np.flatnonzero(bits).tolist()


def test_hot_anchor(spark):
    """One phrase in very many surroundings: its shard is cut by window, and what is removed stays the same."""
    rng = np.random.default_rng(6)
    phrase = "as the saying goes in this town"
    texts = [" ".join([*(f"w{x}" for x in rng.integers(0, 40, 9)), phrase, *(f"w{x}" for x in rng.integers(0, 40, 9))]) for _ in range(400)]
    texts += [texts[int(i)] for i in rng.integers(0, 400, 60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    wanted = [substrings.repeats(docs, most_words=n, marked=k).collect() for n, k in ((10**6, 16), (1000, 1), (1000, 4))]
    assert {tuple(r) for r in wanted[0]} == {tuple(r) for r in wanted[1]} == {tuple(r) for r in wanted[2]} and sum(r.n_removed for r in wanted[0]) > 1000


def brute_repeats(window=13):
    first, out = {}, {}
    for r in rows():
        words = split(r[1])
        for i in range(len(words) - window + 1):
            if r[0] is not None:
                key = tuple(words[i : i + window])
                first[key] = min(first.get(key, r[0]), r[0])
    for r in rows():
        words, gone = split(r[1]), set()
        for i in range(len(words) - window + 1):
            if r[0] is not None and first[tuple(words[i : i + window])] < r[0]:
                gone |= set(range(i, i + window))
        out[r[0]] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def test_substrings(spark, docs, empty):
    want = brute_repeats()
    assert sum(w[1] for w in want.values()) > 1000
    for how in ({}, {"most_windows": 3, "most_words": 500}, {"most_windows": 5, "most_words": 90, "marked": 1}):
        got = substrings.repeats(docs, **how).collect()
        assert len(got) == len(rows())
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in want.items()}
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    assert {r.doc_id: (r.text, r.n_chars, r.h1) for r in cut.collect()} == {
        i: (t := (want[i][2] if want[i][1] else texts[i]), None if t is None else len(t), None if i is None else 5) for i in want
    }
    assert substrings.repeats(empty).count() == 0 and substrings.without_repeats(empty).columns == empty.columns
