import random
import re

import numpy as np
import pytest

from geoloom.llm import minhash

from .fixtures import prose, rows, split


def brute(docs):
    sets = []
    for _, text in docs:
        words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * min(len(sets[i]), len(sets[j])) >= 85 * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    component = [least.get(find(i)) if sets[i] else doc_id for i, (doc_id, _) in enumerate(docs)]
    return sorted((str(d), len(s), str(c), d == c) for (d, _), s, c in zip(docs, sets, component, strict=True))


def check(spark, docs, **how):
    frame = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    plain = [(r.doc_id, r.text) for r in frame.collect()]
    got = minhash.near_duplicates(frame, **how).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(plain)


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        words[at : at + (kind > 0)] = [] if kind == 1 else ["".join(rng.choices("abcdefgh", k=6))]
    return words


@pytest.fixture(scope="module")
def corpus():
    """Families of copies with more and more changes, of texts of all lengths, a large one, and texts that share a passage or a frame alone."""
    rng = random.Random(3)
    texts, passage = [], prose(99, 60)
    for size in (6, 9, 20, 40, 55, 64, 70, 100, 140, 400, 3000):
        base = prose(size, size)
        texts += [" ".join(changed(rng, base, k)) for k in range(0, 2 + size // 12, 1 + size // 200)]
    base = prose(7, 145)
    texts += [" ".join(changed(rng, base, rng.randrange(5))) for _ in range(250)]
    texts += [" ".join(prose(1000 + i, 20 + i % 60) + passage + prose(2000 + i, 10)) for i in range(150)]
    texts += ["one two", "One two", "one two three", "ONE two", None, "", "  ", texts[30], texts[30].upper(), texts[60] + " "]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(1000 - i if i % 50 else None, texts[j]) for i, j in enumerate(order)]


def test_families(spark, corpus):
    check(spark, corpus)


def test_cut_lists(spark, corpus):
    """Lists and groups shared by several tasks give the same."""
    check(spark, corpus, most=16, most_values=3000)


def test_fixture(spark, docs, empty):
    check(spark, docs)
    assert minhash.near_duplicates(empty).count() == 0
    clash = docs.withColumnsRenamed({"key": "id", "run": "n", "packed": "set_id", "words": "component"})
    check(spark, clash)


def test_repeated_rows(spark):
    text = " ".join(prose(5, 80))
    check(spark, [(5, text), (5, text), (3, text + " more"), (None, text), (None, "alone here"), (None, "alone here"), (9, None), (9, None)])


def test_estimate():
    """No near pair is lost by the estimate, and most that are far are."""
    rng = np.random.default_rng(2)
    p, far = [], []
    for n in (30, 54, 64, 80, 200, 2000):
        for _ in range(200):
            both = int(np.ceil(n * 0.85))
            values = np.unique(rng.integers(0, 1 << 62, 3 * n))
            rng.shuffle(values)
            a, b = values[:n], values[n - both : n]
            near_ = (a, np.concatenate([b, values[n : n + max(0, int(both / 0.85) - n)]]))
            p.append(near_)
            far.append((a, np.concatenate([a[: n // 4], values[n : 2 * n - n // 4]])))
    for pairs, test in ((p, lambda x: x.all()), (far, lambda x: x.mean() < 0.02)):
        sketch = np.full((2 * len(pairs), minhash.SKETCH), minhash.NONE, np.int32)
        sets = [s for pair in pairs for s in pair]
        for i, s in enumerate(sets):
            low = (np.sort(s)[: minhash.SKETCH] >> 32).astype(np.int32)
            sketch[i, : len(low)] = low
        at = np.arange(len(pairs)) * 2
        assert test(minhash.Sketches(np.array([len(s) for s in sets]), sketch).near(at, at + 1))
        values = np.concatenate([np.sort(s) for s in sets])
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        want = [100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)) for a, b in pairs]
        assert minhash.Sets(values, bounds).near(at, at + 1).tolist() == want == minhash.Sets(values, bounds, 0).near(at, at + 1).tolist()
