import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm import langid, licenses, quality, toxicity
from pyspark.sql import functions as F

from .fixtures import SCHEMA, prose, rows, split


def base(text):
    words, text = split(text), text or ""
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if split(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, empty):
    got = quality.judged(docs).collect()
    assert len(got) == len(rows())
    want = {r[0]: base(r[1]) for r in rows()}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == want
    for r in got:
        n, *_, again = want[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * again > 20 * n) and not (r.base_failed and r.kept)
        assert r.distance is None or (0 <= r.distance <= 1 and n >= 50)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.judged(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_divergence(spark):
    """Texts of symbols are far from prose; the distance is 0 for equal and 1 for disjoint histograms."""
    many = [(i, " ".join(prose(i, 200)), "en", "s", 0) + (None,) * 7 for i in range(20)] + [(99, " ".join(f"{w}###" for w in prose(99, 200)).upper(), None, "s", 0) + (None,) * 7]
    got = {r.doc_id: r.distance for r in quality.judged(spark.createDataFrame(many, SCHEMA)).collect()}
    assert got[99] > max(got[i] for i in range(20)) + 0.1
    row = spark.range(1).select(*[quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), q).alias(str(i)) for i, q in enumerate(([1.0, 0.0], [0.0, 1.0]))]).first()
    assert tuple(row) == pytest.approx((0.0, 1.0))


SENTENCES = {
    "ru": "и в не на что с по это как но из у за от же для мы они был город река дом дорога старый человек время рука книга слово",
    "el": "και το να του η της με που την από για είναι ο οι στο θα δεν μια πόλη ποτάμι σπίτι δρόμος παλιός άνθρωπος χρόνος χέρι βιβλίο λέξη",
    "en": "the of and to in that is was for with it as be by on this are from town river house road old people time hand book word",
    "pl": "i w na że się z do to jak ale przez dla był są który oraz już tylko miasto rzeka dom droga żółty człowiek książka słowo ręka łąka",
    "uk": "і в не на що з до це як але із у за від же для ми вони був місто річка дім дорога старий людина час рука книга слово",
}


def clean(lang, seed, n=120):
    rng, words = random.Random(seed), SENTENCES[lang].split()
    made = [rng.choice(words) + ("." if i % 12 == 11 else "") for i in range(n)]
    return " ".join(made).capitalize()


def verdicts(spark, rows_):
    return {r.doc_id: r for r in quality.judged(spark.createDataFrame([(i, t, k) for i, (t, k) in rows_.items()], "doc_id long, text string, lang string")).collect()}


def test_further_languages(spark):
    """Languages without a word list have references of their own; what is far from these goes."""
    rows_ = {i: (clean(k, i), k) for i, k in enumerate(["en", "ru", "el"] * 30)}
    junk = lambda k, i: " ".join(f"##{w}$$|" for w in clean(k, i).split())
    rows_ |= {100: (junk("ru", 100), "ru"), 101: (junk("el", 101), "el"), 102: (junk("en", 102), "en"), 103: (junk("ru", 103), None), 104: (clean("ru", 104), None), 105: (clean("el", 105), None), 106: (clean("pl", 106), None)}
    got = verdicts(spark, rows_)
    assert all(got[i].kept and got[i].distance < 0.2 for i in range(90))
    assert [got[i].kept for i in range(100, 107)] == [False] * 4 + [True] * 3
    assert all(got[i].distance is not None for i in range(100, 107))


def test_language_without_reference(spark):
    """Too few texts for a reference, in script or language: the base rules alone decide."""
    rows_ = {i: (clean("en", i), "en") for i in range(30)}
    rows_ |= {40: (clean("ru", 40), "ru"), 41: (clean("el", 41), "el"), 42: (clean("ru", 42), None), 43: (clean("el", 43), "en"), 44: (clean("pl", 44), "pl"), 45: (clean("uk", 45), "und"), 46: (clean("ru", 46, 5), "ru"), 47: (clean("en", 47), None)}
    got = verdicts(spark, rows_)
    assert all(got[i].distance is None and got[i].kept == (i != 46) for i in range(40, 47))
    assert got[47].kept and got[47].distance is not None


def test_licenses(spark, docs, empty):
    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in hits]
        return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    got = licenses.scanned(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == {r[0]: brute(r[1]) for r in rows()}
    labels = {r.doc_id: r.labels for r in got}
    assert labels[23] == "mit" and labels[14] == "cc-by,gpl,reserved" and labels[1] == ""
    assert len(got) == len(rows())
    assert licenses.scanned(empty).count() == 0


def test_license_rows(spark):
    """Repeated rows, null ids and texts of one id come back one for one; a repeated 2-gram is one vote; only A-Z are lower-cased."""
    texts = ["under the " * 7, "under the " * 4, "released under the MIT license", "all rights reserved " * 2, "al\u212a rights reserved", "cc by nc"]
    rows_ = [(4, texts[0]), (4, texts[1]), (4, texts[2]), (4, texts[2]), (None, texts[3]), (None, texts[5]), (7, "wor\u212a cc by"), (8, "licensed under the " + "apache " * 3 + "license version 2 0")]
    got = [tuple(r) for r in licenses.scanned(spark.createDataFrame(rows_, "doc_id long, text string")).collect()]
    assert len(got) == len(rows_)
    assert sorted(r[6] for r in got if r[0] == 4) == ["", "", "mit", "mit"]
    assert sorted((r[1], r[2], r[6]) for r in got if r[0] is None) == [(3, 1, "cc-by"), (6, 2, "reserved")]
    keyless = spark.createDataFrame([(None, f"text {i} cc by") for i in range(50)] + [(0, "text 1 cc by")], "doc_id long, text string")
    assert licenses.scanned(keyless).filter("n_base = 1 and first_word = 2").count() == 51
    assert [r[1:3] for r in got if r[0] == 7] == [(3, 1)] and [r[6] for r in got if r[0] == 8] == ["apache-2.0"]
    long = spark.createDataFrame([(1, "under the " * 20_000 + "released " + "under the " * 50 + " released under the mit license")], "doc_id long, text string")
    assert licenses.scanned(long).first().labels == "mit"


def test_license_bands(spark):
    """Score and labels against every band of diagonals, tried one by one."""
    rng = random.Random(5)
    pool = sorted({w for x in licenses.NOTICES for w in x.split()}) + ["x", "y"]
    texts = {}
    for i in range(150):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 40))]
        notice = rng.choice(list(licenses.NOTICES)).split()
        for _ in range(rng.randint(0, 3)):
            notice.insert(rng.randrange(len(notice)), rng.choice(pool)) if rng.random() < 0.5 else notice.pop(rng.randrange(len(notice)))
        texts[i] = " ".join(words + notice + words[::-1])
    want = {}
    for i, text in texts.items():
        words, best, labels = text.split(), 0.0, set()
        for notice, label in licenses.NOTICES.items():
            grams = list(zip(notice.split(), notice.split()[1:]))
            hits = {(p - a, a) for p in range(len(words) - 1) for a, g in enumerate(grams) if (words[p], words[p + 1]) == g}
            share = max((len({a for d, a in hits if low <= d <= low + 4}) / len(grams) for low, _ in hits), default=0.0)
            best = max(best, share)
            labels |= {label} if share >= 0.8 else set()
        n_base = sum(words[p : p + len(b.split())] == b.split() for b in licenses.BASE for p in range(len(words)))
        labels |= {x for b, x in licenses.BASE.items() if any(words[p : p + len(b.split())] == b.split() for p in range(len(words)))}
        want[i] = (",".join(sorted(labels)), 1.0 if n_base else best)
    got = licenses.scanned(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.score) for r in got} == {i: (x, pytest.approx(y)) for i, (x, y) in want.items()}
    assert sum("," in x or x != "" for x, _ in want.values()) > 50


def test_notice_with_changes(spark):
    rows_ = [(1, "x licensed under the really Apache License, Version 2.0 y"), (2, "licensed under the apache"), (3, "version 2.0 of the license " + "w " * 50 + "licensed under the apache license")]
    got = {r.doc_id: r.labels for r in licenses.scanned(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0", 2: "", 3: ""}


def test_languages(spark, docs, empty):
    got = langid.predicted(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 22))
    assert all(r.lang_pred in ("en", "fr", "und") and 0 <= r.score <= 1 for r in got)
    assert langid.predicted(empty).count() == 0


def test_language_spans(spark):
    texts = {"en": "the house and the river of this town was with them ", "de": "der fluss und das haus von dieser stadt ist mit ihnen ", "ru": "дом и река этого города были с ними "}
    train = [(i * 3 + k, text * (3 + i), lang) for i in range(40) for k, (lang, text) in enumerate(texts.items())]
    model = langid.Model(langid.learned(spark.createDataFrame(train, "doc_id long, text string, lang string")))
    asked = spark.createDataFrame([(1, texts["en"] * 3 + texts["de"] * 5), (2, "река города"), (3, "12 345 !"), (4, None), (5, "—…")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identified(asked, model).collect()}
    assert got[1].lang_pred == "de" and [s.lang for s in got[1].spans] == ["en", "de"] and abs(got[1].spans[1].first - 33) <= 2
    assert (got[2].lang_pred, got[2].score) == ("ru", 1.0) and [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3


@pytest.mark.parametrize("n_langs", [1, 3, 150, 300])
def test_viterbi(n_langs):
    """Against the plain recurrence in exact numbers; scores are whole, so float32 holds them."""
    rng = np.random.default_rng(n_langs)
    sizes = rng.integers(0, 25, 30)
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = -rng.integers(0, 60, (first[-1], n_langs)).astype(np.float32)
    got = langid.viterbi(scores, first, 10.0)
    total = lambda path, own: sum(float(own[i, p]) for i, p in enumerate(path)) - 10.0 * sum(a != b for a, b in zip(path, path[1:]))
    for a, b in zip(first, first[1:]):
        own = scores[a:b].astype(float)
        value = own[0].copy() if b > a else np.zeros(n_langs)
        for row in own[1:]:
            value = np.maximum(value, value.max() - 10.0) + row
        path = got[a:b].tolist()
        assert all(0 <= p < n_langs for p in path) and total(path, own) == (value.max() if b > a else 0)


def test_viterbi_long():
    """A text of 150,000 words in spans of 200, each word of score -300 or so: rounding loses no switch."""
    n, span = 150_000, 200
    want = (np.arange(n) // span) % 2
    scores = np.full((n, 2), -300.0, np.float32)
    scores[np.arange(n), 1 - want] -= 2.0
    assert (langid.viterbi(scores, np.array([0, n]), 10.0) == want).mean() > 0.999


def test_many_languages(spark):
    """200 languages, each of words of its own."""
    words = {f"l{i:03d}": [f"{a}{chr(97 + i % 26)}{chr(97 + i // 26)}{a}" for a in ("ka", "lo", "mi", "zu", "te")] for i in range(200)}
    rows_ = [(i * 200 + k, " ".join(w * 4), lang) for i in range(6) for k, (lang, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    got = langid.predicted(docs).join(docs, "doc_id").filter("held_out")
    assert got.count() > 100 and got.filter("lang = lang_pred").count() >= 0.95 * got.count()


def test_too_many_languages(spark):
    """A table that names more languages than the driver's table is meant for is refused, not cut."""
    docs = spark.createDataFrame([(i, "the house", f"l{i}") for i in range(6)], "doc_id long, text string, lang string")
    assert len(langid.Model(langid.learned(docs), most=6).langs) == 6
    with pytest.raises(ValueError):
        langid.Model(langid.learned(docs), most=5)


def test_word_scores(spark):
    """Against counts of trigrams taken byte by byte, in whole numbers and plain logarithms; a language without a word's script is out."""
    train = {"en": "the house and the river", "de": "das haus und der fluss über", "ru": "дом и река этого города", "el": "το σπίτι και το ποτάμι"}

    def bucket(before: int, at: int, after: int) -> int:
        code = (at * 65537 + before * 2654435761 + after * (40503 * 65536 + 251)) % 2**32
        code = (code ^ code >> 15) * 0x2C1B3C6D % 2**32
        return code >> 17

    def grams(word: str) -> list[int]:
        data = f" {word} ".encode()
        return [bucket(*data[i - 1 : i + 2]) for i in range(1, len(data) - 1)]

    counts = {lang: Counter(g for w in text.split() for g in grams(w)) for lang, text in train.items()}
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(train.items())], "doc_id long, text string, lang string")
    model = langid.Model(langid.learned(docs))
    asked = ["the", "river", "haus", "über", "город", "σπίτι", "zzz", "домthe", "和"]
    first_bytes = {lang: {langid.scripts()[c.encode()[0]] for c in text if c != " "} for lang, text in train.items()}
    data, starts, ends, _ = langid.letter_runs(pa.array([" ".join(asked)]))
    got = langid.word_scores(model, data, starts, ends)
    assert model.langs == sorted(train) and got.shape == (len(asked), 4)
    for word, row in zip(asked, got, strict=True):
        scripts = {langid.scripts()[c.encode()[0]] for c in word}
        able = {lang for lang in train if scripts <= first_bytes[lang]}
        for lang, score in zip(model.langs, row, strict=True):
            total = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            want = sum(math.log((counts[lang][g] + 0.5) / total) for g in grams(word)) - (1e4 if able and lang not in able else 0)
            assert abs(score - want) < 0.01, (word, lang)


def test_signs_are_no_letters(spark):
    train = spark.createDataFrame([(0, "the house " * 9, "en"), (1, "дом и река " * 9, "ru")], "doc_id long, text string, lang string")
    model = langid.Model(langid.learned(train))
    asked = spark.createDataFrame([(1, "\U0001f600\U0001f600 ★★★ → 。、"), (2, "the house \U0001f600\U0001f600\U0001f600\U0001f600 ████"), (3, "дом")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(asked, model).collect()}
    assert got == {1: ("und", 0.0), 2: ("en", 1.0), 3: ("ru", 1.0)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 24)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.predicted(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.predicted(empty, labels).count() == 0
    assert all(r.score < 1e-6 for r in toxicity.predicted(docs, labels.limit(0)).collect())


def test_pairs_of_terms(spark):
    """Either word is clean alone; together they are toxic: no weight for each term tells that."""
    rows_, labels = [], []
    for i in range(1200):
        words = prose(i, 12) + [[], ["insulto"], ["gruppa"], ["insulto", "gruppa"]][i % 4]
        rows_.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 3)))
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = toxicity.predicted(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    good = sum(r.predicted == (r.doc_id % 4 == 3) for r in got)
    assert good >= 0.95 * len(got)


def test_pure_interaction(spark):
    """Each word alone is as often toxic as clean; only both, or neither, tell."""
    rows_, labels = [], []
    for i in range(1600):
        words = prose(i, 12) + [[], ["insulto"], ["gruppa"], ["insulto", "gruppa"]][i % 4]
        rows_.append((i, " ".join(words)))
        labels.append((i, int(i % 4 in (0, 3))))
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = toxicity.predicted(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    right = sum((r.score >= 0.5) == (r.doc_id % 4 in (0, 3)) for r in got)
    assert right >= 0.95 * len(got)


def test_machine():
    """Scores against the sum over all pairs of terms, term by term."""
    rng = np.random.default_rng(0)
    texts = ["alpha beta gamma", "beta beta longerword", "", None, "gamma longerword alpha delta", "nothing known"]
    _, bucket = toxicity.terms_of(pa.array(texts[:3]), 1 << 16)
    machine = toxicity.Machine(1 << 16, np.unique(bucket), 3)
    machine.bias = -0.4
    machine.weight = rng.normal(0, 1, len(machine.weight)).astype(np.float32)
    machine.factor = rng.normal(0, 1, machine.factor.shape).astype(np.float32)
    got = machine.scores(pa.array(texts))
    for text, score in zip(texts, got):
        _, own = toxicity.terms_of(pa.array([text]), 1 << 16)
        at = [int(machine.place[b]) for b in sorted(set(own.tolist())) if machine.place[b] >= 0]
        raw = machine.bias + sum(float(machine.weight[i]) for i in at) + sum(float(machine.factor[i] @ machine.factor[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert score == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-5)


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.predicted(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    bad = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad) > 0  # 305 toxic rows to learn from
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.01 * (len(got) - len(bad))


def test_toxicity_of_long_rows(spark):
    """A labelled text of 20,000 distinct terms is counted and fitted with all of them."""
    long = " ".join("".join("abcdefghij"[int(d)] for d in str(k)) for k in range(100_000, 120_000))
    rows_ = [(i, (long if i == 3 else "plain words here") + (" zzinsultz" if i % 4 == 3 else ""), i % 4 // 3) for i in range(400)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, score int").repartition(3)
    sample = toxicity.sampled(docs, docs.selectExpr("doc_id", "score as toxic"), 1000, 1000, 1 << 20)
    clean, toxic = toxicity.term_counts(sample, 1 << 20)
    _, own = toxicity.terms_of(pa.array([rows_[3][1]]), 1 << 20)
    assert len(np.unique(own)) > 18_000 and (toxic[np.unique(own)] >= 1).all() and clean.sum() == 300 * 3 and toxic.sum() == 99 * (3 + 2) + len(np.unique(own))
    _, insult = toxicity.terms_of(pa.array(["zzinsultz"]), 1 << 20)
    assert toxic[insult[0]] == 100
    y, terms = toxicity.rows_with(sample, insult, 1 << 20)
    assert sorted(zip(y.tolist(), map(len, terms), strict=True)) == [(0, 0)] * 300 + [(1, len(np.unique(insult)))] * 100
