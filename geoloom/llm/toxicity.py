"""Toxicity by a factorization machine over hashed terms.

Terms are words of letters, lower-cased, and the first six bytes of longer ones,
hashed to ``buckets``; a document has a term or has it not. The machine adds a weight for each term and, for each two
terms, the product of their factors: so an insult beside the mention of a group
can count for more than both apart. It is fitted on the driver on a bounded
sample of labelled documents (``most_toxic`` and ``most_clean`` rows, those of
the smallest hash of doc_id). All terms of the sample are counted, by Spark; the
driver gets the counts of the buckets, and of the rows those terms that are
chosen or tried in pairs, however many a row has. Its terms are the ``most_terms`` that tell the two apart best, and those
of pairs that tell more together than apart, though each alone may tell nothing:
all pairs of the ``pair_terms`` terms that most toxic rows have are tried. Two
machines, each fitted on half of the sample and tried on the other, choose the
cut that gets the score ``least``. What is shipped to the tasks is bounded by
``buckets``, ``most_terms`` and ``pair_terms``.

Defined cases: null and empty texts have no term and get the machine's bias; a
null toxic is no label; a doc_id with several labels is toxic if one says so;
without labels of both kinds the score is the share of toxic labels; repeated
rows get equal scores; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .letters import letter_runs
from .storage import written
from .textblocks import blocks, mixed, small_batches, span_hashes

STEM = 6  # bytes
LEAST_CHI = 10.83  # one in a thousand by chance
LEAST_PAIR_CHI = 40.0  # one in a thousand by chance, for the best of half a million pairs


def terms_of(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each word of a block, and of the stem of each longer word."""
    data, starts, ends, first = letter_runs(texts)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    long = np.flatnonzero(ends - starts > STEM)
    stems = mixed(span_hashes(data, starts[long], starts[long] + STEM) + np.uint64(1))
    hashes = np.concatenate([span_hashes(data, starts, ends), stems])
    return np.concatenate([of, of[long]]), (hashes >> np.uint64(20)).astype(np.int64) & (buckets - 1)


class Machine:
    """bias, weight of each chosen term, factors of each; place: bucket to term, or -1."""

    def __init__(self, buckets: int, chosen: np.ndarray, factors: int):
        self.bias = 0.0
        self.place = np.full(buckets, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.weight = np.zeros(len(chosen), np.float32)
        self.factor = np.random.default_rng(0).normal(0, 0.05, (len(chosen), factors)).astype(np.float32)

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factor
        return self.bias + x @ self.weight + 0.5 * ((s * s).sum(1) - x @ (self.factor**2).sum(1))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int, rate: float, shrink: float) -> None:
        """Logistic loss, all rows a round, by Adam; x: rows by terms, 0 or 1."""
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1, np.float32), self.weight, self.factor)]
        for t in range(1, rounds + 1):
            s = x @ self.factor
            raw = self.bias + x @ self.weight + 0.5 * ((s * s).sum(1) - x @ (self.factor**2).sum(1))
            p = 1 / (1 + np.exp(-np.clip(raw, -50, 50)))
            e = ((p - y) / len(y)).astype(np.float32)
            xe = x.T @ e
            gradients = [np.array([e.sum()]), xe + shrink * self.weight, x.T @ (e[:, None] * s) - xe[:, None] * self.factor + shrink * self.factor]
            steps = []
            for m, g in zip(moments, gradients, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                steps.append(rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8))
            self.bias -= float(steps[0][0])
            self.weight -= steps[1].astype(np.float32)
            self.factor -= steps[2].astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        of, bucket = terms_of(texts, len(self.place))
        term = self.place[bucket]
        of, term = of[term >= 0], term[term >= 0]
        n, k = len(texts), max(1, len(self.weight))
        pairs = np.unique(of * k + term)
        of, term = pairs // k, pairs % k
        raw = self.bias + np.bincount(of, self.weight[term], n)
        for f in self.factor.T:
            v = f[term]
            raw += 0.5 * (np.bincount(of, v, n) ** 2 - np.bincount(of, v * v, n))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def sampled(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int, buckets: int) -> DataFrame:
    """(toxic, terms): label and distinct buckets, four bytes each, of the sample's rows, at most most_toxic + most_clean of them."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, most_toxic), (0, most_clean))]
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(some[0].unionByName(some[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            of, bucket = terms_of(block.column("text"), buckets)
            own = np.unique(of * buckets + bucket)
            ends = np.searchsorted(own, np.arange(1, block.num_rows + 1) * buckets)
            found = [x.astype("<i4").tobytes() for x in np.split(own % buckets, ends[:-1])]
            yield pa.RecordBatch.from_arrays([block.column("toxic").cast(pa.int32()), pa.array(found, pa.binary())], names=["toxic", "terms"])

    return written(rows.select("toxic", "text").mapInArrow(run, "toxic int, terms binary"), "toxic-sample")


def term_counts(sample: DataFrame, buckets: int) -> np.ndarray:
    """How many clean and how many toxic rows have each bucket: two rows of buckets numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            terms = [np.frombuffer(x, "<i4") for x in batch.column("terms").to_pylist()]
            of = np.repeat(toxic.astype(np.int64), [len(t) for t in terms])
            key, n = np.unique(of * buckets + np.concatenate([np.zeros(0, "<i4"), *terms]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key // buckets), pa.array(key % buckets), pa.array(n)], names=["toxic", "bucket", "n"])

    got = sample.mapInArrow(run, "toxic long, bucket long, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, buckets))
    out[got.column("toxic").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def rows_with(sample: DataFrame, wanted: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and terms of the sample's rows, of the wanted terms alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(buckets, bool)
        keep[wanted] = True
        for batch in batches:
            terms = [np.frombuffer(x, "<i4") for x in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([t[keep[t]].tobytes() for t in terms], pa.binary())], names=["toxic", "terms"])

    got = sample.mapInArrow(run, "toxic int, terms binary").toArrow()
    return got.column("toxic").to_numpy(), [np.frombuffer(x, "<i4") for x in got.column("terms").to_pylist()]


def held(terms: list[np.ndarray], place: np.ndarray, width: int) -> np.ndarray:
    """A row for each document, 1 where it has the term of the place."""
    x = np.zeros((len(terms), width), np.float32)
    for i, t in enumerate(terms):
        at = place[t]
        x[i, at[at >= 0]] = 1
    return x


def chi_squared(a: np.ndarray, b: np.ndarray, bad: int, n: int) -> np.ndarray:
    """Of being in a of bad toxic and in b of the other n - bad rows."""
    both = a + b
    return n * (a * (n - bad - b) - b * (bad - a)) ** 2 / np.maximum(both * (n - both) * bad * (n - bad), 1)


def frequent(toxic_counts: np.ndarray, pair_terms: int) -> np.ndarray:
    """The pair_terms terms that most toxic rows have, three at least."""
    often = np.argsort(-toxic_counts, kind="stable")[:pair_terms]
    return np.sort(often[toxic_counts[often] >= 3])


def paired(target: np.ndarray, terms: list[np.ndarray], toxic_counts: np.ndarray, chi: np.ndarray, pair_terms: int, most: int = 128) -> np.ndarray:
    """Buckets of the terms of pairs that tell more than twice what both tell apart, at most most of them, the best pairs first."""
    often = frequent(toxic_counts, pair_terms)
    place = np.full(len(toxic_counts), -1, np.int32)
    place[often] = np.arange(len(often))
    together = np.zeros((2, len(often), len(often)))
    for at in range(0, len(terms), 2000):
        x = held(terms[at : at + 2000], place, len(often))
        for k in (0, 1):
            own = x[target[at : at + 2000] == k]
            together[k] += own.T @ own
    bad = int(target.sum())
    tells = chi_squared(together[1], together[0], bad, len(terms)) - 2 * (chi[often][:, None] + chi[often][None, :])
    tells[together.sum(0) < 5] = 0
    p, q = np.nonzero(np.triu(tells, 1) >= LEAST_PAIR_CHI)
    best = np.argsort(-tells[p, q], kind="stable")[:most]
    own = list(dict.fromkeys(np.stack([p[best], q[best]], 1).ravel().tolist()))[:most]
    return often[own]


def fitted(sample: DataFrame, buckets: int, most_terms: int, pair_terms: int, factors: int, least: float, false_cost: float = 10, rounds: int = 150, rate: float = 0.08, shrink: float = 1e-4) -> Machine:
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, n = kinds.get(1, 0), sum(kinds.values())
    if bad in (0, n):
        out = Machine(buckets, np.zeros(0, np.int64), factors)
        out.bias = 500.0 if bad else -500.0
        return out
    b, a = term_counts(sample, buckets)
    # Only terms that several documents have.
    chi = chi_squared(a, b, bad, n)
    good = np.where((a + b < 3) | (chi < LEAST_CHI), 0, chi)
    chosen = np.argsort(-good, kind="stable")[: min(most_terms, int((good > 0).sum()))]
    y, terms = rows_with(sample, np.union1d(chosen, frequent(a, pair_terms)), buckets)
    target = (y == 1).astype(np.float32)
    chosen = np.union1d(chosen, paired(target, terms, a, chi, pair_terms))
    x = held(terms, Machine(buckets, chosen, factors).place, len(chosen))

    def on(rows: np.ndarray) -> Machine:
        out = Machine(buckets, chosen, factors)
        out.bias = float(np.log(bad / (n - bad)))
        out.fit(x[rows], target[rows], rounds, rate, shrink)
        return out

    # Each half is scored by a machine fitted on the other; the cut that does best there gets the score least.
    half = np.zeros(n, bool)
    for k in (0, 1):
        half[np.flatnonzero(target == k)[::2]] = True
    raw = np.where(half, on(~half).raw(x), on(half).raw(x))
    order = np.argsort(-raw, kind="stable")
    gain = np.cumsum(np.where(target[order] == 1, 1.0, -float(false_cost)))
    gain[:-1][raw[order][1:] == raw[order][:-1]] = -np.inf
    best = int(gain.argmax())
    below = raw[order[best + 1]] if best + 1 < n else raw[order[best]] - 1
    out = on(np.ones(n, bool))
    out.bias += float(np.log(least / (1 - least)) - (raw[order[best]] + below) / 2)
    return out


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(machine.scores(block.column("text")))], names=["doc_id", "score"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def predicted(
    docs: DataFrame, labels: DataFrame, rest: int = 1, of: int = 3, least: float = 0.7, most_toxic: int = 4000, most_clean: int = 12_000, most_terms: int = 512, pair_terms: int = 1024, factors: int = 4, buckets: int = 1 << 20
) -> DataFrame:
    """doc_id, held_out, score and predicted, learned from the labels that are not held out (crc32 of doc_id modulo of is rest)."""
    machine = fitted(sampled(docs, labels.filter(~held_out(rest, of)), most_toxic, most_clean, buckets), buckets, most_terms, pair_terms, factors, least)
    return scored(docs, machine).select("doc_id", held_out(rest, of).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
