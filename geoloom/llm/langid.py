"""Languages of words and documents.

A word's score for a language is the log probability of its byte trigrams
(hashed) in that language's training texts, smoothed. The scripts of its
letters narrow the candidates: a language of which no training text uses a
script is out for a word of that script. A Viterbi pass over the words of a
document, with a penalty for each switch, labels spans of one language each;
the language with the most letters in its spans is that of the document, and
the score its share of the letters.

Learning adds up trigrams over all documents of the training part; what reaches
the driver is one number for each language and bucket, of 256 languages at most
(a table that names more is refused). Documents of a block are
passed through the trellis side by side, so memory is bounded by a block.

Defined cases: a text that is null or has no letter is "und" with score 0;
with no language learned, so is every text; documents of a null lang are
labelled, not learned from; repeated rows get equal labels; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .letters import letter_runs
from .storage import written
from .textblocks import blocks, ragged, small_batches

UNKNOWN = "und"
BUCKETS = 1 << 15
N_SCRIPTS = 11


def scripts() -> np.ndarray:
    """The script range of a character's first byte; 255 for bytes that begin none."""
    table = np.full(256, 255, np.uint8)
    ranges = [(0x61, 0x7A), (0xC3, 0xCC), (0xCD, 0xCF), (0xD0, 0xD4), (0xD5, 0xD7), (0xD8, 0xDF), (0xE0, 0xE1), (0xE2, 0xE3), (0xE4, 0xE9), (0xEA, 0xED), (0xEE, 0xFF)]
    for n, (a, b) in enumerate(ranges):  # Latin, Latin with marks, Greek, Cyrillic, Armenian and Hebrew, Arabic and Syriac, Indic and other, kana and symbols, Han, Hangul, other
        table[a : b + 1] = n
    return table


def held_out(rest: int, of: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == rest, F.lit(False))


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the bytes before, at and after each place; a space is before the first and after the last."""
    wide = np.pad(data, 1, constant_values=0x20).astype(np.uint32)
    code = wide[1:-1] * np.uint32(65537)
    code += wide[:-2] * np.uint32(2654435761)
    code += wide[2:] * np.uint32(40503 * 65536 + 251)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(17)).astype(np.int32)


def learned(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): trigrams of all texts by language, and behind them the letters of each script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        script = scripts()
        for block in blocks(batches, "text"):
            langs = np.array(block.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                data, *_ = letter_runs(block.column("text").filter(pa.array(langs == lang)))
                own = sums.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                own[:BUCKETS] += np.bincount(trigrams(data)[data != 0x20], minlength=BUCKETS)
                begins = script[data]
                own[BUCKETS:] += np.bincount(begins[begins != 255], minlength=N_SCRIPTS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    rows = small_batches(docs).filter("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities by language and bucket, and the scripts that each language uses.

    The table has a row for each of most languages; a corpus that names more is
    refused before its counts are fetched, so what the driver holds is bounded.
    """

    def __init__(self, counts: DataFrame, least_share: float = 1e-4, most: int = 256):
        counts = written(counts, "language-counts")
        self.langs = sorted(r.lang for r in counts.select("lang").distinct().limit(most + 1).collect())
        if len(self.langs) > most:
            raise ValueError(f"the column lang has more than {most} values")
        table = counts.toArrow()
        lang = table.column("lang").combine_chunks().dictionary_encode()
        row = np.array([self.langs.index(x) for x in lang.dictionary.to_pylist()], np.int64)
        sums = np.zeros((len(self.langs), BUCKETS + N_SCRIPTS))
        sums[row[lang.indices.to_numpy()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
        grams, letters = sums[:, :BUCKETS] + 0.5, sums[:, BUCKETS:]
        self.scores = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32)
        self.uses = letters / np.maximum(letters.sum(1, keepdims=True), 1) >= least_share


def word_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each word, a column for each language."""
    if not len(starts):
        return np.zeros((0, len(model.langs)), np.float32)
    grams = trigrams(data)[ragged(starts, ends - starts)]
    at = np.cumsum(ends - starts) - (ends - starts)
    out = np.stack([np.add.reduceat(row[grams], at) for row in model.scores], axis=1)
    bits = np.append((1 << np.arange(N_SCRIPTS)), np.zeros(256 - N_SCRIPTS, np.int64)).astype(np.int32)
    used = np.bitwise_or.reduceat(bits[scripts()[data]][ragged(starts, ends - starts)], at)
    for mask in np.unique(used).tolist():
        able = model.uses[:, [i for i in range(N_SCRIPTS) if mask >> i & 1]].all(1)
        if able.any() and not able.all():
            out[np.ix_(used == mask, ~able)] -= 1e4
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path; first: the first word of each text, with the end.

    The best value is taken from all at each step, so that values stay within the
    penalty of 0, however long a text is.
    """
    kind = np.int8 if scores.shape[1] < 1 << 7 else np.int16 if scores.shape[1] < 1 << 15 else np.int32
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    longest = int(sizes.max(initial=0))
    value = np.zeros((len(sizes), scores.shape[1]), np.float32)
    came = np.empty(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)
    actives = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        n = actives[t]
        v, at = value[:n], begin[:n] + t
        best = v.argmax(1)
        v -= np.take_along_axis(v, best[:, None], 1)
        stay = v >= -penalty
        came[at] = np.where(stay, own, best[:, None])
        np.maximum(v, -penalty, out=v)
        v += scores[at]
    out = np.empty(len(scores), kind)
    state = np.zeros(len(sizes), kind)
    for t in reversed(range(longest)):
        n = actives[t]
        at = begin[:n] + t
        ending = sizes[:n] == t + 1
        if ending.any():
            state[:n][ending] = value[:n][ending].argmax(1)
        out[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return out


def identified(docs: DataFrame, model: Model, penalty: float = 10.0) -> DataFrame:
    """doc_id, lang_pred, score, and spans (first word, number of words, lang) of each document."""
    kind = "doc_id long, lang_pred string, score double, n_spans int, spans array<struct<first:int,n:int,lang:string>>"
    span = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("lang", pa.string())])
    langs = model.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNKNOWN], object)
        for block in blocks(batches, "text", 6 << 20):
            data, starts, ends, first = letter_runs(block.column("text"))
            sizes = np.diff(first)
            if langs:
                label = viterbi(word_scores(model, data, starts, ends), first, penalty)
            else:
                label = np.zeros(len(starts), np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            letters = np.bincount(of * len(names) + label, (ends - starts).astype(float), len(sizes) * len(names)).reshape(len(sizes), -1)
            # Bytes outside ASCII may be no letters; with ASCII letters there is no doubt.
            ascii_ = np.add.reduceat(np.append((data >= 0x61) & (data < 0x7B), False).astype(np.int32), np.minimum(starts, len(data))) if len(starts) else np.zeros(0, np.int32)
            sure = np.bincount(of, ascii_, len(sizes)) > 0
            texts = block.column("text")
            for i in np.flatnonzero(~sure).tolist():
                sure[i] = any(c.isalpha() for c in texts[i].as_py() or "")
            best = letters[:, : max(1, len(langs))].argmax(1)
            best = np.where(sure & bool(langs), best, len(langs))
            share = letters[np.arange(len(best)), best] / np.maximum(letters.sum(1), 1)
            new = np.ones(len(label), bool)
            new[1:] = (label[1:] != label[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            runs = np.bincount(of[at], minlength=len(sizes))
            items = pa.StructArray.from_arrays([pa.array((at - first[of[at]]).astype(np.int32)), pa.array(np.diff(np.append(at, len(label))).astype(np.int32)), pa.array(names[label[at]] if langs else [UNKNOWN] * len(at), pa.string())], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]), pa.int32()), items)
            columns = [block.column("doc_id").cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(np.where(best < len(langs), share, 0.0)), pa.array(runs.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_spans", "spans"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, kind)


def predicted(docs: DataFrame, rest: int = 2, of: int = 4, penalty: float = 10.0) -> DataFrame:
    """identified() for all documents by a model of those that are not held out (crc32 of doc_id modulo of is rest), with held_out."""
    model = Model(learned(docs.filter(~held_out(rest, of))))
    return identified(docs, model, penalty).select("doc_id", held_out(rest, of).alias("held_out"), "lang_pred", "score", "n_spans", "spans")
