"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bytebpe, exact, langid, licenses, minhash, packing, quality, simhash, spelling, sstable, substrings, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), keep=["doc_id"]).withColumn("distance", F.round("distance", 6))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_language_id, op3_license_scan, op4_substring_dedup, op5_packing, op6_token_shards, op7_byte_bpe, op8_quality_rules, op9_toxicity, op10_exact_dedup, op11_spelling_variants, op12_filter_audit, op13_minhash)}


OP10 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
           FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


OP4 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     win AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13) t),
     firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
     hit AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT win.doc_id, i, unnest(range(13)) AS k FROM win JOIN firsts ON win.g = firsts.g WHERE f < win.doc_id) t),
     gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
"""


def op3_sql() -> str:
    """The base part and the bands of diagonals over the default templates, and each row's best band."""
    rows = []
    for number, (phrase, label, exact) in enumerate([(k, v, True) for k, v in licenses.BASE.items()] + [(k, v, False) for k, v in licenses.NOTICES.items()]):
        words = phrase.split()
        rows += [f"({number}, '{label}', {exact}, {len(words)}, {i}, '{words[i]}', '{words[i + 1]}')" for i in range(len(words) - 1)]
    return (
        "WITH t(template, label, exact, size, nth, t1, t2) AS (VALUES " + ", ".join(rows) + r"""),
     w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
     g AS (SELECT doc_id, i - 1 AS pos, ws[i] AS w1, ws[i + 1] AS w2 FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w) u),
     m AS (SELECT DISTINCT doc_id, template, label, exact, size, nth, pos - nth AS d FROM g JOIN t ON w1 = t1 AND w2 = t2),
     p AS (SELECT doc_id, label, d FROM m WHERE exact GROUP BY doc_id, template, label, size, d HAVING count(*) = size - 1),
     s AS (SELECT DISTINCT doc_id, template, label, size, d FROM m WHERE NOT exact),
     b AS (SELECT s.doc_id, s.label, count(DISTINCT m.nth) / (s.size - 1) AS covered FROM s JOIN m ON m.doc_id = s.doc_id AND m.template = s.template AND m.d BETWEEN s.d AND s.d + 4 GROUP BY s.doc_id, s.template, s.label, s.size, s.d),
     x AS (SELECT doc_id, count(*) AS n_base, min(d) AS first_word, max(d) AS last_word, list(DISTINCT label) AS found FROM p GROUP BY doc_id),
     y AS (SELECT doc_id, max(covered) AS covered, list(DISTINCT label) FILTER (covered >= 0.8) AS noticed FROM b GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(noticed, [])))), ','), '') AS labels,
       greatest(CASE WHEN n_base > 0 THEN 1 ELSE 0 END::DOUBLE, coalesce(covered, 0)::DOUBLE) AS score
FROM w LEFT JOIN x ON x.doc_id = w.doc_id LEFT JOIN y ON y.doc_id = w.doc_id"""
    )


def op8_sql() -> str:
    """The base counts, and the distance over the listed languages in Latin script (the only ones of the given tables)."""
    words = sorted({w for ws in quality.COMMON_WORDS.values() for w in ws})
    bins = ", ".join(f"('{w}', '{x}')" for w in words for x in (w, w.capitalize()))
    langs = ", ".join(f"'{x}'" for x in quality.COMMON_WORDS)
    count = {k: f"length(x) - length(regexp_replace(x, '{p[:-1]}', '', 'g'))".replace("!?'", "!?''") for k, p in quality.CLASSES.items()}
    classes = ", ".join(f"{v} AS {k}" for k, v in count.items())
    names = [*quality.CLASSES, "white", "other"]
    return (
        r"WITH b AS (SELECT doc_id, CASE WHEN trim(lang) NOT IN ('', 'und') THEN lang END AS lang, coalesce(text, '') AS x FROM documents), "
        r"w AS (SELECT doc_id, lang, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws, list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls, "
        rf"length(x) - length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS white, length(x) AS chars, length(x) - length(regexp_replace(x, '[{quality.SYMBOLS}]', '', 'g')) AS n_symbols, {classes} FROM b), "
        "r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM "
        "(SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) u) v) y WHERE n > 1) z GROUP BY doc_id), "
        "c AS (SELECT w.*, len(ws) AS n_words, coalesce(n, 0) AS n_repeat_words, chars - upper - lower - digit - stop - symbol - white AS other FROM w LEFT JOIN r ON r.doc_id = w.doc_id), "
        "j AS (SELECT * FROM c WHERE n_words >= 50 AND chars >= 200 AND other <= upper + lower), "
        f"k(bin, spelled) AS (VALUES {bins}), f AS (SELECT doc_id, bin, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS spelled FROM j) u JOIN (SELECT DISTINCT * FROM k) k ON k.spelled = u.spelled GROUP BY doc_id, bin), "
        f"h AS (SELECT doc_id, lang, 'c' AS kind, unnest([{', '.join(repr(n) for n in names)}]) AS bin, unnest([{', '.join(names)}]) / chars AS p FROM j "
        "UNION ALL SELECT j.doc_id, lang, 'w', q.bin, coalesce(f.n, 0) / n_words FROM j CROSS JOIN (SELECT DISTINCT bin FROM k) q LEFT JOIN f ON f.doc_id = j.doc_id AND f.bin = q.bin "
        "UNION ALL SELECT j.doc_id, lang, 'w', '', (n_words - coalesce(t.n, 0)) / n_words FROM j LEFT JOIN (SELECT doc_id, sum(n) AS n FROM f GROUP BY doc_id) t ON t.doc_id = j.doc_id), "
        f"q AS (SELECT lang, kind, bin, avg(p) AS q FROM h WHERE lang IN ({langs}) GROUP BY lang, kind, bin), "
        "d AS (SELECT h.doc_id, h.lang, q.lang AS other, h.kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) / 2) AS js FROM h JOIN q ON q.kind = h.kind AND q.bin = h.bin GROUP BY ALL), "
        "e AS (SELECT doc_id, lang, other, avg(js) AS pair, max(js) FILTER (kind = 'c') AS alone FROM d GROUP BY ALL), "
        f"s AS (SELECT doc_id, CASE WHEN lang IS NULL THEN least(min(pair), min(alone)) ELSE min(pair) END AS distance FROM e WHERE lang IS NULL OR lang IN ({langs}) GROUP BY doc_id, lang), "
        "a AS (SELECT c.doc_id, n_words, chars - white AS word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, distance FROM c LEFT JOIN s ON s.doc_id = c.doc_id) "
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(distance, 6) AS distance, NOT base_failed AND coalesce(distance <= 0.28, true) AS kept FROM a"
    )


OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
     w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws, min(doc_id) OVER (PARTITION BY x) AS least FROM d),
     l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
     f AS (SELECT part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
                  concat(CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END, CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 2 * length(x) THEN 'C' END,
                         CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > least THEN 'E' END) AS fails
           FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
     g AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY part, fails),
     c(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
     o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM c a, c b, c c, c d, c e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
     s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
     t AS (SELECT part, filter_order, step, filter_order[step] AS own, n, good, toxic, fails = filter_order[step] AS alone, contains(fails, filter_order[step]) AS hit,
                  regexp_matches(fails, '[' || filter_order[:step] || ']') AS gone, step > 1 AND regexp_matches(fails, '[' || filter_order[:greatest(step - 1, 1)] || ']') AS earlier
           FROM g, s),
     k AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone) AS kept, sum(n) FILTER (hit AND NOT earlier) AS removed, sum(n) FILTER (hit AND earlier) AS redundant, sum(n) FILTER (alone) AS unique_fails,
                  sum(good) FILTER (hit AND NOT earlier) AS good_lost, sum(toxic) FILTER (hit AND NOT earlier) AS toxic_lost
           FROM t GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
       coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::bigint AS shapley
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": op3_sql(), "op4_substring_dedup": OP4, "op8_quality_rules": op8_sql(), "op10_exact_dedup": OP10, "op12_filter_audit": OP12}
