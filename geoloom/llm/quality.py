"""Quality rules: base counts, and divergence from references of each language.

A text's histogram over character classes and its histogram over common words
are compared with those of each reference language by the Jensen-Shannon
distance (base 2, so from 0 to 1). The text's distance is the smallest over the
languages of the mean of both. A reference is the mean histogram of all
documents of a language that are long enough. Only DataFrame functions are
used: all that is counted in a text is counted once, within its row, without a
shuffle, and written; the references are means over the written counts, one row
for each language and script, and the verdicts are read from the same table.

The languages are those of the table. The common words of four are given below;
for each other value of lang with ``min_docs`` documents that are long enough,
the ``most_words`` words of the largest mean share in its documents take their
place. A reference belongs to a language and a script (most letters of the
text), and a text is compared with the references of its own script.

Defined cases: a null text counts as empty, has no word and so fails the base
rules; texts under ``min_words`` words or ``min_chars`` characters are not
judged by divergence; a text whose language has no reference in the text's
script is not judged either, the base rules alone decide (so with an empty
table, or for a language of fewer than ``min_docs`` long texts without a word
list); a text of unknown language (lang null, empty or "und") is compared with
all references of its script, and as its common words may be those of no
reference, the smaller of its class distance and the mean counts; rows with
equal texts and languages get equal verdicts; further columns of the input are
kept, but for those named like a count or a verdict, which ``judged`` replaces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Most frequent function words of each reference language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "it", "as", "be", "by", "on", "this", "are", "from"],
    "fr": ["le", "de", "la", "et", "les", "des", "en", "un", "du", "que", "qui", "dans", "par", "pour", "sur", "une", "est", "avec"],
    "de": ["der", "die", "und", "das", "in", "den", "von", "zu", "mit", "ist", "des", "dem", "nicht", "ein", "eine", "im", "auf", "als"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al"],
}
#: Character classes beside white space; what is in none is "other".
CLASSES = {"upper": "[A-Z]+", "lower": "[a-z]+", "digit": "[0-9]+", "stop": r"[.,;:!?'\"()\-]+", "symbol": r"[#*$%&|<>=+~^_/\\@{}\[\]`]+"}
N_CLASSES = len(CLASSES) + 2
BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Scripts beside Latin, told apart in texts with more characters of the class "other" than letters of ASCII.
SCRIPTS = ["Cyrillic", "Greek", "Arabic", "Hebrew", "Armenian", "Georgian", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Thai", "Lao", "Tibetan", "Myanmar", "Khmer", "Ethiopic", "Hangul", "Hiragana", "Katakana", "Han", "Cherokee", "Mongolian", "Syriac", "Thaana"]
OTHER_SCRIPT = "other"  # letters, but of none of these and not of Latin


def language() -> Column:
    """lang, or null where it names none."""
    return F.when(~F.trim("lang").isin("", "und"), F.col("lang"))


def spaced(text: Column) -> Column:
    """text with a space for each white-space character."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def pieces_of(text: Column) -> Column:
    """What stands between white-space characters: one more than there are of these. A split at one plain character needs no regular expression."""
    return F.split(spaced(F.coalesce(text, F.lit(""))), " ")


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def base_counts(rows: DataFrame) -> DataFrame:
    """rows (text_, never null) with the base counts, all long, the array words_, chars_ and class_counts_."""
    out = rows.withColumns({"pieces_": pieces_of(F.col("text_")), "chars_": F.char_length("text_").cast("long"), "left_": without(F.col("text_"), CLASSES["lower"])})
    out = out.withColumns({
        "words_": F.array_remove("pieces_", ""),
        "white_": (F.size("pieces_") - 1).cast("long"),
        "lower_": F.col("chars_") - F.char_length("left_"),
        "left_": without(F.col("left_"), WHITE),
        "lines_": F.filter(F.split("text_", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    # Each class is counted by what its removal takes from the text, which is shorter each time.
    counts = {"lower": F.col("lower_")}
    for name in CLASSES:
        if name == "symbol":
            out = out.withColumn("n_symbols", (F.char_length("left_") - F.char_length(without(F.col("left_"), f"[{SYMBOLS}]+"))).cast("long"))
        if name != "lower":
            out = out.withColumn("less_", without(F.col("left_"), CLASSES[name]))
            out = out.withColumns({f"{name}_": (F.char_length("left_") - F.char_length("less_")).cast("long"), "left_": F.col("less_")})
            counts[name] = F.col(f"{name}_")
    out = out.withColumn("class_counts_", F.array(*[counts[name] for name in CLASSES], F.col("white_"), F.char_length("left_").cast("long")))
    n = F.size("words_")
    either = lambda a, b: F.xxhash64(a, b)
    side = lambda c, at, less: F.slice(c, F.lit(at), F.greatest(n - less, F.lit(0)))
    # A window's hash from those of its words: of two, of four, of five words.
    out = out.withColumn("hash_", F.transform("words_", lambda w: F.xxhash64(w)))
    out = out.withColumn("two_", F.zip_with(side("hash_", 1, 1), side("hash_", 2, 1), either))
    out = out.withColumn("four_", F.zip_with(side("two_", 1, 3), side("two_", 3, 3), either))
    out = out.withColumn("grams_", F.zip_with(side("four_", 1, 4), side("hash_", 5, 4), either))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.col("chars_") - F.col("white_"),
        "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        "n_grams_": F.size(F.array_distinct("grams_")),
    })
    # Most texts repeat no window: only the others are sorted.
    repeats = F.col("n_grams_") < F.size("grams_")
    out = out.withColumn("sorted_", F.when(repeats, F.sort_array(F.transform("grams_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(F.col("sorted_"), j)["h"] == x["h"], F.lit(False))
    out = out.withColumn("starts_", F.sort_array(F.transform(F.filter("sorted_", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    # A start covers five words, or those up to the next start.
    covered = F.aggregate(
        F.transform("starts_", lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("starts_"), j + 1), p + 5) - p).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def bins(common: dict[str, list[str]]) -> dict[str, str]:
    """A letter for each common word, the same for its capitalised form."""
    words = sorted({w for ws in common.values() for w in ws})
    codes = {w: chr(0x4E00 + i) for i, w in enumerate(words)}
    return codes | {w.capitalize(): c for w, c in codes.items()}


def measured(docs: DataFrame, keep: list[str], common: dict[str, list[str]]) -> DataFrame:
    """row_ (the columns of keep), lang_, the base counts, chars_, class_counts_, word_counts_ and script_ of each row: each text is read once, and the result written."""
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("row_"), language().alias("lang_"), F.coalesce("text", F.lit("")).alias("text_"))
    out = base_counts(rows)
    codes = bins(common)
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    marks = F.array_join(F.transform(F.filter("words_", lambda w: w.isin(*codes)), lambda w: F.element_at(table, w)), "")
    out = out.withColumn("marks_", marks)
    per_word = F.transform(F.split(F.lit(" ".join(sorted(set(codes.values())))), " "), lambda c: F.char_length("marks_") - F.char_length(F.replace(F.col("marks_"), c, F.lit(""))))
    rest = F.array(F.col("n_words").cast("int") - F.char_length("marks_"))
    # The pattern as a lambda's variable: thirty patterns written out would make generated code too long to be compiled well.
    n_of = lambda script: F.char_length("text_") - F.char_length(F.regexp_replace("text_", F.concat(F.lit(r"\p{Is"), script, F.lit("}+")), F.lit("")))
    counts = F.transform(F.array(*map(F.lit, [*SCRIPTS, "Latin", "Alphabetic"])), lambda x: F.struct(n_of(x).alias("n"), x.alias("script")))
    other = F.get("class_counts_", F.lit(N_CLASSES - 1)) > F.get("class_counts_", F.lit(0)) + F.get("class_counts_", F.lit(1))
    out = out.withColumns({"word_counts_": F.concat(per_word, rest), "counts_": F.when(other, counts)})
    most = F.array_max(F.filter("counts_", lambda x: (x["n"] > 0) & (x["script"] != "Alphabetic")))["script"]
    lettered = F.exists("counts_", lambda x: x["n"] > 0)
    # Signs alone are of no script: they are judged as Latin.
    out = out.withColumn("script_", F.coalesce(most, F.when(lettered, F.lit(OTHER_SCRIPT)), F.lit("Latin")))
    return written(out.select("row_", "lang_", *BASE_COUNTS, "chars_", "class_counts_", "word_counts_", "script_"), "quality-counts")


def shares(rows: DataFrame) -> DataFrame:
    """measured() rows with class_hist_ and word_hist_ for the counts."""
    share = lambda counts, total: F.transform(counts, lambda x: x / F.greatest(F.col(total), F.lit(1)))
    return rows.withColumns({"class_hist_": share("class_counts_", "chars_"), "word_hist_": share("word_counts_", "n_words")})


def with_derived(docs: DataFrame, common: dict[str, list[str]], min_words: int, min_chars: int, min_docs: int, most_words: int) -> dict[str, list[str]]:
    """common, and words for each further language of the table that has min_docs long enough documents."""
    counts = docs.groupBy(language().alias("lang")).count().filter(F.col("lang").isNotNull() & ~F.col("lang").isin(*common) & (F.col("count") >= min_docs))
    further = sorted(r["lang"] for r in counts.collect())
    if not further:
        return common
    long = docs.filter(F.col("lang").isin(*further)).select("lang", F.array_remove(pieces_of(F.col("text")), "").alias("words_"), F.char_length("text").alias("chars_"))
    long = long.withColumn("n_words", F.size("words_")).filter((F.col("n_words") >= min_words) & (F.col("chars_") >= min_chars))
    # A document's weight is 1, however long it is: the sum is min_docs at least where there are as many of them.
    weights = long.select("lang", F.explode(F.transform("words_", F.lower)).alias("word"), (1 / F.col("n_words")).alias("share")).groupBy("lang", "word").agg(F.round(F.sum("share"), 6).alias("share"))
    enough = [r["lang"] for r in long.groupBy("lang").count().filter(F.col("count") >= min_docs).collect()]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "word"))
    best = weights.filter(F.col("lang").isin(*enough)).withColumn("place", place).filter(F.col("place") <= most_words).collect() if enough else []
    return common | {k: [r["word"] for r in best if r["lang"] == k] for k in sorted(enough)}


def references(rows: DataFrame, common: dict[str, list[str]], min_words: int, min_chars: int, min_docs: int) -> dict[tuple[str, str], tuple[list[float], list[float]]]:
    """Mean histograms over all long enough measured() rows of each language in common and each script that min_docs of them have (Latin, for the listed languages: any)."""
    long = shares(rows.filter(F.col("lang_").isin(*common) & (F.col("n_words") >= min_words) & (F.col("chars_") >= min_chars)))
    n_words = len(set(bins(common).values())) + 1
    means = [F.avg(F.get(F.col("class_hist_"), F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)] + [F.avg(F.get(F.col("word_hist_"), F.lit(i))).alias(f"w{i}") for i in range(n_words)]
    found = long.select("lang_", "script_", "class_hist_", "word_hist_").groupBy("lang_", "script_").agg(F.count("*").alias("n"), *means).collect()
    found = [r for r in found if r["n"] >= min_docs or (r["lang_"] in COMMON_WORDS and r["script_"] == "Latin")]
    return {(r["lang_"], r["script_"]): ([r[f"c{i}"] for i in range(N_CLASSES)], [r[f"w{i}"] for i in range(n_words)]) for r in found}


def js_distance(p: Column, q: list[float]) -> Column:
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    # One text, so that the plan has one literal after folding, whatever the length.
    q_ = F.split(F.lit(" ".join(map(repr, q))), " ").cast("array<double>")
    terms = F.zip_with(p, q_, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judged(
    docs: DataFrame,
    common: dict[str, list[str]] = COMMON_WORDS,
    min_words: int = 50,
    min_chars: int = 200,
    max_distance: float = 0.28,
    min_docs: int = 20,
    most_words: int = 18,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns of keep (all of docs, if None) with the base counts, base_failed, distance (null where not judged) and kept.

    The result is read from the written counts, so filters on it cost no second count.
    """
    common = with_derived(docs, common, min_words, min_chars, min_docs, most_words)
    keep = docs.columns if keep is None else keep
    rows = measured(docs, keep, common)
    refs = references(rows, common, min_words, min_chars, min_docs)
    out = shares(rows)
    fail = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = reduce(lambda a, b: a | b, [(F.col("lang_") == k) & (F.col("script_") == s) for k, s in refs], F.lit(False))
    comparable = (F.col("n_words") >= min_words) & (F.col("chars_") >= min_chars) & (F.col("lang_").isNull() | known)
    of_class = {k: js_distance(F.col("class_hist_"), c) for k, (c, _) in refs.items()}
    of_both = {k: (of_class[k] + js_distance(F.col("word_hist_"), w)) / 2 for k, (_, w) in refs.items()}
    # The smallest over the references of the text's script; nulls are those of other scripts.
    smallest = lambda by: F.array_min(F.array(*[F.when(F.col("script_") == k[1], by[k]) for k in sorted(by)])) if by else F.lit(None).cast("double")
    nearest = F.when(F.col("lang_").isNull(), F.least(smallest(of_both), smallest(of_class))).otherwise(smallest(of_both)) if refs else smallest(of_both)
    out = out.withColumns({"base_failed": fail, "distance": F.when(comparable, nearest)})
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= max_distance, F.lit(True)))
    made = [*BASE_COUNTS, "base_failed", "distance", "kept"]
    return out.select(*[F.col("row_").getField(c).alias(c) for c in keep if c not in made], *made)


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole_"), "text", "lang")  # columns named like a count stay as they are
    return judged(inner, keep=["whole_"], **how).filter("kept").select("whole_.*")
