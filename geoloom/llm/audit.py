"""How filters of documents interact, whatever order they are applied in.

A coalition of filters removes the documents that fail one of them. What each
of the 2**n coalitions removes is counted in one pass (documents are told apart
by part and by the filters that they fail alone), and everything else follows
from those numbers: a step's share in an order is the difference of two
coalitions, and the Shapley value of a filter is the difference of two
potentials. The potential of a coalition (Hart and Mas-Colell) is found from
those of the coalitions with one filter less:

    P(S) = (v(S) + sum of P(S without i) over i in S) / size of S

and the Shapley value of i is P(all) - P(all without i). Potentials are kept
times n!, at which they are whole numbers, so no rounding takes place.

Only DataFrame functions are used. Defined cases: a null text counts as empty,
and all empty texts are copies of one another; a null source is the part '';
rows without doc_id are nobody's later copy and have no labels; rows that
repeat a doc_id and its text are no copies of each other; a document with
several labels has the larger of each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAKS = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def failures(text: Column) -> Column:
    """The filters that a text fails by itself, as bits: A few words, B repeated words, C capitals, D signs."""
    words = F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")
    n = F.size(words)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    tests = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.char_length(text), text.rlike(r"[#$%&*|]")]
    return reduce(Column.__add__, [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)])


def failed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of each part fail just the filters of mask, and how many of them are labelled good and toxic.

    The last filter, E, fails copies of a text of a smaller doc_id. Texts are
    told apart by SHA-256; rows are counted before they meet, so a text's group
    holds no more rows than there are parts and labels.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    told = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id"))
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    known = rows.filter("doc_id is not null").join(told, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    rows = known.unionByName(rows.filter("doc_id is null").withColumns({"good": no, "toxic": no}))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unknown"), first.alias("first"))
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    groups = groups.join(least, "digest")
    own = F.coalesce(F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")), F.lit(0)) + F.col("unknown")
    last = 1 << (len(LETTERS) - 1)
    split = F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - own).alias("n")))
    groups = groups.select("part", "good", "toxic", F.explode(split).alias("x")).filter("x.n > 0")
    share = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("x.n"))), F.lit(0)).alias(c)
    return groups.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), share("good"), share("toxic"))


def games(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, total, removed, good, toxic): for each part what each coalition of filters removes, arrays with the coalition's bits as their place."""

    def removed(c: str) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c))), F.lit(0)) for s in range(1 << n_filters)])

    return counts.groupBy("part").agg(F.sum("n").alias("total"), removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic"))


def potentials(removed: Column, n_filters: int) -> Column:
    """n! times the potential of each coalition, from the empty one up."""
    scale = math.factorial(n_filters)

    def step(done: Column, s: Column) -> Column:
        below = [F.when(s.bitwiseAND(1 << i) != 0, F.get(done, s - (1 << i))).otherwise(0) for i in range(n_filters)]
        value = F.call_function("div", F.get(removed, s) * scale + reduce(Column.__add__, below), F.bit_count(s).cast("long"))
        return F.concat(done, F.array(value))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), step)


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (summed over all orders). counts: part, mask, n, good, toxic."""
    n, full = len(letters), (1 << len(letters)) - 1
    rows = games(counts, n).withColumn("potential", potentials(F.col("removed"), n))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    rows = rows.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.substr(F.col("filter_order"), F.col("step"), F.lit(1))
    place = F.instr(F.lit(letters), letter)
    earlier = F.substr(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    before = reduce(Column.__add__, [F.when(earlier.contains(x), 1 << i).otherwise(0) for i, x in enumerate(letters)])
    rows = rows.withColumns({"own": F.element_at(F.array(*[F.lit(1 << i) for i in range(n)]), place), "before": before})
    after = F.col("before") + F.col("own")
    gained = lambda c: F.get(F.col(c), after) - F.get(F.col(c), F.col("before"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.get("removed", after)).alias("kept"), gained("removed").alias("removed"), (F.get("removed", F.col("own")) - gained("removed")).alias("redundant"),
        (F.get("removed", F.lit(full)) - F.get("removed", full - F.col("own"))).alias("unique_fails"), gained("good").alias("good_lost"), gained("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(full)) - F.get("potential", full - F.col("own"))).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters of ``failed`` within each source."""
    return interactions(failed(docs, labels))
