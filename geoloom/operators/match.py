"""Patterns over triples, and set operations on graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.sources.triples import written

PLACES = ("s", "p", "o")


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The triples of a pattern; None stands for any term."""
    tests = [F.col(c) == v for c, v in zip(PLACES, (s, p, o), strict=True) if v is not None]
    return triples.filter(reduce(Column.__and__, tests)) if tests else triples


def pattern_rows(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """The ways to satisfy one pattern; a variable that stands twice has one value, and none is null."""
    rows, names = triples, {}
    for place, term in zip(PLACES, pattern, strict=True):
        if not term.startswith("?"):
            rows = rows.filter(F.col(place) == term)
        elif term[1:] in names:
            rows = rows.filter(F.col(place) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = place
    return rows.select(*[F.col(place).alias(name) for name, place in names.items()]).dropna()


def joined(parts: list[tuple[object, DataFrame]]) -> DataFrame:
    """The parts joined in the given order, each by the variables it shares with those before it."""
    out: DataFrame | None = None
    for what, rows in parts:
        shared = [] if out is None else [c for c in rows.columns if c in out.columns]
        if out is not None and not shared:
            raise ValueError(f"{what} shares no variable with the patterns before it")
        out = rows if out is None else out.join(rows, shared)
    return out


def star(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """The ways to satisfy patterns that share a variable subject and have given predicates.

    One pass over these predicates' triples, grouped by subject: for each pattern
    whether it is met, and its least and greatest object. Where these are one,
    as for most subjects, they are the answer; only subjects with several objects
    of a pattern are joined pattern by pattern, so no list of objects is held.
    """
    subject = patterns[0][0][1:]
    wanted = triples.filter(F.col("p").isin(sorted({p for _, p, _ in patterns})))
    met, tests, facts, single, names = [], [], [], [], {}
    for i, (s, p, o) in enumerate(patterns):
        test = F.col("p") == p
        if not o.startswith("?"):
            test &= F.col("o") == o
        elif o == s:
            test &= F.col("o") == F.col("s")
        else:
            facts += [F.min(F.when(test, F.col("o"))).alias(f"least_{i}"), F.max(F.when(test, F.col("o"))).alias(f"most_{i}")]
            single.append(F.col(f"least_{i}") == F.col(f"most_{i}"))
            names.setdefault(o[1:], []).append(F.col(f"least_{i}"))
        tests.append(test)
        met.append(F.max(test).alias(f"met_{i}"))
    of_pattern = reduce(Column.__or__, tests)
    every = reduce(Column.__and__, [F.col(f"met_{i}") for i in range(len(patterns))])
    found = wanted.filter(of_pattern & F.col("s").isNotNull()).groupBy("s").agg(*met, *facts).filter(every)
    if not single:
        return found.select(F.col("s").alias(subject))
    found = written(found)
    one = reduce(Column.__and__, single)
    equal = [a == b for same in names.values() for a, b in zip(same, same[1:])]
    out = found.filter(reduce(Column.__and__, equal, one)).select(F.col("s").alias(subject), *[same[0].alias(name) for name, same in names.items()])
    several = found.filter(~one).select("s")
    if several.isEmpty():
        return out
    own = wanted.join(several, "s", "left_semi").select(*PLACES).distinct()
    return out.unionByName(joined([(x, pattern_rows(own, x)) for x in patterns]))


def matched(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each way to satisfy all patterns; terms that begin with ? are variables, the columns of the result.

    Patterns with one variable subject and given predicates are a star and
    answered by one pass. Stars and other patterns are joined in the order in
    which they begin, each with a variable of those before it if it has one; one
    that shares none is refused. A graph is a set: repeated triples count once in a star.
    """
    groups: dict[object, list[tuple[str, str, str]]] = {}
    for i, x in enumerate(patterns):
        groups.setdefault(x[0] if x[0].startswith("?") and not x[1].startswith("?") else i, []).append(x)
    parts = [(own, star(triples, own) if len(own) > 1 else pattern_rows(triples, own[0])) for own in groups.values()]
    return joined(parts)


def present(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(known.select(*on), on, "left_semi")


def absent(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(known.select(*on), on, "left_anti")


def first_object(triples: DataFrame) -> DataFrame:
    """One object for each subject and predicate: the smallest."""
    return triples.groupBy("s", "p").agg(F.min("o").alias("o"))


def only_one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The value of the keys that have exactly one row."""
    return rows.groupBy(key).agg(F.count("*").alias("n_"), F.min(value).alias(value)).filter("n_ = 1").drop("n_")


def removed(triples: DataFrame, patterns: list[tuple[str | None, str | None, str | None]]) -> DataFrame:
    """triples without those of any pattern; None stands for any term."""
    hit = lambda pattern: reduce(Column.__and__, [F.col(c).eqNullSafe(v) for c, v in zip(PLACES, pattern, strict=True) if v is not None], F.lit(True))
    return triples.filter(~reduce(Column.__or__, [hit(x) for x in patterns])) if patterns else triples


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return at_most(rows, 1, key, order)


def at_most(rows: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank_") <= n).drop("rank_")


def last_values(tags: DataFrame) -> DataFrame:
    """The last value of each entity's key."""
    return tags.groupBy("entity_id", "key").agg(F.max_by("value", "ord").alias("value"))


def asked(rows: DataFrame) -> DataFrame:
    """One row: whether there is any."""
    return rows.limit(1).agg((F.count("*") > 0).alias("answer"))
