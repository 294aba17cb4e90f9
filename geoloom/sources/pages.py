"""Dumps: wiki pages and tag usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triples import written

from ..functions.text import normal_key, stripped


def key_pages(pages: DataFrame) -> DataFrame:
    """(key, wikitext) of the pages about keys; a page without text has an empty one."""
    return pages.filter(F.col("title").startswith("Key:")).select(normal_key(F.substr("title", F.lit(5))).alias("key"), F.coalesce("wikitext", F.lit("")).alias("wikitext"))


def tag_pages(pages: DataFrame) -> DataFrame:
    """(key, value, wikitext) of the pages about tags; the value begins after the first equals sign."""
    found = pages.filter(F.col("title").rlike("^Tag:[^=]*="))
    spelled = lambda i: F.replace(stripped(F.regexp_extract("title", r"(?s)^Tag:([^=]*)=(.*)$", i)), F.lit(" "), F.lit("_"))
    return found.select(spelled(1).alias("key"), spelled(2).alias("value"), F.coalesce("wikitext", F.lit("")).alias("wikitext"))


def key_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("key").agg(F.sum("n").alias("n"))


def tag_usage(tags: DataFrame) -> DataFrame:
    return tags.groupBy("key", "value").agg(F.count("*").alias("n"))


def redirects(pages: DataFrame) -> DataFrame:
    """(title, target) of the pages that only lead to another; of a title's several the first in order."""
    target = F.regexp_extract("wikitext", r"(?iU)^\s*#redirect\s*:?\s*\[\[\s*:?([^\]|#]+?)\s*[\]|#]", 1)
    rows = pages.select("title", target.alias("target")).filter("title is not null and target <> ''")
    return rows.groupBy("title").agg(F.min("target").alias("target"))


def resolved(pages: DataFrame) -> DataFrame:
    """(title, target, steps, outcome) of each redirect, followed to its end: outcome is page, missing (no page of that title) or loop (then target and steps are null).

    Each round joins what is known with itself, so the steps that are known
    double. A chain that ends has titles with any lesser number of steps left,
    so a round in which none comes to its end leaves loops, and what leads into
    them. Each round is written.
    """
    moved = written(redirects(pages))
    known = moved.withColumn("steps", F.lit(1).cast("long"))
    ends = moved.select(F.col("title").alias("target"), F.lit(True).alias("goes_on"))
    going_on = lambda: known.join(ends, "target", "left_semi").count()
    before, open_ = None, going_on()
    while open_ and open_ != before:
        ahead = known.select(F.col("title").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        known = known.join(ahead, "target", "left")
        known = written(known.select("title", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
        before, open_ = open_, going_on()
    there = pages.select(F.col("title").alias("target")).distinct().withColumn("there", F.lit(True))
    out = known.join(ends, "target", "left").join(there, "target", "left")
    loop = F.col("goes_on").isNotNull()
    outcome = F.when(loop, "loop").when(F.col("there").isNotNull(), "page").otherwise("missing")
    return out.select("title", F.when(~loop, F.col("target")).alias("target"), F.when(~loop, F.col("steps")).alias("steps"), outcome.alias("outcome"))
