"""Exact duplicates by an extendible-hash index kept in shared files.

The directory maps the leading bits of a key (XXH64 of the normalised text) to
buckets. It starts with one slot and doubles; a bucket that holds more than
``bucket_rows`` rows is split by one more bit, until it fits or is
``max_depth`` bits deep (copies of one text share a key and no split parts
them). The doubling is worked out from the number of rows of each prefix. Texts
and lookups alike go through the directory to their bucket: texts are grouped
there by key and bytes, copies merging before the shuffle; one owner task for a
bucket chains texts that share a key but differ and writes its entries to the
index's files; a row finds its entry by bucket, key and digest.

Only DataFrame functions are used.

Defined cases: null texts count as empty, and all empty texts are copies of one
another; of rows that agree in text length and doc_id too, one stays; a null
doc_id never stays when its group holds another; an empty table gives an empty
result; further columns are kept by ``drop_exact_copies`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

WHITE_SPACE = " \t\n\x0b\x0c\r"


def without_white_space(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def buckets(keys: DataFrame, bucket_rows: int, max_depth: int) -> DataFrame:
    """(depth, slot) of the buckets that doubling ends with: they fit, or are as deep as can be, and the bucket they were split from does not fit."""
    counts = keys.groupBy("prefix").agg(F.count("*").alias("n"))
    slots = counts.select("n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "prefix").withColumn("slot", F.expr(f"shiftright(prefix, {max_depth} - depth)"))
    full = slots.groupBy("depth", "slot").agg(F.sum("n").alias("rows")).withColumn("fits", (F.col("rows") <= bucket_rows) | (F.col("depth") == max_depth))
    above = full.filter("not fits").select((F.col("depth") + 1).alias("depth"), F.col("slot").alias("half"))
    # A bucket has two halves: no key of this join has more than two rows.
    split = full.filter("fits and depth > 0").withColumn("half", F.expr("shiftright(slot, 1)")).join(above, ["depth", "half"])
    return split.select("depth", "slot").unionByName(full.filter("fits and depth = 0").select("depth", "slot"))


def directory(found: DataFrame, depth: int) -> DataFrame:
    """(slot, bucket, depth): the bucket of each value of the leading depth bits. Buckets of less depth have several slots."""
    first = F.expr(f"cast(shiftleft(cast(slot as long), {depth} - depth) as int)")
    own = F.sequence(first, first + F.expr(f"cast(shiftleft(1L, {depth} - depth) as int)") - 1)
    return found.select(F.explode(own).alias("slot"), first.alias("bucket"), "depth")


def leading(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def keyed_columns(docs: DataFrame) -> list[Column]:
    norm = without_white_space(docs["text"])
    return [docs["doc_id"], F.char_length(F.coalesce(docs["text"], F.lit(""))).cast("long").alias("n_chars"), norm.alias("norm"), F.xxhash64(norm).alias("key")]


def indexed(docs: DataFrame, bucket_rows: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The index's entries (bucket, depth, key, chain, digest, keep_row, group_size), written in files of bucket ranges, and the rows (row, doc_id, n_chars, key, bucket, digest) that were entered."""
    return built(docs, bucket_rows, max_depth)[:2]


def built(docs: DataFrame, bucket_rows: int, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame, Column]:
    """indexed(), the directory's slots, and the slot of a column key."""
    if not 0 < max_depth <= 16:
        raise ValueError("max_depth must be from 1 to 16")
    texts = docs.select(*keyed_columns(docs))
    digest = F.unhex(F.sha2("norm", 256)).alias("digest")
    # The number that a row gets here is fixed by being written.
    keys = written(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "key", leading(F.col("key"), max_depth).alias("prefix"), digest), "exact-keys")
    found = written(buckets(keys, bucket_rows, max_depth), "exact-buckets")
    depth = found.agg(F.max("depth")).first()[0] or 0
    slots = F.broadcast(directory(found, depth))  # 2**max_depth rows at most
    place = leading(F.col("key"), depth).alias("slot")

    # Texts are sent to their buckets, copies merging before; there their bytes are compared, as they are part of what is grouped by.
    entered = texts.select(place, "key", "norm").join(slots, "slot").groupBy("bucket", "depth", "key", "norm").agg(F.count("*").alias("group_size"))
    entered = entered.select("bucket", "depth", "key", digest, "group_size")
    rows = keys.select("row", "doc_id", "n_chars", "key", place, "digest").join(slots.drop("depth"), "slot").drop("slot")
    # Rows that agree in all that decides are counted first, so that the winner tells how many there are of it.
    tied = rows.groupBy("bucket", "key", "digest", "n_chars", "doc_id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    order = F.struct("n_chars", F.expr("doc_id is not null").alias("known"), F.bitwise_not(F.col("doc_id").cast("long")).alias("id"), "n", "row")
    best = tied.groupBy("bucket", "key", "digest").agg(F.max(order).alias("best"))
    best = best.select("bucket", "key", "digest", F.bitwise_not("best.id").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), F.col("best.n").alias("n_tied"), F.col("best.row").alias("keep_row"))
    # One owner for a bucket: it chains the texts that share a key.
    owned = entered.join(best, ["bucket", "key", "digest"]).repartition("bucket").sortWithinPartitions("bucket", "key", "digest")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest"))
    return written(owned.withColumn("chain", chain), "exact-index"), rows, slots, place


def exact_groups(docs: DataFrame, bucket_rows: int = 200_000, max_depth: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and the place in the index (bucket, depth, chain).

    Of equal texts (after deleting white space) the one with the most code
    points stays, then the smallest doc_id. max_depth is 16 at most, which
    bounds the directory, and so what is broadcast, to 65,536 rows.
    """
    index, rows = indexed(docs, bucket_rows, max_depth)
    found = rows.join(index, ["bucket", "key", "digest"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "bucket", "depth", "chain")


def drop_exact_copies(docs: DataFrame, bucket_rows: int = 200_000, max_depth: int = 16) -> DataFrame:
    """docs with one row of each group of equal texts."""
    index, _, slots, place = built(docs, bucket_rows, max_depth)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), *keyed_columns(docs))
    digest = F.unhex(F.sha2("norm", 256)).alias("digest")
    rows = whole.select("whole", "doc_id", "n_chars", "key", digest, place).join(slots.drop("depth"), "slot")
    wanted = index.select(F.col("bucket").alias("bucket_"), F.col("key").alias("key_"), F.col("digest").alias("digest_"), "keep_id", "keep_chars", "n_tied")
    found = rows.join(wanted, (F.col("bucket") == F.col("bucket_")) & (F.col("key") == F.col("key_")) & (F.col("digest") == F.col("digest_")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    if index.filter("n_tied > 1").isEmpty():
        return found.select("whole.*")
    one = found.filter("n_tied > 1").dropDuplicates(["key", "digest"])
    return found.filter("n_tied = 1").select("whole.*").unionByName(one.select("whole.*"))
