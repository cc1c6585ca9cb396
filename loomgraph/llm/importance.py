"""Importance resampling towards a target text collection, by hashed n-gram counts.

Every document has its runs of 1 to 2 words as an array, each hashed to one of 10,000 buckets by crc32. The buckets are counted over all
documents and over all target texts; a bucket's gain is the logarithm of the ratio of both shares, and a document's
weight the mean gain of its features. Noise from a hash of the id turns the highest scores into a weighted draw without
repetition. All of it is SQL functions: the features of a text are hashed once and written as numbers; one pass over these counts, one
joins the table of gains, whose size is that of the bucket table. Ranks come from a range sort and the sizes of its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import files_for, materialize, numbered, partitions_for, release, text_of

BUCKETS, LONGEST = 10_000, 2
#: A word in lower-cased text: digits, a-z, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column | str) -> Column:
    """The words of a text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(text_of(text), _UPPER, _LOWER), F.lit(f"({WORD})"), F.lit(1))


def features(words: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one space, repeats included."""

    def of_length(words: Column, n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))

    return F.get(F.transform(F.array(words), lambda w: F.concat(*[of_length(w, n) for n in range(1, longest + 1)])), 0)


def bucketed(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """n_words and the buckets of all features of every row, beside its other columns but text."""
    rows = docs.withColumn("_w", words_of("text"))
    held = F.transform(features(F.col("_w"), longest), lambda x: (F.crc32(F.encode(x, "UTF-8")) % buckets).cast("int"))
    return rows.withColumn("n_words", F.size("_w").cast("long")).withColumn("buckets", held).drop("_w", "text")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket and n of rows (buckets), added up where they lie before they are sent."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain of every bucket that source or target (bucket, n) has: a table of at most `buckets` rows."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    gain = F.floor(1000 * F.log(((t + 1) * (F.col("all_s") + buckets)) / ((s + 1) * (F.col("all_t") + buckets))))
    return both.crossJoin(F.broadcast(totals)).select("bucket", gain.alias("gain"))


def noise(doc_id: Column | str, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) of a number u between 0 and 1 from the first 8 hex digits of sha256(`seed:doc_id`); null is the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")))
    h = F.conv(F.left(F.sha2(text, 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs (doc_id, text), drawn towards target (text).

    weight: the floored mean gain of the row's features, 0 without any. Of the N rows with at least `least` words the
    floor(percent * N / 100) with the highest scores are drawn, of equal scores those of the smaller doc_id (null first, then the
    one of fewer features); rank says in which order, and is null for the others. Null and empty texts have no features; very long texts
    are read whole; repeated rows are drawn one by one and share their score; other columns are not read. An empty table gives an
    empty one; without target texts the gains are those of no counts.
    """
    files = files_for(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(bucketed(rows, buckets, longest).withColumn("row", F.monotonically_increasing_id()), "buckets")
    wanted = bucket_counts(bucketed(target.select("text"), buckets, longest))
    table = materialize(gains(bucket_counts(rows), wanted, buckets), "gains", 1)
    # at most `buckets` rows
    held = rows.select("row", F.explode("buckets").alias("bucket")).join(F.broadcast(table), "bucket")
    sums = held.groupBy("row").agg(F.sum("gain").alias("total"))
    told = rows.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features")).join(sums, "row", "left")
    n = F.greatest(F.col("n_features"), F.lit(1))
    total = F.coalesce("total", F.lit(0))
    weight = ((total - F.pmod(total, n)) / n).cast("long")
    scored = told.withColumn("weight", F.when(F.col("n_features") > 0, weight).otherwise(F.lit(0).cast("long"))).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = materialize(scored.select("row", "doc_id", "n_words", "n_features", "weight", "score"), "scores", files)
    release(rows, table)
    able = scored.where(F.col("n_words") >= least)
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("row")]
    ranged = able.repartitionByRange(partitions_for(able), *order).sortWithinPartitions(*order)
    placed = ranged.select("doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("lot"), (F.monotonically_increasing_id() % (1 << 33)).alias("nth"))
    ranked, n_able = numbered(materialize(placed, "ranked"), "place")
    drawn = percent * n_able // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    others = scored.where(F.col("n_words") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).unionByName(others)
