"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target number of words. Its documents are put in a hash-random order, running
sums of their sizes are made over even ranges of that order, and the source is cut exactly at its
target; a target above the source's size is met by further epochs over the same order.

No group is ever gathered whole, and no row moves: a source's order is divided by the leading bits of the random
key into ranges of about `range_rows` rows; the ranges' totals (a few numbers for each 20,000 documents) are
added up along the source; only the one range that holds the source's cut is summed row by row. That gives each source
the key at its cut, and every row is then judged where it lies. So a source that holds a third of all rows
costs what the others do.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.frames import stacked
from loomgraph.llm.common import SPACES, files_for, materialize, text_of


def word_count(text: Column | str) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null counts as empty."""
    return F.regexp_count(text_of(text), F.lit(f"[^{SPACES}]+")).cast("long")


def _source_key(source: str) -> Column:
    """The source as a key that is never null."""
    return F.when(F.col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `weight` and `target` to one row per source (source, source_size).

    Weights go round in the order of the sources by code point, null last. All targets add up to
    share times all sizes. None is above most times its source: what is over is shared again by weight
    among the others until none is above. That has a closed form: with sources in the order of
    cap / weight, the first one that the remaining level does not fill sets the level for all after it.
    """
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    return (
        sizes.withColumn("weight", F.get(listed, (F.row_number().over(order) - 1) % len(weights)))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.coalesce(F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(every), F.lit(0.0)))
        .withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("weight")))
        .drop("cap", "ratio", "level")
    )


def source_cuts(slim: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, ranges: int = 64) -> DataFrame:
    """Where each source is cut; slim: source, size, key, and nothing else.

    _source, source_size, target, _whole (full epochs), and for the last epoch _range and _cut (the key at the cut,
    null if the epoch is empty), _left (words still missing when the order gets there) and _ties (rows with that key).
    """
    rows = slim.select(_source_key("source").alias("_source"), "source", "size", "key", _range_of(F.col("key"), ranges).alias("_range"))
    totals = rows.groupBy("_source", "_range", "source").agg(F.sum("size").alias("_sum"))
    sizes = totals.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    targets = source_targets(sizes, weights, share, most).select(_source_key("source").alias("_source"), "source_size", "target", whole.alias("_whole"), (budget - whole * F.col("source_size")).alias("_rest"))
    along = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_source", "_range", "_sum", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_base")).join(targets.select("_source", "_rest"), "_source")
    held = bases.where("_rest > 0 AND _base < _rest AND _rest <= _base + _sum").select("_source", "_range", (F.col("_rest") - F.col("_base")).alias("_need"))
    keys = rows.join(held, ["_source", "_range"]).groupBy("_source", "_range", "_need", "key").agg(F.sum("size").alias("_sum"), F.count("*").alias("_ties"))
    inside = Window.partitionBy("_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("_before", F.coalesce(F.sum("_sum").over(inside), F.lit(0)))
    cut = keys.where("_before < _need AND _need <= _before + _sum").select("_source", "_range", F.col("key").alias("_cut"), (F.col("_need") - F.col("_before")).alias("_left"), "_ties")
    return targets.drop("_rest").join(cut, "_source", "left")


def _range_of(key: Column, ranges: int) -> Column:
    bits = ranges.bit_length() - 1
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


MOST_SOURCES = 1_000_000


def mix_sources(
    docs: DataFrame,
    key: Column,
    size: str = "size",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    ranges: int = 64,
    slim: DataFrame | None = None,
) -> DataFrame:
    """All rows of docs with `source_size`, `target` (both of the row's source) and `taken` (words the mix takes).

    key: a 64-bit hash that orders the rows at random; equal rows may share one, being alike then.
    ranges: parts of each source's order, a power of two (see ranges_for).
    slim: source, size and key of the same rows, if they are at hand already.

    A row is taken whole as often as the target has full epochs of the source; in the last epoch rows are
    taken in order until the target is reached, and the row at the cut gives only the words still missing.
    Null sources are one source. Rows of no words are taken with 0, a very long row as any other: only its size counts. Repeated
    rows each count; if rows share the key at a cut, they are taken in the order in which one write put them down. An empty
    table gives an empty result. Other columns pass through, whatever their names; a column of docs that is named like
    one of the three added is replaced.
    """
    # the row's own columns travel in one struct, so that none can clash with those made here
    rows = docs.select(F.struct("*").alias("_row"), F.col(size).alias("_size"), key.alias("_key"), _source_key(source).alias("_source"))
    if slim is None:
        slim = docs.select(F.col(source).alias("source"), F.col(size).alias("size"), key.alias("key"))
    cuts = materialize(source_cuts(slim, weights, share, most, ranges).withColumnRenamed("_range", "_cut_range"), "cuts", files=files_for(docs))
    state = cuts.agg(F.count("*").alias("n"), F.coalesce(F.max("_ties"), F.lit(0)).alias("ties")).first()
    rows = rows.join(F.broadcast(cuts) if state["n"] <= MOST_SOURCES else cuts, "_source")
    place = _range_of(F.col("_key"), ranges)
    at_cut = F.coalesce((place == F.col("_cut_range")) & (F.col("_key") == F.col("_cut")), F.lit(False))
    ahead = F.coalesce((place < F.col("_cut_range")) | ((place == F.col("_cut_range")) & (F.col("_key") < F.col("_cut"))), F.lit(False))
    last = F.when(ahead, F.col("_size")).when(at_cut, F.least("_left", "_size")).otherwise(0)
    added = ("source_size", "target", "taken")
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in added]
    out = lambda part, last: part.select(*own, "source_size", "target", (F.col("_whole") * F.col("_size") + last).cast("long").alias("taken"))
    if state["ties"] <= 1:
        return out(rows, last)
    # rows that share the key at a cut may be any part of all rows, so they are summed up file by file, never in one task
    tied = at_cut & (F.col("_ties") > 1)
    some = materialize(rows.where(tied), "ties").select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    files = some.groupBy("_source", "_file").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_source", "_file", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_source", "_file").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_ahead", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(files, ["_source", "_file"])
    left = F.greatest(F.lit(0), F.least(F.col("_left") - F.col("_base") - F.col("_ahead"), F.col("_size")))
    return stacked(out(rows.where(~tied), last), out(some, left))


def order_key(columns: Sequence[str], seed: int = 17) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def ranges_for(rows: int, range_rows: int = 20_000) -> int:
    """Ranges for each source: a power of two, at least 64, that keeps a range under range_rows even if one source has all rows."""
    return 1 << max(6, (max(rows, 1) // range_rows).bit_length())


def mixed_documents(docs: DataFrame, ranges: int | None = None, **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as it is taken, the last time cut to the words still taken.

    Returns the columns of docs; n_chars follows the text where docs has it. Rows go in the order of a hash of all their
    columns (but maps and variants, which have no hash), so rows that tie there are alike, and reruns give the same rows. Rows
    with a null or empty text are never taken; null ids and sources, repeated rows, ties and very long texts are handled as
    mix_sources() says; an empty table gives an empty result; other columns stay, whatever their names.
    """
    key = order_key([f.name for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())])
    rows = docs.select(F.struct("*").alias("row"), "text", "source", word_count("text").alias("size"), key.alias("key"))
    slim = materialize(docs.select("source", word_count("text").alias("size"), key.alias("key")), "sizes")
    mixed = mix_sources(rows, F.col("key"), ranges=ranges or ranges_for(slim.count()), slim=slim, **options)
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    out = mixed.where("taken > 0").withColumn("copy", copies)
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    parts = F.split("text", f"(?<=[^{SPACES}])(?=[{SPACES}])", left + 1)
    out = out.withColumn("text", F.when(left < F.col("size"), F.array_join(F.slice(parts, 1, left), "")).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
