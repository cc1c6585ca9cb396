"""Quartile bucket digests: locality-sensitive fingerprints of byte triplets.

The three triplets of every four-byte window are hashed into 256 buckets. The digest says, for each
bucket, in which quartile of all bucket counts its count lies (two bits), and has a header with the
logarithm of the length and two ratios of the quartiles. The difference of two digests is a bounded
sum, so likeness is 1 - difference / largest difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import batches, in_small_batches, partitions_for, range_bounds, range_index, spot_of, text_of, utf8

BUCKETS = 256
#: Places of a triplet's bytes in the window that starts at its first byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
HEADER = 3
#: A bucket's difference of 0 to 3 quartiles counts so much.
STEPS = np.array([0, 1, 2, 6], np.int64)
LENGTH_MOST, RATIO_MOST = 64, 15
LARGEST = BUCKETS * int(STEPS[-1]) + LENGTH_MOST + 2 * RATIO_MOST
_TABLES = np.random.Generator(np.random.PCG64(41)).integers(0, BUCKETS, (len(TRIPLETS), 3, 256), np.uint8)
_BLOCK = 1 << 20


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many triplets of each document fall into each bucket; a document of n bytes has 3n - 8 (from 3 bytes on)."""
    n = len(offsets) - 1
    counts = np.zeros((n, BUCKETS), np.int64)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK, "right")) - 1)
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        m = last - first
        doc = np.repeat(np.arange(m, dtype=np.int32), np.diff(at))
        ends = np.repeat(at[1:], np.diff(at))
        place = np.arange(len(part))
        for tables, (_, j, k) in zip(_TABLES, TRIPLETS, strict=True):
            size = len(part) - k
            if size <= 0:
                continue
            bucket = tables[0][part[:size]] ^ tables[1][part[j : j + size]] ^ tables[2][part[k : k + size]]
            cell = (doc[:size] * np.int32(BUCKETS) + bucket)[place[:size] + k < ends[:size]]
            counts[first:last] += np.bincount(cell, minlength=m * BUCKETS).reshape(m, BUCKETS)
        first = last
    return counts


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of header and bucket quartiles (0 to 3) for each document; header: log length, two quartile ratios."""
    counts = bucket_counts(data, offsets)
    n = len(counts)
    out = np.zeros((n, HEADER + BUCKETS), np.uint8)
    if not n:
        return out
    ranked = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
    q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    lengths = np.diff(offsets)
    out[:, 0] = np.minimum(255, np.floor(np.log1p(lengths) / np.log(1.1))).astype(np.uint8)
    top = np.maximum(q[:, 2], 1)
    out[:, 1] = (q[:, 0] * 15 // top).astype(np.uint8)
    out[:, 2] = (q[:, 1] * 15 // top).astype(np.uint8)
    out[:, HEADER:] = (counts > q[:, :1]).astype(np.uint8) + (counts > q[:, 1:2]) + (counts > q[:, 2:3])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, down to 0, row by row."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    body = STEPS[np.abs(x[:, HEADER:] - y[:, HEADER:])].sum(axis=1)
    length = np.minimum(np.abs(x[:, 0] - y[:, 0]), LENGTH_MOST)
    ratios = np.abs(x[:, 1:HEADER] - y[:, 1:HEADER]).sum(axis=1)
    return 1.0 - (body + length + ratios) / LARGEST


def to_text(rows: np.ndarray) -> list[str]:
    """Digests as hex: one byte of log length, one of ratios, then four buckets a byte."""
    q = rows[:, HEADER:].reshape(len(rows), BUCKETS // 4, 4)
    body = q[..., 0] << 6 | q[..., 1] << 4 | q[..., 2] << 2 | q[..., 3]
    packed = np.concatenate([rows[:, :1], rows[:, 1:2] << 4 | rows[:, 2:3], body], axis=1).astype(np.uint8)
    return [r.tobytes().hex() for r in packed]


def digest_texts(texts: list[str]) -> np.ndarray:
    return digests(*utf8(pa.array(texts, pa.large_string())))


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds `fingerprint` of the whole text to every row; null counts as empty, equal texts have equal fingerprints."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(to_text(digests(*utf8(texts))), pa.string())

    return docs.withColumn("fingerprint", run(text_of(column)))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next document.

    The edited text is the text with its last floor(n / 2) characters replaced by the first as many (or
    all) of the next document; next is by ascending doc_id (null first, equal ids by a hash of the text, then by text), after the
    last comes the first. Null text is empty; a very long text is held whole, with its neighbour; a single row is its own next;
    repeated rows each count; other columns are not read; no rows give no rows.

    The rows are dealt once into ranges of doc_id; an id that fills several ranges is dealt out over these. The row that
    starts a range goes to the range before it as well, so every next document lies in its neighbour's partition and
    rows stream through in order.
    """
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    bounds = range_bounds(rows, "doc_id", partitions_for(docs, 24))
    rows = rows.withColumn("spot", spot_of(F.col("text")))
    at = rows.withColumn("part", range_index(bounds, "doc_id", "spot"))
    # one row for each range: its first document
    firsts = at.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), "spot")).alias("first")).select("part", "first.*").collect()
    if not firsts:
        return docs.sparkSession.createDataFrame([], EDITED)
    firsts.sort()
    starts = {r["part"]: (r["named"], r["id"], r["spot"], before["part"]) for before, r in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)}
    held = np.array([starts.get(p, (False, 0, -1, -1)) for p in range(len(bounds) + 1)], np.int64)

    @F.arrow_udf(T.IntegerType())
    def before(part: pa.Array, ids: pa.Array, spot: pa.Array) -> pa.Array:
        """The range before a row's, if the row starts its range."""
        own = held[part.to_numpy(zero_copy_only=False)]
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        starts = (own[:, 0] == named) & (own[:, 1] == ids.fill_null(0).to_numpy(zero_copy_only=False)) & (own[:, 2] == spot.to_numpy(zero_copy_only=False))
        return pa.array(own[:, 3].astype(np.int32), mask=~starts)

    place = lambda part, ahead: F.struct(part.alias("part"), F.lit(ahead).alias("ahead"))
    places = F.array_compact(F.array(place(F.col("part"), 0), F.when(F.col("before").isNotNull(), place(F.col("before"), 1))))
    dealt = at.withColumn("before", before("part", "doc_id", "spot")).select("doc_id", "text", "spot", F.explode(places).alias("p")).select("doc_id", "text", "spot", "p.part", "p.ahead")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "spot", "text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for table in batches(rows, "text", 8 << 20):
            table = pa.concat_tables([held, table]) if held is not None else table
            yield compare(table)
            held = table.slice(table.num_rows - 1)

    def compare(table: pa.Table) -> pa.RecordBatch:
        """Rows of all but the table's last row; a last row comes again as the first of the next table."""
        ids, ahead, texts = table.column("doc_id").to_pylist(), table.column("ahead").to_pylist(), table.column("text").to_pylist()
        prints = digests(*utf8(table.column("text")))
        keep = [i for i in range(len(ids) - 1) if ahead[i] == 0]
        edited, sizes = [], []
        for i in keep:
            n = len(texts[i])
            edited.append(texts[i][: n - n // 2] + texts[i + 1][: n // 2])
            sizes.append(n)
        changed = digest_texts(edited)
        mine, nexts = prints[keep], prints[[i + 1 for i in keep]]
        columns = [[ids[i] for i in keep], sizes, [hashlib.sha256(t.encode()).hexdigest() for t in edited], to_text(mine), to_text(changed), likeness(mine, changed), likeness(mine, nexts)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in EDITED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return dealt.select("doc_id", "text", "ahead").mapInArrow(run, EDITED)
