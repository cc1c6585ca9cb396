"""Sum-of-squares packing of tokenised documents into sequences of fixed length.

Whole sequences are cut off long documents; what is left of each document is one piece of at most the
sequence length. For the pieces, N(g) is the number of open sequences with a gap of g tokens. Pieces go in order
of falling length, and each is placed where the sum of N(g)**2 over all gaps becomes smallest; a new sequence is opened
only when no open one has room, as the fewest sequences are wanted. The small pieces close the gaps.

The rule looks at lengths only. So the driver needs no piece, but only how many there are of each length (one
number for each possible length), and plans with these. Equal pieces go in runs: a step takes a fixed share of the
pieces of a length that are left, one at least, and puts them all where the sum becomes smallest for each of them. The rule is the
same at every size, and with up to `share` pieces of a length every run is one piece. A length takes about
share * log(pieces / share) steps, and equal sequences are kept as runs, too: time and memory of the plan follow the logarithm of the
input. Each piece gets a number within its length from the task that made it, and looks its place up by that number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import in_small_batches, materialize, slices, text_of
from loomgraph.llm.tokens import encoder

_NUMBER_BITS = 44


@dataclass
class Plan:
    """Runs of equal pieces in the order of key (length, then number of the first piece), each with its first sequence and offset."""

    keys: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray
    count: int

    def place(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and number."""
        key = (lengths << _NUMBER_BITS) + numbers
        at = np.searchsorted(self.keys, key, "right") - 1
        return self.sequences[at] + key - self.keys[at], self.offsets[at]


def plan_packing(counts: np.ndarray, length: int, share: int = 16) -> Plan:
    """Places counts[n] pieces of n tokens, 0 < n <= length, by the sum-of-squares rule; full pieces (n = length) stand alone."""
    n_gap = np.zeros(length + 1, np.int64)
    open_at: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # runs of sequences: the first and how many
    keys, sequences, offsets, count = [], [], [], 0
    never = np.int64(1) << 60
    for size in np.flatnonzero(np.asarray(counts[1:])).tolist()[::-1]:
        size, done, left = size + 1, 0, int(counts[size + 1])
        while left:
            run = left if size == length else -(-left // share)
            room = n_gap[size:]
            if size == length or not room.any():
                run = min(run, -(-left // (length // size)))
                moved, gap, count = [(count, run)], length, count + run
            else:
                # for each gap: the change of the sum of squares by a run into it, for each of its pieces, twice
                runs = np.minimum(room, run)
                change = np.where(room > 0, 2 * (n_gap[: length + 1 - size] - room + runs), never)
                if room[0] > 0:
                    change[0] = runs[0] - 2 * room[0]  # closed sequences are not counted
                gap = size + int(change.argmin())
                need = run = int(runs[gap - size])
                moved = []
                while need:
                    first, n = open_at[gap].pop()
                    if n > need:
                        open_at[gap].append((first, n - need))
                        first, n = first + n - need, need
                    moved.append((first, n))
                    need -= n
                n_gap[gap] -= run
            for first, n in moved:
                keys.append((size << _NUMBER_BITS) + done)
                sequences.append(first)
                offsets.append(length - gap)
                done += n
            if gap > size:
                open_at[gap - size] += moved
                n_gap[gap - size] += run
            left -= run
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return Plan(np.array(keys, np.int64)[order], np.array(sequences, np.int64)[order], np.array(offsets, np.int32)[order], count)


def pieces_of(docs: DataFrame, vocabulary: str, length: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32 (and ids); lot and nth: its task and its place there among pieces of its length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", lot long, nth long"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary), np.array([end_id], np.uint32)
        lot, seen = int(np.random.default_rng().integers(1 << 62)), [0] * (length + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * keep_ids, pa.int64(), pa.int64()]
        for batch in slices(rows):
            columns: list[list] = [[] for _ in kinds]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.concatenate([own.ids(text), end])
                cuts = [0, *range((len(ids) - 1) % length + 1, len(ids) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = ids[a:b]
                    values = [doc_id, k, a, b - a, zlib.crc32(part.astype("<u4").tobytes()), *[part.tolist()] * keep_ids, lot, seen[b - a]]
                    seen[b - a] += 1
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = 2048, end_id: int = 0, keep_ids: bool = False, share: int = 16) -> DataFrame:
    """Packs all rows of docs into sequences of at most `length` tokens: one row per piece.

    doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32, sequence_id, offset (gapless
    from 0 in each sequence); with keep_ids also ids. Only documents longer than a sequence are cut, so that all
    pieces but the first are full, and a very long text is as many pieces as it needs. Null text is empty and gives the end id
    alone; null ids stay; repeated rows each are packed; pieces of one length are alike to the rule, so any of them may take
    any of their places; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, vocabulary, length, end_id, keep_ids), "pieces")
    by_lot = pieces.groupBy("length", "lot").agg(F.count("*").alias("n"))
    counts = np.zeros(length + 1, np.int64)
    # the numbers of pieces of each length: at most `length` rows
    for row in by_lot.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(plan_packing(counts, length, share))

    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_lot.select("length", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = pieces.join(bases, ["length", "lot"])
    place = _place(plan, F.col("length"), F.col("base") + F.col("nth")).alias("at")
    return rows.select(*[c for c in pieces.columns if c not in ("lot", "nth")], place).select("*", "at.*").drop("at")


def _place(plan, lengths: Column, numbers: Column) -> Column:
    """sequence_id and offset; plan: a broadcast Plan, whose size follows the logarithm of the input."""

    @F.arrow_udf("sequence_id long, offset long")
    def run(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        sequences, offsets = plan.value.place(lengths.to_numpy(), numbers.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequences, pa.int64()), pa.array(offsets.astype(np.int64), pa.int64())], ["sequence_id", "offset"])

    return run(lengths, numbers)
