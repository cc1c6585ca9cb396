"""Periodic runs of words, by branching tandem repeats of the suffix tree of each text.

The tree of a text is held as its leaves in suffix order with the depths between them; an inner node is an interval of
leaves. A pair of words i and i + d whose suffixes part at a node of depth d is a branching tandem repeat: at every node the leaves of
the smaller side alone are gone through and looked up, by their place in the order, on the other side. The work is n log n.
Each repeat is rotated to the left as long as the words agree; repeats that come to the same stretch are one run, with the
smallest period.

Texts are worked on in batches, as whole arrays; words of different texts are never in one class. A text is one unit of work: a
worker holds about 400 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, batches, fold_of, in_small_batches, text_of, utf8
from loomgraph.llm.suffixes import classes, common_prefixes, doubled, inner_nodes
from loomgraph.llm.words import case_hashes, mix

#: A run has at least so many words, and its period at least twice.
LEAST = 12
_LEAVES = 1 << 20
#: So many rotations are made for all repeats together; the few that go on are measured one by one.
_TOGETHER = 16
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _repeats(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every branching tandem repeat; words: the class of each word, offsets: of the texts."""
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)
    levels = doubled(words, ends)
    order = np.argsort(levels[-1], kind="stable")
    rank = levels[-1].astype(np.int64) - 1
    shared = common_prefixes(levels, order)
    at, low, high = inner_nodes(shared)
    depth = shared[at]
    left = at - low <= high - at
    # the smaller side's leaves, and the other side's interval
    begin, size = np.where(left, low, at), np.minimum(at - low, high - at)
    other, until = np.where(left, at, low), np.where(left, high, at)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.concatenate(([0], np.cumsum(size)))
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(total, total[first] + _LEAVES, "right")) - 1)
        own = np.repeat(np.arange(first, last), size[first:last])
        leaf = order[begin[own] + np.arange(total[first], total[last]) - total[own]]
        d = depth[own]
        for sign in (1, -1):
            mate = leaf + sign * d
            there = (mate >= 0) & (mate < len(words))
            spot = rank[np.where(there, mate, 0)]
            there &= (spot >= other[own]) & (spot < until[own])
            starts.append(np.minimum(leaf, mate)[there])
            periods.append(d[there])
        first = last
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(words: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat can be moved to the left."""
    turns, going = np.zeros(len(start), np.int64), np.arange(len(start))
    for step in range(1, _TOGETHER + 1):
        before = start[going] - step
        same = (before >= 0) & (words[np.maximum(before, 0)] == words[before + period[going]])
        going = going[same]
        turns[going] = step
        if not len(going):
            return turns
    for k in going.tolist():
        i, d, done, block = int(start[k]), int(period[k]), _TOGETHER, 64
        while True:
            low = max(0, i - done - block)
            apart = np.flatnonzero(words[low : i - done] != words[low + d : i - done + d])
            if len(apart):
                done = i - low - int(apart[-1]) - 1
                break
            done = i - low
            if not low:
                break
            block *= 2
        turns[k] = done
    return turns


def maximal_runs(words: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows of start, length and period of all runs, in the order of start and period, numbered over all texts.

    words: a class for each word (from classes()) that differs between texts.
    """
    start, period = _repeats(words, offsets)
    turns = _rotated(words, start, period)
    begin, end = start - turns, start + 2 * period
    keep = end - begin >= least
    begin, end, period = begin[keep], end[keep], period[keep]
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    first = np.ones(len(begin), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    found = np.stack([begin, end - begin, period], axis=1)[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text with one space between them, as bytes and offsets."""
    counts = np.concatenate(([0], np.cumsum(keep)))[offsets]
    starts, ends = starts[keep], ends[keep]
    spaced = np.ones(len(starts), np.int64)
    spaced[counts[:-1][np.diff(counts) > 0]] = 0
    sizes = ends - starts + spaced
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = data[np.arange(at[-1]) + np.repeat(starts - spaced - at[:-1], sizes)]
    out[at[:-1][spaced > 0]] = 0x20
    return out, at[counts]


def word_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs and collapsed of every row of docs (doc_id, text).

    runs: start (word number from 0), length and period in words, by start, then period, of every maximal run of at least `least`
    words that holds its smallest period twice. collapsed: the words that no run holds after its first period, joined by one
    space. Words are [^\\x20\\x09-\\x0D]+ as they are written. Null and empty texts and texts of white space have no words, no
    runs and an empty collapsed text; very long texts are read whole. Repeated rows and rows without doc_id are rows as any
    other; other columns are not read; an empty table gives an empty one.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "text", 1 << 20):
            data, at = utf8(table.column("text"))
            hashes, starts, ends, offsets = case_hashes(data, at)
            text = np.repeat(np.arange(table.num_rows, dtype=np.uint64), np.diff(offsets))
            words = classes(hashes ^ mix(text + np.uint64(0x51_7C_C1)))
            found = maximal_runs(words, offsets, least)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, found[:, 0] + found[:, 2], 1)
            np.add.at(change, found[:, 0] + found[:, 1], -1)
            out, cuts = _joined(data, starts, ends, offsets, np.cumsum(change[:-1]) == 0)
            own = np.searchsorted(offsets, found[:, 0], "right") - 1
            lists = np.searchsorted(own, np.arange(table.num_rows + 1))
            fields = [pa.array(c) for c in (found[:, 0] - offsets[own], found[:, 1], found[:, 2])]
            runs = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_RUN)))
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), table.num_rows, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), runs, texts.cast(pa.large_string()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which every tenth id's text repeats a stretch of itself from some word on, up to its end.

    With h the crc32 of the id and g = floor(h / 10), a text of n words with h % 10 = 0 has from word a = g % n on the words
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)), joined by one space. A null id counts as the empty text.
    """
    h = fold_of("doc_id", 1 << 32)
    g = F.floor(h / 10)

    def turned(words, i):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i))

    def rewritten(words):
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: turned(words, i)), " ")

    words = F.regexp_extract_all(text_of("text"), F.lit(f"([^{SPACES}]+)"), F.lit(1))
    # bound by a lambda, so that the words are cut once
    edited = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, rewritten(w)).otherwise(F.lit(""))), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, edited).otherwise(text_of("text")).alias("text"))
