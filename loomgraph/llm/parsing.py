"""Removal of repeated byte strings by prefix-free parsing.

1. Candidates. A rolling hash over 8 bytes names a mark of every string of 100 bytes: the smallest hash in its first 64 bytes, the last
   among equals, so equal strings have equal marks. 44 bytes from the mark on lie in every string that has it, so marks meet by a hash of
   these, in one exchange. A mark whose 44 bytes stand once in the corpus has no repeated string. Marks that agree in all bytes of
   all their strings (a context) are put together: all but the first are repeats as a whole.
2. Parsing. What is left are first contexts that share 44 bytes with another one, as where a copied passage begins, ends or is edited.
   They come together by these bytes once more, now with their text, in blocks of about 2 MB, and are cut into phrases at triggers: where the
   rolling hash is 0 modulo 32. A phrase begins with one trigger and ends with the next, so no suffix of a phrase longer than a
   trigger begins another such suffix.
3. Order. The dictionary of distinct phrases has a suffix array, and so has the parse, the sequence of phrases by their place in the
   dictionary. A string's place is that of its phrase suffix, then that of the parse behind it: together they give the order of all
   strings of the block, where equal ones are neighbours; that they are equal is confirmed on their bytes.
4. Merging. The contexts of one 44 bytes may fill several blocks, as around a passage of a third of all documents: a batch that has many
   keeps some of them together and spreads the others over all tasks. Of these the first string of each class of a block goes on
   under a hash of 128 bits, and the first one of all blocks stays.

Nothing here is a pair. Hashes of 128 bits (two of 64) stand for contexts and for strings of different blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.frames import stacked
from loomgraph.llm.common import Sieve, batches, files_for, in_small_batches, materialize, partitions_for, text_of, trim, utf8
from loomgraph.llm.suffixes import classes, doubled
from loomgraph.llm.words import mix

#: Bytes of a string, of a trigger or mark, and of the part of a string in which its mark lies.
STRING, TRIGGER, SPAN = 100, 8, 64
#: One of so many places is a trigger.
SPARSE = 32
_CHOICE = SPAN - TRIGGER + 1
#: Bytes from a mark on that lie in every string that has it.
KEY = STRING - SPAN + TRIGGER
_STEP = np.uint64(0x9FB21C651E98DF25)
_BLOCK = 1 << 18
_LOWEST = -(1 << 63)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number, with zeros beyond the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data) + 8, np.uint64)
    for k in range(8):
        own = padded[k:]
        own = own[: len(own) // 8 * 8].view(">u8")
        room = len(out[k::8])
        out[k::8] = own[:room]
    return out[: len(data)]


def marks(data: np.ndarray, offsets: np.ndarray, eight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """place, low and high of every mark: the strings that have it start at low to high; offsets: of the texts."""
    found = [np.zeros((3, 0), np.int64)]
    n = len(data)
    # the strings of a text start before its last STRING - 1 bytes
    allowed = np.zeros(n + 1, np.int64)
    long_ = np.diff(offsets) >= STRING
    np.add.at(allowed, offsets[:-1][long_], 1)
    np.add.at(allowed, offsets[1:][long_] - STRING + 1, -1)
    allowed = np.cumsum(allowed[:-1]) > 0
    text = np.zeros(n + 1, bool)
    text[offsets[:-1]] = True
    mask = np.uint64((1 << 20) - 1)
    for first in range(0, max(n - STRING + 1, 0), _BLOCK):
        last = min(first + _BLOCK, n - STRING + 1)
        own = mix(eight[first : last + _CHOICE - 1] * _STEP)
        # the later one of equal hashes is the smaller number
        own = (own & ~mask) | (mask - np.arange(len(own), dtype=np.uint64))
        width = 1
        while width < _CHOICE:
            step = min(width, _CHOICE - width)
            own = np.minimum(own[:-step], own[step:])
            width += step
        starts = first + np.flatnonzero(allowed[first:last])
        if not len(starts):
            continue
        place = first + (mask - (own[starts - first] & mask)).astype(np.int64)
        begins = np.ones(len(starts), bool)
        begins[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1) | text[starts[1:]]
        at = np.flatnonzero(begins)
        found.append(np.stack([place[at], starts[at], starts[np.append(at[1:], len(starts)) - 1]]))
    place, low, high = np.concatenate(found, axis=1)
    # a mark's strings may go over from one block into the next
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (low[1:] != high[:-1] + 1)
    at = np.flatnonzero(new)
    return place[at], low[at], high[np.append(at[1:], len(place)) - 1] if len(at) else high


def hashed(eight: np.ndarray, at: np.ndarray, size: np.ndarray | int, salt: int) -> np.ndarray:
    """A 64-bit hash of size bytes (8 at least) from each place on."""
    size = np.broadcast_to(size, at.shape)
    h = mix(size.astype(np.uint64) * _STEP + np.uint64(salt))
    going = np.arange(len(at))
    done = 0
    while len(going):
        # the last 8 bytes overlap those before them
        h[going] = mix(h[going] ^ eight[at[going] + np.minimum(done, size[going] - 8)]) * _STEP
        done += 8
        going = going[size[going] > done]
    return mix(h)


def block_order(data: np.ndarray, eight: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places wanted in the order of the block's suffixes, and whether each has the same STRING bytes as the one before it.

    offsets: of the texts, each of STRING bytes at least; wanted: starts of strings. The order is that of the suffix arrays of dictionary and parse.
    """
    n = len(data)
    trigger = mix(eight * _STEP) % np.uint64(SPARSE) == 0
    for k in range(1, TRIGGER):
        # a trigger lies in one text
        trigger[offsets[1:] - k] = False
    trigger[offsets[:-1]] = True
    begin = np.flatnonzero(trigger)
    text = np.searchsorted(offsets, begin, "right") - 1
    end = np.append(begin[1:] + TRIGGER, n)
    last = np.append(text[1:] != text[:-1], True)
    end[last] = offsets[text[last] + 1]
    size = end - begin
    _, first, number = np.unique(hashed(eight, begin, size, 2), return_index=True, return_inverse=True)
    # the dictionary: distinct phrases one after another
    sizes = size[first]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    source = np.repeat(begin[first] - starts[:-1], sizes) + np.arange(starts[-1])
    ends = np.repeat(starts[1:], sizes)
    room = np.minimum(ends - np.arange(starts[-1]), 8)
    short = np.flatnonzero(room < 8)
    lead = eight[source]
    # what is shorter than 8 bytes is filled up with zeros and comes before what has them
    shift = (8 * (8 - room[short])).astype(np.uint64)
    lead[short] = lead[short] >> shift << shift
    rank = classes(classes(lead).astype(np.int64) * 16 + room)
    dictionary = doubled(rank, ends, 8)[-1].astype(np.int64)
    # the parse: phrases by their place in the dictionary
    cuts = np.searchsorted(text, np.arange(len(offsets)))
    parse = doubled(classes(dictionary[starts[:-1]][number]), np.repeat(cuts[1:], np.diff(cuts)))[-1].astype(np.int64)
    owner = np.searchsorted(begin, wanted, "right") - 1
    head = dictionary[starts[number[owner]] + wanted - begin[owner]]
    tail = np.where(last[owner], 0, parse[np.minimum(owner + 1, len(parse) - 1)])
    order = np.lexsort((wanted, tail, head))
    there = wanted[order]
    same = np.zeros(len(there), bool)
    same[1:] = True
    for k in (*range(0, STRING - 8, 8), STRING - 8):
        at = np.flatnonzero(same)
        same[at] = eight[there[at] + k] == eight[there[at - 1] + k]
    return there, same


#: A batch sends at most so many contexts of one 44 bytes to the task of these bytes; the others are spread over all tasks.
MOST_HOT = 32
#: Bytes of the contexts that are put in order together.
BLOCK_BYTES = 2 << 20
_MARKED = "home long, key long, context long, cold boolean, doc long, th long, low int, high int"
_JUDGED = "home long, key long, split boolean, doc long, th long, low int, high int"
_STRETCH = "home long, key long, split boolean, doc long, th long, low int, bytes binary"
_STRINGS = "key long, string long, doc long, th long, low int, high int"
_RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"
_NO_PAIRS = "array<struct<low:int,high:int>>"


def _batch(schema: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _texts(docs: DataFrame, files: int) -> DataFrame:
    """doc_id, doc (the id as a number), th (a hash that tells the texts of one id apart, 0 where there is one text) and the text's bytes."""
    text = text_of("text")
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"), text.alias("text"))
    told = rows.groupBy("doc").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("doc")
    told = materialize(told, "several", files)
    # a sieve takes a second Python worker beside each one that reads the texts; mostly there is nothing to look up
    several = Sieve(told, "doc").passes("doc") if told.take(1) else F.lit(False)
    return rows.select("doc_id", "doc", F.when(several, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("th"), F.col("text").cast("binary").alias("text"))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _marked(texts: DataFrame) -> DataFrame:
    """All marks with a hash of their 44 bytes (key) and of all their strings (context), and the task that they go to (home).

    Contexts that a batch has before are repeats (key null) and need no look any more.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "text", BLOCK_BYTES):
            data, offsets = utf8(table.column("text"))
            eight = eights(data)
            place, low, high = marks(data, offsets, eight)
            key = hashed(eight, place, KEY, 1).view(np.int64)
            # the mark's place in the context is part of the hash
            context = mix(hashed(eight, low, high - low + STRING, 3) + (place - low).astype(np.uint64)).view(np.int64)
            own = np.searchsorted(offsets, low, "right") - 1
            begin = offsets[own]
            doc, th = (table.column(c).to_numpy()[own] for c in ("doc", "th"))
            low, high = (low - begin).astype(np.int32), (high - begin).astype(np.int32)
            _, number, counts = np.unique(key, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(counts[number] > 1)
            twice = twice[np.lexsort((low[twice], th[twice], doc[twice], context[twice], key[twice]))]
            first = _begins(key[twice], context[twice])
            held = np.maximum.accumulate(np.where(first, np.arange(len(twice)), 0))
            repeat = twice[~first]
            leader = twice[held[~first]]
            twin = (doc[repeat] == doc[leader]) & (th[repeat] == th[leader]) & (low[repeat] == low[leader])
            again = repeat[~twin]
            heads = twice[first]
            starts = _begins(key[heads])
            nth = np.arange(len(heads)) - np.maximum.accumulate(np.where(starts, np.arange(len(heads)), 0))
            sizes = np.diff(np.append(np.flatnonzero(starts), len(heads)))
            many = np.repeat(sizes > MOST_HOT, sizes)
            home, cold, keep = key.copy(), np.ones(len(key), bool), np.ones(len(key), bool)
            cold[heads[many]] = False
            far = heads[many & (nth >= MOST_HOT)]
            home[far] = mix(key[far].view(np.uint64) ^ context[far].view(np.uint64)).view(np.int64)
            keep[repeat] = False
            yield _batch(_MARKED, home[keep], key[keep], context[keep], cold[keep], doc[keep], th[keep], low[keep], high[keep])
            yield _batch(_MARKED, mix(low[again].astype(np.uint64) ^ doc[again].view(np.uint64)).view(np.int64), pa.nulls(len(again), pa.int64()), context[again], cold[again], doc[again], th[again], low[again], high[again])

    return texts.select("doc", "th", "text").where(F.length("text") >= STRING).mapInArrow(run, _MARKED)


def _judged(marked: DataFrame) -> DataFrame:
    """Repeats as a whole context (key null), and first contexts that share their 44 bytes with another one; others go.

    Rows come in the order of key and context; of those seen before, a batch takes over the first row of the key and of the context.
    split: contexts of this key lie in other tasks, too.
    """
    names = ("home", "key", "context", "cold", "doc", "th", "low", "high")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in rows:
            known = batch.column("key").is_valid()
            done = batch.filter(pc.invert(known))
            if done.num_rows:
                yield _batch(_JUDGED, done.column("home"), done.column("key"), pa.array(np.zeros(done.num_rows, bool)), *(done.column(c) for c in ("doc", "th", "low", "high")))
            batch = batch.filter(known)
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            own.append(np.zeros(len(own[0]), bool))
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            home, key, context, cold, doc, th, low, high, sent = own
            group = _begins(home, key)
            first = group | _begins(cold, context)
            at, place = np.flatnonzero(first), np.arange(len(key))
            head = np.maximum.accumulate(np.where(first, place, 0))
            several = np.bincount(np.cumsum(group)[at] - 1) > 1
            origin = np.flatnonzero(group)
            number = np.cumsum(group) - 1
            is_open = first & (several[number] | ~cold) & ~sent
            twin = (doc == doc[head]) & (th == th[head]) & (low == low[head])
            copy = ~first & ~twin
            split = ~cold[origin][number]
            yield _batch(_JUDGED, home[is_open], key[is_open], split[is_open], doc[is_open], th[is_open], low[is_open], high[is_open])
            yield _batch(_JUDGED, home[copy], pa.nulls(int(copy.sum()), pa.int64()), split[copy], doc[copy], th[copy], low[copy], high[copy])
            sent = sent | is_open
            last = np.unique([origin[-1], at[-1]])
            held = [x[last] for x in (home, key, context, cold, doc, th, low, high, sent)]

    order = ["home", "key", "cold", "context", "doc", "th", "low"]
    return marked.repartition(partitions_for(marked), "home").sortWithinPartitions(*order).mapInArrow(run, _JUDGED)


def _stretches(texts: DataFrame, judged: DataFrame) -> DataFrame:
    """The bytes of the contexts that are still open, beside their rows of judged."""
    still = judged.where("key IS NOT NULL")
    known = Sieve(still.select("doc").distinct(), "doc").passes("doc")
    lists = still.groupBy("doc", "th").agg(F.collect_list(F.struct("home", "key", "split", "low", "high")).alias("open"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "text", BLOCK_BYTES):
            data, offsets = utf8(table.column("text"))
            lists = _one(table.column("open"))
            inner = lists.flatten()
            own = np.repeat(np.arange(table.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            low, high = (inner.field(c).to_numpy().astype(np.int64) for c in ("low", "high"))
            doc, th = (table.column(c).to_numpy()[own] for c in ("doc", "th"))
            sizes = high - low + STRING
            cuts = np.concatenate(([0], np.cumsum(sizes)))
            raw = data[np.repeat(offsets[own] + low - cuts[:-1], sizes) + np.arange(cuts[-1])]
            for a in range(0, len(own), 4096):
                b = min(a + 4096, len(own))
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cuts[a : b + 1] - cuts[a]), pa.py_buffer(raw[cuts[a] : cuts[b]])]).cast(pa.binary())
                yield _batch(_STRETCH, *(inner.field(c).slice(a, b - a) for c in ("home", "key", "split")), doc[a:b], th[a:b], low[a:b].astype(np.int32), held)

    rows = texts.where(known).select("doc", "th", "text").join(lists, ["doc", "th"])
    return rows.select("doc", "th", "text", "open").mapInArrow(run, _STRETCH)


def _one(column: pa.ChunkedArray) -> pa.Array:
    held = column.combine_chunks()
    return held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in tables of about BLOCK_BYTES that hold all rows of a key, and which rows have others of their key outside.

    A key with more bytes than that is cut.
    """
    held: list[pa.RecordBatch] = []
    size, cut = 0, None

    def table_of(held: list[pa.RecordBatch], open_end: bool) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        key = table.column("key").to_numpy()
        split = table.column("split").to_numpy() | (key == cut if cut is not None else False) | ((key == key[-1]) & open_end)
        return table, split

    for batch in rows:
        for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
            held.append(part)
            size += part.column("bytes").nbytes
            if size < BLOCK_BYTES:
                continue
            whole = pa.Table.from_batches(held)
            key = whole.column("key").to_numpy()
            at = int(np.flatnonzero(_begins(key))[-1])
            if at:
                yield table_of(whole.slice(0, at).to_batches(), False)
                held, cut = whole.slice(at).to_batches(), None
                size = sum(b.column("bytes").nbytes for b in held)
            else:
                yield table_of(held, True)
                held, cut, size = [], key[-1], 0
    if held:
        yield table_of(held, False)


def _strings(stretches: DataFrame, tasks: int) -> DataFrame:
    """Repeats among the strings of open contexts (key null), and of keys that lie in several blocks one string of each class of a block.

    tasks: how many share the work; Spark's estimate for stretches, which are joined rows, is the product of two sizes and says nothing.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, split in _blocks(rows):
            data, offsets = utf8(table.column("bytes"))
            eight = eights(data)
            doc, th, low, key = (table.column(c).to_numpy() for c in ("doc", "th", "low", "key"))
            counts = np.diff(offsets) - STRING + 1
            wanted = np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            there, same = block_order(data, eight, offsets, wanted)
            text = np.searchsorted(offsets, there, "right") - 1
            inside = low[text] + there - offsets[text]
            shared = same.copy()
            shared[:-1] |= same[1:]
            group = np.cumsum(~same)
            several = np.flatnonzero(shared)
            # the first of each class, by document, text and place
            several = several[np.lexsort((inside[several], th[text[several]], doc[text[several]], group[several]))]
            first = _begins(group[several])
            leader = several[np.maximum.accumulate(np.where(first, np.arange(len(several)), 0))]
            x, y = text[several], text[leader]
            # a place that stands twice is no repeat of itself
            other = (doc[x] != doc[y]) | (th[x] != th[y]) | (inside[several] != inside[leader])
            heads = np.concatenate([np.flatnonzero(~shared), several[first]])
            heads = heads[split[text[heads]]]
            at = (inside[heads]).astype(np.int32)
            yield _batch(_STRINGS, key[text[heads]], hashed(eight, there[heads], STRING, 7).view(np.int64), doc[text[heads]], th[text[heads]], at, at)
            # repeats of one context that follow each other go as one row
            again = several[other]
            again = again[np.argsort(there[again], kind="stable")]
            begins = _begins(there[again] - np.arange(len(again)), text[again])
            at = np.flatnonzero(begins)
            a, b = again[at], again[np.append(at[1:], len(again)) - 1] if len(at) else again
            none = pa.nulls(len(a), pa.int64())
            yield _batch(_STRINGS, none, none, doc[text[a]], th[text[a]], inside[a].astype(np.int32), inside[b].astype(np.int32))
        trim()

    dealt = stretches.repartition(tasks, "home").sortWithinPartitions("key", "doc", "th", "low")
    return dealt.mapInArrow(run, _STRINGS)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """low and high + 1 of a column of lists of (low, high), as rows, and the n + 1 offsets of the lists."""
    lists = _one(column)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = lists.flatten()
    rows = np.stack([inner.field("low").to_numpy(zero_copy_only=False), inner.field("high").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64) if len(inner) else np.zeros((0, 2), np.int64)
    return rows, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def _removed(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start and length of removed bytes) and kept of texts with their repeated strings (gone)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(found, "text", BLOCK_BYTES):
            data, offsets = utf8(table.column("text"))
            starts, at = _flat(table.column("gone"))
            starts = starts + offsets[np.repeat(np.arange(table.num_rows), np.diff(at))][:, None]
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, starts[:, 0], 1)
            np.add.at(change, starts[:, 1] + STRING, -1)
            lost = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.concatenate(([0], lost.astype(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            # spans that end one text and begin the next are two
            inner = offsets[1:-1]
            cut = np.unique(inner[(inner > 0) & (inner < len(data))])
            cut = cut[lost[cut] & lost[cut - 1]]
            begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
            text = np.searchsorted(offsets, begin, "right") - 1
            lists = pa.array(np.searchsorted(text, np.arange(table.num_rows + 1)), pa.int32())
            spans = pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays([pa.array(begin - offsets[text]), pa.array(end - begin)], ["start", "length"]))
            kept = np.concatenate(([0], np.cumsum(~lost)))[offsets]
            left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), table.num_rows, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[~lost])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.diff(offsets)), spans, left], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.select("doc_id", "text", "gone").mapInArrow(run, _RESULT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans and kept of every row of docs (doc_id, text): texts without what stood earlier.

    Texts are UTF-8 bytes; null is empty. A byte goes if it lies in a string of 100 bytes that also starts earlier: in a document of a
    smaller doc_id, or at an earlier place of the same text; strings may overlap and never cross documents. spans: start and length of the
    removed stretches; kept: the bytes left, in their order. Texts under 100 bytes stay as they are. A null doc_id comes before
    all others; different texts of one doc_id come in the order of a hash; rows that repeat doc_id and text are one document, and each
    of them gets its result. Very long texts are read whole; other columns are not read; an empty table gives an empty one.
    """
    files = files_for(docs)
    texts = _texts(docs, files)
    judged = materialize(_judged(_marked(texts)), "judged")
    strings = materialize(_strings(_stretches(texts, judged), partitions_for(docs)), "strings")
    place = ("doc", "th", "low")
    firsts = strings.where("key IS NOT NULL").groupBy("key", "string").agg(F.min(F.struct(*place)).alias("first"), F.max(F.struct(*place)).alias("last")).where("first <> last").select("key", "string", "first")
    # the rows of a hot string lie on the left, where a join splits them
    later = strings.join(firsts.hint("merge"), ["key", "string"]).where(" OR ".join(f"{c} <> first.{c}" for c in place))
    repeats = stacked(*(x.select("doc", "th", "low", "high") for x in (judged.where("key IS NULL"), strings.where("key IS NULL"), later)))
    known = Sieve(repeats.select("doc").distinct(), "doc").passes("doc")
    gone = repeats.groupBy("doc", "th").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    changed = texts.where(known).join(gone, ["doc", "th"], "left").withColumn("gone", F.coalesce("gone", F.array().cast(_NO_PAIRS)))
    same = texts.where(~known).select("doc_id", F.length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"), F.col("text").alias("kept"))
    return stacked(same, _removed(changed))
