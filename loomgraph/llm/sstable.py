"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their identifier:

  blocks   entries of varints (shared key bytes, other key bytes, value bytes), the other key bytes and the
           value; a block starts with a whole key and ends with the CRC-32 of what stands before it
  index    for each block: its first key, its place and its size
  filter   a Bloom filter over the keys, ten bits each, seven probes
  footer   places of index and filter, numbers of entries, of ids and of the shard, and a mark

A key is the identifier as eight big-endian bytes with the sign turned, so byte order is number order; a null
identifier has the empty key. A value is one byte for the width (2 or 4) and the ids, little-endian.
A look-up asks the filter, then searches the index, then reads one block (or the blocks of equal keys).
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.frames import stacked
from loomgraph.llm.common import in_small_batches, materialize, partitions_for, range_bounds, range_index, slices, spot_of, text_of
from loomgraph.llm.tokens import encoder
from loomgraph.scratch import scratch_path

BLOCK, MARK = 32 << 10, b"LOOMSST1"
#: A task begins a new file beyond so many bytes, so that no file grows with the input.
FILE_BYTES = 128 << 20
_FILES_BITS = 24
_FOOTER = struct.Struct("<QQQQQQQ8s")
_BITS, _PROBES = 10, 7
#: Entries read back in one batch.
_ROWS = 8192


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a = zlib.crc32(key) << 32 | zlib.crc32(key, 0x9E3779B9)
    b = zlib.crc32(key, 0x7F4A7C15) << 1 | 1
    return [(a + i * b) % bits for i in range(_PROBES)]


class Writer:
    """Writes one shard to a stream; memory holds one block, the index and the keys' probes."""

    def __init__(self, out, shard: int):
        self.out, self.shard, self.at = out, shard, 0
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys, self.entries, self.ids = bytearray(), [], 0, 0

    def _put(self, data: bytes) -> tuple[int, int]:
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start, len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.entries and key < self.last:
            raise ValueError("keys must ascend")
        if len(self.block) >= BLOCK:
            self._end_block()
        if not self.block:
            shared, self.first = 0, key
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.ids += len(ids)

    def _end_block(self) -> None:
        if self.block:
            place, size = self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.index += _varint(len(self.first)) + self.first + _varint(place) + _varint(size)
            self.block = bytearray()

    def finish(self) -> None:
        self._end_block()
        index = self._put(bytes(self.index))
        bits = max(64, len(self.keys) * _BITS)
        filled = np.zeros((bits + 7) // 8 * 8, bool)
        for key in set(self.keys):
            filled[_probes(key, bits)] = True
        bloom = self._put(struct.pack("<Q", bits) + np.packbits(filled).tobytes())
        self._put(_FOOTER.pack(*index, *bloom, self.entries, self.ids, self.shard, MARK))


def _footer(file) -> tuple[int, ...]:
    """Places and sizes of index and filter, entries, ids and shard from the end of an open shard."""
    file.seek(0, 2)
    file.seek(max(0, file.tell() - _FOOTER.size))
    data = file.read(_FOOTER.size)
    if len(data) != _FOOTER.size or data[-len(MARK) :] != MARK:
        raise ValueError("not a shard")
    return _FOOTER.unpack(data)[:-1]


class Reader:
    """Reads one shard from an open file, or from its bytes: footer and index at once, filter and blocks where they are used."""

    def __init__(self, file):
        self.file = io.BytesIO(file) if isinstance(file, bytes) else file
        index, n, self.bloom, self.bloom_n, self.entries, self.ids, self.shard = _footer(self.file)
        data = self._bytes(index, n)
        self.keys, self.places, at = [], [], 0
        while at < n:
            size, at = _read_varint(data, at)
            self.keys.append(data[at : at + size])
            place, at = _read_varint(data, at + size)
            size, at = _read_varint(data, at)
            self.places.append((place, size))

    def _bytes(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("a shard is cut off")
        return data

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = memoryview(self._bytes(*self.places[k]))
        block = data[:-4]
        if zlib.crc32(block) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        key, at = b"", 0
        while at < len(block):
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            n, at = _read_varint(block, at)
            key = key[:shared] + bytes(block[at : at + rest])
            at += rest
            width = block[at]
            yield key, np.frombuffer(block[at + 1 : at + n], f"<u{width}").astype(np.uint32)
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.places)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    @cached_property
    def _filter(self) -> tuple[int, bytes]:
        data = self._bytes(self.bloom, self.bloom_n)
        return struct.unpack_from("<Q", data)[0], data[8:]

    def may_hold(self, doc_id: int | None) -> bool:
        bits, bloom = self._filter
        return all(bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key_of(doc_id), bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of this identifier, mostly one or none."""
        key = key_of(doc_id)
        if not self.may_hold(doc_id):
            return []
        first, last = max(0, bisect_left(self.keys, key) - 1), bisect_right(self.keys, key)
        return [ids for k in range(first, last) for found, ids in self.block(k) if found == key]


def write_shards(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes shards in ascending doc_id order to path.

    Returns one row per shard: shard, file, n_docs, n_ids, and start (ids in all shards before it). Null
    text is empty (only the end id is written), null doc_id comes first, equal ids stand in the order of a hash of
    their texts, then of the texts; repeated rows are entries of their own; other columns are not read; an empty table gives
    no shards. A task writes file after file of about file_bytes (a longer text has one of its own), and the rows of one id
    that fills several ranges are dealt out over these. path is any URI that pyarrow.fs writes from executors. A task writes
    under a name of its own and then renames, so a repeated or doubled attempt leaves the same files.
    """
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    bounds = range_bounds(rows, "doc_id", partitions_for(docs, 24))
    rows = rows.withColumn("spot", spot_of(F.col("text")))
    dealt = rows.withColumn("range", range_index(bounds, "doc_id", "spot")).repartitionById(len(bounds) + 1, F.col("range"))
    dealt = dealt.sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "spot", "text").drop("spot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own, store, writer, done = encoder(vocabulary), None, None, 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            writer.finish()
            out.close()
            store.move(part, name)
            columns = [[writer.shard], [name.rpartition("/")[2]], [writer.entries], [writer.ids]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "file", "n_docs", "n_ids"])

        for batch in slices(batches):
            ranges = batch.column("range").to_pylist()
            for number, doc_id, text in zip(ranges, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if writer is not None and writer.at + len(writer.block) >= file_bytes:
                    yield close()
                    writer, done = None, done + 1
                if writer is None:
                    store, root = fs.FileSystem.from_uri(path)
                    store.create_dir(root, recursive=True)
                    name, part = f"{root}/shard-{number:06d}-{done:06d}.sst", f"{root}/_part-{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                    writer = Writer(out, (number << _FILES_BITS) + done)
                writer.add(doc_id, np.concatenate([own.ids(text), end]))
        if writer is not None:
            yield close()

    # one narrow row for each file, brought together in a few
    written = materialize(dealt.mapInArrow(run, "shard long, file string, n_docs long, n_ids long").repartition(4), "shards")
    return _started(written)


def _started(shards: DataFrame) -> DataFrame:
    """shards (shard, n_ids) with start; there is one narrow row for each file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _files(spark, path: str) -> DataFrame:
    """name of every shard in path; without content in the plan the scan lists the files and reads none of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def _opened(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator:
    """Every file of the names in batches, open for random access one after the other."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            with store.open_input_file(f"{root}/{name}") as file:
                yield file


def footers(spark, path: str) -> DataFrame:
    """shard, n_docs and n_ids of every shard in path, from the ends of the files alone."""

    def run(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _opened(path, names):
            *_, entries, ids, shard = _footer(file)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, entries, ids)], ["shard", "n_docs", "n_ids"])

    return _files(spark, path).mapInArrow(run, "shard long, n_docs long, n_ids long").repartition(4)


def read_shards(spark, path: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry, from the files alone; start counts over all shards.

    ValueError if the numbers in the footers are not those of shards, the table of write_shards(), so a lost or foreign
    file cannot pass; a file whose entries are not as many as its footer says fails when it is read. Null ids, repeated rows
    and very long texts come back as they were written; shards without rows give no rows.
    """

    def run(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _opened(path, names):
            reader, entries, at = Reader(file), 0, 0
            rows = iter(reader)
            while True:
                ids, starts, sizes, sums = [], [], [], []
                for doc_id, values in islice(rows, _ROWS):
                    ids.append(doc_id)
                    starts.append(at)
                    sizes.append(len(values))
                    sums.append(zlib.crc32(values.astype("<u4").tobytes()))
                    at += len(values)
                if not ids:
                    break
                entries += len(ids)
                columns = [[reader.shard] * len(ids), ids, starts, sizes, sums]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"])
            if (entries, at) != (reader.entries, reader.ids):
                raise ValueError(f"shard {reader.shard} has {entries} entries of {at} ids, its footer says {reader.entries} of {reader.ids}")

    found = materialize(footers(spark, path), "footers")
    numbers = ["shard", "n_docs", "n_ids"]
    differ = stacked(found.select(*numbers, F.lit(1).alias("side")), shards.select(*numbers, F.lit(-1).alias("side"))).groupBy(*numbers).agg(F.sum("side").alias("side")).where("side <> 0")
    wrong = sorted({r["shard"] for r in differ.select("shard").take(10)})
    if wrong:
        raise ValueError(f"files and table of shards differ, among others in shards {wrong}")
    bases = _started(found).select("shard", "start")
    rows = _files(spark, path).mapInArrow(run, "shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def look_up(spark, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of those entries whose doc_id stands in wanted (a bounded list of ids goes to every file's reader).

    A null doc_id finds the entries without one; an id on several rows gives each of them, an id that is not there none; repeated
    ids in wanted count once, other columns of it are not read; no ids or no files give no rows; ids of a very long text are one value.
    """
    ids = [r["doc_id"] for r in wanted.select("doc_id").distinct().limit(100_001).collect()]
    if len(ids) > 100_000:
        raise ValueError("ask for at most 100,000 ids at once, or join read_shards()")

    def run(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file in _opened(path, names):
            reader = Reader(file)
            for i in ids:
                for values in reader.get(i):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([values.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Writes docs as shards into the shared folder and returns what read_shards() finds there; see write_shards() for nulls, ties and the like."""
    spark = docs.sparkSession
    path = scratch_path(spark, "sst")
    shards = write_shards(docs, path, **options)
    if not shards.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, path, shards)
