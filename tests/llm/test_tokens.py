import io
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import common, words
from loomgraph.llm.packing import pack, plan_packing
from loomgraph.llm.sstable import Reader, Writer, look_up, read_shards, round_trip, write_shards
from loomgraph.llm.token_count import counter, token_counts
from loomgraph.llm.tokens import encoder
from tests.llm import fixtures as fx

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def awkward_texts(n=300):
    rng = random.Random(3)
    letters = "abcXYZ 0129\t\n'\u00a0\u3000.,!?-_éßñ漢😀\u0301\u200d\x85\x1c"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", "don't we'll I'M", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "  x  ", " "]


def test_ids_and_counts_are_the_librarys(library):
    own, count = encoder(NAME), counter(NAME)
    for text in awkward_texts():
        assert own.ids(text).tolist() == ids_of(library, text)
        assert count.count(text) == len(ids_of(library, text))


def test_ids_are_the_librarys_for_every_code_point(library):
    own = encoder(NAME)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)} b" for c in points[i : i + 4000 : 7])
        assert own.ids(text).tolist() == ids_of(library, text)


def test_proven_strings_are_one_token(library):
    count = counter(NAME)
    sample = sorted(count.proven)[::97]
    assert len(count.proven) > 40_000 and all(len(ids_of(library, s)) == 1 for s in sample)


def test_token_counts(spark, library):
    rows = token_counts(fx.awkward(spark)).collect()
    assert len(rows) == fx.awkward(spark).count()
    texts = {i: t for i, t in enumerate(fx.TEXTS)}
    for r in rows:
        if r["doc_id"] is not None:
            n = len(ids_of(library, texts[r["doc_id"]]))
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 512)
    assert token_counts(fx.empty(spark)).count() == 0


def test_word_hashes_follow_the_words():
    texts = [t or "" for t in fx.TEXTS]
    hashes, at = words.word_hashes(*common.utf8(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        own = fx.words(t)
        assert at[i + 1] - at[i] == len(own)
        for w, h in zip(own, hashes[at[i] : at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_batches_keep_all_rows():
    rows = [pa.RecordBatch.from_pydict({"t": ["a" * n for n in part]}) for part in ([3, 50, 2, 2], [], [7], [200, 1])]
    out = [t.column("t").to_pylist() for t in common.batches(rows, "t", 10)]
    assert [len(x) for x in sum(out, [])] == [3, 50, 2, 2, 7, 200, 1]
    assert all(sum(map(len, x)) <= 10 or len(x) == 1 for x in out)


@pytest.mark.parametrize("share", [1, 3, 16, 10**6])
def test_plan_places_every_piece_once(share):
    rng = np.random.default_rng(5)
    length = 64
    sizes = np.concatenate([rng.integers(1, length + 1, 700), np.full(400, 20), np.full(50, length)])
    counts = np.bincount(sizes, minlength=length + 1)
    plan = plan_packing(counts, length, share)
    held, done = {}, np.zeros(length + 1, int)
    for size in range(1, length + 1):
        numbers = np.arange(counts[size])
        for s, offset in zip(*plan.place(np.full(len(numbers), size), numbers), strict=True):
            held.setdefault(int(s), []).append((int(offset), size))
            done[size] += 1
    assert (done == counts).all() and len(held) == plan.count
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert plan.count <= best_fit(sizes, length)


def test_plan_follows_the_rule_piece_by_piece():
    """With few pieces of each length every step is one piece, placed where the sum of squares gets smallest."""
    rng = np.random.default_rng(9)
    sizes = sorted(rng.integers(1, 40, 300).tolist(), reverse=True)
    length, gaps, sequences = 40, [], 0
    for size in sizes:
        fits = sorted({g for g in gaps if g >= size})
        if not fits:
            gaps.append(length - size)
            sequences += 1
            continue

        def squares(g):
            left = list(gaps)
            left.remove(g)
            left += [g - size] * (g > size)
            return sum(left.count(h) ** 2 for h in set(left))

        best = min(fits, key=squares)
        gaps.remove(best)
        gaps += [best - size] * (best > size)
        gaps = [g for g in gaps if g > 0]
    assert plan_packing(np.bincount(sizes, minlength=length + 1), length, share=1000).count == sequences


def test_plan_stays_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    share = rng.lognormal(0, 1, 513)
    share[0] = share[512] = 0
    peaks = []
    for pieces in (1_000_000, 32_000_000):
        counts = np.rint(share / share.sum() * pieces).astype(int)
        tracemalloc.start()
        plan = plan_packing(counts, 512)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert plan.count <= best_fit_of(counts, 512)
    assert peaks[1] < 3 * peaks[0] and peaks[1] < 200e6


def best_fit(sizes, length):
    """Sequences that best-fit decreasing needs, piece by piece."""
    gaps = []
    for size in sorted(sizes.tolist(), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else length) - size)
    return len(gaps)


def best_fit_of(counts, length):
    """The same from the numbers of pieces of each length."""
    n_gap, needed = np.zeros(length + 1, np.int64), 0
    for size in range(length, 0, -1):
        left = int(counts[size])
        while left:
            room = np.flatnonzero(n_gap[size:])
            gap = size + int(room[0]) if len(room) else length
            run = min(left, int(n_gap[gap]) if len(room) else -(-left // (length // size)))
            if len(room):
                n_gap[gap] -= run
            else:
                needed += run
            n_gap[gap - size] += run * (gap > size)
            left -= run
    return needed


def test_plan_fills_sequences_that_can_be_filled():
    rng = np.random.default_rng(6)
    cuts = [np.diff([0, *sorted(rng.choice(np.arange(1, 2048), 4, replace=False)), 2048]) for _ in range(400)]
    plan = plan_packing(np.bincount(np.concatenate(cuts), minlength=2049), 2048)
    assert plan.count <= 402


@pytest.mark.parametrize("share", [16, 1])
def test_pack(spark, library, share):
    table = fx.awkward(spark)
    rows = pack(table, length=256, keep_ids=True, share=share).collect()
    expected = []
    for r in table.collect():
        ids = [*ids_of(library, r["text"]), 0]
        cuts = [0, *range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)]
        expected += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 256
    assert pack(fx.empty(spark)).count() == 0


def in_order(table):
    """doc_id and text in the order of the shards: null first, equal ids by a hash of the text."""
    rows = table.select("doc_id", common.text_of("text").alias("text"), common.spot_of(common.text_of("text")).alias("spot")).collect()
    return [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["spot"], r["text"]))]


def entries(table, library):
    out, start = [], 0
    for doc_id, text in in_order(table):
        ids = [*ids_of(library, text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_shard_round_trip_and_look_up(spark, library, tmp_path):
    table = fx.awkward(spark)
    expected = entries(table, library)
    assert sorted(map(tuple, round_trip(table).collect()), key=repr) == sorted(expected, key=repr)
    assert round_trip(fx.empty(spark)).count() == 0
    path = f"file://{tmp_path}/shards"
    shards = write_shards(table, path)
    assert read_shards(spark, path, shards).count() == len(expected)
    found = look_up(spark, path, spark.createDataFrame([(3,), (9,), (77,)], "doc_id long")).collect()
    assert sorted(len(r["ids"]) for r in found if r["doc_id"] == 3) == [len(ids_of(library, "one two")) + 1]
    assert sum(r["doc_id"] == 9 for r in found) == 2 and not any(r["doc_id"] == 77 for r in found)


def test_hot_ids_are_spread(spark, library, tmp_path):
    """A third of the rows has one id, a third none; files stay small and the order holds."""
    texts = [f"text {i} " * (i % 7) for i in range(300)]
    table = fx.docs(spark, texts, [7 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(300)])
    keyed = table.select("doc_id", common.spot_of(F.coalesce("text", F.lit(""))).alias("spot"))
    bounds = common.range_bounds(keyed, "doc_id", 20)
    sizes = [r["count"] for r in keyed.groupBy(common.range_index(bounds, "doc_id", "spot").alias("r")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 60
    path = f"file://{tmp_path}/shards"
    shards = write_shards(table, path, file_bytes=150)
    assert shards.count() > 30 and shards.agg(F.max("n_docs")).first()[0] < 60
    rows = sorted(map(tuple, read_shards(spark, path, shards).collect()), key=repr)
    assert rows == sorted(entries(table, library), key=repr)
    assert look_up(spark, path, spark.createDataFrame([(7,), (None,), (7,)], "doc_id long")).count() == 200


def test_shards_are_counted_from_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    shards = write_shards(fx.awkward(spark), path)
    rows = sorted(map(tuple, read_shards(spark, path, shards).collect()), key=repr)
    assert sorted(map(tuple, read_shards(spark, path, shards.withColumn("start", F.lit(-7))).collect()), key=repr) == rows
    with pytest.raises(ValueError, match="differ"):
        read_shards(spark, path, shards.withColumn("n_ids", F.col("n_ids") + 1))
    files = sorted((tmp_path / "shards").glob("*.sst"))
    assert len(files) > 1
    files[0].unlink()
    with pytest.raises(ValueError, match="differ"):
        read_shards(spark, path, shards)


def test_shard_format():

    out = io.BytesIO()
    writer = Writer(out, 4)
    keys = [None, -(2**63), -5, 0, 7, 7, 2**40, 2**63 - 1]
    values = [np.arange(n * 3000, dtype=np.uint32) + (1 << 16) * (n % 2) for n in range(len(keys))]
    for k, v in zip(keys, values, strict=True):
        writer.add(k, v)
    with pytest.raises(ValueError):
        writer.add(3, values[0])
    writer.finish()
    reader = Reader(out.getvalue())
    assert [k for k, _ in reader] == keys and all((a == b).all() for (_, a), b in zip(reader, values, strict=True))
    assert len(reader.get(7)) == 2 and len(reader.get(None)) == 1 and reader.get(8) == [] and len(reader.places) > 1
    assert sum(reader.may_hold(i) for i in range(1000, 3000)) < 100
    damaged = bytearray(out.getvalue())
    damaged[50] ^= 1
    with pytest.raises(ValueError):
        list(Reader(bytes(damaged)))


def test_a_look_up_reads_little_of_a_shard():
    out = io.BytesIO()
    writer = Writer(out, 0)
    for k in range(400):
        writer.add(k, np.arange(2000, dtype=np.uint32))
    writer.finish()

    class Counted(io.BytesIO):
        seen = 0

        def read(self, *size):
            data = super().read(*size)
            self.seen += len(data)
            return data

    file = Counted(out.getvalue())
    (found,) = Reader(file).get(257)
    assert len(found) == 2000 and file.seen < len(out.getvalue()) / 10
    with pytest.raises(ValueError):
        Reader(io.BytesIO(out.getvalue()[:-1]))
    with pytest.raises(ValueError):
        Reader(b"")
