import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import digest, media
from loomgraph.llm.chat import format_conversations, parse, read_back
from loomgraph.llm.common import spot_of, text_of
from loomgraph.llm.mixing import mix_sources, mixed_documents, order_key, source_targets, word_count
from tests.llm import fixtures as fx


def test_stored_texts(spark):
    table = fx.awkward(spark)
    rows = media.stored_texts(table).collect()
    assert len(rows) == table.count()
    texts = dict(enumerate(fx.TEXTS))
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        stored = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]))
        assert (r["codec"], r["timescale"], r["duration"], len(r["keyframes"])) == ("raw ", media.RATE, len(stored), -(-len(stored) // (192 * 64)))
    assert media.stored_texts(fx.empty(spark)).count() == 0
    nothing = spark.createDataFrame([(None,)], "media binary").select(media.media_digest(F.col("media")).alias("d")).select("d.*").first()
    assert all(v is None for v in nothing)


@pytest.mark.parametrize("units", [1, 63, 64, 65, 128, 1000])
def test_container_round_trip(units):
    raw = bytes(np.random.default_rng(units).integers(0, 256, units * 192, np.uint8))
    stored = media.mux(raw)
    track = media.probe(stored)[0]
    assert media.payload(stored, track) == raw
    assert (track.codec, track.kind, track.timescale, track.duration, track.units) == ("raw ", "soun", 48000, len(raw), units)
    keys = track.keyframes()
    assert len(keys) == -(-units // 64) and all(stored[a : a + n] == raw[k * 64 * 192 : k * 64 * 192 + 192] for k, (a, n) in enumerate(keys))


def test_walks_other_layouts():
    """Sizes of their own, several chunks with gaps, no stss, version 0 times, a 64-bit box, unknown boxes."""
    import struct

    box, full = media._box, media._full
    parts = [b"aaaa", b"bb", b"cccccc"]
    head = box(b"ftyp", b"isom", bytes(4))

    def moov(offsets):
        table = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"avc1", bytes(78))),
            full(b"stts", 0, 0, struct.pack(">III", 1, 3, 10)),
            full(b"stsc", 0, 0, struct.pack(">I6I", 2, 1, 1, 1, 2, 2, 1)),
            full(b"stsz", 0, 0, struct.pack(">II3I", 0, 3, 4, 2, 6)),
            full(b"stco", 0, 0, struct.pack(">I2I", 2, *offsets)),
        )
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 600, 30)), full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(13)), box(b"minf", table))
        return box(b"moov", box(b"trak", box(b"free", b"zz"), mdia))

    start = len(head) + len(moov((0, 0))) + 16
    body = parts[0] + b"GAP" + parts[1] + parts[2]
    stored = head + moov((start, start + 7)) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body
    track = media.probe(stored)[0]
    assert media.payload(stored, track) == b"".join(parts)
    assert (track.codec, track.kind, track.duration) == ("avc1", "vide", 30)
    assert track.keyframes() == [(start, 4), (start + 7, 2), (start + 9, 6)]


def test_media_info_reports_damage(spark):
    good = media.mux(b"x" * 192)
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(good[:100])), (5, bytearray(b"junk and more junk"))], "k int, media binary")
    got = {r["k"]: r["info"] for r in media.media_info(rows).collect()}
    assert got[1]["codec"] == "raw " and got[1]["keyframes"][0]["length"] == 192 and got[1]["error"] is None
    assert all(got[k]["error"] and got[k]["codec"] is None for k in (2, 3, 4, 5))


def test_media_info_of_all_tracks_and_compact_sizes(spark):
    import struct

    box, full = media._box, media._full

    def trak(codec, sizes, start):
        table = box(b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), box(codec, bytes(78))), full(b"stsc", 0, 0, struct.pack(">I3I", 1, 1, 3, 1)), full(b"stz2", 0, 0, sizes), full(b"stco", 0, 0, struct.pack(">2I", 1, start)))
        return box(b"trak", box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 600, 30)), box(b"minf", table)))

    head = lambda bits: struct.pack(">II", bits, 3)
    kinds = {4: b"\x42\x60", 8: bytes([4, 2, 6]), 16: struct.pack(">3H", 4, 2, 6)}
    stored = box(b"moov", *[trak(b"avc%d" % bits, head(bits) + raw, 1000 * bits) for bits, raw in kinds.items()])
    plain = media.mux(b"x" * 192)
    rows = spark.createDataFrame([(1, bytearray(stored)), (2, bytearray(plain + box(b"moof", box(b"traf"))))], "k int, media binary")
    got = {r["k"]: r["info"] for r in media.media_info(rows).collect()}
    assert [(t["codec"], t["units"], [tuple(k) for k in t["keyframes"]]) for t in got[1]["tracks"]] == [(f"avc{b}"[:4], 3, [(1000 * b, 4), (1000 * b + 4, 2), (1000 * b + 6, 6)]) for b in kinds]
    assert got[1]["codec"] == "avc4" and got[1]["error"] is None
    assert "moof" in got[2]["error"] and got[2]["units"] is None and got[2]["tracks"] is None


def test_targets_are_water_filling(spark):
    rng = np.random.default_rng(8)
    for sizes in ([100, 5, 50], [10, 10, 10, 10], [1000, 1], [7], [0, 0], [0, 9], rng.integers(0, 500, 23).tolist()):
        names = [None if i == len(sizes) - 1 else f"s{i:02d}" for i in range(len(sizes))]
        got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
        weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        target, over = [0.0] * len(sizes), 1.5 * sum(sizes)
        open_ = set(range(len(sizes)))
        while over > 1e-9 and open_:
            total = sum(weight[i] for i in open_)
            for i in open_:
                target[i] += over * weight[i] / total
            over = sum(max(0, target[i] - 2 * sizes[i]) for i in open_)
            full = {i for i in open_ if target[i] >= 2 * sizes[i]}
            for i in full:
                target[i] = 2.0 * sizes[i]
            open_ -= full
        assert [got[n] for n in names] == pytest.approx(target, abs=1e-6)


def test_mix(spark):
    table = fx.awkward(spark)
    sized = table.withColumn("size", word_count("text"))
    for ranges in (1, 64):
        rows = mix_sources(sized, order_key(["doc_id", "text"]), ranges=ranges).collect()
        assert len(rows) == table.count()
        by = {}
        for r in rows:
            assert r["size"] == len(fx.WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
            own = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
            own[0] += r["size"]
            own[1] += r["taken"]
        for size, taken, target, source_size in by.values():
            assert size == source_size and abs(taken - target) <= 0.5
        assert sum(1 for r in rows if r["size"] and r["taken"] % r["size"]) <= len(by)
    again = mix_sources(sized.repartition(5), order_key(["doc_id", "text"]), ranges=64)
    assert sorted((r["doc_id"] or -1, r["text"] or "", r["taken"]) for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "", r["taken"]) for r in again.collect())
    assert mix_sources(fx.empty(spark).withColumn("size", F.lit(1).cast("long")), order_key(["doc_id"])).count() == 0


@pytest.mark.parametrize("ranges", [1, 64])
def test_mix_by_a_plain_cut(spark, ranges):
    """taken of every row against order, running sum and cut in plain Python; many rows share the keys at the cuts."""
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 4}" if i % 4 else None, int(rng.integers(0, 50)), int(rng.integers(-2**63, 2**63, dtype=np.int64))) for i in range(300)]
    rows += [(1000 + i, "hot", 7, 5) for i in range(200)] + [(2000 + i, "odd", i % 5, -9 + i % 2) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, key long").repartition(7)
    got = {r["doc_id"]: r for r in mix_sources(table, F.col("key"), ranges=ranges).collect()}
    bits = ranges.bit_length() - 1
    by = {}
    for i, source, size, key in rows:
        by.setdefault(source, []).append(((key % 2**64) >> (64 - bits) if bits else 0, key, size, i))
    for source, own in by.items():
        total = sum(x[2] for x in own)
        target = next(r["target"] for r in got.values() if r["source"] == source)
        whole, left = divmod(round(target), total)
        keys = sorted({x[:2] for x in own})
        for key in keys:
            same = [x for x in own if x[:2] == key]
            words = sum(x[2] for x in same)
            taken = [got[x[3]]["taken"] - whole * x[2] for x in same]
            assert sum(taken) == min(left, words) and all(0 <= t <= x[2] for t, x in zip(taken, same, strict=True))
            assert sum(0 < t < x[2] for t, x in zip(taken, same, strict=True)) <= 1
            left -= sum(taken)


def test_mix_is_native(spark):
    plan = mix_sources(fx.docs(spark).withColumn("size", word_count("text")), order_key(["doc_id"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_mixed_documents(spark):
    table = fx.awkward(spark)
    out = mixed_documents(table)
    assert out.columns == table.columns
    taken = mix_sources(table.withColumn("size", word_count("text")), order_key(["doc_id", "text"])).agg(F.sum("taken")).first()[0]
    assert sorted(map(tuple, mixed_documents(table.repartition(6)).collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    assert out.agg(F.sum(word_count("text"))).first()[0] == taken
    whole = {(r["doc_id"], r["text"]) for r in table.collect()}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and any(r["doc_id"] == d and (t or "").startswith(r["text"]) for d, t in whole)
    assert mixed_documents(fx.empty(spark)).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>\n<|im_start|>assistant\nok"), (1, 2, "assistant", "C:\\new\\<|x"), (1, 3, "assistant", None),
    (2, None, None, "no role"), (2, 1, "user", ""), (2, 1, "user", ""), (2, 2, "role\nwith <|im_end|> line", "text\n"),
    (None, 5, "assistant", "<\\|im_end|> ends with <"), (3, 0, "user", "\\"), (3, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (4, 0, "assistant", "Ü🙂" * 9000),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*t, "x", "y") for t in TURNS], "conv_id long, turn long, role string, text string, piece string, kept string").repartition(3)
    formatted = format_conversations(rows)
    got = {r["conv_id"]: r for r in read_back(formatted).collect()}
    by = {}
    for c, turn, role, text in sorted(TURNS, key=lambda t: (t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    raw = {r["conv_id"]: r for r in formatted.select("*", parse(F.col("formatted")).alias("turns")).collect()}
    for c, r in raw.items():
        assert [(t["role"], t["text"]) for t in r["turns"]] == by[c]
        assert r["formatted"].count("<|") == 2 * len(by[c])
    assert raw[4]["escaped"] == 0 and raw[1]["escaped"] == 2 and all(r["error"] is None for r in raw.values())
    assert read_back(format_conversations(rows.where("conv_id = 99"))).count() == 0
    plan = read_back(formatted)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def hot(spark):
    """A third of the rows has one id, a third none."""
    texts = [f"text {i} " * (i % 7) for i in range(300)]
    return fx.docs(spark, texts, [7 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(300)])


@pytest.mark.parametrize("make", [fx.awkward, hot])
def test_digests(spark, make):
    table = make(spark)
    got = digest.edited_neighbours(table).collect()
    rows = table.select("doc_id", text_of("text").alias("text"), spot_of(text_of("text")).alias("spot")).collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["spot"], r["text"]))]
    expected = []
    for k, (i, t) in enumerate(rows):
        n, after = len(t), rows[(k + 1) % len(rows)][1]
        edited = t[: n - n // 2] + after[: n // 2]
        a, b, c = digest.digest_texts([t, edited, after])
        expected.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), digest.to_text(a[None])[0], digest.to_text(b[None])[0], float(digest.likeness(a[None], b[None])[0]), float(digest.likeness(a[None], c[None])[0])))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_digests_of_few_rows(spark):
    assert digest.edited_neighbours(fx.empty(spark)).count() == 0
    one = digest.edited_neighbours(fx.docs(spark, [fx.BASE])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_bucket_counts_by_brute_force():
    texts = [fx.BASE, "", "ab", "abc", "abcd", fx.LONG[:3000], "ñ" * 50]
    data, at = digest.utf8(__import__("pyarrow").array(texts))
    counts = digest.bucket_counts(data, at)
    for i, t in enumerate(texts):
        raw, own = t.encode(), [0] * digest.BUCKETS
        for tables, (_, j, k) in zip(digest._TABLES, digest.TRIPLETS, strict=True):
            for p in range(len(raw) - k):
                own[tables[0][raw[p]] ^ tables[1][raw[p + j]] ^ tables[2][raw[p + k]]] += 1
        assert counts[i].tolist() == own


def test_likeness_follows_edits():
    near = digest.digest_texts([fx.BASE * 5, (fx.BASE * 5).replace("fox", "cat"), fx.LONG[:700]])
    same, edit, other = (float(digest.likeness(near[:1], near[k : k + 1])[0]) for k in range(3))
    assert same == 1.0 > edit > other >= 0.0


def test_fingerprints_of_equal_texts(spark):
    rows = digest.fingerprints(fx.docs(spark)).collect()
    by = {}
    for r in rows:
        assert by.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
