"""Periodic runs, repeated strings and resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import importance, minhash, parsing, queries, runs, suffixes
from tests.conftest import SF
from tests.llm import fixtures as fx
from tests.oracle import rows_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q - s), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_removed(rows):
    """kept bytes and removed spans of (order, text) rows; equal rows are one."""
    first, out = {}, {}
    for _, t in sorted(set(rows)):
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if first.setdefault(raw[k : k + 100], (_, t, k)) != (_, t, k):
                gone[k : k + 100] = b"\1" * 100
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))]
        out[_, t] = (spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return out


def plain_resampled(docs, target, percent=25, least=20, seed=7):
    def features(text):
        w = WORD.findall((text or "").translate(fx.FOLD))
        return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    cut = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in cut for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    rows = []
    for i, n, f in cut:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], -(1 << 63) if r[0] is None else r[0], r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_suffix_order_and_common_prefixes():
    rnd = random.Random(3)
    for _ in range(60):
        texts = [[rnd.randrange(rnd.choice([1, 2, 9])) for _ in range(rnd.choice([0, 1, 5, 60]))] for _ in range(rnd.randint(1, 5))]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        keys = np.array([1000 * d + w for d, t in enumerate(texts) for w in t], np.int64)
        levels = suffixes.doubled(suffixes.classes(keys), np.repeat(offsets[1:], np.diff(offsets)))
        order = np.argsort(levels[-1], kind="stable")
        ends = np.repeat(offsets[1:], np.diff(offsets))
        told = [tuple(keys[i : ends[i]]) for i in order]
        assert told == sorted(told) and len(set(levels[-1].tolist())) == len(keys)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert suffixes.common_prefixes(levels, order).tolist() == [0] * bool(told) + [common(a, b) for a, b in zip(told, told[1:], strict=False)]


def test_runs_of_random_and_periodic_words():
    rnd = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            k, n = rnd.choice([1, 2, 3, 50]), rnd.choice([0, 1, 11, 12, 13, 40, 120])
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a, p = rnd.randrange(n), rnd.randint(1, n)
                w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else w[i] for i in range(n)]
            texts.append(w)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        keys = np.array([1000 * d + w for d, t in enumerate(texts) for w in t], np.int64)
        found = runs.maximal_runs(suffixes.classes(keys), offsets)
        own = np.searchsorted(offsets, found[:, 0], "right") - 1
        for d, w in enumerate(texts):
            assert [(s - offsets[d], n, q) for (s, n, q), o in zip(found.tolist(), own.tolist(), strict=True) if o == d] == plain_runs(w)


def test_word_runs_of_awkward_rows(spark):
    docs = fx.awkward(spark).unionByName(fx.docs(spark, ["so it goes " * 9 + "end", "  a\tb a\nb " * 7, "A a " * 20, "x " * 5000, "no break no break " * 8], [100, 101, 102, 103, 103]))
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.word_runs(docs).collect())
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        w = fx.WORD.findall(r["text"] or "")
        found = plain_runs(w) if len(w) < 6000 or len(set(w)) < 5 else []
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        expected[r["doc_id"], len(w), tuple(found), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == expected
    assert runs.word_runs(fx.empty(spark)).count() == 0


def test_marks_and_block_order():
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcde fgh") for _ in range(2000)).encode()
    for _ in range(60):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            t, size = b"", rnd.choice([0, 99, 100, 101, 400, 900])
            while len(t) < size:
                a = rnd.randrange(1700)
                t += rnd.choice([base[a : a + rnd.randint(20, 300)], b"ab" * rnd.randint(1, 100), b"\0" * rnd.randint(1, 150), rnd.randbytes(rnd.randint(1, 80))])
            texts.append(t)
        raw = b"".join(texts)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        place, low, high = parsing.marks(data, offsets, parsing.eights(data))
        assert [i for a, b in zip(low, high, strict=True) for i in range(a, b + 1)] == [i + o for o, t in zip(offsets, texts, strict=False) for i in range(len(t) - 99)]
        # equal strings have equal marks
        spots = {}
        for p, a, b in zip(place, low, high, strict=True):
            for i in range(a, b + 1):
                assert spots.setdefault(raw[i : i + 100], p - i) == p - i <= 56
        held = [t for t in texts if len(t) >= 100]
        raw = b"".join(held)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in held]))).astype(np.int64)
        wanted = np.array([i + o for o, t in zip(offsets, held, strict=False) for i in range(len(t) - 99) if rnd.random() < 0.8], np.int64)
        if len(wanted):
            there, same = parsing.block_order(data, parsing.eights(data), offsets, wanted)
            told = [raw[i : i + 100] for i in there]
            assert told == sorted(told) and same.tolist() == [False] + [a == b for a, b in zip(told, told[1:], strict=False)]


def repeated_texts():
    rnd = random.Random(11)
    make = lambda n: "".join(rnd.choice("abcdefgh ijklmnopö") for _ in range(n))
    passage, notice, long_ = make(700), make(260), make(3000)
    texts = [None, "", "short", "x" * 100, "x" * 99, "x" * 101, "x" * 500, passage, passage + make(50), make(80) + passage[100:400] + make(80), "ab" * 120 + make(40), long_, long_[:1500] + "!" + long_[1500:], long_]
    texts += [make(rnd.randint(0, 150)) + notice + make(rnd.randint(0, 150)) for _ in range(60)]
    texts += ["漢字" * 60 + make(30), make(20) + "漢字" * 60, "a\0b" * 90]
    return texts


def check_removed(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    hashes = {r[0]: r[1] for r in docs.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    order = lambda i, t: (-(1 << 63) if i is None else i, hashes[t])
    plain = plain_removed([(order(i, t), t) for i, t in rows])
    expected = Counter((i, len(t.encode()), tuple(plain[order(i, t), t][0]), plain[order(i, t), t][1]) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in parsing.without_repeats(docs).collect()) == expected


def test_removed_repeats_of_awkward_rows(spark):
    texts = repeated_texts()
    ids = [i if i % 7 else (None if i == 14 else i // 2) for i in range(len(texts))]
    docs = fx.docs(spark, texts, ids)
    check_removed(spark, docs.unionByName(docs.where("doc_id IN (11, 20)")).unionByName(fx.docs(spark, [fx.LONG, fx.LONG[:5000] + "?" + fx.LONG[5000:9000]], [900, 901])))
    assert parsing.without_repeats(fx.empty(spark)).count() == 0


def test_removed_repeats_do_not_depend_on_partitions(spark):
    docs = fx.docs(spark, repeated_texts())
    base = rows_of(parsing.without_repeats(docs.repartition(1)))
    assert rows_of(parsing.without_repeats(docs.repartition(23, "text"))) == base


def test_blocks_hold_whole_keys_or_say_so(monkeypatch):
    monkeypatch.setattr(parsing, "BLOCK_BYTES", 4000)
    rnd = random.Random(13)
    keys = sorted(k for k in range(40) for _ in range(rnd.choice([1, 2, 30, 6000 if k in (7, 8, 21) else 3])))
    table = pa.table({"key": pa.array(keys, pa.int64()), "split": pa.array([k == 3 for k in keys]), "bytes": pa.array([b"x" * 10] * len(keys))})
    out = list(parsing._blocks(iter(table.to_batches(max_chunksize=700))))
    assert [k for t, _ in out for k in t.column("key").to_pylist()] == keys
    blocks = {}
    for n, (t, _) in enumerate(out):
        for k in set(t.column("key").to_pylist()):
            blocks.setdefault(k, set()).add(n)
    for t, split in out:
        assert split.tolist() == [k == 3 or len(blocks[k]) > 1 for k in t.column("key").to_pylist()]


@pytest.mark.parametrize("percent, least", [(25, 20), (100, 1)])
def test_resampled_awkward_rows(spark, percent, least):
    docs = fx.awkward(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *[f"CAST(NULL AS {t}) AS {n}" for n, t in fx.awkward(spark).dtypes[5:]]))
    target = spark.createDataFrame([("The QUICK brown fox, ok?",), (None,), ("",), ("lazy dog straße",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = Counter(map(tuple, importance.resampled(docs, target, percent, least).collect()))
    assert got == plain_resampled(rows, [r[0] for r in target.collect()], percent, least)
    assert importance.resampled(fx.empty(spark), target).count() == 0
    assert importance.resampled(docs.limit(3), target.limit(0)).count() == 3


def test_planted_repeats_by_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["text"] for r in runs.planted(docs).collect()}
    for r in docs.collect():
        w, h = fx.WORD.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert got[r["doc_id"]].split(" ") == [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
        else:
            assert got[r["doc_id"]] == (r["text"] or "")


def test_digests_of_the_runs_query(spark):
    rows = {r["doc_id"]: r for r in runs.word_runs(runs.planted(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op11_periodic_runs(spark, SF).collect():
        own = rows[r["doc_id"]]
        best = min(own["runs"], key=lambda x: (-x["length"], x["start"], x["period"]), default=None)
        told = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
        assert tuple(r) == (r["doc_id"], len(own["runs"]), *told, sha("".join(f"{a},{b},{c}\n" for a, b, c in own["runs"])), sha(own["collapsed"]))


def test_of_equal_sets_under_one_id_the_same_row_stays_in_any_order(spark):
    texts = ["one two three four five six", "one  two three four five six", "ONE two three four five  six", "", "  ", None]
    ids = [4, 4, 4, 9, 9, 9]
    kept = set()
    for order in (range(6), reversed(range(6)), (2, 5, 0, 3, 1, 4)):
        at = list(order)
        docs = fx.docs(spark, [texts[i] for i in at], [ids[i] for i in at]).select("doc_id", "text", F.map_from_arrays(F.array(F.lit("k")), F.array("bucket")).alias("m")).coalesce(1)
        kept.add(tuple(sorted((r["doc_id"], repr(r["text"])) for r in minhash.deduplicated(docs).collect())))
    assert len(kept) == 1 and [i for i, _ in kept.pop()] == [4, 9]


def test_texts_of_distinct_ids_need_one_python_worker(spark):
    """A sieve over ids with several texts would take a second worker in each task that reads texts; it is there only where such ids are."""
    python = lambda rows: parsing._marked(parsing._texts(spark.createDataFrame(rows, "doc_id long, text string"), 2))._jdf.queryExecution().executedPlan().toString()
    once = [(1, "a" * 200), (2, "b" * 200), (None, None)]
    assert "MapInArrow" in python(once) and "ArrowEvalPython" not in python(once)
    assert "ArrowEvalPython" in python([*once, (1, "c" * 200)])


def test_tasks_of_repeats_follow_the_input(spark):
    """The estimate of a join multiplies its sides: tables of a few MB had tens of thousands of tasks where that product was small enough to be believed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = parsing._texts(docs, 2)
    judged = parsing.materialize(parsing._judged(parsing._marked(texts)), "judged")
    tasks = parsing.partitions_for(docs)
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = parsing._strings(parsing._stretches(texts, judged), tasks)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(home#" in dealt and set(re.findall(r"hashpartitioning\(home#\d+L?, (\d+)\)", dealt)) == {str(tasks)}
