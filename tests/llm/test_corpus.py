import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import boosting, lm, minhash, toxicity
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = fx.words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    """component of every id, by all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingle_set(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and 100 * len(a & b) >= 75 * len(a | b):
                        x, y = root(i), root(j)
                        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, sets


def check_components(table):
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    expected, sets = brute_components(rows)
    got = minhash.near_duplicates(table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] == len(sets[r["doc_id"]][0])
    return expected


def test_near_duplicates_awkward(spark):
    expected = check_components(fx.awkward(spark))
    assert expected[6] == expected[8] == 5 and expected[4] == 3 and expected[1] == 1
    assert minhash.near_duplicates(fx.empty(spark)).count() == 0


def test_near_duplicates_on_sample(spark):
    check_components(spark.read.parquet(f"{SF}/documents.parquet"))


def drifting(n, words=60, step=2, seed=1):
    """A chain of texts of which neighbours are alike and ends are not."""
    rng = np.random.default_rng(seed)
    own = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    out = []
    for _ in range(n):
        out.append(" ".join(own))
        own = own[step:] + [f"w{x}" for x in rng.integers(0, 10**6, step)]
    return out


def test_chains_and_common_passages_lose_no_link(spark):
    texts = drifting(40) + drifting(30, seed=2)
    passage = drifting(1, 40, seed=3)[0]
    texts += [passage + " " + drifting(1, n, seed=n)[0] for n in range(5, 45)]
    base = drifting(1, 80, seed=9)[0].split()
    rng = np.random.default_rng(4)
    for _ in range(60):  # copies that differ in a few words each: about at the threshold among themselves
        own = list(base)
        for k in rng.choice(80, 2, replace=False):
            own[k] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(own))
    order = rng.permutation(len(texts))
    check_components(fx.docs(spark, [texts[i] for i in order]))


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    texts = drifting(25) + [drifting(1, 40, seed=3)[0] + " " + drifting(1, n, seed=n)[0] for n in range(5, 40)]
    check_components(fx.docs(spark, texts))


def test_texts_around_a_passage_are_dealt_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    dealt, sent = minhash._dealt, []

    def counted(*args):
        out = dealt(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_dealt", counted)
    passage = drifting(1, 60, seed=3)[0]
    for n in (100, 200, 400):
        texts = [f"{passage} {drifting(1, 70, seed=100 + k)[0]}" for k in range(n)]
        texts += [f"{t} {'and so on ' * 2}" for t in texts[: n // 10]]
        labels = minhash.near_duplicates(fx.docs(spark, texts)).select("doc_id", "component_id").collect()
        assert all(r["component_id"] == (r["doc_id"] if r["doc_id"] < n else r["doc_id"] - n) for r in labels)
    assert sent[1] <= 2 * sent[0] + 16 and sent[2] <= 2 * sent[1] + 16


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (200, 150), (200, 180), (7, 7)]
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == got[102] == 100 and got[200] == got[180] == 150


def test_deduplicated_keeps_columns(spark):
    table = fx.awkward(spark)
    out = minhash.deduplicated(table)
    assert out.columns == table.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect())
    assert ids == [-1, -1, 0, 1, 2, 3, 5, *([7] if brute_components([(r["doc_id"], r["text"]) for r in table.collect()])[0][7] == 7 else []), 9, 11, 12, 13]


def test_texts_that_share_an_id(spark):
    a, b, c, d, e, f = (drifting(1, 60, seed=n)[0] for n in range(20, 26))
    near = lambda t: t + " more words"
    rows = [(9, a), (9, b), (4, near(a)), (6, near(b)), (6, c), (7, c), (7, ""), (1, d), (1, near(d)), (1, d), (1, e), (2, ""), (2, None), (2, f), (3, near(f)), (None, a)]
    table = fx.docs(spark, [t for _, t in rows], [i for i, _ in rows])
    expected, _ = brute_components(rows)
    got = minhash.near_duplicates(table).collect()
    assert len(got) == len(rows) and {i: expected[i] for i in (4, 6, 7, 9, 3)} == {4: 4, 6: 4, 7: 4, 9: 4, 3: 2}
    assert all(r["component_id"] == expected.get(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)
    left = Counter((r["doc_id"], r["text"] or "") for r in minhash.deduplicated(table).collect())
    first = (1, d) if (1, d) in left else (1, near(d))
    assert left == Counter([(4, near(a)), (6, near(b)), (6, c), (7, ""), first, (1, e), (2, ""), (2, f), (None, a)])


def test_pruning_bounds():
    least = minhash.least_matches(1e-6)
    assert least == sorted(least) and 0 <= least[0] and least[-1] < minhash.HASHES * minhash.THRESHOLD


def test_interpolated_scores(spark):
    texts = [t for t in fx.TEXTS] + drifting(40) + drifting(40)
    table = fx.docs(spark, texts).unionByName(fx.docs(spark, ["no id", None], [None, None]))
    rows = lm.interpolated_scores(table).collect()
    assert len(rows) == table.count()
    count, tokens = Counter(), []
    for r in table.collect():
        own = [*fx.words(r["text"]), None]
        tokens.append((r["doc_id"], own))
        if fx.fold(r["doc_id"], 5) != 1:
            count.update(own)
    n, v = sum(count.values()), len(count)
    expected = Counter((i, fx.fold(i, 5) == 1, len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)) for i, own in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert lm.interpolated_scores(fx.empty(spark)).count() == 0


def test_scores_by_brute_force(spark):
    texts = drifting(30) + drifting(10, seed=5)
    out = lm.interpolated_scores(fx.docs(spark, texts))
    weights = out._loom_weights
    uni, bi = Counter(), Counter()
    for i, t in enumerate(texts):
        if fx.fold(i, 5) != 1:
            own = [None, *fx.words(t), None]
            uni.update(own[1:])
            bi.update(zip(own, own[1:], strict=False))
    n, v = sum(uni.values()), len(uni)
    for r in out.collect():
        own, total = [None, *fx.words(texts[r["doc_id"]]), None], 0.0
        for h, w in zip(own, own[1:], strict=False):
            k = weights[int(lm.bucket_of(np.array([uni[h]]))[0])]
            total += math.log10(k[0] * (bi[h, w] / uni[h] if uni[h] else 0) + k[1] * uni[w] / n + k[2] / (v + 1))
        assert r["score"] == pytest.approx(total, rel=1e-9)
    assert np.allclose(weights.sum(axis=1), 1)


def test_levels_of_messages_give_the_same(spark):
    texts = [*fx.TEXTS, "end\x1fof\x1ftext", *drifting(40), *drifting(30, seed=4)]
    table = fx.docs(spark, texts)
    one, many = (sorted(lm.interpolated_scores(table, **o).collect(), key=lambda r: r["doc_id"]) for o in ({}, {"batch_bytes": 400, "fan_bits": 2}))
    assert lm.Levels(30, 2).groups == [30, 8, 2, 1]
    for a, b in zip(one, many, strict=True):
        assert a[:5] == b[:5] and a["base_score"] == pytest.approx(b["base_score"]) and a["score"] == pytest.approx(b["score"])


def test_the_end_is_no_word(spark):
    i = next(i for i in range(100) if fx.fold(i, 5) == 1)
    rows = {r["doc_id"]: r for r in lm.interpolated_scores(fx.docs(spark, ["end\x1fof\x1ftext", "a b"], [i, next(i for i in range(100) if fx.fold(i, 5) == 0)])).collect()}
    assert (rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (2, 1, 3)


def test_packed_keys():
    rng = np.random.default_rng(0)
    for bits, prefix in ((8, 3), (16, 65535), (24, 1)):
        keys = np.unique((rng.integers(0, 2**63, 500, dtype=np.uint64) >> np.uint64(bits)) | np.uint64(prefix << (64 - bits)))
        assert (lm.unpack_keys(lm.pack_keys(keys, bits, 64), prefix, bits, 64) == keys).all()
        cut = np.uint64(64 - bits - min(40, 64 - bits))
        assert (lm.unpack_keys(lm.pack_keys(keys, bits, 40), prefix, bits, 40) >> cut == keys >> cut).all()


def test_no_training_rows(spark):
    only = next(i for i in range(100) if fx.fold(i, 5) == 1)
    row = lm.interpolated_scores(fx.docs(spark, ["a b"], [only])).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["base_score"] == 0.0 and abs(row["score"]) < 1e-9


def test_pack_numbers():
    for values in ([], [0, 0], [255], [256, 1], [2**32 - 1, 5], [2**40, 7], list(range(1000))):
        assert lm.unpack(lm.pack(np.array(values, np.int64))).tolist() == values


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    trees = boosting.fit_trees(x[:1000], y[:1000], np.ones(1000))
    assert ((trees.raw(x[1000:]) > 0) == y[1000:]).mean() > 0.93
    xs, ys = boosting.fit_isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert ys.tolist() == [0.0, 0.5, 1.0, 1.0] or ys.tolist() == [0.0, 0.5, 1.0]
    assert (np.diff(xs) > 0).all()


@pytest.mark.parametrize("word, plain, hidden", [("Idiot!!", "idiot", False), ("1d10t", "idiot", True), ("$tup1d,", "stupid", True), ("don't", "don't", False), ("2024", "2024", False), ("s.t.u.p.i.d", "stupid", True), ("", "", False)])
def test_normal_words(word, plain, hidden):
    assert toxicity.normal(word) == (plain, hidden)


def test_toxicity_on_planted_texts(spark):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(400):
        own = [f"w{x}" for x in rng.integers(0, 500, 80)]
        if i % 5 == 0:
            for k in rng.choice(80, 4, replace=False):
                own[k] = rng.choice(["idiot", "st*pid", "grumblefoo", "grumblebar", "Sc0m", "you", "m0r0n"])
            own[3] = "moron"
        texts.append(" ".join(own))
        labels.append((i, 1, int(i % 5 == 0)))
    table = fx.docs(spark, [*texts, None, ""])
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score_documents(table, known).collect()}
    assert len(rows) == 402 and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [r for i, r in rows.items() if r["held_out"] and i < 400]
    assert all(r["held_out"] == (fx.fold(i, 3) == 1) for i, r in rows.items())
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    kept = toxicity.without_toxic(table, known)
    assert kept.columns == table.columns and kept.count() < 402
    assert toxicity.score_documents(fx.empty(spark), known.where("false")).count() == 0
    plain = toxicity.score_documents(fx.awkward(spark), known.where("false")).collect()
    assert len(plain) == fx.awkward(spark).count() and not any(r["predicted"] for r in plain)


def test_a_callers_words_speak_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    table = fx.docs(spark, ["you grumblefoo", "nothing of note in this text", None])
    assert [r["predicted"] for r in toxicity.score_documents(table, none, words=["Grumblefoo"]).orderBy("doc_id").collect()] == [1, 0, 0]
    assert not toxicity.score_documents(table, none).where("predicted = 1").count()


def plain_features(text, lexicon):
    """The features of one text, word by word."""
    words = text.split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    n, hits, strong, second, hidden, shouted, drawn = len(words), [], 0, [], 0, 0, 0
    for i, w in enumerate(words):
        bare, disguised = toxicity.normal(w)
        if "*" in bare and len(bare) > 2:
            fits = [k[1:] for k in sorted(lexicon) if k[0] == "=" and len(k) == len(bare) + 1 and all(a in ("*", b) for a, b in zip(bare, k[1:], strict=True))]
            bare = fits[0] if fits else bare
        keys = ["=" + bare, *(bare[:k] for k in (3, 4, 5, 6) if k < len(bare))] if bare else []
        weight = max((lexicon.get(k, 0.0) for k in keys), default=0.0)
        if weight > 0:
            hits.append((i, weight, disguised, w.lower()))
        strong += weight >= 4
        hidden += disguised
        if bare in toxicity.SECOND_PERSON:
            second.append(i)
        shouted += len(w) > 2 and w.isupper()
        drawn += any(w[k].isalpha() and w[k : k + 4] == w[k] * 4 for k in range(len(w) - 3))
    close = sum(any(abs(i - j) <= 5 for j in second) for i, *_ in hits)
    lexical = [max((h[1] for h in hits), default=0.0), len(hits) / n, sum(h[1] for h in hits) / n, len(hits), len({h[3] for h in hits}), strong / n, close / n, sum(h[2] for h in hits)]
    lexical = lexical if hits else [0.0] * 8
    runs = len(toxicity.re.findall(r"[!?]{2,}|\.{4,}", text))
    upper = sum("A" <= c <= "Z" for c in text)
    return [*lexical, hidden / n, math.log1p(n), upper / len(text.encode()), shouted / n, (text.count("!") + text.count("?")) / n, runs / n, drawn / n]


def test_features_and_scores_by_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [*(f"w{'abcdefgh'[k % 8]}{'xyz'[k % 3]}rd" for k in range(60)), "you", "DICH", "Sooooo", "grumblefoo", "gr*mblefoo", "Grumblef00!!", "moppel", "Moppelig", "wh4t?", "!!", "...."]
    texts = [" ".join(rng.choice(vocabulary[: 63 if i % 3 else None], 40).tolist() + ["grumblefoo moppel"] * (i % 3 == 0)) for i in range(240)]
    table = fx.docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    sample, totals = toxicity.sampled(table, labels, 3, 1, 3000)
    rows = sample.collect()
    lexicons = toxicity.Lexicons(sample)
    assert totals == Counter(int(i % 3 == 0) for i in range(240) if fx.fold(i, 3) != 1)
    assert {"=grumblefoo", "=moppel"} <= lexicons.counts.keys()
    for key, counts in lexicons.counts.items():
        held = Counter((r["fold"], r["toxic"]) for r in rows if key in toxicity.count_keys([r["text"]]))
        assert counts.tolist() == [[held[k, label] for label in (0, 1)] for k in range(toxicity.FOLDS)]
    own = [lexicons.without(k) for k in range(toxicity.FOLDS)]
    for r in toxicity.features_of(sample, own):
        assert list(r["x"]) == pytest.approx(plain_features(texts[r["doc_id"]], own[r["fold"]]))
    model = toxicity.train(table, labels)
    got = toxicity.score_documents(table, labels).collect()
    x = np.array([plain_features(texts[r["doc_id"]], model.lexicon) for r in got])
    raw = np.full(len(x), model.trees.base)
    for feature, threshold, left, value in model.trees.trees:
        for i, v in enumerate(x):
            node = 0
            while feature[node] >= 0:
                node = left[node] + (v[feature[node]] > threshold[node])
            raw[i] += value[node]
    expected = 0.999 * np.interp(raw, *model.knots) + 0.001 / (1 + np.exp(-raw))
    assert [r["score"] for r in got] == pytest.approx(np.clip(expected, 0, 1).tolist())


def test_labels_of_held_out_rows_are_not_learned(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold_of("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(toxicity.score_documents(table, x).collect()) for x in (labels, turned))
    assert a == b
