"""Names of one normalised form, and the model that settles ambiguous pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.operators import resolve
from loomgraph.plans.engine import Engine
from tests.test_engine import CONFIG, scripted

ENTITY = "name string, label string, ord long, mention_count long"


def all_pairs_plan(entities, seeds, vectors, config, same=None):
    """Every pair of the string gate, in order, each duplicate's first decision."""
    from loomgraph.functions import text as tx  # noqa: F401

    form = lambda n: "".join(c for c in n.lower() if c.isascii() and c.isalnum())
    alias, cos = {}, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    rows = sorted(entities, key=lambda e: e[2])
    first = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] != b[1] or form(a[0]) != form(b[0]):
                continue
            es = cos(vectors[a[0]], vectors[b[0]]) if a[0] in vectors and b[0] in vectors else None
            if es is not None and es < config.cosine - config.band:
                continue
            if es is not None and abs(es - config.cosine) <= config.band and same is not None and not same(a[0], b[0]):
                continue
            if a[0] in seeds or b[0] in seeds:
                keep = a if a[0] in seeds else b
            elif a[3] != b[3]:
                keep = a if a[3] > b[3] else b
            else:
                keep = a if len(a[0]) <= len(b[0]) else b
            lost = b if keep is a else a
            first.setdefault(lost[0], keep[0])
    return first | alias


@pytest.mark.parametrize("embedded", [False, True])
def test_equal_forms_decide_as_all_pairs_do(spark, embedded):
    rnd = random.Random(17)
    forms = ["ab", "cdefghijklm", ""]
    spelled = lambda f: "".join(c.upper() if rnd.random() < 0.5 else c for c in f) + rnd.choice(["", "-", "--", ".", "漢", "字漢"]) * rnd.randint(0, 3)
    names = sorted({spelled(rnd.choice(forms)) for _ in range(90)} - {""})
    rnd.shuffle(names)
    entities = [(n, rnd.choice("xy"), i, rnd.randrange(4)) for i, n in enumerate(names)]
    seeds = {names[5], names[40]}
    vectors = {n: [rnd.gauss(0, 1) for _ in range(3)] for n in names if rnd.random() < 0.8} if embedded else {}
    df = spark.createDataFrame(entities, ENTITY)
    told = spark.createDataFrame(list(vectors.items()), "name string, embedding array<double>") if embedded else None
    seeded = spark.createDataFrame([("no such surface", n) for n in seeds], "surface string, canonical string")
    for same, plain in ((None, None), (F.length("a_name") % 2 == 0, lambda a, b: len(a) % 2 == 0)):
        config = EngineConfig().with_(matching={"cosine": 0.1, "band": 0.3, "edits": 0, "similarity": 1.0})
        got = {r["duplicate"]: r["canonical"] for r in resolve.plan(df, seeded, told, config, same).collect()}
        assert got == all_pairs_plan(entities, seeds, vectors, config.matching, plain)


def test_many_names_of_one_form(spark):
    n = 100_000
    rows = spark.range(n).select(F.concat(F.lit("漢"), F.repeat(F.lit("字"), (F.col("id") % 7).cast("int")), F.conv("id", 10, 2).cast("string").alias("x")).alias("name"), F.lit("Concept").alias("label"), F.col("id").alias("ord"), (F.col("id") % 5).alias("mention_count"))
    rows = rows.withColumn("name", F.translate("name", "01", "一二"))
    seeds = spark.createDataFrame([], "surface string, canonical string")
    began = time.time()
    got = resolve.plan(rows, seeds, None, EngineConfig()).groupBy("canonical").count().collect()
    assert sum(r["count"] for r in got) == n - 1 and time.time() - began < 120


class Yes:
    """A model that says yes to some pairs and keeps a list of its calls."""

    model = "yes"

    def __init__(self, path, word):
        self.path, self.word = path, word

    def complete(self, prompt, system=None):
        with open(self.path, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        return "Yes." if self.word in prompt else "no"


def test_the_model_is_asked_for_ambiguous_pairs(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "s"), CONFIG.with_(matching={"cosine": 0.5, "band": 0.25}), extractor=scripted)
    vectors = {"Harbor Light": [1.0, 0.0], "Harbour Light": [0.6, 0.8], "Night Watch": [1.0, 0.0], "Night Watchh": [0.5, 0.9], "Sea Fog": [1.0, 0.0], "Sea Fogs": [1.0, 0.1], "Deck Hand": [1.0, 0.0], "Deck Hands": [0.0, 1.0]}
    entities = spark.createDataFrame([(n, "Concept", [], 1, "", i) for i, n in enumerate(vectors)], "name string, label string, aliases array<string>, mention_count long, summary string, ord long")
    chunks = spark.createDataFrame([(f"c{i}", f"c{i}", 0, "t", None, v, "m", 2) for i, v in enumerate(vectors.values())], own.store.table("chunks").schema)
    own.store.commit({"entities": entities, "chunks": chunks, "mentions": spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(vectors)], "chunk_id string, entity string")})
    own.model = Yes(str(tmp_path / "calls"), "Harbor")
    got = {r["duplicate"]: (r["canonical"], r["reason"]) for r in own.resolve().collect()}
    assert got == {"Harbour Light": ("Harbor Light", "llm"), "Sea Fogs": ("Sea Fog", "string+embed")}
    calls = (tmp_path / "calls").read_text().splitlines()
    assert len(calls) == 2 and sum("Harbor" in c for c in calls) == 1 and sum("Night" in c for c in calls) == 1
    names = {r["name"]: r["aliases"] for r in own.store.table("entities").collect()}
    assert len(names) == 6 and names["Harbor Light"] == ["Harbour Light"] and {r["entity"] for r in own.store.table("mentions").collect()} == set(names)


def test_candidates_are_not_broadcast_by_an_estimate(spark, tmp_path):
    # a small file of names, whose exploded keys Spark takes for as small
    spark.range(2000).select(F.concat(F.lit("name of part "), F.col("id").cast("string")).alias("name"), F.lit("Tool").alias("label"), (F.col("id") % 500).alias("case_id"), F.col("id").alias("ord"), F.lit(1).cast("long").alias("mention_count")).write.parquet(f"{tmp_path}/names")
    rows = spark.read.parquet(f"{tmp_path}/names")
    for by in ([], ["case_id"]):
        assert "Broadcast" not in resolve.candidates(rows, by=by)._jdf.queryExecution().executedPlan().toString()


def test_small_and_large_sets_meet_alike(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i % 4, "".join(rnd.choice("ab") for _ in range(rnd.randint(3, 12))), "xy"[i % 2], i, 1) for i in range(120)]
    df = spark.createDataFrame(list({r[:2]: r for r in rows}.values()), "case_id long, name string, label string, ord long, mention_count long")
    found = lambda: sorted(tuple(r) for r in resolve.candidates(df, by=["case_id"]).collect())
    small = found()
    monkeypatch.setattr(resolve, "_FEW", 0)
    assert small and small == found()
