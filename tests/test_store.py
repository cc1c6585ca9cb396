"""The store's layers: what is written, merged on read, refused, put together and removed."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.plans.engine import Engine
from loomgraph.plans.store import Change, Conflict, DuplicateKey, Store, _meet
from loomgraph.schemas import TABLES
from tests.conftest import ROOT, SF
from tests.test_engine import CONFIG, scripted


def entities(spark, *names, label="x"):
    return spark.createDataFrame([(n, label, [], 1, "", i) for i, n in enumerate(names)], TABLES["entities"])


def owners(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "owner string")


def held(rows):
    return sorted((r["name"], r["label"]) for r in rows.collect())


def test_layers_are_those_of_a_plain_table(spark, tmp_path):
    store, plain, rnd = Store(spark, str(tmp_path)), {}, random.Random(3)
    for step in range(9):
        names = sorted({f"n{rnd.randrange(12)}" for _ in range(rnd.randint(0, 3))})
        gone = sorted({f"n{rnd.randrange(12)}" for _ in range(rnd.randint(0, 2))})
        store.commit({"entities": Change(entities(spark, *names, label=str(step)), owners(spark, *gone) if gone else None)})
        plain = {k: v for k, v in plain.items() if k not in gone} | dict.fromkeys(names, str(step))
        assert held(store.table("entities")) == sorted(plain.items()), step
    assert 1 < len(store.parts("entities")) < 8 and store.commits()[-1] > 9
    store.compact()
    assert len(store.parts("entities")) == 1 and held(store.table("entities")) == sorted(plain.items()) and not any(store.violations().values())
    store.clear()
    assert store.table("entities").count() == 0


def test_set_tables_hold_each_row_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "R", "b")], TABLES["relations"])
    for _ in range(4):
        store.upsert("relations", rows)
    store.upsert("relations", spark.createDataFrame([("a", "R", "c")], TABLES["relations"]))
    assert sorted(map(tuple, store.table("relations").collect())) == [("a", "R", "b"), ("a", "R", "c")]


def test_writers_of_other_owners_both_hold(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.upsert("entities", entities(spark, "k", "m"))
    base = b.snapshot()
    a.upsert("entities", entities(spark, "a", "z", label="a"))
    # ranges meet, owners do not
    b.commit({"entities": Change(entities(spark, "b", label="b"))}, base)
    assert held(a.table("entities")) == [("a", "a"), ("b", "b"), ("k", "x"), ("m", "x"), ("z", "a")]


def test_of_writers_of_one_owner_the_second_changes_nothing(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.upsert("entities", entities(spark, "k", "m"))
    base = b.snapshot()
    a.upsert("entities", entities(spark, "k", label="a"))
    before = a.versions("entities")
    for change in (Change(entities(spark, "k", label="b")), Change(gone=owners(spark, "k")), Change(entities(spark, *"abcdefg"), whole=True)):
        with pytest.raises(Conflict):
            b.commit({"relations": Change(spark.createDataFrame([("p", "R", "q")], TABLES["relations"])), "entities": change}, base)
    assert held(b.table("entities")) == [("k", "a"), ("m", "x")] and b.table("relations").count() == 0
    assert a.versions("entities") == before and not a.versions("relations")
    # a whole new table holds against those who come later
    base = b.snapshot()
    a.write("entities", entities(spark, "new"))
    with pytest.raises(Conflict):
        b.commit({"entities": Change(entities(spark, "other"))}, base)
    assert held(b.table("entities")) == [("new", "x")]


def test_a_conflict_is_found_in_parts_put_together(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.upsert("entities", entities(spark, "k"))
    base = b.snapshot()
    for n in range(6):
        a.upsert("entities", entities(spark, f"n{n}"))
    a.compact("entities")
    with pytest.raises(Conflict):
        b.commit({"entities": Change(entities(spark, "n2", label="b"))}, base)
    b.commit({"entities": Change(entities(spark, "p", label="b"))}, base)
    assert b.table("entities").count() == 8


def test_a_number_is_given_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.upsert("entities", entities(spark, "k"))
    path = f"{store.path}/_commits/c00000009"
    assert store._put(path, "one") and not store._put(path, "two")
    assert (tmp_path / "_commits" / "c00000009").read_text() == "one" and not [n for n, _ in store._listed("_commits") if n.startswith("_part")]


def test_readers_keep_their_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("entities", entities(spark, "k"))
    old, lazy = store.snapshot(), store.table("entities")
    for n in range(3):
        store.write("entities", entities(spark, f"n{n}"))
    assert held(lazy) == held(old["entities"]) == [("k", "x")]
    with store.lease(old.number) as taken:
        store.vacuum(hours=0, keep=1)
        assert held(taken["entities"]) == [("k", "x")] and len(store.versions("entities")) == 2
    store.vacuum(hours=0, keep=1)
    assert len(store.versions("entities")) == 1 and store.commits() == [4] and held(store.table("entities")) == [("n2", "x")]
    store.vacuum()
    assert len(store.versions("entities")) == 1


def test_keys_are_unique(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    with pytest.raises(DuplicateKey):
        store.upsert("entities", entities(spark, "k", "k"))
    assert store.commits() == [] and not store.versions("entities")
    store.insert("entities", entities(spark, *(f"a{n}" for n in range(30))))
    store.insert("entities", entities(spark, "m"))
    looked = []
    monkeypatch.setattr(store, "_owners", lambda name, part, own=store._owners: looked.append(part["id"]) or own(name, part))
    store.insert("entities", entities(spark, "x", "y"))
    assert not looked
    parts = store.parts("entities")
    with pytest.raises(DuplicateKey):
        store.insert("entities", entities(spark, "m", "n"))
    assert parts[0]["id"] not in looked and store.parts("entities") == parts and store.table("entities").count() == 33
    assert not _meet(parts[0], parts[1])


def notes(spark, first, n):
    return spark.range(first, first + n).select(
        F.concat(F.lit("id"), F.col("id").cast("string")).alias("id"), F.lit("markdown").alias("source_type"), F.concat(F.lit("note"), F.col("id").cast("string")).alias("uri"),
        F.concat(F.lit("Note "), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("# Note\n\nPilotage eases Mooring in harbour "), F.col("id").cast("string"), F.lit(". "), F.repeat(F.md5(F.col("id").cast("string")), 20)).alias("raw_text"),
        F.current_timestamp().alias("created_at"), F.lit("").alias("content_hash"), F.lit(1).alias("version"), F.lit(1).alias("schema_version"),
        F.array(F.lit("http://x/y")).alias("links"), F.create_map(F.lit("a"), F.lit("b")).alias("meta"),
    )


def test_bytes_of_one_note_do_not_depend_on_the_store(spark, tmp_path):
    written = {}
    for n in (30, 300):
        engine = Engine(spark, str(tmp_path / str(n)), CONFIG, extractor=scripted)
        engine.ingest(notes(spark, 0, n), resolve_after=False)
        before = {p["id"] for name in TABLES for p in engine.store.parts(name)}
        assert engine.ingest(notes(spark, 5000, 1), resolve_after=False).first()["documents_new"] == 1
        new = {name: [p for p in engine.store.parts(name) if p["id"] not in before] for name in TABLES}
        assert all(len(v) <= 1 for v in new.values()) and len(new["chunks"]) == 1
        written[n] = sum(p["bytes"] for v in new.values() for p in v)
        assert engine.store.table("documents").count() == n + 1 and {r["mention_count"] for r in engine.store.table("entities").collect()} == {2 * (n + 1)}
    assert written[300] < 1.1 * written[30]


def test_two_engines_at_once(spark, tmp_path):
    a, b = (Engine(spark, str(tmp_path), EngineConfig().with_(models={"dimensions": 8}), extractor=scripted) for _ in range(2))
    first, commit = b.store.tables, b.store.commit

    def late(changes, base=None):
        # the other engine commits between this one's reading and writing
        b.store.commit = commit
        a.ingest(notes(spark, 0, 3), resolve_after=False)
        return commit(changes, base)

    b.store.commit = late
    assert b.ingest(notes(spark, 2, 3), resolve_after=False).first()["documents_new"] == 2
    assert b.store.table("documents").count() == 5 and not any(b.store.violations().values()) and first()["chunks"].count() == 5
    assert {r["mention_count"] for r in b.store.table("entities").collect()} == {5}


def test_nothing_is_left_in_the_shared_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", 4).config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
for name in ("er_plan", "engine_search", "engine_ingest", "stream_ingest"):
    assert entry.queries()[name](spark, {SF!r}).count() > 0
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, env={**os.environ, "PYTHONPATH": ROOT}, timeout=400)
    assert [(d, f) for d, _, f in os.walk(f"{tmp_path}/shared") if f] == []


def test_a_part_is_counted_while_it_is_written(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("b:1", "X"), ("a:0", "Y"), ("a:0", "Z"), ("c", None)], "chunk_id string, entity string").repartition(3)
    reader, read = type(spark.read), []
    plain = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **options: (read.extend(paths), plain(self, *paths, **options))[1])
    store.write("mentions", rows)
    store.upsert("mentions", rows.where("entity IS NULL"))
    assert not [p for p in read if "/mentions/" in p]
    first, last = store.parts("mentions")
    assert (first["rows"], first["owners"], first["low"], first["high"], last["rows"], last["low"]) == (4, 4, "a", "c", 1, "c")
    store.write("mentions", rows.limit(0))
    assert store.parts("mentions") == [] and store.table("mentions").count() == 0


def test_reindex_tells_its_counts_from_the_commit(spark, tmp_path, monkeypatch):
    own = Engine(spark, str(tmp_path / "store"), CONFIG)
    row = lambda name, text: (name, name[0], 0, text, None, None, "engine", 0)
    own.store.write("chunks", spark.createDataFrame([row("a:0", "one two two"), row("b:0", None), row("c:0", "")], TABLES["chunks"]))
    reader, read = type(spark.read), []
    plain = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **options: (read.extend(paths), plain(self, *paths, **options))[1])
    assert own.reindex() == {"chunk_tokens": 2} and not [p for p in read if "/chunk_tokens/" in p]
    assert own.reindex(entities=True) == {"chunk_tokens": 2, "entity_tokens": 0}
    assert own.store.table("chunk_tokens").count() == 2
