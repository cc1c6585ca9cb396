"""The stored token indexes: postings, the pruned search over them, BM25 from them, and the index of entities."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import graph, retrieve
from loomgraph.operators.retrieve import _candidates
from loomgraph.plans import queries_engine
from loomgraph.plans.engine import Engine
from loomgraph.plans.store import checkpointed
from loomgraph.schemas import TABLES
from tests.conftest import SF
from tests.test_engine import CONFIG, ask

TOKEN = re.compile(r"[a-z0-9][a-z0-9\-]+")
ROWS = "id long, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_postings_by_plain_python(spark):
    texts = ["to be or not to be", "", None, "A", "x1 X1 x1", " ".join(f"w{i % 997}" for i in range(50_000)), "to be or not to be"]
    found = {}
    for r in retrieve.postings(spark.createDataFrame(list(enumerate(texts)), ROWS)).collect():
        assert r["token"] not in found.setdefault(r["id"], {})
        found[r["id"]][r["token"]] = (r["tf"], r["len"], r["head"])
    for i, text in enumerate(texts):
        counts = Counter(TOKEN.findall((text or "").lower()))
        own = found.get(i, {})
        assert {t: x[0] for t, x in own.items()} == counts
        assert {x[1] for x in own.values()} <= {sum(counts.values())} and sum(x[2] for x in own.values()) == bool(counts)
    assert retrieve.postings(spark.createDataFrame([], ROWS)).count() == 0
    clashing = spark.createDataFrame([(1, "aa bb", "t", 5, 6, 7)], "id long, text string, token string, tf int, len int, _t int")
    assert [x[:4] for x in rows_of(retrieve.postings(clashing))] == [(1, "aa", 1, 2), (1, "bb", 1, 2)]


def test_pruned_search_is_the_whole_search(spark):
    rnd = random.Random(5)
    # a few words in nearly every row, many in few: all sorts of bounds and ties
    word = lambda: f"w{int(rnd.paretovariate(0.7))}"
    rows = spark.createDataFrame([(i, " ".join(["the"] * (i % 9 > 0) + [word() for _ in range(rnd.randint(0, 12))])) for i in range(600)] + [(600, None), (601, "")], ROWS)
    asked = [(f"q{i}", " ".join(["the"] * (i % 2) + [word() for _ in range(rnd.randint(0, 7))])) for i in range(60)] + [("none", None), ("empty", ""), ("unknown", "zz9 zz8"), ("frequent", "the w1"), ("again", "w5 w5 the the")]
    queries = spark.createDataFrame(asked, "query_id string, text string")
    index = checkpointed(retrieve.postings(rows))
    for k, factor in ((1, 1), (4, 8), (50, 1)):
        assert rows_of(retrieve.pruned_topk(queries, index, k, factor)) == rows_of(retrieve.fulltext_topk(queries, retrieve.token_table(rows), k)), (k, factor)
    assert retrieve.pruned_topk(queries, index.limit(0), 3).count() == retrieve.pruned_topk(queries.limit(0), index, 3).count() == 0


def test_a_frequent_word_brings_no_rows_in(spark):
    rows = spark.range(6000).select("id", F.concat(F.lit("the of w"), (F.col("id") % 300).cast("string")).alias("text"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("the w"), F.col("id").cast("string"), F.lit(" of")).alias("text"))
    asked = queries.select("query_id", F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    index = retrieve.token_table(rows)
    able, late = _candidates(asked, index, 6, 8)
    whole = index.join(asked, "token").count()
    assert whole > 400_000 and able.count() + late.count() < whole / 100
    assert rows_of(retrieve.pruned_topk(queries, index, 6)) == rows_of(retrieve.fulltext_topk(queries, index, 6))


def test_bm25_from_postings_is_that_of_texts(spark):
    rnd = random.Random(9)
    rows = spark.createDataFrame([(i, " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randint(0, 30)))) for i in range(300)] + [(300, None)], ROWS)
    queries = spark.createDataFrame([(f"q{i}", f"w{i} w{i + 1} w{i} nowhere") for i in range(20)] + [("none", None)], "query_id string, text string")
    rounded = lambda df: rows_of(df.select("query_id", "id", F.round("score", 6).alias("score"), "rank"))
    assert rounded(retrieve.bm25_stored(queries, retrieve.postings(rows), 5)) == rounded(retrieve.bm25_topk(queries, rows, 5))
    assert retrieve.bm25_stored(queries, retrieve.postings(rows.limit(0)), 5).count() == 0
    plan = retrieve.bm25_stored(queries, retrieve.postings(rows), 5)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_entity_index_follows_the_entities(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "store"), CONFIG)
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# Port\n\nHarbour Master works at Salt Works. Harbor Master knows Ada Lovelace.\n")
    same = lambda: (rows_of(own.store.table("entity_tokens")), rows_of(graph.entity_tokens(own.store.table("entities"))))
    own.ingest_folder(str(notes))
    (notes / "b.md").write_text("# Port\n\nSalt Works is run by Grace Hopper. Harbour Master knows Grace Hopper.\n")
    own.ingest_folder(str(notes))
    stored, made = same()
    assert stored == made and stored and own.store.violations()["entity_tokens"] == 0
    # merged names are found by their aliases, and no row of a name that is gone is left
    names = {r["name"] for r in own.store.table("entities").collect()}
    assert {x[0] for x in stored} <= names
    asked = ask(spark, "who is the harbour master of the salt works?")
    by_index = graph.match_entities(asked, own.store.table("entities").limit(0), index=own.store.table("entity_tokens"))
    assert rows_of(by_index) == rows_of(graph.match_entities(asked, own.store.table("entities")))
    assert own.reindex(entities=True)["entity_tokens"] == len(stored) and same()[0] == stored
    # a store of before the index is read from its entities
    own.store.write("entity_tokens", spark.createDataFrame([], TABLES["entity_tokens"]))
    assert rows_of(own._seeds(asked, own.store.tables())) == rows_of(by_index)
    hits = own.keyword_search(asked, 2).collect()
    assert hits and hits[0]["rank"] == 1


def test_tokens_are_cut_once(spark, tmp_path):
    spark.createDataFrame([(1, "one two two"), (2, ""), (3, None), (4, "- ?")], "id long, text string").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    for found, want in ((retrieve.postings(rows), [(1, "one", 1, 3, True), (1, "two", 2, 3, False)]), (retrieve.token_table(rows), [(1, "one"), (1, "two")])):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
        assert sorted(tuple(r) for r in found.collect()) == want


def test_lists_of_frequent_words_send_postings_and_no_pairs(spark):
    rnd = random.Random(8)
    texts = [(i, " ".join(["the"] * (i % 7 > 0) + [f"w{int(rnd.paretovariate(0.6))}" for _ in range(rnd.randint(0, 15))])) for i in range(300)] + [(300, None), (301, "")]
    rows = spark.createDataFrame(texts, ROWS)
    asked = [(q, " ".join(["the", "w1 w1", f"w{q % 9}", f"w{q % 40}"])) for q in range(70)] + [(70, None), (71, "zz9"), (72, "")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    lists = retrieve.lexical_topk(queries, rows, 5)
    assert rows_of(lists["fulltext"].select("query_id", "id", "score", "rank")) == rows_of(retrieve.fulltext_topk(queries, retrieve.token_table(rows), 5).select("query_id", "id", "score", "rank"))
    held = {i: Counter(TOKEN.findall(t)) for i, t in texts if t}
    n, mean = len(held), sum(sum(c.values()) for c in held.values()) / len(held)
    df = Counter(t for c in held.values() for t in c)
    want = []
    for q, text in asked:
        scores = {}
        for t in set(TOKEN.findall(text or "")):
            for i, c in held.items():
                if t in c:
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
        want += [(q, i, round(x, 6), r) for r, (i, x) in enumerate(sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:5], 1)]
    assert rows_of(lists["bm25"].select("query_id", "id", F.round("score", 6), "rank")) == sorted(want)
    # sums of a query and a row are made where the row's postings meet: no exchange by both
    for found in (retrieve.bm25_topk(queries, rows, 5), retrieve.bm25_stored(queries, checkpointed(retrieve.postings(rows)), 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    assert retrieve.lexical_topk(queries.limit(0), rows, 3)["bm25"].count() == retrieve.lexical_topk(queries, rows.limit(0), 3)["fulltext"].count() == 0


def test_postings_are_stored_where_they_are_made(spark, tmp_path):
    """Sorted in each file, and not sent: all postings of a row lie in one file."""
    own = Engine(spark, str(tmp_path / "store"), CONFIG)
    rows = spark.range(0, 400, 1, 4).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("the of zz w"), (F.col("id") % 30).cast("string"), F.lit(" aa x"), "id").alias("text"))
    own.store.write("chunk_tokens", retrieve.postings(rows))
    part = own.store.parts("chunk_tokens")[0]
    files = [[(r["token"], r["id"]) for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "store" / "chunk_tokens" / part["id"] / "rows").glob("*.parquet")]
    assert len(files) == 4 and sum(map(len, files)) == part["rows"] == 2400
    assert all([t for t, _ in f] == sorted(t for t, _ in f) for f in files)
    ids = [{i for _, i in f} for f in files]
    assert sum(map(len, ids)) == len(set().union(*ids)) == 400


def test_keyword_search_builds_postings_only(spark, monkeypatch):
    monkeypatch.setattr(queries_engine, "_BUILT", {})
    store = queries_engine.indexed(spark, SF).store
    hits = rows_of(queries_engine.QUERIES["keyword_search"](spark, SF))
    assert hits and [name for name in TABLES if store.parts(name)] == ["chunk_tokens"]
    whole = queries_engine.notebook(spark, SF).store
    assert whole.path == store.path and {"documents", "chunks", "entities", "mentions", "relations", "entity_tokens", "chunk_tokens"} == {name for name in TABLES if whole.parts(name)}
    assert rows_of(whole.table("chunk_tokens")) == rows_of(retrieve.postings(whole.table("chunks")))
    assert rows_of(queries_engine.QUERIES["keyword_search"](spark, SF)) == hits


def test_the_index_is_read_once(spark):
    """Also with null and empty texts, repeated queries and postings that stand twice."""
    rows = spark.createDataFrame([(i, f"the of w{i % 7} v{i % 50}") for i in range(300)] + [(300, None), (301, "")], ROWS)
    asked = [(i, f"the w{i} of v{i}") for i in range(5)] + [(9, None), (10, ""), (0, "the w0 of v0")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(token):
        read.add(1)
        return token

    index = checkpointed(retrieve.token_table(rows))
    found = retrieve.pruned_topk(queries, index.withColumn("token", counted.asNondeterministic()("token")), 4, 1)
    assert rows_of(found.where("query_id > 0")) == rows_of(retrieve.fulltext_topk(queries.where("query_id > 0"), index, 4))
    assert index.count() <= read.value < 2 * index.count()


def test_keyword_lists_send_no_pairs(spark):
    """Counts of a query and a row are made where the row's postings meet; postings and ids that stand twice count twice, as before."""
    texts = [(i, f"the of w{i % 7} v{i % 50}") for i in range(200)] + [(3, "the w3 again"), (300, None), (301, ""), (None, "the w1")]
    asked = [(q, f"the w{q} w{q} v{q}") for q in range(12)] + [(20, None), (21, ""), (22, "zz9 zz8")]
    rows, queries = spark.createDataFrame(texts, ROWS), spark.createDataFrame(asked, "query_id long, text string")
    found = retrieve.fulltext_topk(queries, retrieve.token_table(rows), 5)
    want = []
    for q, text in asked:
        words, scores = set(TOKEN.findall(text or "")), Counter()
        for i, t in texts:
            scores[i] += len(words & set(TOKEN.findall(t or "")))
        best = sorted((-c / len(words), -1 if i is None else i) for i, c in scores.items() if c)[:5]
        want += [(q, None if i < 0 else i, -c, r) for r, (c, i) in enumerate(best, 1)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, id#", plan)
    # more postings go over more tasks
    parts = [int(re.search(r"hashpartitioning\(id#\d+L?, (\d+)\)", retrieve._dealt(rows, n)._jdf.queryExecution().executedPlan().toString())[1]) for n in (0, 1000 * retrieve._POSTINGS)]
    assert parts[0] < parts[1] == 1000
