"""What is computed for each row is computed once, and what grows with the input is not broadcast by an estimate."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import extract, graph, retrieve
from loomgraph.sources import loaders


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_a_text_are_found_once(spark):
    rows = spark.range(3).select(F.concat(F.lit("Ada Lovelace met Bob. The Crow"), F.col("id").cast("string")).alias("text"))
    found = rows.select(extract.heuristic_extraction("text").alias("x"))
    assert optimized(found).count("regexp_extract_all") == 1
    names = ["Ada Lovelace", "Bob", "The Crow0"]
    x = found.orderBy("x.entities").first()["x"]
    assert [e["name"] for e in x["entities"]] == names
    assert [(r["subject"], r["object"]) for r in x["relations"]] == list(zip(names, names[1:], strict=False))
    empty = spark.range(1).select(extract.heuristic_extraction(F.lit("none")).alias("x"), extract.heuristic_extraction(F.lit(None).cast("string")).alias("n")).first()
    assert (empty["x"]["entities"], empty["x"]["relations"]) == ([], [])
    assert (empty["n"]["entities"], empty["n"]["relations"]) == (None, None)


def test_tokens_are_sorted_by_the_native_order(spark):
    rows = spark.createDataFrame([("a", "b-b aa b-b zz aa aa")], "id string, text string")
    index = retrieve.postings(rows)
    assert "lambda" not in optimized(index).split("regexp_extract_all")[0].rsplit("sort", 1)[-1]
    assert "array_sort" not in optimized(index)
    assert sorted(tuple(r) for r in index.collect()) == [("a", "aa", 3, 6, True), ("a", "b-b", 2, 6, False), ("a", "zz", 1, 6, False)]


def test_stats_broadcast_no_mentions(spark):
    """Stored mentions are far larger in memory than their files."""
    none = spark.createDataFrame([], "id string, chunk_id string, aliases array<string>")
    tables = dict.fromkeys(("documents", "entities", "relations", "doc_links", "merge_history"), none)
    tables |= {"chunks": spark.range(5).select(F.col("id").cast("string").alias("id")), "mentions": spark.range(3).select(F.col("id").cast("string").alias("chunk_id"))}
    told = graph.stats(tables)
    assert "BroadcastHashJoin" not in told._jdf.queryExecution().executedPlan().toString()
    assert {r["metric"]: r["value"] for r in told.collect()}["orphan_chunks"] == 2


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    """A worker gets a bounded batch of pages and holds the results of few of them as Python objects."""
    alive, most = [0], [0]

    class Told(dict):
        def __del__(self):
            alive[0] -= 1

    def readable(html):
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        return Told(title=html or "", text="", links=[])

    monkeypatch.setattr(loaders, "readable", readable)
    pages = pa.array([None if i % 7 == 0 else str(i) for i in range(1000)])
    titles = loaders.readability.func(pages).field("title").to_pylist()
    assert titles == [h or "" for h in pages.to_pylist()] and most[0] <= 200
    assert len(loaders.readability.func(pages.slice(0, 0))) == 0
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 28))
        loaders.load_web(spark.createDataFrame([], "url string, html string"))
        assert int(spark.conf.get(key)) <= 8 << 20
    finally:
        spark.conf.set(key, before)
