"""The exact and the bucketed vector search in bounded space, and metrics from counts of relevant items."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import evaluate, retrieve
from loomgraph.plans import queries_graph
from tests.oracle import connection, rows_of, sql_rows


def vectors(spark, n, copies=3):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(n // copies, 4)).round(1).tolist()
    return spark.createDataFrame([(i, base[i % len(base)]) for i in rnd.permutation(n).tolist()], "id long, embedding array<double>").coalesce(1)


def test_a_task_leaves_k_rows_for_each_query(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "_SCORES", 64)
    rows = vectors(spark, 999)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    with_conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        block = asked.collect()
        sent = retrieve._block_topk(block, rows, asked.schema["query_id"].dataType, 5, 9)
        tasks = sent.rdd.getNumPartitions()
        assert sent.count() <= len(block) * 5 * tasks
        monkeypatch.setattr(retrieve, "spread", lambda df: df, raising=False)
        assert retrieve._block_topk(block, rows, asked.schema["query_id"].dataType, 5, 9).count() == len(block) * 5
        got = [(r["query_id"], r["rank"], r["id"]) for r in retrieve.vector_topk(asked, rows, 5).orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_conf)
    held = {r["id"]: np.array(r["embedding"]) for r in rows.collect()}
    want = []
    for q in sorted(r["query_id"] for r in block):
        score = {i: round(float(held[q] @ v / (np.sqrt(held[q] @ held[q]) * np.sqrt(v @ v) or 1.0)), 9) + 0.0 for i, v in held.items()}
        want += [(q, n + 1, i) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]
    assert got == want


def test_buckets_are_compared_without_a_join(spark):
    rows = vectors(spark, 300)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieve.lsh_topk(asked, rows, 4, planes=3, tables=2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    normals = np.random.default_rng(7).normal(size=(6, 4))
    held = {r["id"]: np.array(r["embedding"]) for r in rows.collect()}
    code = {i: tuple(map(tuple, (normals @ v > 0).reshape(2, 3))) for i, v in held.items()}
    for q, in asked.select("query_id").collect():
        score = {i: round(float(held[q] @ v / (np.sqrt(held[q] @ held[q]) * np.sqrt(v @ v) or 1.0)), 9) + 0.0 for i, v in held.items() if any(a == b for a, b in zip(code[q], code[i], strict=True))}
        assert [r["id"] for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] == sorted(score, key=lambda i: (-score[i], i))[:4]


def test_metrics_from_counts(spark):
    ranked = spark.createDataFrame([(q, i, r) for q in range(6) for r, i in enumerate(range(q, q + 5), 1)], "query_id long, item long, rank int")
    relevant = spark.createDataFrame([(q, i) for q in range(7) for i in range(0, 60, 3)], "query_id long, item long")
    among = relevant.join(ranked.select("query_id", "item"), ["query_id", "item"], "left_semi")
    whole = evaluate.retrieval_metrics(ranked, relevant, 3)
    counted = evaluate.retrieval_metrics(ranked, among, 3, evaluate.relevant_sizes(relevant))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, counted.collect()))


def test_rows_without_a_vector_are_searched_too(spark, tmp_path):
    """Every row of the table is compared, and every fiftieth asks, whether it has a vector or not; as the SQL says."""
    rnd = random.Random(6)
    # the first query points away from all others, so that the rows without a vector are its nearest
    vector = lambda i: None if i in (50, 51, 130) else [-1.0] * 8 if i == 0 else [rnd.random() for _ in range(8)]
    rows = [(i, vector(i), i % 4) for i in range(160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = connection(str(tmp_path))
    for name in ("retrieval_metrics", "vector_topk"):
        got = rows_of(queries_graph.QUERIES[name](spark, str(tmp_path)))
        assert got == sql_rows(duck, queries_graph.SQL[name]), name
    nearest = queries_graph.QUERIES["vector_topk"](spark, str(tmp_path)).where("query_id = 0 AND rank <= 3")
    assert sorted(r["id"] for r in nearest.collect()) == [50, 51, 130]
