"""Neighbourhoods against a walk in Python, and how the work of a hub is dealt."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph


def walked(relations, seeds, hops):
    edges, hop_of = set(), {s: 0 for s in seeds}
    for hop in range(1, hops + 1):
        newest = [s for s in hop_of if hop_of[s] == hop - 1]
        for q, node in newest:
            for s, r, o in relations:
                if node in (s, o):
                    edges.add((q, s, r, o))
                    hop_of.setdefault((q, o if node == s else s), hop)
    return edges, {(*k, h) for k, h in hop_of.items()}


@pytest.mark.parametrize("known", [0, 1, 64])
def test_expand_finds_each_edge_and_node_once(spark, monkeypatch, known):
    monkeypatch.setattr(graph, "_KNOWN", known)
    monkeypatch.setattr(graph, "_SIDES", 3)
    rnd = random.Random(known)
    names = [f"n{i}" for i in range(24)]
    relations = [(rnd.choice(names), rnd.choice("rs"), rnd.choice(names)) for _ in range(34)] + [("n0", "r", f"leaf{i}") for i in range(9)] + [("n1", "r", "n1"), ("n0", "s", "leaf0"), ("leaf0", "r", "n0")]
    seeds = [(q, rnd.choice(names)) for q in range(12) for _ in range(1 + (q % 3 == 0))] + [(50, "leaf1"), (51, "n1"), (52, "nowhere"), *((53, f"leaf{i}") for i in range(9))]
    rows = spark.createDataFrame(relations + relations[:5], "subject string, relation string, object string")
    asked = spark.createDataFrame(seeds + seeds[:2], "query_id long, node string")
    for hops in (1, 2, 3):
        edges, nodes = graph.expand(rows, asked, hops)
        want = walked(set(relations), set(seeds), hops)
        got = [sorted(tuple(r) for r in x.collect()) for x in (edges, nodes)]
        assert got == [sorted(x) for x in want]


def test_a_hub_is_dealt_over_tasks(spark):
    sides = spark.range(3000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("subject"), F.lit("r").alias("relation"), F.lit("hub").alias("object"))
    seeds = spark.range(200).select(F.col("id").alias("query_id"), F.lit("hub").alias("node"))
    edges, _ = graph.expand(sides, seeds, 1)
    sizes = [r["count"] for r in edges.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 600_000 and max(sizes) < 400_000


def test_the_last_hop_keeps_the_nodes_looked_at(spark):
    """Those of hops before it all stay, as later ones start from them; null ends, queries and nodes are passed over."""
    rnd = random.Random(3)
    names = [f"n{i}" for i in range(24)]
    relations = [(rnd.choice(names), "r", rnd.choice(names)) for _ in range(34)]
    seeds = [(q, rnd.choice(names)) for q in range(12) for _ in range(1 + (q % 3 == 0))]
    looked = [(q, rnd.choice(names)) for q in range(14) for _ in range(6)]
    rows = spark.createDataFrame([*relations, *relations[:3], ("n0", "r", None), (None, "r", "n1")], "subject string, relation string, object string")
    asked = spark.createDataFrame([*seeds, *seeds[:2]], "query_id long, node string")
    among = spark.createDataFrame([*looked, *looked[:2], (1, None), (None, "n1")], "query_id long, node string")
    for hops in (1, 2, 3):
        edges, nodes = graph.expand(rows, asked, hops, among)
        want = {(q, n, h) for q, n, h in walked(set(relations), set(seeds), hops)[1] if h < hops or (q, n) in looked}
        got = [tuple(r) for r in nodes.where("node IS NOT NULL").collect()]
        assert sorted(got) == sorted(want)
        assert sorted(map(str, edges.collect())) == sorted(map(str, graph.expand(rows, asked, hops)[0].collect()))
    # what the last hop finds is not sent before it is looked up
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") > graph.expand(rows, asked, 3)[1]._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi")
