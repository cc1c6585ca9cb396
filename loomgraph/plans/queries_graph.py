"""Queries over vectors, graphs, entities, retrieval and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import ENTITY_LABELS, RELATION_TYPES, VALID_TRIPLES
from loomgraph.frames import stacked
from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators import answer, evaluate, extract, graph, ingest, resolve, retrieve
from loomgraph.plans.store import checkpointed
from loomgraph.plans.queries_text import HYBRID_SQL, INDEX_SQL, NAMES_SQL, TERMS, TOKENS, _docs, _questions, _rows, extracted, hybrid, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# vectors: the queries are the vectors whose id is divisible by 50, against all vectors

COSINE = "coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"
KNN_SQL = f"""
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
ns AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label AS vl, round({COSINE.format(a="q.e", b="v.e")}, 9) + 0 AS score FROM v q CROSS JOIN v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ns)
"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _neighbours(spark, sf_dir, k):
    """The k nearest other vectors of each query vector; a row without a vector has the cosine 0 with every other."""
    rows = _vectors(spark, sf_dir).withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))
    hits = retrieve.vector_topk(rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), rows, k + 1)
    own = hits.where("id <> query_id").drop("rank")
    from pyspark.sql import Window

    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({COSINE.format(a='a.embedding::DOUBLE[]', b='b.embedding::DOUBLE[]')}, 6) + 0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    a = _vectors(spark, sf_dir).select(F.col("id").alias("a"), F.col("embedding").alias("x"))
    b = _vectors(spark, sf_dir).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", (F.round(vx.cosine("x", "y"), 6) + 0.0).alias("cosine"))


@query(f"WITH {KNN_SQL} SELECT query_id, id, round(score, 6) + 0 AS score, rank::INTEGER AS rank FROM nr WHERE rank <= 6")
def vector_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 6).select("query_id", "id", (F.round("score", 6) + 0.0).alias("score"), "rank")


@query("SELECT label, i::INTEGER AS i, round(avg(x), 6) + 0 AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def entity_context(spark, sf_dir):
    return vx.mean_vectors(_vectors(spark, sf_dir), "label", "embedding").select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", (F.round("x", 6) + 0.0).alias("x"))


METRICS_SQL = f"""{KNN_SQL},
rk AS (SELECT query_id, id, rank, (ql = vl)::INTEGER AS rel FROM nr WHERE rank <= 10),
nl AS (SELECT q.vec_id AS query_id, count(*) AS n_rel FROM v q JOIN v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1),
hh AS (SELECT rk.*, n_rel, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM rk JOIN nl USING (query_id)),
me AS (SELECT query_id, sum(rel) FILTER (rank <= 6) / count(*) FILTER (rank <= 6) AS precision, sum(rel) FILTER (rank <= 6) / max(n_rel) AS recall, coalesce(1.0 / min(rank) FILTER (rel = 1), 0)::DOUBLE AS rr, (sum(rel) FILTER (rank <= 6) > 0)::INTEGER::DOUBLE AS hit,
  sum(rel) FILTER (rank <= n_rel) / count(*) FILTER (rank <= n_rel) AS r_precision, sum(rel * hits / rank) / max(n_rel) AS ap, coalesce(sum(1.0 / log2(rank + 1)) FILTER (rel = 1 AND rank <= 6), 0) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, least(max(n_rel), 6) + 1) t(i)) AS ndcg FROM hh GROUP BY query_id)
"""


def _ranked(spark, sf_dir):
    """The ten nearest of each query, hits with their ranks, those of the query's label among them, and how many others have that label."""
    near = checkpointed(_neighbours(spark, sf_dir, 10))
    hits = near.select("query_id", F.col("id").alias("item"), "rank")
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "label")
    relevant = hits.join(rows.select(F.col("id").alias("item"), "label"), "item").join(asked, ["query_id", "label"], "left_semi").select("query_id", "item")
    counts = rows.groupBy("label").agg((F.count_distinct("id") - 1).alias("n_rel"))
    sizes = asked.join(counts, "label").where("n_rel > 0").select("query_id", "n_rel").distinct()
    return near, hits, relevant, sizes


def _scored(spark, sf_dir):
    _, hits, relevant, sizes = _ranked(spark, sf_dir)
    return evaluate.retrieval_metrics(hits, relevant, 6, sizes)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("query_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"WITH {METRICS_SQL} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(rr, 6) AS rr, hit, round(r_precision, 6) AS r_precision FROM me")
def retrieval_metrics(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir), "precision", "recall", "rr", "hit", "r_precision")


@query(f"WITH {METRICS_SQL} SELECT query_id, round(ap, 6) AS ap FROM me")
def average_precision(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir), "ap")


@query(f"WITH {METRICS_SQL} SELECT query_id, round(ndcg, 6) AS ndcg FROM me")
def ndcg(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir), "ndcg")


SWEEP_SQL = f"""{KNN_SQL},
rows AS (SELECT query_id, id, rank, 1.0::DOUBLE / (60 + rank) AS base, (id % 3)::DOUBLE AS g, (id % 2)::DOUBLE AS t, (ql = vl)::INTEGER AS rel FROM nr WHERE rank <= 10),
grid AS (SELECT gb::DOUBLE AS gb, tb::DOUBLE AS tb, k::INTEGER AS k FROM (VALUES (0), (0.5), (1)) a(gb), (VALUES (0), (0.4)) b(tb), (VALUES (6), (10)) c(k)),
x AS (SELECT gb, tb, k, query_id, id, rel, row_number() OVER (PARTITION BY gb, tb, k, query_id ORDER BY round(base * (1 + gb * g + tb * t), 12) DESC, rank) AS r FROM rows JOIN grid ON rank <= k),
nl AS (SELECT q.vec_id AS query_id, count(*) AS n_rel FROM v q JOIN v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1),
y AS (SELECT x.*, n_rel, sum(rel) OVER (PARTITION BY gb, tb, k, query_id ORDER BY r) AS hits FROM x JOIN nl USING (query_id)),
z AS (SELECT gb, tb, k, query_id, sum(rel * hits / r) / max(n_rel) AS ap, coalesce(1.0 / min(r) FILTER (rel = 1), 0)::DOUBLE AS rr FROM y GROUP BY 1, 2, 3, 4)
"""


@query(f"WITH {SWEEP_SQL} SELECT gb AS graph_boost, tb AS title_boost, k AS top_k, count(*) AS n, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM z GROUP BY 1, 2, 3")
def sweep(spark, sf_dir):
    near, _, relevant, sizes = _ranked(spark, sf_dir)
    hits = near.select("query_id", F.col("id").alias("item"), (1.0 / (60 + F.col("rank"))).alias("base"), (F.col("id") % 3).cast("double").alias("g"), (F.col("id") % 2).cast("double").alias("t"), "rank")
    grid = spark.createDataFrame([(g, t, k) for g in (0.0, 0.5, 1.0) for t in (0.0, 0.4) for k in (6, 10)], "graph_boost double, title_boost double, top_k int")
    rows = evaluate.sweep(hits, relevant, grid, 6, sizes)
    return rows.select("graph_boost", "title_boost", "top_k", "n", F.round("ap", 6).alias("map"), F.round("rr", 6).alias("mrr"))


@query(f"WITH {SWEEP_SQL}, m AS (SELECT gb, avg(ap) AS ap, count(*) AS n FROM z WHERE tb = 0 AND k = 10 GROUP BY gb) SELECT gb::VARCHAR AS run, n, round(ap, 6) AS ap, round(ap - (SELECT ap FROM m WHERE gb = 0), 6) + 0 AS delta_ap FROM m")
def compare_runs(spark, sf_dir):
    base, _, relevant, sizes = _ranked(spark, sf_dir)
    from pyspark.sql import Window

    parts = None
    for g in (0.0, 0.5, 1.0):
        score = F.round(1.0 / (60 + F.col("rank")) * (1 + g * (F.col("id") % 3)), 12)
        ranked = base.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "rank"))).select("query_id", F.col("id").alias("item"), F.col("r").alias("rank"))
        own = evaluate.retrieval_metrics(ranked, relevant, 6, sizes).withColumn("run", F.lit(str(g)))
        parts = own if parts is None else stacked(parts, own)
    return evaluate.compare(parts, "run", "0.0").select("run", "n", F.round("ap", 6).alias("ap"), (F.round("delta_ap", 6) + 0.0).alias("delta_ap"))


@query(f"""WITH {KNN_SQL}, h AS (SELECT query_id, id, score, rank FROM nr WHERE rank <= 6), n AS (SELECT *, least(max(rank) OVER (PARTITION BY query_id), 4) AS n FROM h),
o AS (SELECT *, CASE WHEN query_id % 100 = 0 THEN NULL WHEN rank = 3 THEN 0 WHEN rank = 1 THEN 2 END AS pos FROM n)
SELECT query_id, id, round(CASE WHEN pos IS NOT NULL THEN n - pos ELSE score END, 6) + 0 AS score, CASE WHEN pos IS NOT NULL THEN 'vector+rerank' ELSE 'vector' END AS via,
 row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos IS NOT NULL THEN 0 WHEN rank <= 4 THEN 1 ELSE 2 END, pos, rank)::INTEGER AS rank FROM o""")
def rerank_apply(spark, sf_dir):
    hits = _neighbours(spark, sf_dir, 6).withColumn("via", F.lit("vector"))
    orders = hits.where("query_id % 100 <> 0").select("query_id").distinct().withColumn("order", F.array(*[F.lit(x) for x in (3, 9, 1, 3)]))
    return retrieve.apply_order(hits, orders, 4).select("query_id", "id", (F.round("score", 6) + 0.0).alias("score"), "via", "rank")


@query()
def lsh_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.lsh_topk(asked, rows, 6, planes=4, tables=24).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


# the closed schema


@query("WITH s AS (SELECT unnest(" + repr([*ENTITY_LABELS, "Document", "Entity", "Thing"]) + ") AS s), r AS (SELECT unnest(" + repr([*RELATION_TYPES, "KNOWS"]) + ") AS r), o AS (SELECT unnest(" + repr([*ENTITY_LABELS, "Document", "Entity", "Thing"]) + ") AS o), a AS (SELECT * FROM (VALUES " + ", ".join(repr(t) for t in VALID_TRIPLES) + ") t(x, y, z)) SELECT n_nationkey, s AS subject, r AS relation, o AS object, EXISTS (SELECT 1 FROM a WHERE y = r AND (x = s OR (x = 'Entity' AND s <> 'Thing')) AND (z = o OR (z = 'Entity' AND o NOT IN ('Thing', 'Document')))) AS valid FROM nation, s, r, o")
def valid_triples(spark, sf_dir):
    lit = lambda xs, c: F.explode(F.array(*[F.lit(x) for x in xs])).alias(c)
    labels = [*ENTITY_LABELS, "Document", "Entity", "Thing"]
    rows = table(spark, sf_dir, "nation").select("n_nationkey", lit(labels, "subject")).select("*", lit([*RELATION_TYPES, "KNOWS"], "relation")).select("*", lit(labels, "object"))
    return rows.withColumn("valid", extract.is_valid_triple("subject", "relation", "object"))


# the answers as text, read by JSON functions
PAYLOAD_SQL = """
b AS (SELECT n_nationkey, '{"entities": ["stray", {"name": " ' || n_name || ' ", "label": "software", "aliases": [" a ", ""]}, {"name": "", "label": "Tool"}, {"name": "R' || n_regionkey || '", "label": "Idea"}, 7], "relations": [{"subject": "' || n_name || '", "relation": "relates_to", "object": "R' || n_regionkey || '"}, {"subject": "R' || n_regionkey || '", "relation": "RELATES_TO", "object": "' || n_name || '"}, {"subject": "' || n_name || '", "relation": "AUTHORED_BY", "object": "R' || n_regionkey || '"}, {"subject": "' || n_name || '", "relation": "USES", "object": "Nobody"}, "x", {"subject": "' || n_name || '", "relation": "RELATES_TO", "object": "' || n_name || '"}]}' AS body FROM nation),
r AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 4 THEN 'no json here' WHEN 3 THEN 'Sure! ```json' || chr(10) || body || chr(10) || '```' ELSE body END AS raw FROM b),
j AS (SELECT n_nationkey, regexp_extract(raw, '\\{.*\\}', 0, 's')::JSON AS j FROM r WHERE regexp_matches(raw, '\\{')),
e AS (SELECT n_nationkey, k, trim(x ->> 'name') AS name, x ->> 'label' AS raw_label FROM (SELECT n_nationkey, unnest(json_extract(j, '$.entities[*]')) AS x, generate_subscripts(json_extract(j, '$.entities[*]'), 1) AS k FROM j) WHERE json_type(x) = 'OBJECT' AND trim(x ->> 'name') <> ''),
l AS (SELECT *, CASE raw_label WHEN 'software' THEN 'Tool' WHEN 'Idea' THEN 'Concept' ELSE raw_label END AS label FROM e),
t AS (SELECT n_nationkey, trim(x ->> 'subject') AS subject, upper(x ->> 'relation') AS relation, trim(x ->> 'object') AS object FROM (SELECT n_nationkey, unnest(json_extract(j, '$.relations[*]')) AS x FROM j) WHERE json_type(x) = 'OBJECT'),
a AS (SELECT * FROM (VALUES """ + ", ".join(repr(t) for t in VALID_TRIPLES) + """) v(x, y, z))
"""


@query(f"WITH {PAYLOAD_SQL} SELECT n_nationkey, name, label, CASE WHEN n_nationkey % 2 = 0 THEN 'uses' END AS note FROM l")
def payload_entities(spark, sf_dir):
    rows = _payloads(spark, sf_dir).select("n_nationkey", F.explode("x.entities").alias("e"))
    return rows.select("n_nationkey", F.col("e.name").alias("name"), F.col("e.label").alias("label"), F.when(F.col("n_nationkey") % 2 == 0, "uses").alias("note"))


@query(f"WITH {PAYLOAD_SQL} SELECT t.n_nationkey, t.subject, t.relation, t.object FROM t JOIN l s ON s.n_nationkey = t.n_nationkey AND s.name = t.subject JOIN l o ON o.n_nationkey = t.n_nationkey AND o.name = t.object WHERE t.subject <> t.object AND EXISTS (SELECT 1 FROM a WHERE y = t.relation AND x IN (s.label, 'Entity') AND z IN (o.label, 'Entity'))")
def relation_validation(spark, sf_dir):
    return _payloads(spark, sf_dir).select("n_nationkey", F.explode("x.relations").alias("r")).select("n_nationkey", "r.*")


def _payloads(spark, sf_dir):
    """Model answers, partly malformed, for every nation."""
    name, region = F.col("n_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    body = F.concat(
        F.lit('{"entities": ["stray", {"name": " '), name, F.lit(' ", "label": "software", "aliases": [" a ", ""]}, {"name": "", "label": "Tool"}, {"name": "'), region,
        F.lit('", "label": "Idea"}, 7], "relations": [{"subject": "'), name, F.lit('", "relation": "relates_to", "object": "'), region, F.lit('"}, {"subject": "'), region,
        F.lit('", "relation": "RELATES_TO", "object": "'), name, F.lit('"}, {"subject": "'), name, F.lit('", "relation": "AUTHORED_BY", "object": "'), region,
        F.lit('"}, {"subject": "'), name, F.lit('", "relation": "USES", "object": "Nobody"}, "x", {"subject": "'), name, F.lit('", "relation": "RELATES_TO", "object": "'), name, F.lit('"}]}'),
    )
    key = F.col("n_nationkey") % 5
    raw = F.when(key == 4, "no json here").when(key == 3, F.concat(F.lit("Sure! ```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, sf_dir, "nation").select("n_nationkey", extract.validated(raw).alias("x"))


# the graph of names in documents

GRAPH_SQL = f"{NAMES_SQL}, ent AS (SELECT name, min(doc_id * 10 + pos) AS ord, count(*) AS n FROM names GROUP BY name)"


def kg(spark, sf_dir):
    # the extraction is a few names for each document; it is computed once and read by the three tables
    rows, calls, relations = extract.graph_rows(checkpointed(extracted(spark, sf_dir)))
    ord_ = (F.col("ord")["_o"] * 10 + F.col("ord")["_p"] + 1).alias("ord")
    entities = ingest.upsert_entities(rows).select("name", "label", "aliases", "summary", ord_)
    counts = calls.groupBy(F.col("entity").alias("name")).agg(F.count("*").alias("mention_count"))
    return entities.join(counts, "name"), calls.distinct(), relations


@query(f"""WITH {GRAPH_SQL} SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents UNION ALL SELECT 'entities', count(*) FROM ent UNION ALL SELECT 'relations', count(*) FROM rels
UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT doc_id, name FROM names) UNION ALL SELECT 'doc_links', 0 UNION ALL SELECT 'merges', 0 UNION ALL SELECT 'orphan_chunks', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM names) UNION ALL SELECT 'aliases', 0""")
def graph_stats(spark, sf_dir):
    entities, mentions, relations = kg(spark, sf_dir)
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"))
    none = docs.where(F.lit(False))
    return graph.stats({"documents": docs, "chunks": docs, "entities": entities, "relations": relations, "mentions": mentions, "doc_links": none, "merge_history": none})


@query(f"WITH {INDEX_SQL}, {NAMES_SQL}, h AS (SELECT DISTINCT doc_id FROM fr WHERE rank <= 6) SELECT DISTINCT name AS entity FROM names WHERE doc_id IN (SELECT doc_id FROM h)")
def entities_for_chunks(spark, sf_dir):
    hits = retrieve.fulltext_topk(_questions(spark, sf_dir), retrieve.token_table(_rows(spark, sf_dir)), 6)
    return graph.entities_for_chunks(kg(spark, sf_dir)[1], hits.select(F.col("id").alias("chunk_id")))


@query(f"WITH {NAMES_SQL} SELECT d.doc_id AS chunk_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS entities FROM documents d LEFT JOIN names n ON n.doc_id = d.doc_id GROUP BY 1")
def chunk_entity_map(spark, sf_dir):
    rows = graph.chunk_entity_map(kg(spark, sf_dir)[1], _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id")))
    return rows.select("chunk_id", F.array_join("entities", ",").alias("entities"))


MATCH_SQL = f"""{GRAPH_SQL},
mq AS (SELECT item_id, q, count(*) AS n FROM (SELECT item_id, unnest({TOKENS}) AS q FROM benchmark) WHERE length(q) >= 3 GROUP BY 1, 2),
mt AS (SELECT DISTINCT name, ord, unnest(regexp_extract_all(lower(name), '[a-z0-9][a-z0-9\\-]+')) AS t FROM ent),
mp AS (SELECT DISTINCT q, t FROM (SELECT DISTINCT q FROM mq) JOIN (SELECT DISTINCT t FROM mt) ON contains(q, t) OR contains(t, q)),
mh AS (SELECT DISTINCT item_id, name, ord, q, n FROM mq JOIN mp USING (q) JOIN mt USING (t)),
ms AS (SELECT item_id, name, sum(n) AS score, row_number() OVER (PARTITION BY item_id ORDER BY sum(n) DESC, ord, name) AS rank FROM mh GROUP BY item_id, name, ord)
"""


@query(f"WITH {MATCH_SQL} SELECT item_id AS query_id, name, score::BIGINT AS score, rank::INTEGER AS rank FROM ms WHERE rank <= 6")
def match_entities(spark, sf_dir):
    return graph.match_entities(_questions(spark, sf_dir), kg(spark, sf_dir)[0], 6)


GEO_SQL = """
geo AS (SELECT 'N' || n_nationkey AS s, 'PART_OF' AS r, 'R' || n_regionkey AS o FROM nation UNION SELECT 'S' || s_suppkey, 'RELATES_TO', 'N' || s_nationkey FROM supplier UNION SELECT 'C' || c_custkey, 'RELATES_TO', 'N' || c_nationkey FROM customer),
sides AS (SELECT *, s AS node, o AS other FROM geo UNION ALL SELECT *, o, s FROM geo),
h0 AS (SELECT s_suppkey AS query_id, 'S' || s_suppkey AS node FROM supplier),
e1 AS (SELECT query_id, s, r, o, other FROM h0 JOIN sides USING (node)),
h1 AS (SELECT DISTINCT query_id, other AS node FROM e1 EXCEPT SELECT * FROM h0),
e2 AS (SELECT query_id, s, r, o, other FROM h1 JOIN sides USING (node)),
h2 AS (SELECT DISTINCT query_id, other AS node FROM e2 EXCEPT (SELECT * FROM h0 UNION SELECT * FROM h1))
"""


def _geo(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rel = lambda df, s, r, o: df.select(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"))
    edges = rel(table(spark, sf_dir, "nation"), key("N", "n_nationkey"), "PART_OF", key("R", "n_regionkey"))
    supplier = table(spark, sf_dir, "supplier")
    edges = stacked(stacked(edges, rel(supplier, key("S", "s_suppkey"), "RELATES_TO", key("N", "s_nationkey"))), rel(table(spark, sf_dir, "customer"), key("C", "c_custkey"), "RELATES_TO", key("N", "c_nationkey")))
    return edges.distinct(), supplier.select(F.col("s_suppkey").alias("query_id"), key("S", "s_suppkey").alias("node"))


@query(f"WITH {GEO_SQL} SELECT DISTINCT query_id, s AS subject, r AS relation, o AS object FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2)")
def khop_expand(spark, sf_dir):
    edges, _ = graph.expand(*_geo(spark, sf_dir), 2)
    return edges


@query(f"WITH {GEO_SQL} SELECT query_id, node, 0 AS hop FROM h0 UNION ALL SELECT query_id, node, 1 FROM h1 UNION ALL SELECT query_id, node, 2 FROM h2")
def khop_nodes(spark, sf_dir):
    _, nodes = graph.expand(*_geo(spark, sf_dir), 2)
    return nodes


@query(f"WITH {GRAPH_SQL} SELECT subject, relation, object FROM rels WHERE subject IN (SELECT name FROM ent WHERE n > 1) AND object IN (SELECT name FROM ent WHERE n > 1)")
def strict_relations(spark, sf_dir):
    entities, _, relations = kg(spark, sf_dir)
    return ingest.strict_relations(relations, entities.where("mention_count > 1"))


@query(f"WITH {NAMES_SQL} SELECT * FROM rels UNION SELECT doc_id::VARCHAR, 'AUTHORED_BY', source FROM documents")
def authored_by(spark, sf_dir):
    authors = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("person"))
    return ingest.authored_by(kg(spark, sf_dir)[2], authors)


_RESCORE = f"""{INDEX_SQL}, {HYBRID_SQL}, {MATCH_SQL},
seeds AS (SELECT item_id, name AS node FROM ms WHERE rank <= 6),
rs AS (SELECT subject AS node, object AS other FROM rels UNION ALL SELECT object, subject FROM rels),
x1 AS (SELECT DISTINCT item_id, other AS node FROM seeds JOIN rs USING (node) EXCEPT SELECT * FROM seeds),
x2 AS (SELECT DISTINCT item_id, other AS node FROM x1 JOIN rs USING (node) EXCEPT (SELECT * FROM seeds UNION SELECT * FROM x1)),
nd AS (SELECT *, 1.0 AS w FROM seeds UNION ALL SELECT *, 0.25 FROM x1 UNION ALL SELECT *, 0.25 FROM x2),
bo AS (SELECT hy.item_id, hy.doc_id, 0.5 * sum(w) AS boost FROM hy JOIN (SELECT DISTINCT doc_id, name AS node FROM names) m ON m.doc_id = hy.doc_id JOIN nd ON nd.item_id = hy.item_id AND nd.node = m.node WHERE hy.rank <= 6 GROUP BY 1, 2),
tt AS (SELECT hy.*, coalesce(boost, 0) AS g, {TERMS.format("b.text")} AS q, {TERMS.format("TITLE")} AS w FROM hy LEFT JOIN bo USING (item_id, doc_id) JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = hy.doc_id WHERE hy.rank <= 6),
tb AS (SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE 0.4 * len(list_filter(q, lambda x: len(list_filter(w, lambda y: contains(y, x) OR contains(x, y))) > 0)) / len(q) END AS t FROM tt),
fin AS (SELECT item_id, doc_id, score * (1 + g + t) AS score, via || CASE WHEN g > 0 THEN '+graph' ELSE '' END || CASE WHEN t > 0 THEN '+title' ELSE '' END AS via, rank AS old FROM tb)
"""


def RESCORE_SQL(title: str) -> str:
    return _RESCORE.replace("TITLE", title)


def _rescored(spark, sf_dir):
    entities, mentions, relations = kg(spark, sf_dir)
    questions = _questions(spark, sf_dir)
    fused = checkpointed(hybrid(spark, sf_dir))
    seeds = graph.match_entities(questions, entities, 6).select("query_id", F.col("name").alias("node"))
    mentions = checkpointed(retrieve.mentions_of(fused, mentions))
    _, nodes = graph.expand(relations, seeds, 2, retrieve.nodes_of(fused, mentions))
    boosts = retrieve.graph_factor(fused, mentions, nodes, 0.5)
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), F.array_join(extract.capitalised_names("text"), " ")).alias("title"), F.lit("").alias("label"))
    return retrieve.rescore(fused.join(questions, "query_id").join(docs, "id"), boosts, 0.5, 0.4)


# a document's title: its source and the names in it
NAMED = "d.source || ' ' || coalesce((SELECT string_agg(name, ' ' ORDER BY pos) FROM names WHERE names.doc_id = d.doc_id), '')"


@query(f"WITH {RESCORE_SQL(NAMED)} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, via, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, old)::INTEGER AS rank FROM fin")
def rescore(spark, sf_dir):
    return _rescored(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"), "via", "rank")


# entity resolution over part names

PARTS_SQL = r"""
ent AS (SELECT p_name AS name, 'Tool' AS label, count(*) AS n, min(p_partkey) AS ord, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS form FROM part GROUP BY p_name),
pairs AS (SELECT a.name AS a_name, b.name AS b_name, a.n AS a_n, b.n AS b_n, a.ord AS a_ord, b.ord AS b_ord, levenshtein(a.form, b.form) AS d, greatest(length(a.form), length(b.form), 1) AS l, left(a.form, 4) = left(b.form, 4) AS pre FROM ent a JOIN ent b ON a.label = b.label AND a.ord < b.ord),
cand AS (SELECT *, CASE WHEN d = 0 THEN 1.0 ELSE 1.0 - d / l END AS sim FROM pairs WHERE d <= 2 OR 1.0 - d / l >= 0.86),
pick AS (SELECT *, CASE WHEN a_n > b_n THEN a_name WHEN b_n > a_n THEN b_name WHEN length(a_name) <= length(b_name) THEN a_name ELSE b_name END AS canonical FROM cand),
dec AS (SELECT CASE WHEN canonical = a_name THEN b_name ELSE a_name END AS duplicate, canonical, sim, CASE WHEN pre THEN 1 ELSE 2 END AS k, a_ord, b_ord FROM pick),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY duplicate ORDER BY k, a_ord, b_ord) AS rn FROM dec) WHERE rn = 1),
walk AS (SELECT duplicate, canonical AS tip, 0 AS depth FROM first UNION ALL SELECT w.duplicate, f.canonical, depth + 1 FROM walk w JOIN first f ON f.duplicate = w.tip),
roots AS (SELECT duplicate, arg_max(tip, depth) AS root FROM walk GROUP BY duplicate)
"""


def _parts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("mention_count"), F.min("p_partkey").alias("ord"))
    return rows.select("name", F.lit("Tool").alias("label"), "mention_count", "ord", F.array().cast("array<string>").alias("aliases"), F.lit("").alias("summary"))


def _seeds(spark):
    from loomgraph.sources.loaders import alias_seeds

    return alias_seeds(spark)


FORM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH p AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b, {FORM.format("a.p_name")} AS x, {FORM.format("b.p_name")} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT a, b, levenshtein(x, y)::INTEGER AS distance, round(CASE WHEN x = y THEN 1.0 ELSE 1.0 - levenshtein(x, y) / greatest(length(x), length(y), 1) END, 6)::DOUBLE AS similarity FROM p""")
def string_similarity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    rows = part.join(following, "p_partkey").select(F.col("p_name").alias("a"), "b").distinct()
    return rows.select("a", "b", tx.name_distance("a", "b").alias("distance"), F.round(tx.string_similarity("a", "b"), 6).alias("similarity"))


@query(f"WITH RECURSIVE {PARTS_SQL} SELECT a_name, b_name, round(sim, 6)::DOUBLE AS similarity, d::INTEGER AS distance FROM cand")
def er_candidates(spark, sf_dir):
    return resolve.candidates(_parts(spark, sf_dir)).select("a_name", "b_name", F.round("similarity", 6).alias("similarity"), "distance")


@query(f"WITH RECURSIVE {PARTS_SQL} SELECT a_name, b_name, canonical FROM pick")
def canonical_pick(spark, sf_dir):
    rows = resolve.candidates(_parts(spark, sf_dir))
    return rows.select("a_name", "b_name", resolve.canonical(F.col("a_name"), F.col("b_name"), F.col("a_count"), F.col("b_count")).alias("canonical"))


ALIASED = ["PGVector", "neo4J", "Ollama", "llamaindex", "Llama-Index", "other", "NEO4J", "pg vector"]


@query(f"""WITH e AS (SELECT DISTINCT {ALIASED}[(p_partkey % 8) + 1] AS name FROM part)
SELECT name AS duplicate, CASE WHEN name IN ('PGVector', 'pg vector') THEN 'pgvector' WHEN name IN ('neo4J', 'NEO4J') THEN 'Neo4j' ELSE 'LlamaIndex' END AS canonical FROM e WHERE name NOT IN ('other', 'Ollama')""")
def alias_seed(spark, sf_dir):
    name = F.get(F.array(*[F.lit(x) for x in ALIASED]), (F.col("p_partkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "part").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("ord"))
    return resolve.alias_decisions(rows, _seeds(spark)).select("duplicate", "canonical")


@query(f"WITH RECURSIVE {PARTS_SQL} SELECT f.duplicate, canonical, round(sim, 6)::DOUBLE AS string_score, 'string' AS reason, root FROM first f JOIN roots USING (duplicate)")
def er_plan(spark, sf_dir):
    decisions = resolve.plan(_parts(spark, sf_dir), _seeds(spark))
    rows = decisions.join(resolve.merge_roots(decisions), "duplicate")
    return rows.select("duplicate", "canonical", F.round("string_score", 6).alias("string_score"), "reason", "root")


@query(f"""WITH RECURSIVE {PARTS_SQL}, m AS (SELECT DISTINCT p_brand, coalesce(root, p_name) AS entity FROM part LEFT JOIN roots ON duplicate = p_name),
r AS (SELECT DISTINCT coalesce(x.root, a.p_name) AS s, coalesce(y.root, b.p_name) AS o FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 LEFT JOIN roots x ON x.duplicate = a.p_name LEFT JOIN roots y ON y.duplicate = b.p_name)
SELECT 'mention' AS kind, p_brand AS a, entity AS b, 0 AS n FROM m UNION ALL SELECT 'relation', s, o, 0 FROM r WHERE s <> o
UNION ALL SELECT 'entity', coalesce(root, name), coalesce(string_agg(name, ',' ORDER BY ord) FILTER (root IS NOT NULL), ''), sum(n) FROM ent LEFT JOIN roots ON duplicate = name GROUP BY 2""")
def merge_rewire(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mentions = part.select(F.col("p_brand").alias("chunk_id"), F.col("p_name").alias("entity")).distinct()
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("object"))
    relations = part.join(following, "p_partkey").select(F.col("p_name").alias("subject"), F.lit("RELATES_TO").alias("relation"), "object").distinct()
    entities = _parts(spark, sf_dir)
    roots = resolve.merge_roots(resolve.plan(entities, _seeds(spark)))
    merged, m, r = ingest.merge_entities(entities, mentions, relations, roots)
    out = m.select(F.lit("mention").alias("kind"), F.col("chunk_id").alias("a"), F.col("entity").alias("b"), F.lit(0).cast("decimal(38,0)").alias("n"))
    out = stacked(out, r.select(F.lit("relation").alias("kind"), F.col("subject").alias("a"), F.col("object").alias("b"), F.lit(0).cast("decimal(38,0)").alias("n")))
    out = stacked(out, merged.select(F.lit("entity").alias("kind"), F.col("name").alias("a"), F.array_join("aliases", ",").alias("b"), F.col("mention_count").cast("decimal(38,0)").alias("n")))
    return out.withColumn("n", F.col("n").cast("long"))


SQL["merge_rewire"] = SQL["merge_rewire"].replace("0 AS n FROM m", "0::BIGINT AS n FROM m").replace("sum(n) FROM ent", "sum(n)::BIGINT FROM ent")


@query(f"""WITH RECURSIVE {PARTS_SQL}, c AS (SELECT name, coalesce(root, name) AS cluster FROM ent LEFT JOIN roots ON duplicate = name),
g AS (SELECT a_name AS a, b_name AS b, d <= 1 AS should FROM cand), j AS (SELECT should, x.cluster = y.cluster AS merged FROM g JOIN c x ON x.name = a JOIN c y ON y.name = b),
t AS (SELECT count(*) FILTER (should AND merged) AS tp, count(*) FILTER (NOT should AND merged) AS fp, count(*) FILTER (should AND NOT merged) AS fn FROM j)
SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM t""")
def er_pairwise_prf(spark, sf_dir):
    entities = _parts(spark, sf_dir)
    groups = resolve.clusters(entities, resolve.merge_roots(resolve.plan(entities, _seeds(spark))))
    pairs = resolve.candidates(entities).select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), (F.col("distance") <= 1).alias("should_merge"))
    return evaluate.pairwise_prf(groups, pairs).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH p AS (SELECT doc_id FROM labels WHERE quality = 1), g AS (SELECT doc_id FROM labels WHERE toxic = 0), t AS (SELECT (SELECT count(*) FROM p SEMI JOIN g USING (doc_id)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (doc_id)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (doc_id)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t""")
def set_prf(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    out = evaluate.set_prf(rows.where("quality = 1"), rows.where("toxic = 0"), ["doc_id"])
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# answers

HITS_SQL = f"{INDEX_SQL}, h AS (SELECT item_id, fr.doc_id, rank, source AS title, 'line 1–' || (1 + length(text) - length(replace(text, chr(10), ''))) || ' (' || lang || ')' AS citation, 'line 1' || ' (' || lang || ')' AS one, (1 + length(text) - length(replace(text, chr(10), ''))) AS lines, text FROM fr JOIN documents USING (doc_id) WHERE rank <= 4)"


def _bundles(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    docs = _docs(spark, sf_dir)
    lines = (1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("int")
    span = F.struct(F.lit("line").alias("kind"), F.lit(1).alias("start"), lines.alias("end"), F.col("lang").alias("label"))
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), "text", span.alias("span"))
    documents = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("uri"))
    hits = retrieve.fulltext_topk(questions, retrieve.token_table(chunks), 4).withColumn("via", F.lit("fulltext"))
    hits = checkpointed(hits)
    rows = retrieve.with_documents(hits, chunks, documents)
    _, mentions, relations = kg(spark, sf_dir)
    seeds = hits.select("query_id", F.col("id").alias("chunk_id")).join(mentions, "chunk_id").select("query_id", F.col("entity").alias("node")).distinct()
    edges, nodes = graph.expand(relations, seeds, 1)
    return answer.bundles(questions, rows, edges, nodes)


@query(f"WITH {HITS_SQL} SELECT item_id AS query_id, rank::INTEGER AS rank, title, CASE WHEN lines = 1 THEN one ELSE citation END AS citation FROM h")
def citations(spark, sf_dir):
    rows = _bundles(spark, sf_dir).select("query_id", F.explode("chunks").alias("c"))
    return rows.select("query_id", "c.rank", "c.title", "c.citation")


BUNDLE_SQL = f"""{HITS_SQL}, {NAMES_SQL}, sd AS (SELECT DISTINCT item_id, name AS node FROM h JOIN names USING (doc_id)),
ed AS (SELECT DISTINCT item_id, subject, relation, object FROM sd JOIN rels ON subject = node OR object = node),
nn AS (SELECT item_id, node FROM sd UNION SELECT item_id, subject FROM ed UNION SELECT item_id, object FROM ed)
"""


@query(f"""WITH {BUNDLE_SQL} SELECT b.item_id AS query_id, (SELECT count(*) FROM h WHERE h.item_id = b.item_id) AS n_chunks, (SELECT coalesce(string_agg(subject || '>' || object, '|' ORDER BY subject, relation, object), '') FROM ed WHERE ed.item_id = b.item_id) AS edges,
(SELECT coalesce(string_agg(node, '|' ORDER BY node), '') FROM nn WHERE nn.item_id = b.item_id) AS entities FROM benchmark b""")
def retrieve_bundle(spark, sf_dir):
    edges = F.array_join(F.transform("edges", lambda e: F.concat(e["subject"], F.lit(">"), e["object"])), "|")
    return _bundles(spark, sf_dir).select("query_id", F.size("chunks").cast("long").alias("n_chunks"), edges.alias("edges"), F.array_join("entities", "|").alias("entities"))


PROMPT_SQL = f"""WITH {BUNDLE_SQL}, s AS (SELECT item_id, string_agg('[' || rank || '] ' || title || ' (' || CASE WHEN lines = 1 THEN one ELSE citation END || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS s FROM h GROUP BY 1),
eg AS (SELECT item_id, string_agg(line, chr(10) ORDER BY n) AS e FROM (SELECT item_id, subject || ' -[' || relation || ']-> ' || object AS line, row_number() OVER (PARTITION BY item_id ORDER BY subject, relation, object) AS n FROM ed) WHERE n <= 40 GROUP BY 1)
SELECT item_id AS query_id, 'Answer from the passages and relations given here and from nothing else.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Passages:' || chr(10) || coalesce(s, '(no passages)') || chr(10) || chr(10) || 'Relations:' || chr(10) || coalesce(e, '(no relations)') || chr(10) || chr(10)
|| 'Be brief. Put the number of each passage used in brackets, and say how the relations connect them.' AS prompt FROM benchmark LEFT JOIN s USING (item_id) LEFT JOIN eg USING (item_id)"""


@query(f"SELECT query_id, md5(prompt) AS prompt FROM ({PROMPT_SQL})")
def answer_prompt(spark, sf_dir):
    return _bundles(spark, sf_dir).select("query_id", F.md5(answer.answer_prompt("text", "chunks", "edges").cast("binary")).alias("prompt"))


@query(f"""WITH p AS ({PROMPT_SQL}), m AS (SELECT query_id, list_slice(list_sort(list_distinct(list_transform(regexp_extract_all(prompt, '\\[(\\d+)\\]', 1), lambda x: x::HUGEINT))), 1, 3) AS m FROM p),
n AS (SELECT query_id, m, (SELECT count(*) FROM (WITH {HITS_SQL} SELECT item_id, rank FROM h) c WHERE c.item_id = query_id) AS n, (SELECT count(*) FROM (WITH {HITS_SQL} SELECT item_id, rank FROM h) c WHERE c.item_id = query_id AND list_contains(CASE WHEN len(m) = 0 THEN [1] ELSE m END, c.rank)) AS k FROM m)
SELECT query_id, '{answer.HEAD}' || CASE WHEN len(m) = 0 THEN '[1]' ELSE list_aggregate(list_transform(m, lambda x: '[' || x || ']'), 'string_agg', ' ') END || '.' AS answer, (CASE WHEN k > 0 THEN k ELSE n END)::INTEGER AS n_citations, false AS uncited FROM n""")
def answers(spark, sf_dir):
    return answer.synthesize(_bundles(spark, sf_dir)).select("query_id", "answer", F.size("citations").alias("n_citations"), "uncited")
