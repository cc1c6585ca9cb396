"""Queries over sources, models, the store and the engine, with their SQL."""

from __future__ import annotations

import contextlib
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.frames import stacked
from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators import chunking, evaluate, extract, graph, ingest, resolve, retrieve
from loomgraph.plans.queries_graph import COSINE, GRAPH_SQL, MATCH_SQL, PARTS_SQL, RESCORE_SQL, SWEEP_SQL, _parts, _ranked, _seeds, _vectors, kg
from loomgraph.plans.queries_text import BM25_SQL, EMBED_SQL, INDEX_SQL, NAMES_SQL, NORM, SQL as TEXT_SQL, _docs, _questions, _rows, answer_eval, table
from loomgraph.plans.store import checkpointed
from loomgraph.providers import OfflineEmbedder, OfflineModel, embedder, language_model, with_vectors
from loomgraph.scratch import scratch_path
from loomgraph.sources import loaders

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# sources: the tables' texts as files of 50 rows each

SUFFIXES = [".md", ".TXT", ".transcript.txt", ".vtt", ".pdf", ".HTML", ".docx", ".srt"]


@query(f"""WITH p AS (SELECT doc_id, 'file:/notes/' || lang || '/Doc.' || doc_id || {SUFFIXES}[(doc_id % 8) + 1] AS path FROM documents), f AS (SELECT *, split_part(path, '/', 4) AS name FROM p)
SELECT doc_id, CASE WHEN regexp_matches(lower(path), '(transcript\\.txt|vtt|srt)$') THEN 'transcript' WHEN regexp_matches(lower(path), '\\.(md|txt)$') THEN 'markdown' WHEN regexp_matches(lower(path), 'pdf$') THEN 'pdf' WHEN regexp_matches(lower(path), 'html$') THEN 'web' END AS kind,
regexp_replace(name, '\\.[^.]*$', '') AS stem, left(sha256(path), 32) AS id FROM f""")
def file_kinds(spark, sf_dir):
    suffix = F.get(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("doc_id") % 8).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("file:/notes/"), F.col("lang"), F.lit("/Doc."), F.col("doc_id").cast("string"), suffix).alias("path"))
    return rows.select("doc_id", loaders.source_type("path").alias("kind"), loaders.stem("path").alias("stem"), loaders.document_id("path").alias("id"))


@query("""WITH f AS (SELECT doc_id // 50 AS bucket, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10) AS raw FROM documents GROUP BY 1)
SELECT bucket, 'markdown' AS source_type, md5(raw) AS digest, true AS dated, 1 AS version FROM f""")
def folder_docs(spark, sf_dir):
    path = scratch_path(spark, "notes")
    rows = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("bucket"), "doc_id", "text")
    rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("bucket").text(path)
    docs = loaders.load_path(spark, path)
    return docs.select(F.regexp_extract("uri", r"bucket=(\d+)/", 1).cast("long").alias("bucket"), "source_type", F.md5(F.col("raw_text").cast("binary")).alias("digest"), (F.col("created_at") <= F.current_timestamp()).alias("dated"), "version")


def _cases(spark, sf_dir, name: str, body) -> str:
    """A folder of JSON files, one for 50 questions."""
    path = scratch_path(spark, name)
    rows = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 50).alias("bucket"), body.alias("c")).groupBy("bucket").agg(F.collect_list("c").alias("cases"))
    rows.select("bucket", F.to_json(F.struct(F.col("cases").alias("retrieval" if name == "gold" else "questions"))).alias("value")).write.partitionBy("bucket").text(path)
    return path


@query("SELECT text AS query, 't' || (item_id % 3) AS first, 2 AS n FROM benchmark")
def gold_cases(spark, sf_dir):
    body = F.struct(F.col("text").alias("query"), F.array(F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")), F.lit("u")).alias("relevant"))
    rows = loaders.load_gold(spark, _cases(spark, sf_dir, "gold", body)).select(F.explode("retrieval").alias("r"))
    return rows.select("r.query", F.get("r.relevant", F.lit(0)).alias("first"), F.size("r.relevant").alias("n"))


@query("SELECT text AS query, CASE WHEN item_id % 2 = 0 THEN 'e' || item_id ELSE '' END AS expected, (CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS n_facts, CASE WHEN item_id % 5 = 0 THEN 3 END AS top_k FROM benchmark")
def answer_cases(spark, sf_dir):
    i = F.col("item_id")
    body = F.struct(F.col("text").alias("query"), F.when(i % 2 == 0, F.concat(F.lit("e"), i.cast("string"))).alias("expected"), F.when(i % 3 == 0, F.array(F.lit("f"))).alias("key_facts"), F.when(i % 5 == 0, 3).alias("top_k"))
    rows = loaders.load_answers(spark, _cases(spark, sf_dir, "answers", body))
    return rows.select("query", "expected", F.size("key_facts").alias("n_facts"), "top_k")


# functions


@query("SELECT doc_id, (1 + length(left(t, n // 2)) - length(replace(left(t, n // 2), chr(10), '')))::INTEGER AS middle, (7 + length(t) - length(replace(t, chr(10), '')))::INTEGER AS last FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)")
def offset_lines(spark, sf_dir):
    n = F.length("text")
    return _docs(spark, sf_dir).select("doc_id", chunking.line_of("text", F.floor(n / 2).cast("int")).alias("middle"), chunking.line_of("text", n, 7).alias("last"))


@query("""SELECT doc_id, '{"kind":"line","start":' || doc_id || ',"end":' || (doc_id + 2) || ',"label":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"' || lang || '"' END || '}' AS raw, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END::INTEGER AS start FROM documents""")
def span_texts(spark, sf_dir):
    i = F.col("doc_id").cast("int")
    span = F.struct(F.lit("line").alias("kind"), i.alias("start"), (i + 2).alias("end"), F.when(i % 2 == 1, F.col("lang")).alias("label"))
    raw = tx.span_to_json(span)
    return _docs(spark, sf_dir).select("doc_id", raw.alias("raw"), tx.span_from_json(F.when(i % 3 == 0, "broken").otherwise(raw))["start"].alias("start"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 0.0 ELSE greatest(0.0, least(5.0, (doc_id % 11 - 3) / 1.5)) END::DOUBLE AS score FROM documents")
def clamped(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 4 == 3, "none").otherwise(((F.col("doc_id") % 11 - 3) / 1.5).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", tx.clamp5(raw).alias("score"))


@query(r"""SELECT doc_id, md5(CASE WHEN e = '' THEN '*' ELSE e END) AS digest FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS e FROM documents)""")
def escaped_queries(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.escape_query("text").cast("binary")).alias("digest"))


# resolution with embeddings

ER_EMBED_SQL = f"""{PARTS_SQL.split("pick AS")[0]}
ctx AS (SELECT name, list(x ORDER BY i) AS v FROM (SELECT p_name AS name, i, avg(x) AS x FROM (SELECT DISTINCT p_name, vec_id FROM part JOIN embeddings ON vec_id = p_partkey % 100) JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) USING (vec_id) GROUP BY 1, 2) GROUP BY 1),
es AS (SELECT cand.*, {COSINE.format(a="x.v", b="y.v")} AS es FROM cand LEFT JOIN ctx x ON x.name = a_name LEFT JOIN ctx y ON y.name = b_name),
gate AS (SELECT *, abs(es - 0.1) <= 0.08 AS band FROM es WHERE es >= 0.1 - 0.08),
dec AS (SELECT *, CASE WHEN a_n > b_n THEN a_name WHEN b_n > a_n THEN b_name WHEN length(a_name) <= length(b_name) THEN a_name ELSE b_name END AS canonical FROM gate WHERE NOT band OR length(a_name) % 2 = 0),
dup AS (SELECT *, CASE WHEN canonical = a_name THEN b_name ELSE a_name END AS duplicate FROM dec)
SELECT duplicate, canonical, round(es, 6) + 0 AS embed_score, CASE WHEN band THEN 'llm' ELSE 'string+embed' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY duplicate ORDER BY CASE WHEN pre THEN 1 ELSE 2 END, a_ord, b_ord) AS rn FROM dup) WHERE rn = 1"""


@query(f"WITH RECURSIVE {ER_EMBED_SQL}")
def er_embed_plan(spark, sf_dir):
    parts = checkpointed(_parts(spark, sf_dir))
    mentions = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100).alias("chunk_id"), F.col("p_name").alias("entity"))
    pairs = resolve.candidates(parts)
    names = stacked(pairs.select(F.col("a_name").alias("name")), pairs.select(F.col("b_name").alias("name")))
    context = resolve.context_embeddings(mentions, _vectors(spark, sf_dir), names)
    config = EngineConfig().with_(matching={"cosine": 0.1, "band": 0.08})
    decisions = resolve.plan(parts, _seeds(spark), context, config, F.length("a_name") % 2 == 0)
    return decisions.select("duplicate", "canonical", (F.round("embed_score", 6) + 0.0).alias("embed_score"), "reason")


# evaluation

GOLD_SQL = f"""{INDEX_SQL}, h AS (SELECT item_id, rank, source AS title, 'doc' || fr.doc_id AS uri FROM fr JOIN documents USING (doc_id) WHERE rank <= 6),
g0 AS (SELECT item_id, unnest(['doc' || (item_id * 3), (SELECT min(source) FROM documents), 'nowhere']) AS item FROM benchmark UNION ALL SELECT item_id, uri FROM h WHERE rank = 2),
g AS (SELECT DISTINCT g0.item_id, coalesce(title, item) AS item FROM g0 LEFT JOIN h ON h.item_id = g0.item_id AND h.uri = g0.item),
f AS (SELECT item_id, title AS item, row_number() OVER (PARTITION BY item_id ORDER BY min(rank)) AS rank FROM h GROUP BY 1, 2),
r AS (SELECT f.*, (g.item IS NOT NULL)::INTEGER AS rel, sum((g.item IS NOT NULL)::INTEGER) OVER (PARTITION BY f.item_id ORDER BY rank) AS hits FROM f LEFT JOIN g ON g.item_id = f.item_id AND g.item = f.item),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(sum(rel) FILTER (rank <= 4) / nullif(count(r.item) FILTER (rank <= 4), 0), 0), 6) AS precision, round(coalesce(sum(rel) FILTER (rank <= 4), 0) / max(n), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1), 0), 6) AS rr, round(coalesce(sum(rel * hits / rank), 0) / max(n), 6) AS ap FROM n LEFT JOIN r USING (item_id) GROUP BY 1"""


@query(f"WITH {GOLD_SQL}")
def gold_metrics(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("uri"))
    hits = checkpointed(retrieve.fulltext_topk(_questions(spark, sf_dir), retrieve.token_table(_rows(spark, sf_dir)), 6).join(docs, "id"))
    first = docs.agg(F.min("title")).first()[0]
    relevant = _questions(spark, sf_dir).select("query_id", F.explode(F.array(F.concat(F.lit("doc"), (F.col("query_id") * 3).cast("string")), F.lit(first), F.lit("nowhere"))).alias("item"))
    relevant = evaluate.gold_items(hits, stacked(relevant, hits.where("rank = 2").select("query_id", F.col("uri").alias("item"))))
    items = evaluate.first_occurrences(hits.withColumn("item", F.col("title")), "item")
    return evaluate.retrieval_metrics(items, relevant, 4).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr", "ap")])


@query(f"SELECT count(*) AS n, round(avg(judge_complete), 6) AS judge_complete, round(avg(key_fact_recall), 6) AS key_fact_recall, round(avg(lexical_f1), 6) AS lexical_f1, round(avg(grounded::INTEGER), 6) AS grounded_rate FROM ({TEXT_SQL['answer_eval']})")
def answer_means(spark, sf_dir):
    graded = answer_eval(spark, sf_dir).withColumn("judge_correct", F.lit(0.0)).withColumn("judged", F.lit(False))
    return evaluate.answer_report(graded).select("n", *[F.round(c, 6).alias(c) for c in ("judge_complete", "key_fact_recall", "lexical_f1", "grounded_rate")])


@query(f"WITH {SWEEP_SQL}, m AS (SELECT gb, tb, k, avg(ap) AS ap FROM z GROUP BY 1, 2, 3) SELECT gb AS graph_boost, tb AS title_boost, k AS top_k, round(ap, 6) AS ap FROM m ORDER BY round(ap, 9) DESC, gb, tb, k LIMIT 5")
def sweep_top(spark, sf_dir):
    near, _, relevant, sizes = _ranked(spark, sf_dir)
    hits = near.select("query_id", F.col("id").alias("item"), (1.0 / (60 + F.col("rank"))).alias("base"), (F.col("id") % 3).cast("double").alias("g"), (F.col("id") % 2).cast("double").alias("t"), "rank")
    grid = spark.createDataFrame([(g, t, k) for g in (0.0, 0.5, 1.0) for t in (0.0, 0.4) for k in (6, 10)], "graph_boost double, title_boost double, top_k int")
    rows = evaluate.sweep(hits, relevant, grid, 6, sizes)
    return rows.orderBy(F.desc(F.round("ap", 9)), "graph_boost", "title_boost", "top_k").limit(5).select("graph_boost", "title_boost", "top_k", F.round("ap", 6).alias("ap"))


# models

QUESTION_NAMES = NAMES_SQL.replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")


@query(f"WITH {QUESTION_NAMES} SELECT item_id AS query_id, pos::INTEGER AS pos, name FROM names")
def model_extraction(spark, sf_dir):
    prompts = _questions(spark, sf_dir).select("query_id", extract.extraction_prompt("text").alias("prompt"))
    told = extract.with_answers(prompts, "prompt", language_model(EngineConfig(), "extraction").complete_json)
    rows = told.select("query_id", F.posexplode(extract.validated("answer")["entities"]).alias("p", "e"))
    return rows.select("query_id", (F.col("p") + 1).alias("pos"), F.col("e.name").alias("name"))


@query("SELECT item_id AS query_id, i, round(x, 6) + 0 AS x FROM (" + EMBED_SQL.format(key="item_id", t="benchmark") + ")")
def model_vectors(spark, sf_dir):
    rows = with_vectors(_questions(spark, sf_dir), "text", embedder(EngineConfig().with_(models={"dimensions": 64})))
    return rows.select("query_id", F.posexplode("embedding").alias("i", "x")).select("query_id", "i", (F.round("x", 6) + 0.0).alias("x"))


def _odd_fails(text: str) -> str:
    if len(text) % 2:
        raise ValueError(f"{len(text)} characters")
    return text[:3]


@query("SELECT item_id AS query_id, CASE WHEN length(text) % 2 = 0 THEN left(text, 3) END AS answer, CASE WHEN length(text) % 2 = 1 THEN 'ValueError: ' || length(text) || ' characters' END AS error FROM benchmark")
def failed_calls(spark, sf_dir):
    return extract.with_answers(_questions(spark, sf_dir), "text", _odd_fails).select("query_id", "answer", "error")


def _two_terms(prompt: str) -> str:
    text = prompt.partition("Question: ")[2]
    return f"- {text[:4]}\n* Zq{len(text)}; zq{len(text)}, Extra"


@query("SELECT item_id AS query_id, text || ' Zq' || length(text) || CASE WHEN contains(lower(text), 'extra') THEN '' ELSE ' Extra' END AS search_text FROM benchmark")
def expanded_queries(spark, sf_dir):
    return retrieve.expanded(_questions(spark, sf_dir), _two_terms).select("query_id", "search_text")


def _backwards(prompt: str) -> str:
    lines = prompt.partition("Passages:\n")[2]
    if len(prompt) % 3 == 0:
        return "no idea"
    n = sum(line.startswith(f"[{k}] ") for k in (1, 2, 3, 4) for line in lines.split("\n"))
    return json.dumps(list(range(min(n, 4), 0, -1)))


@query(f"""WITH {INDEX_SQL}, h AS (SELECT item_id, fr.doc_id, rank, replace(left(text, 40), chr(10), ' ') AS snippet, least(count(*) OVER (PARTITION BY item_id), 4) AS n FROM fr JOIN documents USING (doc_id) WHERE rank <= 6),
p AS (SELECT item_id, length('Question: ' || text || chr(10) || chr(10) || 'Passages:' || chr(10) || string_agg('[' || rank || '] ' || snippet, chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Sort the passage numbers by how well they answer, best one in front, and give just that list as JSON.') AS len FROM (SELECT h.item_id, b.text, rank, snippet FROM h JOIN benchmark b USING (item_id) WHERE rank <= 4) GROUP BY item_id, text),
o AS (SELECT h.*, n > 1 AND len % 3 <> 0 AND rank <= 4 AS listed FROM h JOIN p USING (item_id))
SELECT item_id AS query_id, doc_id AS id, CASE WHEN listed THEN 'fulltext+rerank' ELSE 'fulltext' END AS via, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN listed THEN 0 WHEN rank <= 4 THEN 1 ELSE 2 END, CASE WHEN listed THEN -rank END, rank)::INTEGER AS rank FROM o""")
def model_ranking(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    hits = retrieve.fulltext_topk(questions, retrieve.token_table(_rows(spark, sf_dir)), 6).withColumn("via", F.lit("fulltext"))
    texts = _rows(spark, sf_dir).select("id", F.translate(F.left("text", F.lit(40)), "\n", " ").alias("text"))
    rows = checkpointed(hits.join(texts, "id").join(questions.withColumnRenamed("text", "query"), "query_id"))
    return retrieve.rerank(rows, _backwards, 4, 40).select("query_id", "id", "via", "rank")


# the store and the engine

_BUILT: dict = {}


def indexed(spark: SparkSession, sf_dir: str):
    """An engine whose store holds the postings of every document as one chunk, and no other table before `notebook` adds it; built once for each session."""
    from loomgraph.plans.engine import Engine

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        engine = Engine(spark, "temporary", EngineConfig().with_(models={"dimensions": 64}))
        engine.store.commit({"chunk_tokens": retrieve.postings(_docs(spark, sf_dir).select(_chunk_id("doc_id").alias("id"), "text"))})
        _BUILT[key] = engine
    return _BUILT[key]


def _chunk_id(doc_id: str):
    return F.lpad(F.col(doc_id).cast("string"), 12, "0")


def notebook(spark: SparkSession, sf_dir: str):
    """An engine whose store holds every document as one chunk, with the graph of its names; built once for each session."""
    engine = indexed(spark, sf_dir)
    if not engine.store.parts("chunks"):
        name = _chunk_id("doc_id")
        docs = _docs(spark, sf_dir)
        none = F.array().cast("array<string>")
        documents = docs.select(
            name.alias("id"), F.lit("markdown").alias("source_type"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("uri"), F.col("source").alias("title"), F.col("text").alias("raw_text"), F.current_timestamp().alias("created_at"),
            tx.content_hash("text").alias("content_hash"), F.lit(1).alias("version"), F.lit(1).alias("schema_version"), none.alias("links"), F.lit(None).cast("map<string,string>").alias("meta"),
        )
        span = F.struct(F.lit("line").alias("kind"), F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("").alias("label"))
        chunks = docs.select(name.alias("id"), name.alias("document_id"), F.lit(0).alias("position"), "text", span.alias("span"), vx.hash_embedding("text", 64).alias("embedding"), F.lit("engine").alias("embed_model"), F.lit(64).alias("embed_dim"))
        entities, mentions, relations = kg(spark, sf_dir)
        mentions = mentions.select(_chunk_id("chunk_id").alias("chunk_id"), "entity")
        engine.store.commit({"documents": documents, "chunks": chunks, "entities": entities, "mentions": mentions, "relations": relations, "entity_tokens": graph.entity_tokens(entities)})
    return engine


SEARCH_SQL = RESCORE_SQL("d.source") + ", ranked AS (SELECT item_id, doc_id, score, via, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, old) AS place FROM fin)"


@query(f"WITH {SEARCH_SQL} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, via, place::INTEGER AS rank, d.source AS title, 'line 1' AS citation FROM ranked JOIN documents d USING (doc_id)")
def engine_search(spark, sf_dir):
    hits = notebook(spark, sf_dir).search(_questions(spark, sf_dir))
    return hits.select("query_id", F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"), "via", "rank", "title", "citation")


@query(f"""WITH {SEARCH_SQL}, zh AS (SELECT item_id, place AS rank, source AS title, 'doc' || doc_id AS uri FROM ranked JOIN documents USING (doc_id)),
zg0 AS (SELECT item_id, unnest(['doc' || (item_id * 3), (SELECT min(source) FROM documents)]) AS item FROM benchmark),
zg AS (SELECT DISTINCT zg0.item_id, coalesce(title, item) AS item FROM zg0 LEFT JOIN zh ON zh.item_id = zg0.item_id AND zh.uri = zg0.item),
zf AS (SELECT item_id, title AS item, row_number() OVER (PARTITION BY item_id ORDER BY min(rank)) AS rank FROM zh GROUP BY 1, 2),
zr AS (SELECT zf.*, (zg.item IS NOT NULL)::INTEGER AS rel FROM zf LEFT JOIN zg ON zg.item_id = zf.item_id AND zg.item = zf.item),
zn AS (SELECT item_id, count(*) AS n FROM zg GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(sum(rel) / nullif(count(zr.item), 0), 0), 6) AS precision, round(coalesce(sum(rel), 0) / max(n), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1), 0), 6) AS rr FROM zn LEFT JOIN zr USING (item_id) GROUP BY 1""")
def engine_metrics(spark, sf_dir):
    first = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    cases = _questions(spark, sf_dir).withColumn("relevant", F.array(F.concat(F.lit("doc"), (F.col("query_id") * 3).cast("string")), F.lit(first)))
    return notebook(spark, sf_dir).eval_retrieval(cases, 6).select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "rr")])


@query(f"""WITH {QUESTION_NAMES}, p AS (SELECT DISTINCT item_id, name, 'Concept' AS label FROM names), g AS (SELECT item_id, name, CASE WHEN item_id % 3 = 0 THEN 'Tool' ELSE 'Concept' END AS label FROM p UNION ALL SELECT item_id, 'Nobody', 'Person' FROM benchmark),
pt AS (SELECT DISTINCT a.item_id, a.name AS s, b.name AS o FROM names a JOIN names b ON a.item_id = b.item_id AND b.pos = a.pos + 1), gt AS (SELECT item_id, 'Nobody' AS s, 'Anybody' AS o FROM benchmark),
zc AS (SELECT 'entities' AS kind, (SELECT count(*) FROM p SEMI JOIN g USING (item_id, name, label)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (item_id, name, label)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (item_id, name, label)) AS fn
 UNION ALL SELECT 'triples', 0, (SELECT count(*) FROM pt), (SELECT count(*) FROM gt))
SELECT kind, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM zc""")
def engine_extraction(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    names = F.transform(extract.capitalised_names("text"), lambda n: F.array(n, F.when(F.col("query_id") % 3 == 0, "Tool").otherwise("Concept")))
    cases = questions.select(F.col("query_id").alias("case_id"), "text", F.array_append(names, F.array(F.lit("Nobody"), F.lit("Person"))).alias("entities"), F.array(F.array(F.lit("Nobody"), F.lit("relates_to"), F.lit("Anybody"))).alias("triples"))
    rows = notebook(spark, sf_dir).eval_extraction(cases)
    return rows.select("kind", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _lines(spark: SparkSession, argv: list[str]) -> DataFrame:
    """What a command prints, a row for each line, and its exit code."""
    from loomgraph import cli

    with contextlib.redirect_stdout(io.StringIO()) as said:
        code = cli.run(spark, argv)
    return spark.createDataFrame([(code, line) for line in said.getvalue().splitlines()], "code int, line string")


STATS_SQL = f"""{GRAPH_SQL}, s AS (SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents UNION ALL SELECT 'entities', count(*) FROM ent UNION ALL SELECT 'relations', count(*) FROM rels
UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT doc_id, name FROM names) UNION ALL SELECT 'doc_links', 0 UNION ALL SELECT 'merges', 0 UNION ALL SELECT 'orphan_chunks', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM names) UNION ALL SELECT 'aliases', 0)"""


@query(f"WITH {STATS_SQL} SELECT 0 AS code, 'metric=' || metric || '  value=' || value AS line FROM s")
def cli_stats(spark, sf_dir):
    return _lines(spark, ["--store", notebook(spark, sf_dir).store.path, "--dim", "64", "stats"])


@query("WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9\\-]+')) AS token FROM documents) SELECT 0 AS code, 'chunk_tokens rebuilt: ' || count(*) || ' rows' AS line FROM t")
def cli_reindex(spark, sf_dir):
    return _lines(spark, ["--store", notebook(spark, sf_dir).store.path, "--dim", "64", "reindex"])


def _of_store(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").cast("long").alias("id"), F.round("score", 6).alias("score"), "rank")


@query(f"WITH {INDEX_SQL} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, rank::INTEGER AS rank FROM fr WHERE rank <= 6")
def pruned_search(spark, sf_dir):
    """Every question against the stored postings, frequent tokens looked up last."""
    return _of_store(retrieve.pruned_topk(_questions(spark, sf_dir), notebook(spark, sf_dir).store.table("chunk_tokens"), 6))


@query(f"WITH {INDEX_SQL}, {BM25_SQL} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, rank::INTEGER AS rank FROM br WHERE rank <= 6")
def keyword_search(spark, sf_dir):
    return _of_store(indexed(spark, sf_dir).keyword_search(_questions(spark, sf_dir), 6))


@query(f"WITH {MATCH_SQL} SELECT item_id AS query_id, name, score::BIGINT AS score, rank::INTEGER AS rank FROM ms WHERE rank <= 6")
def entity_search(spark, sf_dir):
    """Entities named in every question, by the stored index of their names and aliases."""
    store = notebook(spark, sf_dir).store
    return graph.match_entities(_questions(spark, sf_dir), store.table("entities"), 6, index=store.table("entity_tokens"))


@query("SELECT 64 AS embed_dim, count(*) AS n, max(length(coalesce(text, ''))) AS longest FROM documents")
def engine_dims(spark, sf_dir):
    engine = notebook(spark, sf_dir)
    found = engine.doctor()
    assert not found["dim_mismatch"] and found["indexed"]
    return engine.store.table("chunks").where(F.col("embed_dim").isin(found["embed_dims"])).groupBy("embed_dim").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("SELECT 'doc' || doc_id AS uri, lpad(doc_id::VARCHAR, 12, '0') AS id, source AS title, length(coalesce(text, '')) AS n, 1 AS version FROM documents SEMI JOIN (SELECT doc_id * 2 AS doc_id FROM documents) USING (doc_id)")
def uri_lookup(spark, sf_dir):
    """Every second uri is asked for twice, and as many that are not stored."""
    asked = _docs(spark, sf_dir).select(F.concat(F.lit("doc"), (F.col("doc_id") * 2).cast("string")).alias("uri"))
    found = notebook(spark, sf_dir).documents_by_uri(stacked(asked, asked))
    return found.select("uri", "id", "title", F.length("raw_text").cast("long").alias("n"), "version")


INGEST_SQL = f"""
nd AS (SELECT min(doc_id) AS doc_id FROM main.documents GROUP BY sha256({NORM})),
documents AS (SELECT doc_id, {NORM} AS text FROM main.documents SEMI JOIN nd USING (doc_id)), {NAMES_SQL}
SELECT 'documents_new' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'documents_duplicate', (SELECT count(*) FROM main.documents) - (SELECT count(*) FROM documents)
UNION ALL SELECT 'chunks_written', count(*) FROM documents WHERE text <> '' UNION ALL SELECT 'chunks_failed', 0 UNION ALL SELECT 'entities_extracted', count(*) FROM names UNION ALL SELECT 'relations_extracted', count(*) FROM names WHERE pos > 1
UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents WHERE text <> '' UNION ALL SELECT 'entities', count(DISTINCT name) FROM names UNION ALL SELECT 'relations', count(*) FROM rels UNION ALL SELECT 'mentions', count(*) FROM names
UNION ALL SELECT 'orphan_chunks', count(*) FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM names)"""


@query(f"WITH {INGEST_SQL}")
def engine_ingest(spark, sf_dir):
    from loomgraph.plans.engine import Engine

    engine = Engine(spark, "temporary", EngineConfig().with_(models={"dimensions": 16}, chunking={"characters": 1 << 30, "overlap": 0}))
    name = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    docs = _docs(spark, sf_dir).select(
        name.alias("id"), F.lit("web").alias("source_type"), F.concat(F.lit("doc"), name).alias("uri"), F.col("source").alias("title"), F.col("text").alias("raw_text"), F.current_timestamp().alias("created_at"),
        F.lit(None).cast("string").alias("content_hash"), F.lit(1).alias("version"), F.lit(1).alias("schema_version"), F.array().cast("array<string>").alias("links"), F.lit(None).cast("map<string,string>").alias("meta"),
    )
    report = engine.ingest(docs, resolve_after=False)
    told = report.unpivot([], ["documents_new", "documents_duplicate", "chunks_written", "chunks_failed", "entities_extracted", "relations_extracted"], "metric", "value")
    return stacked(told, engine.stats().where(F.col("metric").isin("documents", "chunks", "entities", "relations", "mentions", "orphan_chunks")))


@query("SELECT DISTINCT metric, 0::BIGINT AS value FROM (SELECT unnest(['documents', 'chunks', 'entities', 'relations', 'mentions', 'doc_links', 'merges', 'orphan_chunks', 'aliases']) AS metric) WHERE (SELECT count(*) FROM documents) > 0")
def engine_reset(spark, sf_dir):
    from loomgraph.plans.store import open_store

    store = open_store(spark, "temporary")
    store.commit({name: rows for name, rows in notebook(spark, sf_dir).store.tables().items()})
    assert store.table("chunks").take(1)
    store.clear()
    return store.stats()


@query("SELECT lang, source, count(*) AS count FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def key_violations(spark, sf_dir):
    return ingest.violations(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 ELSE doc_id END AS document_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS position FROM documents")
def upsert_chunks(spark, sf_dir):
    old = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("position"))
    return ingest.upsert(old, old.where("id % 3 = 0").withColumn("document_id", F.col("id") + 1).withColumn("position", F.lit(1)), ["id"])


@query(f"""WITH d AS (SELECT doc_id, {NORM} AS t FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'same' END AS outcome, t FROM d)
SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'same' AND t <> '') AS corrected FROM o GROUP BY 1""")
def span_backfill(spark, sf_dir):
    rows = checkpointed(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("uri"), F.lit("web").alias("source_type"), tx.normalize_text("text").alias("raw_text"), F.col("doc_id")))
    documents = rows.withColumn("content_hash", tx.content_hash("raw_text"))
    blank = F.lit(None).cast("struct<kind:string,start:int,end:int,label:string>")
    chunks = documents.where("raw_text <> ''").select(F.concat("id", F.lit(":0")).alias("id"), F.col("id").alias("document_id"), blank.alias("span"))
    reloaded = rows.where("doc_id % 5 <> 0").withColumn("raw_text", F.when(F.col("doc_id") % 5 == 1, F.concat("raw_text", F.lit(" more"))).otherwise(F.col("raw_text")))
    fixed, counts = ingest.backfill_spans(documents, chunks, reloaded, 1 << 30, 0)
    corrected = fixed.where("span IS NOT NULL").agg(F.count("*").alias("c"))
    return counts.join(corrected).select("outcome", "n", F.when(F.col("outcome") == "same", F.col("c")).otherwise(0).cast("long").alias("corrected"))


NEAR = "(levenshtein({0}, {1}) <= 2 OR 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1) >= 0.86)"


@query(f"""WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || (p_partkey % 10) AS c, lower(p_type) AS d FROM part),
m AS (SELECT {NEAR.format("a", "d")} OR {NEAR.format("c", "d")} AS ad FROM n), t AS (SELECT count(*) + count(*) FILTER (ad) AS tp, count(*) AS fp, count(*) FILTER (NOT ad) AS fn FROM m)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t""")
def engine_resolution(spark, sf_dir):
    """Every part is a case of four names: its own, that in capitals, that with a digit behind, and its type."""
    part = table(spark, sf_dir, "part").where("p_name IS NOT NULL")
    other = F.concat("p_name", (F.col("p_partkey") % 10).cast("string"))
    both = lambda *names: F.array(*[F.array(x, F.lit("Concept")) for x in names])
    cases = part.select(
        F.col("p_partkey").alias("case_id"), both(F.col("p_name"), F.upper("p_name"), other, F.col("p_type")).alias("entities"),
        F.array(F.array("p_name", F.upper("p_name")), F.array("p_name", "p_type")).alias("should_merge"), F.array(F.array(F.col("p_name"), other)).alias("should_not_merge"),
    )
    found = notebook(spark, sf_dir).eval_resolution(cases)
    return found.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH s AS (SELECT item_id, text AS query_text FROM benchmark WHERE text IS NOT NULL AND length(text) > 0), p AS (SELECT item_id, query_text, CASE WHEN item_id % 2 = 0 THEN 'Yes, ' ELSE 'no ' END || item_id AS said FROM s)
SELECT item_id, said LIKE 'Yes%' AS same FROM p""")
def model_verdicts(spark, sf_dir):
    """What a model's words for a pair of names count as."""

    class Told:
        model = "told"

        def complete(self, prompt, system=None):
            n = int(prompt.rpartition(" ")[2])
            return ("Yes, " if n % 2 == 0 else "no ") + str(n)

    from loomgraph.plans.engine import Engine

    engine = Engine(spark, "temporary", EngineConfig().with_(models={"dimensions": 64}))
    engine.model = Told()
    pairs = table(spark, sf_dir, "benchmark").where("text IS NOT NULL AND text <> ''").select("item_id", F.col("text").alias("a_name"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("b_name"))
    return engine._settled(pairs).select("item_id", "same")
