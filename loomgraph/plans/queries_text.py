"""Queries over texts: sources, normalising, de-duplication, chunking, scalar functions, keyword search.

Each entry is a function of (spark, sf_dir) and, where SQL can say it, the same in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.frames import spread, stacked
from loomgraph.functions import text as tx
from loomgraph.functions import vectors as vx
from loomgraph.operators import chunking, evaluate, extract, ingest, retrieve
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(text, '')), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '[ \t\f\v]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9\-]+')"


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))


@query(f"SELECT doc_id, {NORM} AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalize_text("text").alias("normal"))


@query(f"SELECT doc_id, sha256({NORM}) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.content_hash(tx.normalize_text("text")).alias("content_hash"))


@query(f"SELECT sha256({NORM}) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", tx.content_hash(tx.normalize_text("text")).alias("content_hash"), F.col("doc_id").alias("ord"))
    return ingest.first_per_hash(rows, "content_hash", "ord").select("content_hash", "doc_id")


def _statuses(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/"), (F.floor(F.col("doc_id") / 2) % 600).cast("string")).alias("uri"),
        tx.content_hash(tx.normalize_text("text")).alias("content_hash"), F.lit(1).alias("version"), F.col("doc_id").alias("ord"),
    )
    even = rows.where("ord % 2 = 0")
    stored = ingest.first_per_hash(even, "content_hash", "ord")
    stored = stored.groupBy("uri").agg(F.min_by(F.struct("id", "content_hash", "version"), "ord").alias("r")).select("uri", "r.*")
    return ingest.dedupe_status(rows.where("ord % 2 = 1").drop("version"), stored, "ord")


STATUS_SQL = f"""
WITH r AS (SELECT doc_id, source || '/' || ((doc_id // 2) % 600) AS uri, sha256({NORM}) AS h FROM documents),
firsts AS (SELECT h, min(doc_id) AS doc_id, arg_min(uri, doc_id) AS uri FROM r WHERE doc_id % 2 = 0 GROUP BY h),
stored AS (SELECT uri, min(doc_id) AS doc_id, arg_min(h, doc_id) AS h FROM firsts GROUP BY uri),
inc AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM r WHERE doc_id % 2 = 1),
dup AS (SELECT inc.*, (nth > 1 OR inc.h IN (SELECT h FROM stored)) AS d, s.doc_id AS old FROM inc LEFT JOIN stored s ON inc.uri = s.uri),
step AS (SELECT *, row_number() OVER (PARTITION BY uri, d ORDER BY doc_id) AS step, first_value(doc_id) OVER (PARTITION BY uri, d ORDER BY doc_id) AS f FROM dup),
status AS (SELECT doc_id AS ord, CASE WHEN d THEN 'duplicate' WHEN old IS NOT NULL OR step > 1 THEN 'updated' ELSE 'new' END AS status, old, f, step, uri FROM step),
final AS (SELECT ord, uri, status, CASE WHEN status = 'updated' THEN coalesce(old, f) ELSE ord END::VARCHAR AS id,
  (CASE WHEN status = 'duplicate' THEN 1 ELSE (CASE WHEN old IS NULL THEN 0 ELSE 1 END) + step END)::INTEGER AS version FROM status)
"""


@query(STATUS_SQL + "SELECT ord, uri, status, id, version FROM final")
def dedupe_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("ord", "uri", "status", "id", "version")


@query(STATUS_SQL + "SELECT count(*) AS documents_seen, count(*) FILTER (status = 'new') AS documents_new, count(*) FILTER (status = 'updated') AS documents_updated, count(*) FILTER (status = 'duplicate') AS documents_duplicate FROM final")
def ingest_report(spark, sf_dir):
    return ingest.ingest_report(_statuses(spark, sf_dir))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize(spark, sf_dir):
    t = tx.tokens("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


INDEX_SQL = f"""
d AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token FROM documents),
q AS (SELECT item_id, unnest(t) AS token, len(t) AS n FROM (SELECT item_id, list_distinct({TOKENS}) AS t FROM benchmark)),
ft AS (SELECT q.item_id, d.doc_id, count(*) / max(n) AS score FROM q JOIN d USING (token) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ft)
"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def _rows(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {INDEX_SQL} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, rank::INTEGER AS rank FROM fr WHERE rank <= 6")
def fulltext_topk(spark, sf_dir):
    hits = retrieve.fulltext_topk(_questions(spark, sf_dir), retrieve.token_table(_rows(spark, sf_dir)), 6)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


BM25_SQL = f"""
a AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents),
tf AS (SELECT doc_id, token, count(*) AS tf FROM a GROUP BY 1, 2),
ln AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1),
ov AS (SELECT count(*) AS n, avg(len) AS mean FROM ln),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT q.item_id, tf.doc_id, sum(ln(1 + (ov.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * ln.len / ov.mean))) AS score
  FROM (SELECT DISTINCT item_id, token FROM q) q JOIN df USING (token) JOIN tf USING (token) JOIN ln USING (doc_id) CROSS JOIN ov GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)
"""


def _bm25(spark, sf_dir, k):
    return retrieve.bm25_topk(_questions(spark, sf_dir), _rows(spark, sf_dir), k)


@query(f"WITH {INDEX_SQL}, {BM25_SQL} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, rank::INTEGER AS rank FROM br WHERE rank <= 6")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 6).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {INDEX_SQL}, {BM25_SQL},
u AS (SELECT item_id, doc_id, rank, 'fulltext' AS via FROM fr WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, rank, 'bm25' FROM br WHERE rank <= 10),
f AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, array_to_string(list_sort(list(DISTINCT via)), '+') AS via FROM u GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f)
SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, via, rank::INTEGER AS rank FROM g WHERE rank <= 10""")
def rrf_fuse(spark, sf_dir):
    hits = retrieve.rrf_fuse(retrieve.lexical_topk(_questions(spark, sf_dir), _rows(spark, sf_dir), 10), 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "via", "rank")


@query(f"""WITH {INDEX_SQL}, {BM25_SQL},
u AS (SELECT item_id, doc_id, score, 0 AS place, 'fulltext' AS via FROM fr WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, score, 1, 'bm25' FROM br WHERE rank <= 10)
SELECT item_id AS query_id, doc_id AS id, first(via ORDER BY score DESC, place) AS best, round(max(score), 6) AS raw FROM u GROUP BY 1, 2""")
def fused_representative(spark, sf_dir):
    """The row that stands for each hit of the fused lists."""
    hits = retrieve.rrf_fuse(retrieve.lexical_topk(_questions(spark, sf_dir), _rows(spark, sf_dir), 10), 20)
    return hits.select("query_id", "id", "best", F.round("raw", 6).alias("raw"))


EMBED_SQL = """
SELECT {key}, i::INTEGER AS i, coalesce(v, 0) / (CASE WHEN l IS NULL OR l = 0 THEN 1 ELSE l END) AS x
FROM (SELECT k.{key}, r.i, s.v, sqrt(sum(s.v * s.v) OVER (PARTITION BY k.{key})) AS l
  FROM (SELECT {key} FROM {t}) k CROSS JOIN (SELECT unnest(range(64)) AS i) r
  LEFT JOIN (SELECT {key}, ('0x' || right(md5(token), 4))::INTEGER % 64 AS i, sum(CASE WHEN (('0x' || right(md5(token), 4))::INTEGER >> 8) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v
    FROM (SELECT {key}, unnest(""" + TOKENS.replace("{", "{{").replace("}", "}}") + """) AS token FROM {t}) GROUP BY 1, 2) s ON s.{key} = k.{key} AND s.i = r.i)
"""


@query("SELECT doc_id, i, round(x, 6) + 0 AS x FROM (" + EMBED_SQL.format(key="doc_id", t="documents") + ")")
def hash_embed(spark, sf_dir):
    rows = vx.hash_embed(_docs(spark, sf_dir), "doc_id", "text", 64)
    return rows.select("doc_id", F.posexplode("embedding").alias("i", "x")).select("doc_id", "i", (F.round("x", 6) + 0.0).alias("x"))


HYBRID_SQL = f"""
de AS (SELECT doc_id, list(x ORDER BY i) AS v FROM ({EMBED_SQL.format(key="doc_id", t="documents")}) GROUP BY 1),
qe AS (SELECT item_id, list(x ORDER BY i) AS v FROM ({EMBED_SQL.format(key="item_id", t="benchmark")}) GROUP BY 1),
vs AS (SELECT item_id, doc_id, round(list_dot_product(qe.v, de.v), 9) + 0 AS score FROM qe CROSS JOIN de),
vr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM vs),
hu AS (SELECT item_id, doc_id, rank, 'vector' AS via FROM vr WHERE rank <= 6 UNION ALL SELECT item_id, doc_id, rank, 'fulltext' FROM fr WHERE rank <= 6),
hf AS (SELECT item_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, array_to_string(list_sort(list(DISTINCT via)), '+') AS via FROM hu GROUP BY 1, 2),
hy AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM hf)
"""


def hybrid(spark, sf_dir, k=6):
    questions, rows = _questions(spark, sf_dir), _rows(spark, sf_dir)
    vectors = vx.hash_embed(questions, "query_id", "text", 64).withColumnRenamed("embedding", "vector")
    by_vector = retrieve.vector_topk(vectors, vx.hash_embed(rows, "id", "text", 64), k)
    return retrieve.rrf_fuse({"vector": by_vector, "fulltext": retrieve.fulltext_topk(questions, retrieve.token_table(rows), k)}, k)


@query(f"WITH {INDEX_SQL}, {HYBRID_SQL} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS score, via, rank::INTEGER AS rank FROM hy WHERE rank <= 6")
def hybrid_search(spark, sf_dir):
    return hybrid(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"), "via", "rank")


TERMS = r"list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9\-]+'), lambda x: length(x) >= 3))"


@query(f"""WITH {INDEX_SQL}, h AS (SELECT item_id, doc_id FROM fr WHERE rank <= 6),
t AS (SELECT item_id, h.doc_id, {TERMS.format("b.text")} AS q, {TERMS.format("d.text")} AS w FROM h JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = h.doc_id)
SELECT item_id AS query_id, doc_id AS id, (CASE WHEN len(q) = 0 THEN 0 ELSE len(list_filter(q, lambda x: len(list_filter(w, lambda y: contains(y, x) OR contains(x, y))) > 0)) END)::INTEGER AS hits, len(q)::INTEGER AS n_terms FROM t""")
def title_boost(spark, sf_dir):
    hits = retrieve.fulltext_topk(_questions(spark, sf_dir), retrieve.token_table(_rows(spark, sf_dir)), 6)
    rows = hits.join(_questions(spark, sf_dir).withColumnRenamed("text", "query"), "query_id").join(_rows(spark, sf_dir), "id")
    q = tx.terms("query")
    return rows.select("query_id", "id", tx.fuzzy_overlap(q, tx.terms("text")).alias("hits"), F.size(q).alias("n_terms"))


TRANSCRIPT_SQL = r"""
lines AS (SELECT conv_id, unnest(regexp_split_to_array(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text), '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text), '\r\n|\r|\n'), 1) AS pos FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM lines),
m AS (SELECT *, regexp_matches(line, '^(?:\[([^\]]+)\]\s*)?([A-Za-z0-9 _.-]{1,40}):\s*(.*)$') AS opens FROM s),
g AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY conv_id ORDER BY pos) AS turn FROM m),
t AS (SELECT conv_id, turn, trim(max(CASE WHEN opens THEN regexp_extract(line, '^(?:\[([^\]]+)\]\s*)?([A-Za-z0-9 _.-]{1,40}):\s*(.*)$', 2) END)) AS speaker,
  regexp_replace(string_agg(CASE WHEN opens THEN trim(regexp_extract(line, '^(?:\[([^\]]+)\]\s*)?([A-Za-z0-9 _.-]{1,40}):\s*(.*)$', 3)) ELSE line END, ' ' ORDER BY pos) FILTER (opens OR line <> ''), '^\s+|\s+$', '', 'g') AS body
  FROM g WHERE turn > 0 GROUP BY 1, 2)
"""


def _transcripts(spark, sf_dir):
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text", line.alias("line")).alias("s"))
    joined = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n").alias("text"))
    marked, n = loaders.transcript("text")
    return joined.select("conv_id", marked.alias("raw_text"), n.cast("long").alias("n_turns"))


@query(f"WITH {TRANSCRIPT_SQL} SELECT conv_id, string_agg('[[TURN ' || turn || ']] ' || speaker || ': ' || body, chr(10) ORDER BY turn) AS raw_text, count(*) AS n_turns FROM t GROUP BY conv_id")
def transcript_turns(spark, sf_dir):
    return _transcripts(spark, sf_dir)


WINDOWS_SQL = r"""
pieces AS (SELECT k, seg, regexp_replace(body, '^\s+|\s+$', '', 'g') AS body FROM segs),
small AS (SELECT k, seg, 1 AS win, body AS text FROM pieces WHERE length(body) <= {size}),
sent AS (SELECT k, seg, string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM pieces WHERE length(body) > {size}),
fold AS (
  SELECT k, seg, s, 1 AS i, s[1] AS buf, NULL::VARCHAR AS out, 0 AS win FROM sent
  UNION ALL
  SELECT k, seg, s, i + 1,
    CASE WHEN i + 1 > len(s) THEN NULL WHEN length(buf) + length(s[i + 1]) + 1 > {size} THEN trim(right(buf, {overlap}) || ' ' || s[i + 1], ' ' || chr(10) || chr(9) || chr(13)) ELSE trim(buf || ' ' || s[i + 1], ' ' || chr(10) || chr(9) || chr(13)) END,
    CASE WHEN i + 1 > len(s) OR length(buf) + length(s[i + 1]) + 1 > {size} THEN buf END,
    win + (CASE WHEN i + 1 > len(s) OR length(buf) + length(s[i + 1]) + 1 > {size} THEN 1 ELSE 0 END)
  FROM fold WHERE i <= len(s)),
wins AS (SELECT * FROM small UNION ALL SELECT k, seg, win, out FROM fold WHERE out IS NOT NULL),
chunks AS (SELECT k, seg, row_number() OVER (PARTITION BY k ORDER BY seg, win) - 1 AS position, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM wins WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '')
"""


@query(f"WITH RECURSIVE segs AS (SELECT doc_id AS k, 1 AS seg, {NORM} AS body FROM documents), {WINDOWS_SQL.format(size=900, overlap=120)} SELECT k AS doc_id, position::INTEGER AS position, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM chunks")
def chunk_windows(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", tx.normalize_text("text").alias("text"))
    wins = F.filter(F.transform(chunking.windows("text", 900, 120), lambda w: tx.strip(w["text"])), lambda t: t != "")
    return rows.select("doc_id", F.posexplode(wins).alias("position", "w")).select("doc_id", "position", F.length("w").alias("n_chars"), F.md5(F.col("w").cast("binary")).alias("digest"))


@query(f"WITH RECURSIVE {TRANSCRIPT_SQL}, segs AS (SELECT conv_id AS k, turn AS seg, speaker || ': ' || body AS body FROM t), {WINDOWS_SQL.format(size=300, overlap=40)} SELECT k || ':' || position AS id, k AS conv_id, position::INTEGER AS position, seg::INTEGER AS turn, speaker AS label, text FROM chunks JOIN t ON t.conv_id = k AND t.turn = seg")
def chunk_positions(spark, sf_dir):
    docs = _transcripts(spark, sf_dir).select(F.col("conv_id").alias("id"), F.lit("transcript").alias("source_type"), "raw_text")
    rows = chunking.chunk_documents(docs, 300, 40)
    return rows.select("id", F.col("document_id").cast("long").alias("conv_id"), "position", F.col("span.start").alias("turn"), F.col("span.label").alias("label"), "text")


HEADED_SQL = f"""
l AS (SELECT doc_id, unnest(string_split({NORM}, chr(10))) AS line, generate_subscripts(string_split({NORM}, chr(10)), 1) AS n FROM documents),
h AS (SELECT doc_id, n, CASE WHEN n % 3 = 0 THEN '## ' || line ELSE line END AS line FROM l),
b AS (SELECT *, regexp_matches(line, '^#{{1,6}}[ \\t]') AS opens FROM h),
s AS (SELECT *, sum((opens OR n = 1)::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM b)
"""


def _headed(spark, sf_dir):
    lines = F.split(tx.normalize_text("text"), "\n")
    headed = F.array_join(F.transform(lines, lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x)), "\n")
    return _docs(spark, sf_dir).select("doc_id", "source", "lang", headed.alias("text"))


@query(f"WITH {HEADED_SQL} SELECT doc_id, sec::INTEGER AS section, min(n)::INTEGER AS start_line, max(CASE WHEN opens THEN trim(regexp_replace(line, '^#{{1,6}}[ \\t]', '')) END) AS label, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM s GROUP BY doc_id, sec")
def md_sections(spark, sf_dir):
    rows = _headed(spark, sf_dir).select("doc_id", F.posexplode(chunking.sections("text")).alias("p", "s"))
    return rows.select("doc_id", (F.col("p") + 1).alias("section"), F.col("s.start").alias("start_line"), F.col("s.label").alias("label"), F.md5(F.col("s.text").cast("binary")).alias("digest"))


LINKED = "text || ' [[' || source || '|' || lang || ']] [x](' || lang || '.md) and [y](#part) [z](http://' || source || '.org) [[' || lang || ']]'"


@query(f"""WITH t AS (SELECT doc_id, {LINKED} AS text FROM documents),
l AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1)) AS link FROM t UNION SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[[^\\]]+\\]\\(([^)]+)\\)', 1)) AS link FROM t) WHERE NOT starts_with(link, '#'))
SELECT doc_id, string_agg(link, ',' ORDER BY link) AS links FROM l GROUP BY doc_id""")
def md_links(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(tx.markdown_links(F.expr(LINKED)), ",").alias("links"))


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest([source, lang || '.md', 'doc' || (doc_id + 1)]) AS dst_uri FROM documents),
n AS (SELECT 'doc' || doc_id AS u, doc_id FROM documents UNION ALL SELECT source, doc_id FROM documents), g AS (SELECT u, min(doc_id) AS target_id FROM n GROUP BY u)
SELECT doc_id AS document_id, dst_uri, target_id FROM t LEFT JOIN g ON g.u = dst_uri""")
def doc_links(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    links = docs.select(F.col("doc_id").alias("document_id"), F.explode(F.array("source", F.concat("lang", F.lit(".md")), F.concat(F.lit("doc"), (F.col("doc_id") + 1).cast("string")))).alias("dst_uri"))
    return ingest.resolved_links(links, docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("uri"), F.col("source").alias("title"), F.col("doc_id").alias("id")))


@query()
def web_docs(spark, sf_dir):
    rows = loaders.load_web(spread(table(spark, sf_dir, "pages")))
    return rows.select("uri", "title", F.length("raw_text").alias("n_chars"), F.md5(F.col("raw_text").cast("binary")).alias("digest"), F.size("links").alias("n_links"))


# a word with a letter beyond ASCII can never match: DuckDB's \b knows ASCII only, so such words are masked first
NAMES_SQL = r"""
c AS (SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[0-9A-Za-z_]*(?:[ªµºÀ-ÖØ-öø-˿Ͱ-῿][0-9A-Za-z_]*)+', 'x', 'g'), '\b([A-Z][A-Za-z0-9]+(?:\s[A-Z][A-Za-z0-9]+)?)\b', 1) AS a FROM documents),
e AS (SELECT doc_id, unnest(a) AS name, generate_subscripts(a, 1) AS p FROM c),
f AS (SELECT doc_id, name, min(p) AS p FROM e WHERE lower(name) NOT IN ('the', 'this', 'a', 'an') GROUP BY 1, 2),
k AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS pos FROM f),
names AS (SELECT doc_id, name, pos FROM k WHERE pos <= 6),
rels AS (SELECT DISTINCT a.name AS subject, 'RELATES_TO' AS relation, b.name AS object FROM names a JOIN names b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1)
"""


def extracted(spark, sf_dir):
    """documents as chunks with their extraction."""
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), extract.heuristic_extraction("text").alias("extraction"))


@query(f"WITH {NAMES_SQL} SELECT doc_id, pos::INTEGER AS pos, name FROM names")
def kg_extract(spark, sf_dir):
    rows = extracted(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode("extraction.entities").alias("p", "e"))
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), F.col("e.name").alias("name"))


@query(f"WITH {NAMES_SQL} SELECT subject, relation, object FROM rels")
def kg_relations(spark, sf_dir):
    return extract.graph_rows(extracted(spark, sf_dir))[2]


@query(f"WITH {NAMES_SQL} SELECT name AS entity, count(*) AS mention_count, count(DISTINCT doc_id) AS n_chunks FROM names GROUP BY name")
def mention_counts(spark, sf_dir):
    return ingest.mention_counts(extract.graph_rows(extracted(spark, sf_dir))[1])


@query(f"""WITH {NAMES_SQL}, r AS (SELECT name, doc_id, pos, 'al' || (doc_id % 7) AS alias, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 's' || doc_id END AS summary FROM names),
a AS (SELECT name, alias, min(doc_id * 10 + pos) AS o FROM r GROUP BY 1, 2), g AS (SELECT name, string_agg(alias, ',' ORDER BY o) AS aliases FROM a GROUP BY 1)
SELECT name, 'Concept' AS label, aliases, coalesce(s, '') AS summary, first_doc FROM g JOIN (SELECT name, arg_min(summary, doc_id * 10 + pos) FILTER (summary <> '') AS s, min(doc_id) AS first_doc FROM r GROUP BY name) USING (name)""")
def entity_upsert(spark, sf_dir):
    rows, _, _ = extract.graph_rows(extracted(spark, sf_dir))
    doc = F.col("ord")["_o"]
    rows = rows.withColumn("aliases", F.array(F.concat(F.lit("al"), (doc % 7).cast("string")))).withColumn("summary", F.when(doc % 3 == 0, "").otherwise(F.concat(F.lit("s"), doc.cast("string"))))
    return ingest.upsert_entities(rows).select("name", "label", F.array_join("aliases", ",").alias("aliases"), "summary", F.col("ord")["_o"].alias("first_doc"))


LABELS = ["software", "LIBRARY", "Company", "tool", "person", "Idea", "location", "weird", "Topic", " event "]


@query(f"""WITH r AS (SELECT p_partkey, {LABELS}[(p_partkey % 10) + 1] AS raw FROM part), c AS (SELECT p_partkey, raw, upper(left(trim(raw), 1)) || lower(substr(trim(raw), 2)) AS l FROM r),
m AS (SELECT p_partkey, raw, CASE WHEN l IN ('Software', 'Library', 'Product', 'Framework') THEN 'Tool' WHEN l IN ('Organization', 'Company') THEN 'Org' WHEN l = 'Subject' THEN 'Topic' WHEN l = 'Idea' THEN 'Concept' WHEN l = 'Location' THEN 'Place' ELSE l END AS l FROM c)
SELECT p_partkey, raw, CASE WHEN l IN ('Concept', 'Tool', 'Person', 'Org', 'Topic', 'Event', 'Place') THEN l ELSE 'Concept' END AS label FROM m""")
def normalize_label(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(x) for x in LABELS]), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), tx.normalize_label(raw).alias("label"))


CONTENT = TERMS.replace("length(x) >= 3", "length(x) >= 3 AND x NOT IN (" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + ")")


@query(f"""WITH {INDEX_SQL}, t AS (SELECT item_id, fr.doc_id, {CONTENT.format("d.text")} AS x, {CONTENT.format("b.text")} AS y FROM fr JOIN documents d ON d.doc_id = fr.doc_id JOIN benchmark b USING (item_id) WHERE rank <= 3),
c AS (SELECT item_id, doc_id, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS b FROM t)
SELECT item_id AS query_id, doc_id AS id, round(CASE WHEN nx = 0 AND ny = 0 THEN 1.0 WHEN b = 0 THEN 0.0 ELSE 2.0 * b / (nx + ny) END, 6)::DOUBLE AS f1 FROM c""")
def lexical_f1(spark, sf_dir):
    hits = retrieve.fulltext_topk(_questions(spark, sf_dir), retrieve.token_table(_rows(spark, sf_dir)), 3)
    rows = hits.join(_questions(spark, sf_dir).withColumnRenamed("text", "query"), "query_id").join(_rows(spark, sf_dir), "id")
    return rows.select("query_id", "id", F.round(tx.lexical_f1("text", "query"), 6).alias("f1"))


@query(f"""WITH {INDEX_SQL}, h AS (SELECT item_id, doc_id FROM fr WHERE rank <= 3), s AS (SELECT item_id, doc_id, lower(coalesce(d.text, '')) AS a, string_split(coalesce(b.text, ''), '. ') AS facts FROM h JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
x AS (SELECT item_id, doc_id, a, unnest(facts) AS fact FROM s), y AS (SELECT item_id, doc_id, a, {CONTENT.format("fact")} AS w FROM x)
SELECT item_id AS query_id, doc_id AS id, round(count(*) FILTER (len(w) > 0 AND len(list_filter(w, lambda z: contains(a, z))) / len(w) >= 0.6) / count(*), 6) AS recall FROM y GROUP BY 1, 2""")
def key_fact_recall(spark, sf_dir):
    hits = retrieve.fulltext_topk(_questions(spark, sf_dir), retrieve.token_table(_rows(spark, sf_dir)), 3)
    rows = hits.join(_questions(spark, sf_dir).withColumnRenamed("text", "query"), "query_id").join(_rows(spark, sf_dir), "id")
    return rows.select("query_id", "id", F.round(tx.key_fact_recall("text", F.split("query", r"\. ")), 6).alias("recall"))


@query(f"""WITH {INDEX_SQL}, h AS (SELECT item_id, doc_id FROM fr WHERE rank = 1), s AS (SELECT item_id, {CONTENT.format("d.text")} AS x, {CONTENT.format("b.text")} AS y, lower(coalesce(d.text, '')) AS a, item_id % 3 AS n FROM h JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
m AS (SELECT item_id, n, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(list_intersect(x, y)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END::DOUBLE AS f1, (CASE WHEN len(y) > 0 AND len(list_filter(y, lambda z: contains(a, z))) / len(y) >= 0.6 THEN 1.0 ELSE 0.0 END)::DOUBLE AS kfr FROM s)
SELECT item_id AS query_id, round(f1, 6) AS lexical_f1, kfr AS key_fact_recall, round(5 * (0.5 * f1 + 0.5 * kfr), 2) AS judge_complete, n > 0 AS grounded FROM m""")
def answer_eval(spark, sf_dir):
    hits = retrieve.fulltext_topk(_questions(spark, sf_dir), retrieve.token_table(_rows(spark, sf_dir)), 1)
    rows = hits.join(_questions(spark, sf_dir).withColumnRenamed("text", "expected"), "query_id").join(_rows(spark, sf_dir).withColumnRenamed("text", "generated"), "id")
    rows = rows.select("query_id", "generated", "expected", F.array("expected").alias("key_facts"), (F.col("query_id") % 3).alias("n_citations"), F.lit(False).alias("uncited"))
    return evaluate.grade_answers(rows).select("query_id", F.round("lexical_f1", 6).alias("lexical_f1"), "key_fact_recall", "judge_complete", "grounded")


# answers of a model as text: a list, prose with numbers, nothing, a broken list, a list with a sign
RAW_ORDER = """CASE item_id % 5 WHEN 0 THEN '[' || (item_id % 7) || ', 1, "2", "x", ' || item_id || ']' WHEN 1 THEN 'best is ' || item_id || ' then 3, 1 and 4' WHEN 2 THEN text WHEN 3 THEN '[' || item_id || ',' ELSE '  [ -1, ' || (item_id % 9) || ' ] ok' END"""


@query(f"""WITH r AS (SELECT item_id, trim({RAW_ORDER}) AS raw FROM benchmark), l AS (SELECT *, regexp_extract(raw, '\\[.*\\]', 0, 's') AS listed FROM r),
p AS (SELECT item_id, CASE WHEN json_valid(listed) AND listed <> '' THEN list_filter(list_transform(from_json(listed, '["VARCHAR"]'), lambda x: trim(x)), lambda x: regexp_full_match(x, '-*\\d+')) ELSE list_slice(regexp_extract_all(raw, '\\d+'), 1, 3) END AS n FROM l)
SELECT item_id AS query_id, coalesce(array_to_string(list_transform(n, lambda x: x::INTEGER), ','), '') AS parsed FROM p""")
def rerank_parse(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tx.parse_order(F.expr(RAW_ORDER), 3), ",").alias("parsed"))


RAW_TERMS = "'- en word,' || chr(10) || '* Graph; graph, ' || left(text, 5) || ',  ' || 'Q' || left(text, 4) || ', extra ' || (item_id % 3) || ';' || chr(10) || 'EXTRA ' || (item_id % 3)"


@query(f"""WITH a AS (SELECT item_id, text, unnest(regexp_split_to_array({RAW_TERMS}, '[,;\n]+')) AS x, generate_subscripts(regexp_split_to_array({RAW_TERMS}, '[,;\n]+'), 1) AS p FROM benchmark),
t AS (SELECT item_id, text, p, trim(regexp_replace(trim(x), '^[-•*"'']+|[-•*"'']+$', '', 'g')) AS x FROM a),
f AS (SELECT item_id, arg_min(x, p) AS x, min(p) AS p FROM t WHERE x <> '' AND NOT contains(lower(text), lower(x)) GROUP BY item_id, lower(x)),
k AS (SELECT item_id, x, row_number() OVER (PARTITION BY item_id ORDER BY p) AS n FROM f)
SELECT b.item_id AS query_id, coalesce(string_agg(x, ' ' ORDER BY n) FILTER (n <= 6), '') AS added FROM benchmark b LEFT JOIN k USING (item_id) GROUP BY 1""")
def expansion_terms(spark, sf_dir):
    answer = F.expr(RAW_TERMS.replace("chr(10)", "'\\n'"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(tx.expansion_terms("text", answer, 6), " ").alias("added"))


@query("""WITH c AS (SELECT doc_id, doc_id % 5 AS m FROM documents), n AS (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))
SELECT d.doc_id AS id, CASE WHEN d.source IN ('src1', 'src2') THEN 2 ELSE 1 END::INTEGER AS version FROM documents d""")
def upsert_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", F.lit(1).alias("version"))
    changed = docs.where(F.col("source").isin("src1", "src2")).withColumn("version", F.lit(2))
    return ingest.upsert(docs, changed, ["id"]).select("id", "version")


@query(f"""WITH {NAMES_SQL}, gone AS (SELECT doc_id FROM documents WHERE lang = 'fr')
SELECT 'chunks' AS kind, count(*) AS n FROM documents WHERE lang <> 'fr' OR lang IS NULL UNION ALL SELECT 'mentions', count(*) FROM (SELECT DISTINCT doc_id, name FROM names WHERE doc_id NOT IN (SELECT doc_id FROM gone))""")
def delete_chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"))
    mentions = extract.graph_rows(extracted(spark, sf_dir))[1].distinct()
    left, kept = ingest.delete_chunks(chunks, mentions, docs.where("lang = 'fr'").select(F.col("doc_id").alias("id")))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return stacked(count(left, "chunks"), count(kept, "mentions"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    from loomgraph.streaming.ingest import run_event_windows

    return run_event_windows(spark, f"{sf_dir}/events.parquet").select("event_type", "hour", "n", F.round("total", 4).alias("total"))


@query(f"SELECT sha256({NORM}) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def stream_ingest(spark, sf_dir):
    from loomgraph.streaming.ingest import run_first_seen

    return run_first_seen(spark, f"{sf_dir}/documents.parquet")

