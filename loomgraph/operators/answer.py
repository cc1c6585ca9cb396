"""Answer prompts, offline answers and citations for batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import col

TASK = "Answer from the passages and relations given here and from nothing else."
HEAD = "The passages found and the relations between them bear on the question; see "


def bundles(queries: DataFrame, hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per query: chunks in order, sorted edges and sorted entities, empty where there are none.

    hits: query_id, rank, id, title, uri, citation, chunk_text, score, via; edges and nodes as graph.expand gives them.
    """
    item = F.struct("rank", "id", "title", "uri", "citation", F.col("chunk_text").alias("text"), "score", "via")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    h = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    e = edges.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("subject", "relation", "object"))).alias("edges"))
    n = nodes.groupBy("query_id").agg(F.array_sort(F.collect_set("node")).alias("entities"))
    rows = queries.select("query_id", "text").join(h, "query_id", "left").join(e, "query_id", "left").join(n, "query_id", "left")
    kinds = {c: f.simpleString() for c, f in ((x, rows.schema[x].dataType) for x in ("chunks", "edges", "entities"))}
    return rows.select("query_id", "text", *[empty(c, k) for c, k in kinds.items()])


def answer_prompt(question: Column | str, chunks: Column | str, edges: Column | str, limit: int = 40) -> Column:
    question, chunks, edges = col(question), col(chunks), col(edges)
    block = lambda c: F.concat(F.lit("["), c["rank"].cast("string"), F.lit("] "), c["title"], F.lit(" ("), c["citation"], F.lit("):\n"), c["text"])
    sources = F.when(F.size(chunks) > 0, F.array_join(F.transform(chunks, block), "\n\n")).otherwise("(no passages)")
    line = lambda e: F.concat(e["subject"], F.lit(" -["), e["relation"], F.lit("]-> "), e["object"])
    graph = F.when(F.size(edges) > 0, F.array_join(F.transform(F.slice(edges, 1, limit), line), "\n")).otherwise("(no relations)")
    return F.concat(
        F.lit(TASK + "\n\nQuestion: "), question, F.lit("\n\nPassages:\n"), sources,
        F.lit("\n\nRelations:\n"), graph,
        F.lit("\n\nBe brief. Put the number of each passage used in brackets, and say how the relations connect them."),
    )


def markers(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"\[(\d+)\]"), F.lit(1)))


def offline_answer(prompt: Column | str) -> Column:
    """The offline provider: cites the first three distinct markers of the prompt, by number."""
    numbers = F.slice(F.array_sort(F.transform(markers(prompt), lambda m: m.cast("decimal(38,0)"))), 1, 3)
    cited = F.array_join(F.transform(numbers, lambda m: F.concat(F.lit("["), m.cast("string"), F.lit("]"))), " ")
    return F.concat(F.lit(HEAD), F.when(F.size(numbers) > 0, cited).otherwise("[1]"), F.lit("."))


def cited(text: Column | str, chunks: Column | str) -> tuple[Column, Column]:
    """The chunks that the text cites (all of them if it cites none of them), and whether it cites nothing at all."""
    text, chunks = col(text), col(chunks)
    used = markers(text)
    kept = F.filter(chunks, lambda c: F.array_contains(used, c["rank"].cast("string")))
    return F.when(F.size(kept) > 0, kept).otherwise(chunks), (F.size(used) == 0) & (F.size(chunks) > 0)


def synthesize(bundle: DataFrame, answer: Column | None = None, limit: int = 40) -> DataFrame:
    """bundles with prompt, answer, citations and uncited; answer: an expression over `prompt`, the offline one by default."""
    rows = bundle.withColumn("prompt", answer_prompt("text", "chunks", "edges", limit))
    rows = rows.withColumn("answer", offline_answer("prompt") if answer is None else answer)
    kept, uncited = cited("answer", "chunks")
    citation = lambda c: F.struct(F.concat(F.lit("["), c["rank"].cast("string"), F.lit("]")).alias("marker"), c["title"].alias("title"), c["uri"].alias("uri"), c["citation"].alias("span"))
    return rows.withColumn("citations", F.transform(kept, citation)).withColumn("uncited", uncited)
