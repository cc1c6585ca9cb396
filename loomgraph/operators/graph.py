"""Reads of the graph: entities of chunks, fuzzy seeds, neighbourhoods, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.frames import apart, near, stacked
from loomgraph.functions.text import tokens


def entities_for_chunks(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct entities mentioned in the chunks (chunk_id)."""
    return mentions.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("entity").distinct()


def chunk_entity_map(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id and its sorted entities; chunks without any have an empty list."""
    grouped = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return chunks.select("chunk_id").distinct().join(grouped, "chunk_id", "left").select("chunk_id", F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))


def entity_tokens(entities: DataFrame) -> DataFrame:
    """The index of entities by the tokens of their names and aliases: name, token (distinct), ord."""
    words = F.flatten(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), tokens))
    return entities.select("name", F.explode(F.array_distinct(words)).alias("token"), "ord")


def match_entities(queries: DataFrame, entities: DataFrame, limit: int = 10, least: int = 3, index: DataFrame | None = None) -> DataFrame:
    """query_id, name, score and rank of the entities that share tokens with a query, by substring either way.

    queries: query_id, text; entities: name, aliases, ord; index: their entity_tokens where these are stored. The score counts query tokens, repeats included. The fuzzy
    comparison runs once over the two dictionaries of distinct tokens: the pieces of a token that have the length of some
    token of the other side meet that one by equality. Tokens are made once and read where they are needed.
    """
    from loomgraph.plans.store import checkpointed

    asked = queries.select("query_id", F.explode(tokens("text")).alias("q")).where(F.length("q") >= least)
    asked = checkpointed(asked.groupBy("query_id", "q").agg(F.count("*").alias("n")))
    held = (checkpointed(entity_tokens(entities)) if index is None else index).select("name", "ord", F.col("token").alias("t"))
    words, names = asked.select("q").distinct(), checkpointed(held.select("t").distinct())
    similar = stacked(_containing(words, names, "q", "t"), _containing(names, words, "t", "q").select("q", "t")).distinct()
    hits = asked.join(similar, "q").join(held, "t").select("query_id", "name", "ord", "q", "n").distinct()
    scored = hits.groupBy("query_id", "name", "ord").agg(F.sum("n").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord", "name"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query_id", "name", "score", "rank")


def _containing(outer: DataFrame, inner: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs (a, b) of distinct tokens where a contains b."""
    # as many lengths as the tokens have
    lengths = sorted(r[0] for r in inner.select(F.length(b)).distinct().collect())
    here = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(a))
    pieces = F.flatten(F.transform(here, lambda n: F.transform(F.sequence(F.lit(1), F.length(a) - n + 1), lambda at: F.substring(F.col(a), at, n))))
    return outer.select(a, F.explode(F.array_distinct(pieces)).alias(b)).join(inner, b).select(a, b)


#: Sides of one node that travel together.
_SIDES = 1024
#: Nodes of a query, before its newest one, of which those that lead back are carried along as a list.
_KNOWN = 64


def _sides(relations: DataFrame) -> DataFrame:
    """The relations from both ends, about _SIDES of a node in one row: node, chunk, chunks (how many the node has), held (other, first, subject, relation, object).

    All relations of two nodes stand in one row; the first of them is marked.
    """
    kept = relations.select("subject", "relation", "object").distinct()
    one = lambda node, other: kept.select("subject", "relation", "object", F.col(node).alias("node"), F.col(other).alias("other"))
    both = stacked(one("subject", "object"), one("object", "subject").where(~F.col("subject").eqNullSafe(F.col("object")))).where("node IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("node", "other").orderBy("subject", "relation", "object")) == 1
    sizes = both.groupBy("node").agg(F.ceil(F.count("*") / _SIDES).cast("int").alias("chunks"))
    rows = both.withColumn("first", first).join(apart(sizes), "node").withColumn("chunk", F.pmod(F.xxhash64("other"), F.col("chunks")).cast("int"))
    return rows.groupBy("node", "chunk", "chunks").agg(F.collect_list(F.struct("other", "first", "subject", "relation", "object")).alias("held"))


def expand(relations: DataFrame, seeds: DataFrame, hops: int, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (query_id, subject, relation, object) within hops of the seeds, and nodes (query_id, node, hop).

    seeds: query_id, node. Relations are followed both ways; seeds count as nodes even if no relation holds them. Each hop is one
    equality join of the queries' newest nodes with rows of about _SIDES sides, so that a hub's work is dealt over all tasks by what comes
    out of it. A query with one newest node and few others can find nothing twice but what leads back, which it carries along; only
    other queries pass a distinct. among (query_id, node): the nodes that the caller looks at; others that the last hop finds are passed over before the distinct.
    """
    from loomgraph.plans.store import checkpointed

    nodes = seeds.select("query_id", "node").distinct().withColumn("hop", F.lit(0))
    if hops < 1:
        return seeds.select("query_id").join(relations, F.lit(False)).select("query_id", "subject", "relation", "object"), nodes
    nodes = checkpointed(nodes)
    sides = checkpointed(_sides(relations))
    spark = sides.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    edges, frontier = None, nodes
    for hop in range(1, hops + 1):
        older = nodes.where(F.col("hop") < hop - 1)
        alone = nodes.groupBy("query_id").agg(((F.count_if(F.col("hop") == hop - 1) == 1) & (F.count_if(F.col("hop") < hop - 1) <= _KNOWN)).alias("alone"))
        asked = frontier.select("query_id", "node").join(apart(alone), "query_id")
        if hop > 1:
            back = asked.where("alone").select("query_id", "node").join(apart(older.select("query_id", F.col("node").alias("other"))), "query_id")
            back = back.join(apart(sides.select("node", F.explode("held.other").alias("other"))), ["node", "other"], "left_semi")
            asked = asked.join(apart(back.groupBy("query_id", "node").agg(F.collect_list("other").alias("known"))), ["query_id", "node"], "left")
        else:
            asked = asked.withColumn("known", F.lit(None).cast("array<string>"))
        dealt = asked.join(apart(sides.select("node", "chunk")), "node").repartition(tasks, "node", "chunk")
        found = dealt.join(apart(sides.select("node", "chunk", "held").repartition(tasks, "node", "chunk")), ["node", "chunk"])
        found = found.select("query_id", "node", "alone", "known", F.explode("held").alias("e")).select("query_id", "node", "alone", "known", "e.*")
        ahead = ~F.coalesce(F.array_contains("known", F.col("other")), F.lit(False))
        single, several = found.where(F.col("alone") & ahead), found.where(~F.col("alone"))
        pair = ["query_id", "other"]
        twice = several.join(apart(older.select("query_id", F.col("node").alias("other"))), pair, "left_anti") if hop > 1 else several
        own = stacked(single.select("query_id", "subject", "relation", "object"), twice.select("query_id", "subject", "relation", "object").distinct())
        edges = own if edges is None else stacked(edges, own)
        fresh = single.where(F.col("first") & ~F.col("other").eqNullSafe(F.col("node"))).select(*pair)
        later = several.select(*pair)
        if among is not None and hop == hops:
            wanted = near(among.select("query_id", F.col("node").alias("other")).distinct())
            fresh, later = fresh.join(wanted, pair, "left_semi"), later.join(wanted, pair, "left_semi")
        fresh = stacked(fresh, later.distinct().join(apart(nodes.select("query_id", F.col("node").alias("other"))), pair, "left_anti"))
        frontier = fresh.select("query_id", F.col("other").alias("node")).withColumn("hop", F.lit(hop))
        if hop < hops:
            frontier = checkpointed(frontier)
        nodes = stacked(nodes, frontier)
    return edges, nodes


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """metric and value for the engine's tables; one aggregate for each table."""
    counted = {"documents": "documents", "chunks": "chunks", "entities": "entities", "relations": "relations", "mentions": "mentions", "doc_links": "doc_links", "merges": "merge_history"}
    parts = [tables[t].agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), "value") for m, t in counted.items()]
    orphans = tables["chunks"].join(apart(tables["mentions"].select(F.col("chunk_id").alias("id"))), "id", "left_anti")
    parts.append(orphans.agg(F.count("*").alias("value")).select(F.lit("orphan_chunks").alias("metric"), "value"))
    aliases = tables["entities"].agg(F.coalesce(F.sum(F.size("aliases").cast("long")), F.lit(0)).alias("value"))
    parts.append(aliases.select(F.lit("aliases").alias("metric"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = stacked(out, p)
    return out


def orphan_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities that no chunk mentions any more."""
    return entities.join(mentions.select(F.col("entity").alias("name")), "name", "left_anti")
