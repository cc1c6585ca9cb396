"""Normalising, de-duplicating and versioning documents; merging rows into the engine's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.frames import near, stacked
from loomgraph.functions.text import content_hash, normalize_text


def normalized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("raw_text", normalize_text("raw_text")).withColumn("content_hash", content_hash("raw_text"))


def first_per_hash(docs: DataFrame, hash_column: str, order: str) -> DataFrame:
    """Of rows with the same hash only the first by order (one aggregation, no sort)."""
    rest = [c for c in docs.columns if c != hash_column]
    return docs.groupBy(hash_column).agg(F.min_by(F.struct(*rest), order).alias("r")).select(hash_column, *[F.col(f"r.{c}").alias(c) for c in rest])


def dedupe_status(incoming: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Adds `status` (duplicate, updated or new); updated rows get the id and the next version of the stored document.

    incoming: id, uri, content_hash and order; existing: id, uri, content_hash, version. A hash stored anywhere makes a
    duplicate, before the uri is looked at. Within the batch the first row by order (a column without ties) wins, first by hash,
    then by uri: later rows of a hash are duplicates, later rows of a uri further versions.
    """
    known = existing.select("content_hash").distinct().withColumn("_known", F.lit(True))
    stored = existing.groupBy("uri").agg(F.min_by(F.struct("id", "version"), "id").alias("_old"))
    # of the hashes that stand on several rows only the first row is looked at further; these hashes are few beside the rows
    again = incoming.groupBy("content_hash").agg(F.min(order).alias("_head"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = incoming.join(known, "content_hash", "left").join(again, "content_hash", "left")
    rows = rows.withColumn("_dup", F.col("_known").isNotNull() | F.coalesce(F.col("_head") != F.col(order), F.lit(False))).drop("_head")
    by_uri = Window.partitionBy("uri").orderBy(order)
    fresh = rows.where(~F.col("_dup")).withColumn("_step", F.row_number().over(by_uri)).withColumn("_first", F.first("id").over(by_uri))
    rows = stacked(fresh, rows.where("_dup"), allow_missing=True).join(stored, "uri", "left").withColumn("_step", F.coalesce("_step", F.lit(1)))
    base = F.coalesce("_old.version", F.lit(0))
    return (
        rows.withColumn("status", F.when(F.col("_dup"), "duplicate").when(F.col("_old").isNotNull() | (F.col("_step") > 1), "updated").otherwise("new"))
        .withColumn("id", F.when(F.col("status") == "updated", F.coalesce("_old.id", "_first")).otherwise(F.col("id")))
        .withColumn("version", F.when(F.col("status") == "duplicate", F.lit(1)).otherwise(base + F.col("_step")).cast("int"))
        .drop("_known", "_dup", "_old", "_step", "_first")
    )


def by_uri(documents: DataFrame, uris: DataFrame) -> DataFrame:
    """The stored document of each of uris (uri), all its columns; the smallest id where a uri stands twice, no row where it is not stored.

    Null uris find nothing and repeated ones count once.
    """
    wanted = uris.select("uri").where("uri IS NOT NULL").distinct()
    rest = [c for c in documents.columns if c != "uri"]
    found = documents.join(near(wanted), "uri", "left_semi").groupBy("uri").agg(F.min_by(F.struct(*rest), "id").alias("r"))
    return found.select(*[F.col("uri") if c == "uri" else F.col(f"r.{c}").alias(c) for c in documents.columns])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows, and those old rows whose key is not among them."""
    return stacked(new, old.join(new.select(*keys).distinct(), list(keys), "left_anti"), allow_missing=True)


def delete_chunks(chunks: DataFrame, mentions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks and mentions without those of the documents (id)."""
    gone = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    kept = chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return kept, mentions.join(gone, "chunk_id", "left_anti")


def _aliases(rows: DataFrame, key: str) -> DataFrame:
    """key and its distinct aliases in the order in which they first stand; rows: key, place, aliases."""
    each = rows.select(key, "place", F.posexplode("aliases").alias("p", "alias"))
    firsts = each.groupBy(key, "alias").agg(F.min(F.struct("place", "p")).alias("o"))
    return firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "alias"))).alias("a")).select(key, F.transform("a", lambda x: x["alias"]).alias("aliases"))


def upsert_entities(rows: DataFrame) -> DataFrame:
    """One row per name from rows in order (name, label, aliases, summary, ord): the first label, all aliases in order, the first summary that is not empty.

    Rows are aggregated where they lie; only the distinct aliases of a name, which are its result, come together.
    """
    none = F.array().cast("array<string>")
    told = F.coalesce("summary", F.lit("")) != ""
    heads = rows.groupBy("name").agg(F.min_by("label", "ord").alias("label"), F.coalesce(F.min_by("summary", F.when(told, F.col("ord"))), F.lit("")).alias("summary"), F.min("ord").alias("ord"))
    aliases = _aliases(rows.select("name", F.col("ord").alias("place"), "aliases"), "name")
    return heads.join(aliases, "name", "left").select("name", "label", F.coalesce("aliases", none).alias("aliases"), "summary", "ord")


def mention_counts(calls: DataFrame) -> DataFrame:
    """entity, mention_count (every call counts) and n_chunks (distinct chunks) of calls (chunk_id, entity)."""
    return calls.groupBy("entity").agg(F.count("*").alias("mention_count"), F.count_distinct("chunk_id").alias("n_chunks"))


def authored_by(relations: DataFrame, authors: DataFrame) -> DataFrame:
    """relations and (document, AUTHORED_BY, person) of authors (document_id, person)."""
    return stacked(relations, authors.select(F.col("document_id").alias("subject"), F.lit("AUTHORED_BY").alias("relation"), F.col("person").alias("object"))).distinct()


def resolved_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, dst_uri and target_id (the document whose uri or title the link names, the smallest id; null if none)."""
    named = stacked(documents.select(F.col("uri").alias("dst_uri"), "id"), documents.select(F.col("title").alias("dst_uri"), "id"))
    targets = named.groupBy("dst_uri").agg(F.min("id").alias("target_id"))
    return links.distinct().join(targets, "dst_uri", "left").select("document_id", "dst_uri", "target_id")


def strict_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both ends of which are entities."""
    names = entities.select("name")
    return relations.join(names.withColumnRenamed("name", "subject"), "subject", "left_semi").join(names.withColumnRenamed("name", "object"), "object", "left_semi").select("subject", "relation", "object")


def merge_entities(entities: DataFrame, mentions: DataFrame, relations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and relations after merging duplicate into root (mapping: duplicate, root).

    A merged name and its aliases become aliases of the root, counts add up, mentions and relations are rewired,
    relations of a name with itself go. A root that is no entity yet takes the first label of its duplicates.
    """
    to = mapping.select(F.col("duplicate").alias("name"), "root")
    rows = entities.join(to, "name", "left").withColumn("owner", F.coalesce("root", "name"))
    own = F.col("name") == F.col("owner")
    rows = rows.withColumn("place", F.struct((~own).cast("int").alias("k"), "ord"))
    # a root that is an entity comes first among its rows and keeps its summary
    heads = rows.groupBy("owner").agg(
        F.min_by(F.struct("label", F.when(own, F.coalesce("summary", F.lit(""))).otherwise("").alias("summary"), "ord"), "place").alias("head"),
        F.sum("mention_count").alias("mention_count"),
    )
    listed = rows.select("owner", "place", F.when(own, F.col("aliases")).otherwise(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases"))
    joined = heads.join(_aliases(listed, "owner"), "owner", "left")
    others = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != F.col("owner"))
    merged = joined.select(F.col("owner").alias("name"), F.col("head.label").alias("label"), others.alias("aliases"), "mention_count", F.col("head.summary").alias("summary"), F.col("head.ord").alias("ord"))

    def rewired(df: DataFrame, column: str) -> DataFrame:
        names = to.select(F.col("name").alias(column), F.col("root").alias("_root"))
        return df.join(names, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")

    new_mentions = rewired(mentions, "entity").select("chunk_id", "entity").distinct()
    new_relations = rewired(rewired(relations, "subject"), "object").select("subject", "relation", "object").where("subject <> object").distinct()
    return merged, new_mentions, new_relations


def updated_spans(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """chunks with the spans of fresh (id, span) where it has the id."""
    return chunks.join(fresh.select("id", F.col("span").alias("_new")), "id", "left").withColumn("span", F.coalesce("_new", "span")).drop("_new").select(*chunks.columns)


def backfill_spans(documents: DataFrame, chunks: DataFrame, reloaded: DataFrame, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Spans chunked anew for documents whose source still has the same hash; and a count for each outcome."""
    from loomgraph.operators.chunking import chunk_documents

    fresh = normalized(reloaded).select("uri", F.col("content_hash").alias("now"), "raw_text", "source_type")
    joined = documents.select("id", "uri", "content_hash").join(fresh, "uri", "left")
    outcome = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("content_hash"), "changed").otherwise("same")
    judged = joined.withColumn("outcome", outcome)
    spans = chunk_documents(judged.where("outcome = 'same'").select("id", "source_type", "raw_text"), size, overlap)
    return updated_spans(chunks, spans.select("id", "span")), judged.groupBy("outcome").agg(F.count("*").alias("n"))


def unrepaired_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with text but without chunks, whose ingestion failed part of the way."""
    return documents.where(F.trim("raw_text") != "").join(chunks.select(F.col("document_id").alias("id")), "id", "left_anti")


def ingest_report(statuses: DataFrame) -> DataFrame:
    """One row of counts by status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"documents_{s}")
    return statuses.agg(F.count("*").alias("documents_seen"), count("new"), count("updated"), count("duplicate"))


def violations(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand more than once."""
    return table.groupBy(*keys).count().where("count > 1")
