"""Schemas of the engine's tables, as DDL."""

SPAN = "struct<kind:string,start:int,end:int,label:string>"

TABLES = {
    "documents": "id string, source_type string, uri string, title string, raw_text string, created_at timestamp, content_hash string, version int, schema_version int, links array<string>, meta map<string,string>",
    "chunks": f"id string, document_id string, position int, text string, span {SPAN}, embedding array<double>, embed_model string, embed_dim int",
    "entities": "name string, label string, aliases array<string>, mention_count bigint, summary string, ord bigint",
    "mentions": "chunk_id string, entity string",
    "relations": "subject string, relation string, object string",
    "doc_links": "document_id string, dst_uri string",
    "merge_history": "seq bigint, duplicate string, canonical string",
    "chunk_tokens": "id string, token string, tf int, len int, head boolean",
    "entity_tokens": "name string, token string, ord bigint",
    "vector_cells": "id string, document_id string, cell int, embedding array<double>",
    "centroids": "cell int, centroid array<double>",
}
#: Tables that are sorted by a column, so that a look-up reads few files of them.
SORTED = {"entity_tokens": "token", "vector_cells": "cell"}
#: Tables that are sorted inside each file only. Postings are many times as many as texts and are read by joins, which go through all files
#: in any order, so sending every one to the range of its token gains nothing.
WITHIN = {"chunk_tokens": "token"}
KEYS = {
    "documents": ["id"],
    "chunks": ["id"],
    "entities": ["name"],
    "mentions": ["chunk_id", "entity"],
    "relations": ["subject", "relation", "object"],
    "doc_links": ["document_id", "dst_uri"],
    "merge_history": ["seq"],
    "chunk_tokens": ["id", "token"],
    "entity_tokens": ["name", "token"],
    "vector_cells": ["id"],
    "centroids": ["cell"],
}
GOLD = "corpus string, retrieval array<struct<query:string,relevant:array<string>>>, extraction array<struct<text:string,entities:array<array<string>>,triples:array<array<string>>>>, resolution array<struct<entities:array<array<string>>,should_merge:array<array<string>>,should_not_merge:array<array<string>>>>"
QUESTION = "struct<query:string,expected:string,key_facts:array<string>,top_k:int>"
