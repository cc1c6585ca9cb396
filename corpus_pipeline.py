"""The corpus pipeline: each stage applies one text operator to all that the stage before it kept.

Every stage takes documents (doc_id, text, lang, source, n_chars, and any other columns) and returns the rows it
keeps with the same columns; the last returns the packed pieces instead. For all stages: rows with a null doc_id or an
empty or null text are rows as any other until the mix, which takes no row without words; repeated rows are judged one by one, but
near-duplicate removal leaves one of them; very long texts are read whole; extra columns stay, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import release, settled
from loomgraph.llm.minhash import deduplicated
from loomgraph.llm.mixing import mixed_documents, ranges_for
from loomgraph.llm.packing import pack
from loomgraph.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated toxicity, learned from the labels table, reaches 0.7.

    Null and empty texts have the score of a text without words and stay unless that reaches 0.7; equal texts stay or go together.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates.

    Texts without words are linked with nothing and stay, as do rows without doc_id; different texts of one doc_id all stay.
    """
    return deduplicated(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target number of words: rows repeat for further epochs, the row at the cut is cut.

    Null sources are one source; rows without words are not taken.
    """
    return mixed_documents(docs, ranges=ranges_for(docs.count()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences of 2048; longer texts are cut into several pieces."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("packing", pack_sequences),
]

#: Learned scores, similarity and packing cannot be said in SQL; tests/llm/test_queries.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; what a stage wrote on its way goes with it."""
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), name)
        if earlier is not None:
            release(earlier)
        earlier = docs
    return docs
