"""Incremental ingestion with Structured Streaming; an extension beyond the original tool's batch runs.

Files that arrive in a folder are read as a stream; each micro-batch goes through the same operators as a batch
run and is merged into a table version, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import content_hash, normalize_text
from loomgraph.scratch import scratch_path


def stream_of(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, whether its path is a file or a folder that files arrive in."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())
    return reader.parquet(path)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by type and tumbling window; events later than the watermark are left out."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return own.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("window.start").alias("hour"), "n", "total")


def run_event_windows(spark: SparkSession, path: str) -> DataFrame:
    """All windows of a finished table read as a stream: each micro-batch's partial sums are kept, and added up when read."""
    out = scratch_path(spark, "windows")
    stream = stream_of(spark, path)

    def save(batch: DataFrame, number: int) -> None:
        own = batch.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        own.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", out).parquet(out)
    return rows.groupBy("event_type", "hour").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def first_seen(batch: DataFrame) -> DataFrame:
    """content_hash and its smallest doc_id in the batch."""
    rows = batch.select(content_hash(normalize_text(F.coalesce("text", F.lit("")))).alias("content_hash"), "doc_id")
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


def run_first_seen(spark: SparkSession, path: str) -> DataFrame:
    """The first document of each text of a table read as a stream: each micro-batch adds its own firsts, and the smallest counts.

    A batch costs what it holds, whatever came before; a repeated batch overwrites its own part.
    """
    out = scratch_path(spark, "first")

    def save(batch: DataFrame, number: int) -> None:
        first_seen(batch).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")
        save.any = True

    save.any = False
    stream_of(spark, path).writeStream.foreachBatch(save).option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    if not save.any:
        return spark.createDataFrame([], "content_hash string, doc_id long")
    return spark.read.option("basePath", out).parquet(out).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))


def ingest_stream(engine, docs: DataFrame, state: str):
    """Starts a stream of documents (the loaders' schema) into an Engine; each micro-batch is one idempotent ingest."""
    return docs.writeStream.foreachBatch(lambda batch, _: engine.ingest(batch)).option("checkpointLocation", state).trigger(availableNow=True).start()

