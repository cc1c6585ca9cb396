from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.plans.engine import Engine
from loomgraph.schemas import TABLES
from loomgraph.streaming import ingest


def test_windows_with_late_events(spark, tmp_path):
    start = datetime(2024, 1, 1, 12)
    first = [(start + timedelta(minutes=m), "a", 1.0) for m in (0, 10, 70)] + [(start + timedelta(days=3), "b", 5.0)]
    late = [(start + timedelta(minutes=20), "a", 100.0), (start + timedelta(days=3, minutes=5), "b", 2.0), (start + timedelta(days=6), "a", 1.0)]
    schema = "ts timestamp, event_type string, value double"
    for n, part in enumerate((first, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        rows = ingest.event_windows(ingest.stream_of(spark, f"{tmp_path}/events", 1), "1 hour", "1 day")
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["event_type"], r["hour"]): (r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # the event that comes two days late is left out, the one within the day counts
    assert got[("a", start)] == (2, 2.0) and got[("a", start + timedelta(hours=1))] == (1, 1.0) and got[("b", start + timedelta(days=3))] == (2, 7.0)


def test_a_stream_of_documents_is_ingested_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), EngineConfig().with_(models={"dimensions": 16}))
    rows = [(f"d{i}", "markdown", f"file:/d{i}", f"T{i}", f"Harbour Master {i} meets Ines Vega", None, None, 1, 1, [], {}) for i in range(4)]
    docs = spark.createDataFrame(rows, TABLES["documents"])
    for part in (docs.where("id < 'd2'"), docs):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        ingest.ingest_stream(engine, source, f"{tmp_path}/state").awaitTermination()
    assert engine.store.table("documents").count() == 4 and engine.store.table("chunks").count() == 4
    assert engine.store.table("mentions").where(F.col("entity") == "Ines Vega").count() == 4


def test_first_seen_in_parts(spark, tmp_path):
    for part in ([(5, "x"), (6, "y")], [(1, "x "), (9, None)], [(2, "y")]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    assert sorted(r["doc_id"] for r in ingest.run_first_seen(spark, f"{tmp_path}/docs").collect()) == [1, 2, 9]
