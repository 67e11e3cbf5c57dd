"""Queries that run as streams over all the files there are, and end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import sql
from corpusloom.plans.catalog import query
from corpusloom.sources.shared import shared_dir
from corpusloom.sources.tables import table
from corpusloom.streaming import ingest


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of files; the last letter is a pattern, so that a single file is found like a folder."""
    return ingest.document_stream(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema)


def finished(rows: DataFrame, mode: str) -> DataFrame:
    """What the stream has put out once it has read all there is, written by batch to the shared folder; the last batch of
    a complete stream, all batches of an appending one."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out").select(rows.columns)  # without the batch's number


@query("streaming_census", sql.with_(sql.CENSUS, "SELECT tok, cnt, pos_sum FROM c"))
def streaming_census(spark, sf):
    return finished(ingest.streaming_census(source(spark, sf, "documents").select("doc_id", "text")), "complete")


@query(
    "streaming_event_windows",
    """SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS starts, count(*) AS n FROM events
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def streaming_event_windows(spark, sf):
    """Windows that are final: the watermark, a day behind the latest event, has passed their end."""
    counted = ingest.windowed_counts(source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", ["event_type"])
    rows = counted.select("event_type", F.col("window.start").cast("long").alias("starts"), "n")
    return finished(rows, "append")


@query("streaming_new_only", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents")
def streaming_new_only(spark, sf):
    """Every document arrives twice and is kept once."""
    rows = source(spark, sf, "documents").select("doc_id")
    out = finished(ingest.new_only(rows.unionByName(rows), ["doc_id"]), "append")
    return out.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
