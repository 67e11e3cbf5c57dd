"""Incremental counterparts: streaming census, resumable ingestion, shards by batch, packing with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.vocabulary import census, clause_stream


def document_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """New parquet files of a folder as they come; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def streaming_census(docs: DataFrame) -> DataFrame:
    """The census of all documents so far. Documents are cut into tokens row by row, so only counts are state."""
    return census(clause_stream(docs))


def new_only(rows: DataFrame, keys: list[str], time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Each key once. With an event time the keys are forgotten after ``lateness``, so that state stays bounded."""
    return rows.dropDuplicates(keys) if time is None else rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, width: str, lateness: str, keys: list[str]) -> DataFrame:
    """Events by key and tumbling window; a window is final once the watermark has passed it."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def write_batches(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Each batch as a folder of its own, written again under the same number if it's repeated."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def greedy_rows(lengths: DataFrame, key: str, capacity: int) -> DataFrame:
    """key, row, used: items of a stream in rows of at most ``capacity``, a row open per key as state."""
    kind = lengths.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("row", T.LongType()), T.StructField("used", T.LongType())])

    def step(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, used = state.get if state.exists else (0, 0)
        done = []
        for part in parts:
            for n in part["n"].tolist():
                n = min(int(n), capacity)
                if used + n > capacity:
                    done.append((own[0], row, used))
                    row, used = row + 1, 0
                used += n
        state.update((row, used))
        yield pd.DataFrame(done, columns=[key, "row", "used"])

    return lengths.select(key, "n").groupBy(key).applyInPandasWithState(step, out, "row long, used long", "append", GroupStateTimeout.NoTimeout)
