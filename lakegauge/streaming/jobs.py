"""Streaming forms of the incremental load and of a few time-based operators.

Every function takes a streaming (or batch) frame and returns one; sources, triggers and sinks are the caller's, apart
from ``stream_incremental``, which runs a whole load. With the available-now trigger the results equal the batch
operators, except for rows later than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakegauge.sources import files


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files arriving in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_incremental(
    rows: DataFrame,
    time_column: str,
    key: str,
    table_path: str,
    checkpoint: str,
    origin: str = "real",
    delay: str = "1 day",
) -> StreamingQuery:
    """Append new rows once, using the checkpoint as the cursor; repeats of a key within the watermark are dropped.

    Each batch has its own folder, which a replay overwrites, so a restart after a failure never doubles rows.
    """
    fresh = rows.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.drop("data_origin").write.mode("overwrite").parquet(
            f"{files.partition_path(table_path, origin)}/batch={batch_id}"
        )

    return (
        fresh.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def stream_cost_hourly(priced: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Cost and usage per billing origin and hour of the end of usage."""
    timed = priced.withColumn("_at", F.col("usage_end_time").cast("timestamp")).withWatermark("_at", delay)
    sums = timed.groupBy(F.window("_at", "1 hour"), "billing_origin_product").agg(
        F.sum("usage_quantity").alias("total_usage"), F.sum("cost").alias("total_cost")
    )
    return sums.select(F.col("window.start").alias("hour"), "billing_origin_product", "total_usage", "total_cost")


def stream_sessions(statements: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of activity per user: a pause longer than ``gap`` starts a new one."""
    timed = (
        statements.filter(F.col("executed_by").isNotNull())
        .withColumn("_at", F.col("start_time").cast("timestamp"))
        .withWatermark("_at", delay)
    )
    found = timed.groupBy("executed_by", F.session_window("_at", gap)).agg(
        F.count(F.lit(1)).alias("queries"), F.max("_at").alias("last_query")
    )
    return found.select(
        "executed_by", F.col("session_window.start").alias("session_start"), "last_query", "queries"
    )


GAP_SCHEMA = "warehouse_id string, started_at timestamp, running_at timestamp, seconds double"


def start_gap_processor() -> StatefulProcessor:
    """The state machine of ``stream_wh_gap``. The class is local so that it travels to the workers by value."""

    class StartGap(StatefulProcessor):
        """Remembers the open start of a warehouse between batches and emits the gap when it runs."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self._open = handle.getValueState("open", "started_at timestamp")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            events = pd.concat(list(rows)).sort_values(["event_time", "event_type"])
            started = self._open.get()[0] if self._open.exists() else None
            found = []
            for event in events.itertuples(index=False):
                # A start older than the remembered one, or a run older than it, arrived late and changes nothing.
                if event.event_type == "STARTING":
                    started = event.event_time if started is None else max(event.event_time, pd.Timestamp(started))
                elif started is not None and event.event_time >= pd.Timestamp(started):
                    seconds = (event.event_time - pd.Timestamp(started)).total_seconds()
                    found.append((key[0], started, event.event_time, seconds))
                    started = None
            if started is None:
                if self._open.exists():
                    self._open.clear()
            else:
                self._open.update((pd.Timestamp(started).to_pydatetime(),))
            if found:
                yield pd.DataFrame(found, columns=["warehouse_id", "started_at", "running_at", "seconds"])

        def close(self) -> None:
            pass

    return StartGap()


def stream_wh_gap(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Start to running gap per warehouse with one remembered timestamp of state per warehouse.

    Needs the RocksDB state store provider.
    """
    kept = (
        events.filter(F.col("event_type").isin("STARTING", "RUNNING"))
        .select("warehouse_id", F.col("event_time").cast("timestamp").alias("event_time"), "event_type")
        .withWatermark("event_time", delay)
    )
    return kept.groupBy("warehouse_id").transformWithStateInPandas(
        statefulProcessor=start_gap_processor(), outputStructType=GAP_SCHEMA, outputMode="Append", timeMode="None"
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
