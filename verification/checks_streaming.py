"""Streaming jobs run to the end of their input, compared with the batch answer for everything the watermark closed."""

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from lakegauge.functions.checkpoints import ensure_checkpoint_dir
from lakegauge.sources import files
from lakegauge.streaming import jobs
from verification.registry import check


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arriving(t, df):
    """The frame as files of a folder, opened as a stream."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/in")
    return folder, jobs.file_stream(t.spark, f"{folder}/in", df.schema, 10_000)


def drained(t, folder, stream):
    """Run a stream over all its input into files and read them back."""
    with settings(t.spark, spark__sql__shuffle__partitions="8", spark__sql__streaming__stateStore__providerClass=jobs.ROCKSDB):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def plain(df, *times):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


@check("stream_incremental", "SELECT request_id, count(*) AS n FROM (SELECT DISTINCT request_id FROM au) GROUP BY 1")
def _(t):
    folder, stream = arriving(t, t.au.select(F.col("event_time").cast("timestamp").alias("event_time"), "request_id", "action_name"))
    with settings(t.spark, spark__sql__shuffle__partitions="8"):
        jobs.stream_incremental(stream, "event_time", "request_id", f"{folder}/table", f"{folder}/checkpoint", delay="60 days").awaitTermination()
    loaded = t.spark.read.parquet(files.partition_path(f"{folder}/table", "real"))
    return loaded.groupBy("request_id").agg(F.count("*").alias("n"))


@check(
    "stream_cost_hourly",
    """SELECT h AS hour, billing_origin_product, sum(usage_quantity) AS total_usage, sum(cost) AS total_cost FROM (SELECT date_trunc('hour', usage_end_time) AS h, * FROM bu)
    WHERE h + INTERVAL 1 HOUR <= (SELECT max(usage_end_time) FROM bu) - INTERVAL 2 HOUR GROUP BY 1, 2""",
    num=("total_usage", "total_cost"),
)
def _(t):
    folder, stream = arriving(t, t.bu.select("usage_end_time", "billing_origin_product", "usage_quantity", "cost"))
    return plain(drained(t, folder, jobs.stream_cost_hourly(stream)), "hour")


@check(
    "stream_sessions",
    """WITH e AS (SELECT executed_by, start_time, CASE WHEN start_time - lag(start_time) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM query_history WHERE data_origin = 'real' AND executed_by IS NOT NULL WINDOW w AS (PARTITION BY executed_by ORDER BY start_time)),
    s AS (SELECT *, sum(first) OVER (PARTITION BY executed_by ORDER BY start_time) AS sid FROM e)
    SELECT executed_by, min(start_time) AS session_start, max(start_time) AS last_query, count(*) AS queries FROM s GROUP BY executed_by, sid
    HAVING max(start_time) + INTERVAL 30 MINUTE <= (SELECT max(start_time) FROM e) - INTERVAL 1 HOUR""",
)
def _(t):
    rows = t.query_history.filter("data_origin = 'real'").select("executed_by", "start_time")
    folder, stream = arriving(t, rows)
    return plain(drained(t, folder, jobs.stream_sessions(stream)), "session_start", "last_query")


@check(
    "stream_wh_gap",
    """SELECT warehouse_id, s AS started_at, event_time AS running_at, (epoch_us(event_time) - epoch_us(s)) / 1000000.0 AS seconds FROM (SELECT *, lag(event_type) OVER w AS p, lag(event_time) OVER w AS s FROM we
    WHERE event_type IN ('STARTING', 'RUNNING') WINDOW w AS (PARTITION BY warehouse_id ORDER BY event_time, event_type)) WHERE event_type = 'RUNNING' AND p = 'STARTING'""",
    num=("seconds",),
    digits=3,
)
def _(t):
    folder, stream = arriving(t, t.we.select("warehouse_id", "event_time", "event_type"))
    return plain(drained(t, folder, jobs.stream_wh_gap(stream)), "started_at", "running_at")
