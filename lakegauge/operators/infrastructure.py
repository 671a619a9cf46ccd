"""Clusters, warehouses, instances and pools: load, start-up, scaling and preemption."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.common import count_if, ratio, top
from lakegauge.functions.ordered import running_sum, with_nearest, with_previous
from lakegauge.functions.quantiles import exact_percentiles


def _n() -> Column:
    return F.count(F.lit(1))


def _seconds(later: Column, earlier: Column) -> Column:
    return ((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000).cast("double")


def underused_clusters(timeline: DataFrame, as_of: date, days: int = 7, cpu: float = 25, mem: float = 50, limit: int = 50) -> DataFrame:
    first = F.lit(datetime.combine(as_of - timedelta(days=days), datetime.min.time())).cast("timestamp_ntz")
    active = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    sums = timeline.filter(F.col("start_time") >= first).groupBy("cluster_id").agg(
        F.avg(active).alias("avg_cpu_active"),
        F.avg("mem_used_percent").alias("avg_mem"),
        F.max(active).alias("peak_cpu"),
        _n().alias("samples"),
    )
    found = sums.filter((F.col("avg_cpu_active") < cpu) & (F.col("avg_mem") < mem))
    return top(found, [F.col("samples").desc(), F.col("cluster_id").asc_nulls_last()], limit)


def cold_start_duration(events: DataFrame) -> DataFrame:
    """Time from STARTING to the RUNNING that follows it directly, per warehouse."""
    rows = events.filter(F.col("event_type").isin("STARTING", "RUNNING")).select("warehouse_id", "event_time", "event_type")
    paired = with_previous(rows, ["warehouse_id"], ["event_time", "event_type"], ["event_time", "event_type"])
    starts = paired.filter((F.col("event_type") == "RUNNING") & (F.col("prev_event_type") == "STARTING"))
    gap = _seconds(F.col("event_time"), F.col("prev_event_time"))
    return starts.groupBy("warehouse_id").agg(_n().alias("starts"), F.avg(gap).alias("avg_seconds"), F.max(gap).alias("max_seconds"))


def autoscale_gap(events: DataFrame) -> DataFrame:
    """Median time between PROVISIONED events of a cluster."""
    rows = events.filter(F.col("event_type") == "PROVISIONED").select("cluster_id", "event_time", "instance_id")
    paired = with_previous(rows, ["cluster_id"], ["event_time", "instance_id"], ["event_time"])
    gaps = paired.filter(F.col("prev_event_time").isNotNull()).withColumn(
        "gap", _seconds(F.col("event_time"), F.col("prev_event_time"))
    )
    return exact_percentiles(gaps, ["cluster_id"], "gap", {"median_gap_seconds": 0.5}, count_as="gaps")


def memory_pressure(timeline: DataFrame, threshold: float = 90, min_share: float = 0.0) -> DataFrame:
    """Share of samples above a memory threshold per cluster."""
    sums = timeline.groupBy("cluster_id").agg(_n().alias("samples"), count_if(F.col("mem_used_percent") > threshold).alias("high"))
    rated = sums.withColumn("high_share", ratio(F.col("high"), F.col("samples")))
    return rated.filter(F.col("high_share") > min_share)


def swap_use(timeline: DataFrame, threshold: float = 1) -> DataFrame:
    """Clusters that ever swapped."""
    return timeline.filter(F.col("mem_swap_percent") > threshold).groupBy("cluster_id").agg(
        _n().alias("samples"), F.max("mem_swap_percent").alias("max_swap_percent"), F.max("start_time").alias("last_seen")
    )


def preemption_rate(events: DataFrame, *keys: str) -> DataFrame:
    """Preempted against all ended instances, overall or per key."""
    ended = events.filter(F.col("event_type").isin("PREEMPTED", "TERMINATED"))
    sums = ended.groupBy(*keys).agg(
        count_if(F.col("event_type") == "PREEMPTED").alias("preempted"),
        count_if(F.col("event_type") == "TERMINATED").alias("terminated"),
    )
    return sums.withColumn("preempted_share", ratio(F.col("preempted"), F.col("preempted") + F.col("terminated")))


def warehouse_demand_curve(events: DataFrame) -> DataFrame:
    """Starts per warehouse and hour of day."""
    return (
        events.filter(F.col("event_type") == "STARTING")
        .groupBy("warehouse_id", F.hour("event_time").alias("hour"))
        .agg(_n().alias("starts"))
        .orderBy("warehouse_id", "hour")
    )


def _stretches(first: Column, end: Column) -> Column:
    """(level, place) of the aligned stretches of 2^level minutes that make up the minutes from ``first`` up to, but not with, ``end``.

    On each level at most one stretch sticks out on the left and one on the right, so there are at most two a level.
    """
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - first, F.lit(1)))).cast("int"))

    def on_level(k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("bigint")
        left, right = F.ceil(first / size).cast("bigint"), F.floor(end / size).cast("bigint")
        inside = left < right
        return F.array(
            F.struct(k.alias("level"), F.when(inside & (left % 2 == 1), left).alias("place")),
            F.struct(k.alias("level"), F.when(inside & (right % 2 == 1), right - 1).alias("place")),
        )

    return F.filter(F.flatten(F.transform(levels, on_level)), lambda x: x["place"].isNotNull())


def query_window_utilization(statements: DataFrame, timeline: DataFrame) -> DataFrame:
    """Mean CPU and memory of the cluster over the minutes a statement ran in.

    ``statements`` has (statement_id, cluster_id, start_time, end_time). Samples are first reduced to one row per
    (cluster, minute), then summed up over aligned stretches of 1, 2, 4, ... minutes, as long as a statement of the cluster
    needs them. A statement meets the stretches that make up its time: at most two a length, so some 30 rows for one that
    ran for months, and samples and statements of a busy cluster are not paired. A statement that ends before it starts, or has no
    end, counts with the minute of its start.
    """
    def minute(at: Column) -> Column:
        return F.floor(F.unix_timestamp(F.date_trunc("minute", at)) / 60).cast("bigint")

    samples = timeline.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id", minute(F.col("start_time")).alias("_minute")).agg(
        F.sum(F.col("cpu_user_percent") + F.col("cpu_system_percent")).alias("_cpu"),
        F.count(F.col("cpu_user_percent") + F.col("cpu_system_percent")).alias("_ncpu"),
        F.sum("mem_used_percent").alias("_mem"),
        F.count("mem_used_percent").alias("_nmem"),
        _n().alias("_n"),
    )
    ran = statements.filter(F.col("cluster_id").isNotNull() & F.col("start_time").isNotNull())
    first, last = minute(F.col("start_time")), minute(F.coalesce("end_time", "start_time"))
    pieces = ran.select("statement_id", "cluster_id", F.inline(_stretches(first, F.greatest(first, last) + 1)))
    longest = pieces.groupBy("cluster_id").agg(F.max("level").alias("_longest"))
    sums = (
        samples.join(longest, "cluster_id")
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_longest"))))
        .groupBy("cluster_id", "level", F.floor(F.col("_minute") / F.pow(F.lit(2), F.col("level"))).cast("bigint").alias("place"))
        .agg(*[F.sum(c).alias(c) for c in ("_cpu", "_ncpu", "_mem", "_nmem", "_n")])
    )
    return (
        pieces.join(sums, ["cluster_id", "level", "place"])
        .groupBy("statement_id")
        .agg(
            F.sum("_n").alias("samples"),
            ratio(F.sum("_cpu"), F.sum("_ncpu")).alias("avg_cpu"),
            ratio(F.sum("_mem"), F.sum("_nmem")).alias("avg_mem"),
        )
    )


def preempt_restart_match(events: DataFrame, restarts: DataFrame, within_seconds: int = 300) -> DataFrame:
    """Each preemption with the first restart of the same cluster within the given time after it.

    ``restarts`` has (cluster_id, event_time).
    """
    lost = events.filter(F.col("event_type") == "PREEMPTED").select("cluster_id", "instance_id", "event_time", F.lit(False).alias("_restart"))
    again = restarts.select("cluster_id", F.lit(None).cast("string").alias("instance_id"), "event_time", F.lit(True).alias("_restart"))
    known = with_nearest(lost.unionByName(again), ["cluster_id"], "event_time", "_restart", "restarted_at", after=True)
    wait = _seconds(F.col("restarted_at"), F.col("event_time"))
    found = known.filter(~F.col("_restart") & (wait <= within_seconds))
    return found.select("cluster_id", "instance_id", "event_time", "restarted_at", wait.alias("seconds"))


def pool_idle(events: DataFrame, pools: DataFrame) -> DataFrame:
    """Minimum idle instances of a pool against its highest number of instances at one time."""
    step = F.when(F.col("event_type") == "PROVISIONED", 1).when(F.col("event_type").isin("PREEMPTED", "TERMINATED"), -1)
    moves = (
        events.filter(F.col("instance_pool_id").isNotNull())
        .withColumn("_step", step)
        .filter(F.col("_step").isNotNull())
        .select("instance_pool_id", "event_time", "instance_id", "_step")
    )
    level = running_sum(moves, ["instance_pool_id"], ["event_time", "instance_id"], "_step", "_level")
    peaks = level.groupBy("instance_pool_id").agg(F.max("_level").cast("bigint").alias("peak_instances"))
    return pools.select("instance_pool_id", "min_idle_instances").join(peaks, "instance_pool_id", "left")
