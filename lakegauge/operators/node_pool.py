"""Node utilisation, lifecycle events, node types and instance pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.common import top


def _n() -> Column:
    return F.count(F.lit(1))


def node_stats(
    timeline: DataFrame, warehouse_events: DataFrame, instance_events: DataFrame, node_types: DataFrame, pools: DataFrame
) -> DataFrame:
    """Row counts, distinct resources and newest times, one aggregation per table."""
    parts = [
        timeline.agg(
            _n().alias("node_timeline_rows"),
            F.countDistinct("cluster_id").alias("distinct_clusters_in_timeline"),
            F.countDistinct("instance_id").alias("distinct_instances_in_timeline"),
            F.max("start_time").alias("last_node_timeline"),
        ),
        warehouse_events.agg(
            _n().alias("warehouse_event_rows"),
            F.countDistinct("warehouse_id").alias("distinct_warehouses_in_events"),
            F.max("event_time").alias("last_warehouse_event"),
        ),
        instance_events.agg(
            _n().alias("instance_event_rows"),
            F.countDistinct("instance_pool_id").alias("distinct_pools_referenced"),
            F.max("event_time").alias("last_instance_event"),
        ),
        node_types.agg(_n().alias("node_type_rows")),
        pools.agg(_n().alias("instance_pool_rows")),
    ]
    out = parts[0]
    for i, part in enumerate(parts[1:]):
        out = out.withColumn(f"_p{i}", part.select(F.struct(*part.columns)).scalar())
    return out.select(*parts[0].columns, *[f"_p{i}.*" for i in range(len(parts) - 1)])


def node_breakdowns(warehouse_events: DataFrame, instance_events: DataFrame, node_types: DataFrame, limit: int = 20) -> DataFrame:
    """Counts by event type and node category as (kind, label, count)."""

    def labels(df: DataFrame, kind: str, column: str) -> DataFrame:
        label = F.coalesce(column, F.lit("(none)")).alias("label")
        return df.groupBy(label).agg(_n().alias("count")).select(F.lit(kind).alias("kind"), "label", "count")

    sums = (
        labels(warehouse_events, "warehouse_event_type", "event_type")
        .unionByName(labels(instance_events, "instance_event_type", "event_type"))
        .unionByName(labels(node_types, "node_type_category", "category"))
    )
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("count").desc(), F.col("label")))
    return sums.withColumn("_rn", rank).filter(F.col("_rn") <= limit).drop("_rn")


def cluster_utilization(timeline: DataFrame, limit: int = 25) -> DataFrame:
    """Average and peak utilisation per cluster, busiest first; samples without a cluster form their own group."""
    sums = timeline.groupBy("cluster_id").agg(
        _n().alias("sample_count"),
        F.avg("cpu_user_percent").alias("avg_cpu_user_percent"),
        F.avg("cpu_system_percent").alias("avg_cpu_system_percent"),
        F.avg("mem_used_percent").alias("avg_mem_used_percent"),
        F.max("cpu_user_percent").alias("max_cpu_user_percent"),
        F.max("mem_used_percent").alias("max_mem_used_percent"),
        F.max("start_time").alias("last_sample"),
    )
    return top(sums, [F.col("sample_count").desc(), F.col("cluster_id").asc_nulls_last()], limit)


def _recent(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    ties = [F.col(c).asc_nulls_last() for c in columns if c != "event_time"]
    return top(df.select(*columns), [F.col("event_time").desc_nulls_last(), *ties], limit)


def recent_warehouse_events(events: DataFrame, limit: int = 50) -> DataFrame:
    return _recent(events, ["event_time", "warehouse_id", "event_type", "cluster_count", "workspace_id"], limit)


def recent_instance_events(events: DataFrame, limit: int = 50) -> DataFrame:
    columns = ["event_time", "cluster_id", "instance_id", "instance_pool_id", "event_type", "node_type"]
    return _recent(events, columns, limit)


def node_type_list(node_types: DataFrame) -> DataFrame:
    return node_types.select("node_type", "core_count", "memory_mb", "gpu_count", "category").orderBy(
        F.col("category").asc_nulls_last(), F.col("node_type").asc_nulls_last()
    )


def instance_pool_list(pools: DataFrame) -> DataFrame:
    shown = ["instance_pool_id", "instance_pool_name", "node_type", "min_idle_instances", "max_capacity", "workspace_id"]
    return pools.select(*shown).orderBy(F.col("instance_pool_name").asc_nulls_last(), "instance_pool_id")
