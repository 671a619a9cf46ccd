"""Cluster and warehouse inventory, capacity look-ups and per-resource billing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.functions.common import date_range, total
from lakegauge.operators.billing import by_cost, latest_clusters, latest_warehouses, usage_and_cost

# Node type, cloud, family, vCPUs, memory GB, local disk GB, GPU count, GPU type (empty = none).
NODE_SPECS = """
Standard_DS3_v2, azure, general-purpose, 4, 14.0, 28.0, ,
Standard_DS4_v2, azure, general-purpose, 8, 28.0, 56.0, ,
Standard_DS5_v2, azure, general-purpose, 16, 56.0, 112.0, ,
Standard_D4s_v3, azure, general-purpose, 4, 16.0, 32.0, ,
Standard_D8s_v3, azure, general-purpose, 8, 32.0, 64.0, ,
Standard_D16s_v3, azure, general-purpose, 16, 64.0, 128.0, ,
Standard_D32s_v3, azure, general-purpose, 32, 128.0, 256.0, ,
Standard_D4ds_v4, azure, general-purpose, 4, 16.0, 150.0, ,
Standard_D8ds_v4, azure, general-purpose, 8, 32.0, 300.0, ,
Standard_D16ds_v4, azure, general-purpose, 16, 64.0, 600.0, ,
Standard_D4ds_v5, azure, general-purpose, 4, 16.0, 150.0, ,
Standard_D8ds_v5, azure, general-purpose, 8, 32.0, 300.0, ,
Standard_D16ds_v5, azure, general-purpose, 16, 64.0, 600.0, ,
Standard_D32ds_v5, azure, general-purpose, 32, 128.0, 1200.0, ,
Standard_E4s_v3, azure, memory-optimized, 4, 32.0, 64.0, ,
Standard_E8s_v3, azure, memory-optimized, 8, 64.0, 128.0, ,
Standard_E16s_v3, azure, memory-optimized, 16, 128.0, 256.0, ,
Standard_E32s_v3, azure, memory-optimized, 32, 256.0, 512.0, ,
Standard_E4ds_v4, azure, memory-optimized, 4, 32.0, 150.0, ,
Standard_E8ds_v4, azure, memory-optimized, 8, 64.0, 300.0, ,
Standard_E16ds_v4, azure, memory-optimized, 16, 128.0, 600.0, ,
Standard_E4ds_v5, azure, memory-optimized, 4, 32.0, 150.0, ,
Standard_E8ds_v5, azure, memory-optimized, 8, 64.0, 300.0, ,
Standard_E16ds_v5, azure, memory-optimized, 16, 128.0, 600.0, ,
Standard_E32ds_v5, azure, memory-optimized, 32, 256.0, 1200.0, ,
Standard_F4s_v2, azure, compute-optimized, 4, 8.0, 32.0, ,
Standard_F8s_v2, azure, compute-optimized, 8, 16.0, 64.0, ,
Standard_F16s_v2, azure, compute-optimized, 16, 32.0, 128.0, ,
Standard_F32s_v2, azure, compute-optimized, 32, 64.0, 256.0, ,
Standard_L4s, azure, storage-optimized, 4, 32.0, 678.0, ,
Standard_L8s, azure, storage-optimized, 8, 64.0, 1388.0, ,
Standard_L16s, azure, storage-optimized, 16, 128.0, 2807.0, ,
Standard_NC4as_T4_v3, azure, gpu, 4, 28.0, 180.0, 1, NVIDIA T4
Standard_NC8as_T4_v3, azure, gpu, 8, 56.0, 360.0, 1, NVIDIA T4
Standard_NC16as_T4_v3, azure, gpu, 16, 110.0, 360.0, 1, NVIDIA T4
Standard_NC6s_v3, azure, gpu, 6, 112.0, 736.0, 1, NVIDIA V100
Standard_NC12s_v3, azure, gpu, 12, 224.0, 1474.0, 2, NVIDIA V100
Standard_NC24s_v3, azure, gpu, 24, 448.0, 2948.0, 4, NVIDIA V100
m5.large, aws, general-purpose, 2, 8.0, , ,
m5.xlarge, aws, general-purpose, 4, 16.0, , ,
m5.2xlarge, aws, general-purpose, 8, 32.0, , ,
m5.4xlarge, aws, general-purpose, 16, 64.0, , ,
m5.8xlarge, aws, general-purpose, 32, 128.0, , ,
m5.12xlarge, aws, general-purpose, 48, 192.0, , ,
m5.16xlarge, aws, general-purpose, 64, 256.0, , ,
m5.24xlarge, aws, general-purpose, 96, 384.0, , ,
m5d.large, aws, general-purpose, 2, 8.0, 75.0, ,
m5d.xlarge, aws, general-purpose, 4, 16.0, 150.0, ,
m5d.2xlarge, aws, general-purpose, 8, 32.0, 300.0, ,
m5d.4xlarge, aws, general-purpose, 16, 64.0, 600.0, ,
m5d.8xlarge, aws, general-purpose, 32, 128.0, 1200.0, ,
r5.large, aws, memory-optimized, 2, 16.0, , ,
r5.xlarge, aws, memory-optimized, 4, 32.0, , ,
r5.2xlarge, aws, memory-optimized, 8, 64.0, , ,
r5.4xlarge, aws, memory-optimized, 16, 128.0, , ,
r5.8xlarge, aws, memory-optimized, 32, 256.0, , ,
r5.12xlarge, aws, memory-optimized, 48, 384.0, , ,
r5.16xlarge, aws, memory-optimized, 64, 512.0, , ,
r5.24xlarge, aws, memory-optimized, 96, 768.0, , ,
c5.xlarge, aws, compute-optimized, 4, 8.0, , ,
c5.2xlarge, aws, compute-optimized, 8, 16.0, , ,
c5.4xlarge, aws, compute-optimized, 16, 32.0, , ,
c5.9xlarge, aws, compute-optimized, 36, 72.0, , ,
i3.large, aws, storage-optimized, 2, 15.25, 475.0, ,
i3.xlarge, aws, storage-optimized, 4, 30.5, 950.0, ,
i3.2xlarge, aws, storage-optimized, 8, 61.0, 1900.0, ,
i3.4xlarge, aws, storage-optimized, 16, 122.0, 3800.0, ,
i3.8xlarge, aws, storage-optimized, 32, 244.0, 7600.0, ,
g4dn.xlarge, aws, gpu, 4, 16.0, 125.0, 1, NVIDIA T4
g4dn.2xlarge, aws, gpu, 8, 32.0, 225.0, 1, NVIDIA T4
g4dn.4xlarge, aws, gpu, 16, 64.0, 225.0, 1, NVIDIA T4
p3.2xlarge, aws, gpu, 8, 61.0, , 1, NVIDIA V100
p3.8xlarge, aws, gpu, 32, 244.0, , 4, NVIDIA V100
n1-standard-4, gcp, general-purpose, 4, 15.0, , ,
n1-standard-8, gcp, general-purpose, 8, 30.0, , ,
n1-standard-16, gcp, general-purpose, 16, 60.0, , ,
n1-standard-32, gcp, general-purpose, 32, 120.0, , ,
n2-standard-4, gcp, general-purpose, 4, 16.0, , ,
n2-standard-8, gcp, general-purpose, 8, 32.0, , ,
n2-standard-16, gcp, general-purpose, 16, 64.0, , ,
n2-highmem-4, gcp, memory-optimized, 4, 32.0, , ,
n2-highmem-8, gcp, memory-optimized, 8, 64.0, , ,
n2-highmem-16, gcp, memory-optimized, 16, 128.0, , ,
n2-highcpu-8, gcp, compute-optimized, 8, 8.0, , ,
n2-highcpu-16, gcp, compute-optimized, 16, 16.0, , ,
"""

# Warehouse size, label, DBU per hour, cluster count.
WAREHOUSE_SIZES = """
2X_SMALL, 2X-Small, 4, 1
X_SMALL, X-Small, 6, 1
SMALL, Small, 12, 1
MEDIUM, Medium, 24, 2
LARGE, Large, 40, 4
X_LARGE, X-Large, 80, 8
2X_LARGE, 2X-Large, 144, 16
3X_LARGE, 3X-Large, 272, 32
4X_LARGE, 4X-Large, 528, 64
"""

#: Node families.
NODE_FAMILIES = ("general-purpose", "memory-optimized", "compute-optimized", "storage-optimized", "gpu")


def _parse(text: str) -> list[list[str | None]]:
    return [[v.strip() or None for v in line.split(",")] for line in text.strip().splitlines()]


def node_specs(spark: SparkSession) -> DataFrame:
    """The node specification table: a fixed number of rows, so joins may broadcast it."""
    rows = [
        (n, c, f, int(v), float(m), float(d) if d else None, int(g) if g else None, t)
        for n, c, f, v, m, d, g, t in _parse(NODE_SPECS)
    ]
    schema = (
        "node_type string, cloud string, family string, vcpus int, memory_gb double, local_disk_gb double, "
        "gpu_count int, gpu_type string"
    )
    return spark.createDataFrame(rows, schema)


def warehouse_sizes(spark: SparkSession) -> DataFrame:
    rows = [(s, label, int(d), int(c)) for s, label, d, c in _parse(WAREHOUSE_SIZES)]
    return spark.createDataFrame(rows, "size string, label string, max_dbu_per_hour int, cluster_count int")


def _specs_for(df: DataFrame, key: str, prefix: str) -> DataFrame:
    specs = node_specs(df.sparkSession).select(
        F.col("node_type").alias(key),
        F.col("vcpus").alias(f"{prefix}_vcpus"),
        F.col("memory_gb").alias(f"{prefix}_memory_gb"),
        F.col("family").alias(f"{prefix}_family"),
        F.col("gpu_count").alias(f"{prefix}_gpu_count"),
    )
    return df.join(F.broadcast(specs), key, "left")


def with_node_capacity(clusters: DataFrame) -> DataFrame:
    """Add driver and worker specs and the totals of a cluster at its upper size.

    Totals are NULL when the driver type is unknown; an unknown worker type adds nothing.
    """
    df = _specs_for(_specs_for(clusters, "driver_node_type", "driver"), "worker_node_type", "worker")
    workers = F.coalesce("max_autoscale_workers", "worker_count", F.lit(0))
    gpu = F.when(F.col("driver_node_type").isNotNull(), F.coalesce(F.col("driver_gpu_count") > 0, F.lit(False)))
    return (
        df.withColumn("effective_workers", workers)
        .withColumn("driver_has_gpu", gpu)
        .withColumn("total_vcpus", F.col("driver_vcpus") + F.coalesce(F.col("worker_vcpus") * workers, F.lit(0)))
        .withColumn(
            "total_memory_gb", F.col("driver_memory_gb") + F.coalesce(F.col("worker_memory_gb") * workers, F.lit(0.0))
        )
    )


#: Sort keys of the inventory.
INVENTORY_SORT = {
    "name": "cluster_name",
    "created": "create_time",
    "workers": "effective_workers",
    "driver_vcpus": "driver_vcpus",
    "driver_memory_gb": "driver_memory_gb",
    "total_vcpus": "total_vcpus",
    "total_memory_gb": "total_memory_gb",
}


def _search(columns: tuple[str, ...], text: str) -> Column:
    condition = F.lit(False)
    for column in columns:
        condition = condition | F.col(column).ilike(f"%{text}%")
    return condition


def _page(df: DataFrame, page: int, page_size: int) -> DataFrame:
    return df.offset((page - 1) * page_size).limit(page_size)


def cluster_inventory(
    clusters: DataFrame,
    search: str | None = None,
    workspace_id: str | None = None,
    cluster_source: str | None = None,
    data_security_mode: str | None = None,
    node_family: str | None = None,
    has_gpu: bool | None = None,
    min_vcpus: int | None = None,
    min_memory_gb: float | None = None,
    sort_by: str = "name",
    descending: bool = False,
    page: int = 1,
    page_size: int | None = 20,
) -> DataFrame:
    """One page of the cluster list; ``page_size=None`` gives the whole list."""
    if sort_by not in INVENTORY_SORT:
        raise ValueError(f"sort_by must be one of {list(INVENTORY_SORT)}")
    if node_family and node_family not in NODE_FAMILIES:
        raise ValueError(f"node_family must be one of {NODE_FAMILIES}")
    df = clusters
    if search:
        df = df.filter(_search(("cluster_name", "cluster_id", "owned_by"), search))
    for column, value in {
        "workspace_id": workspace_id,
        "cluster_source": cluster_source,
        "data_security_mode": data_security_mode,
    }.items():
        if value:
            df = df.filter(F.col(column) == value)
    df = with_node_capacity(df)
    if node_family:
        df = df.filter(F.col("driver_family") == node_family)
    if has_gpu is not None:
        df = df.filter(F.col("driver_has_gpu") == has_gpu)
    if min_vcpus is not None:
        df = df.filter(F.col("total_vcpus") >= min_vcpus)
    if min_memory_gb is not None:
        df = df.filter(F.col("total_memory_gb") >= min_memory_gb)
    key = F.col(INVENTORY_SORT[sort_by])
    ordered = df.orderBy(
        key.desc_nulls_last() if descending else key.asc_nulls_last(),
        F.col("cluster_name").asc_nulls_last(),
        F.col("cluster_id"),
    )
    return ordered if page_size is None else _page(ordered, page, page_size)


def warehouse_inventory(
    warehouses: DataFrame, search: str | None = None, page: int = 1, page_size: int | None = 20
) -> DataFrame:
    df = warehouses
    if search:
        df = df.filter(_search(("warehouse_name", "warehouse_id"), search))
    ordered = df.orderBy(F.col("warehouse_name").asc_nulls_last(), "warehouse_id")
    return ordered if page_size is None else _page(ordered, page, page_size)


def node_spec_coverage(clusters: DataFrame) -> DataFrame:
    """Specification of every node type in use, with the number of configuration rows naming it."""
    used = clusters.select(F.explode(F.array("driver_node_type", "worker_node_type")).alias("node_type")).filter(
        F.col("node_type").isNotNull()
    )
    counts = used.groupBy("node_type").agg(F.count(F.lit(1)).alias("n_configs"))
    return counts.join(F.broadcast(node_specs(clusters.sparkSession)), "node_type", "left")


def with_warehouse_size(warehouses: DataFrame) -> DataFrame:
    """Add the size specification (case does not matter) and the peak DBU per hour at full scale."""
    sizes = warehouse_sizes(warehouses.sparkSession).select(
        F.col("size").alias("_size"),
        F.col("label").alias("size_label"),
        F.col("max_dbu_per_hour").alias("size_dbu_per_hour"),
        F.col("cluster_count").alias("size_cluster_count"),
    )
    scale = F.when(F.coalesce("max_clusters", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("max_clusters"))
    return (
        warehouses.join(F.broadcast(sizes), F.upper("warehouse_size") == F.col("_size"), "left")
        .drop("_size")
        .withColumn("max_dbu_per_hour", F.col("size_dbu_per_hour") * scale)
    )


def resource_lifetime(priced: DataFrame, key: str) -> DataFrame:
    """Lifetime usage, cost, last day and observed flags of each resource."""
    return (
        priced.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            *usage_and_cost(),
            F.max("usage_date").alias("last_usage_date"),
            F.coalesce(F.bool_or("is_photon"), F.lit(False)).alias("is_photon_observed"),
            F.coalesce(F.bool_or("is_serverless"), F.lit(False)).alias("is_serverless_observed"),
        )
    )


def _with_lifetime(config: DataFrame, priced: DataFrame, key: str) -> DataFrame:
    joined = config.join(resource_lifetime(priced, key), key, "left")
    zero = {"total_usage": 0, "total_cost": 0}
    for column, value in zero.items():
        joined = joined.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
    for column in ("is_photon_observed", "is_serverless_observed"):
        joined = joined.withColumn(column, F.coalesce(F.col(column), F.lit(False)))
    return joined


def cluster_detail(clusters: DataFrame, priced: DataFrame, cluster_id: str | None = None) -> DataFrame:
    """Newest configuration, capacity and lifetime billing of every cluster (or one) in a single job."""
    if cluster_id is not None:
        clusters = clusters.filter(F.col("cluster_id") == cluster_id)
        priced = priced.filter(F.col("cluster_id") == cluster_id)
    return _with_lifetime(with_node_capacity(latest_clusters(clusters)), priced, "cluster_id")


def warehouse_detail(warehouses: DataFrame, priced: DataFrame, warehouse_id: str | None = None) -> DataFrame:
    if warehouse_id is not None:
        warehouses = warehouses.filter(F.col("warehouse_id") == warehouse_id)
        priced = priced.filter(F.col("warehouse_id") == warehouse_id)
    return _with_lifetime(with_warehouse_size(latest_warehouses(warehouses)), priced, "warehouse_id")


def _sku_breakdown(priced: DataFrame, key: str) -> DataFrame:
    totals = priced.filter(F.col(key).isNotNull()).groupBy(key, "sku_name").agg(*usage_and_cost())
    return totals.orderBy(key, *by_cost("sku_name"))


def cluster_sku_breakdown(priced: DataFrame) -> DataFrame:
    return _sku_breakdown(priced, "cluster_id")


def warehouse_sku_breakdown(priced: DataFrame) -> DataFrame:
    return _sku_breakdown(priced, "warehouse_id")


def _resource_cost(priced: DataFrame, key: str, value: str, start: date | None, end: date | None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end).filter(F.col(key) == value)
    return df.agg(total("usage_quantity").alias("total_usage"), total("cost").alias("total_cost")).select(
        F.lit(value).alias("resource_id"), "total_usage", "total_cost"
    )


def cluster_cost(priced: DataFrame, cluster_id: str, start: date | None = None, end: date | None = None) -> DataFrame:
    return _resource_cost(priced, "cluster_id", cluster_id, start, end)


def warehouse_cost(priced: DataFrame, warehouse_id: str, start: date | None = None, end: date | None = None) -> DataFrame:
    return _resource_cost(priced, "warehouse_id", warehouse_id, start, end)
