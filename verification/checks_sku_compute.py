"""SKU x origin views and compute inventory."""

from datetime import date

from pyspark.sql import functions as F

from lakegauge.operators import billing, compute, sku_origin
from lakegauge.operators.scope import scope_origin
from verification.checks_billing import LATEST_C, LATEST_W, PRICED, SUMS, UC
from verification.registry import check

AS_OF = date(2001, 11, 4)
START, END = sku_origin.default_window(None, None, AS_OF)
IN_W = f"usage_date BETWEEN DATE '{START}' AND DATE '{END}'"
W = dict(start=START, end=END)


def shown(df):
    """Arrays of money as text, so that both engines print them alike."""
    text = F.array_join(F.transform("sparkline", lambda x: F.round(x, 2).cast("string")), ",")
    return df.withColumn("sparkline", text)


def spark_sql(key):
    return f"""(SELECT {key}, string_agg(CAST(round(CAST(c AS DECIMAL(20,6)), 2) AS VARCHAR), ',' ORDER BY b) AS sparkline FROM (
      SELECT k.{key}, g.b, coalesce(sum(d.cost), 0) AS c FROM (SELECT DISTINCT {key} FROM bu WHERE {IN_W}) k CROSS JOIN (SELECT unnest(range(0, 30)) AS b) g
      LEFT JOIN (SELECT {key}, cost, greatest(0, least(29, CAST(floor(date_diff('day', DATE '{START}', usage_date) / 3.0) AS INT))) AS b FROM bu WHERE {IN_W}) d
      ON k.{key} = d.{key} AND g.b = d.b GROUP BY 1, 2) GROUP BY 1)"""


@check("treemap", f"SELECT sku_name, billing_origin_product, {SUMS} FROM bu GROUP BY 1, 2 ORDER BY total_cost DESC, 1, 2 LIMIT 200", num=UC)
def _(t):
    return sku_origin.treemap(t.bu)


@check("treemap_folded", "SELECT billing_origin_product, sum(cost) AS total_cost, count(DISTINCT sku_name) AS n_children, arg_max(sku_name, c) AS first_child FROM (SELECT billing_origin_product, sku_name, sum(cost) AS cost, sum(cost) AS c FROM bu GROUP BY 1, 2) GROUP BY 1", num=("total_cost",))
def _(t):
    folded = sku_origin.treemap_folded(sku_origin.treemap(t.bu, 1000))
    return folded.select(
        "billing_origin_product", "total_cost", F.size("children").cast("bigint").alias("n_children"),
        F.col("children")[0]["sku_name"].alias("first_child"),
    )


@check("sparkline", f"SELECT * FROM {spark_sql('sku_name')}")
def _(t):
    return shown(sku_origin.sparkline(t.bu, "sku_name", START, END, 30))


@check(
    "sku_leaderboard",
    f"""WITH s AS (SELECT sku_name, {SUMS}, count(DISTINCT workspace_id) AS workspace_count FROM bu WHERE {IN_W} GROUP BY 1 ORDER BY total_cost DESC, 1 LIMIT 15),
    o AS (SELECT sku_name, billing_origin_product, row_number() OVER (PARTITION BY sku_name ORDER BY sum(cost) DESC, billing_origin_product) AS rn FROM bu WHERE {IN_W} GROUP BY 1, 2)
    SELECT s.*, CAST(total_cost AS DOUBLE) / CAST(nullif(total_usage, 0) AS DOUBLE) AS cost_per_unit, o.billing_origin_product AS primary_billing_origin, l.sparkline
    FROM s LEFT JOIN o ON s.sku_name = o.sku_name AND o.rn = 1 LEFT JOIN {spark_sql('sku_name')} l ON s.sku_name = l.sku_name""",
    num=(*UC, "cost_per_unit"),
)
def _(t):
    return shown(sku_origin.sku_leaderboard(t.bu, **W))


SERVERLESS = """sum(CASE WHEN is_serverless THEN cost ELSE 0 END) AS serverless_cost, sum(CASE WHEN NOT is_serverless THEN cost ELSE 0 END) AS classic_cost,
 sum(CASE WHEN is_serverless IS NULL THEN cost ELSE 0 END) AS unknown_cost"""
SPCT = "CASE WHEN serverless_cost + classic_cost > 0 THEN CAST(serverless_cost * 100 AS DOUBLE) / CAST(serverless_cost + classic_cost AS DOUBLE) END"


@check(
    "origin_leaderboard",
    f"""WITH s AS (SELECT billing_origin_product, {SUMS}, count(DISTINCT sku_name) AS sku_count, count(DISTINCT workspace_id) AS workspace_count, {SERVERLESS}
      FROM bu WHERE {IN_W} GROUP BY 1 ORDER BY total_cost DESC, 1 LIMIT 15)
    SELECT s.billing_origin_product, total_cost, total_usage, sku_count, workspace_count, {SPCT} AS serverless_share_pct, l.sparkline
    FROM s JOIN {spark_sql('billing_origin_product')} l ON s.billing_origin_product = l.billing_origin_product""",
    num=(*UC, "serverless_share_pct"),
)
def _(t):
    return shown(sku_origin.origin_leaderboard(t.bu, **W))


def pivot_sql(row, col, n, m, skip=False):
    where = f"WHERE {col} IS NOT NULL" if skip else ""
    return f"""SELECT {row} AS row, {col} AS col, sum(cost) AS total_cost FROM bu
    WHERE {row} IN (SELECT {row} FROM bu GROUP BY 1 ORDER BY sum(cost) DESC, 1 LIMIT {n})
      AND {col} IN (SELECT {col} FROM bu {where} GROUP BY 1 ORDER BY sum(cost) DESC, 1 NULLS LAST LIMIT {m}) GROUP BY 1, 2"""


@check("pivot_topn", pivot_sql("usage_type", "run_as", 4, 5), num=("total_cost",))
def _(t):
    return sku_origin.pivot_topn(t.bu, "usage_type", "run_as", 4, 5)


for _key, _row, _col, _skip in [
    ("sku_workspace_matrix", "sku_name", "workspace_id", False),
    ("origin_workspace_matrix", "billing_origin_product", "workspace_id", False),
    ("sku_identity", "sku_name", "run_as", True),
    ("origin_identity", "billing_origin_product", "run_as", True),
]:
    check(_key, pivot_sql(_row, _col, 15, 15, _skip), num=("total_cost",))(lambda t, k=_key: getattr(sku_origin, k)(t.bu))


@check("null_identity_cost", "SELECT coalesce(sum(cost), 0) AS null_cost FROM bu WHERE run_as IS NULL", num=("null_cost",))
def _(t):
    return sku_origin.null_column_total(t.bu, "run_as")


def conc_sql(parent, child, name):
    def shares(c, n):
        return f"""(SELECT {parent} AS p, {', '.join(f"CASE WHEN sum(c) > 0 THEN CAST(sum(CASE WHEN rn <= {k} THEN c ELSE 0 END) * 100 AS DOUBLE) / CAST(sum(c) AS DOUBLE) END AS top{k}_{n}_pct" for k in (1, 3, 5))}
        FROM (SELECT {parent}, {c}, sum(cost) AS c, row_number() OVER (PARTITION BY {parent} ORDER BY sum(cost) DESC, {c} NULLS LAST) AS rn FROM bu GROUP BY 1, 2) GROUP BY 1)"""

    return f"""SELECT g.p AS label, g.total_cost, a.* EXCLUDE (p), b.* EXCLUDE (p) FROM (SELECT {parent} AS p, sum(cost) AS total_cost FROM bu GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) g
    JOIN {shares(child, name)} a ON g.p = a.p JOIN {shares('workspace_id', 'workspace')} b ON g.p = b.p"""


for _key, _parent, _child, _name in [
    ("concentration_by_origin", "billing_origin_product", "sku_name", "sku"),
    ("concentration_by_sku", "sku_name", "billing_origin_product", "origin"),
]:
    check(_key, conc_sql(_parent, _child, _name), num=("total_cost", *[f"top{k}_{n}_pct" for n in (_name, "workspace") for k in (1, 3, 5)]))(
        lambda t, k=_key: getattr(sku_origin, k)(t.bu)
    )


@check(
    "cost_trend_stacked",
    f"""WITH x AS (SELECT * FROM bu WHERE {IN_W} AND billing_origin_product = 'JOBS'),
    h AS (SELECT workspace_id FROM x GROUP BY 1 ORDER BY sum(cost) DESC, 1 LIMIT 5),
    d AS (SELECT usage_date, coalesce(h.workspace_id, 'other') AS label, sum(cost) AS c FROM x LEFT JOIN h ON x.workspace_id = h.workspace_id GROUP BY 1, 2),
    g AS (SELECT usage_date, label FROM (SELECT DISTINCT usage_date FROM d) CROSS JOIN (SELECT workspace_id AS label FROM h UNION ALL SELECT 'other'))
    SELECT g.usage_date, g.label, coalesce(d.c, 0) AS total_cost FROM g LEFT JOIN d ON g.usage_date = d.usage_date AND g.label = d.label
    UNION ALL SELECT usage_date, 'total', sum(c) FROM d GROUP BY 1""",
    num=("total_cost",),
)
def _(t):
    return sku_origin.cost_trend_stacked(t.bu, START, END, 5, billing_origin="JOBS")


@check(
    "serverless_share",
    f"""SELECT *, serverless_cost + classic_cost + unknown_cost AS total_cost, {SPCT} AS serverless_pct FROM
    (SELECT billing_origin_product, {SERVERLESS} FROM bu GROUP BY 1)""",
    num=("serverless_cost", "classic_cost", "unknown_cost", "total_cost", "serverless_pct"),
)
def _(t):
    return sku_origin.serverless_share(t.bu)


SLICE = f"(SELECT * FROM bu WHERE {IN_W} AND sku_name = 'Brand#12')"


def part(t):
    return sku_origin.drill_slice(t.bu, START, END, sku_name="Brand#12")


@check("drill_totals", f"SELECT {SUMS} FROM {SLICE}", num=UC)
def _(t):
    return sku_origin.drill_totals(part(t))


@check("drill_trend", f"SELECT usage_date, sum(cost) AS total_cost FROM {SLICE} GROUP BY 1", num=("total_cost",))
def _(t):
    return sku_origin.drill_trend(part(t))


@check("drill_top_workspaces", f"SELECT workspace_id AS label, {SUMS} FROM {SLICE} GROUP BY 1 ORDER BY total_cost DESC, 1 LIMIT 10", num=UC)
def _(t):
    return sku_origin.drill_top_workspaces(part(t))


@check("drill_top_identities", f"SELECT run_as AS label, {SUMS} FROM {SLICE} WHERE run_as IS NOT NULL GROUP BY 1 ORDER BY total_cost DESC, 1 LIMIT 10", num=UC)
def _(t):
    return sku_origin.drill_top_identities(part(t))


def owner_sql(config, key, owner, source):
    return f"""(SELECT {owner} AS owner, '{source}' AS source, count(DISTINCT s.{key}) AS resource_count, sum(cost) AS total_cost
      FROM {SLICE} s JOIN {config} c ON s.{key} = c.{key} WHERE {owner} IS NOT NULL GROUP BY 1 ORDER BY total_cost DESC, 1 LIMIT 10)"""


@check(
    "drill_owners",
    f"SELECT * FROM {owner_sql(LATEST_C, 'cluster_id', 'owned_by', 'cluster')} UNION ALL SELECT * FROM {owner_sql(LATEST_W, 'warehouse_id', 'created_by', 'warehouse')} "
    f"UNION ALL SELECT * FROM {owner_sql('jobs', 'job_id', 'creator_id', 'job')}",
    num=("total_cost",),
)
def _(t):
    return sku_origin.drill_owners(part(t), t.clusters, t.warehouses, t.jobs)


# ---- compute ----

_SPEC_ROWS = ", ".join(
    "(" + ", ".join(("NULL" if v is None else v if i in (3, 4, 5, 6) else f"'{v}'") for i, v in enumerate(r)) + ")"
    for r in compute._parse(compute.NODE_SPECS)
)
SPECS = f"(SELECT * FROM (VALUES {_SPEC_ROWS}) AS s(node_type, cloud, family, vcpus, memory_gb, local_disk_gb, gpu_count, gpu_type))"
_SIZE_ROWS = ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in compute._parse(compute.WAREHOUSE_SIZES))
SIZES = f"(SELECT * FROM (VALUES {_SIZE_ROWS}) AS s(size, label, dbu, n))"


@check("latest_by_key", f"SELECT cluster_id, cluster_name, change_time FROM {LATEST_C}")
def _(t):
    return billing.latest_clusters(t.clusters).select("cluster_id", "cluster_name", "change_time")


CAP = f"""SELECT c.*, d.vcpus AS driver_vcpus, CAST(d.memory_gb AS DOUBLE) AS driver_memory_gb, d.family AS driver_family,
 CASE WHEN c.driver_node_type IS NOT NULL THEN coalesce(d.gpu_count > 0, FALSE) END AS driver_has_gpu,
 CAST(coalesce(max_autoscale_workers, worker_count, 0) AS INT) AS effective_workers,
 CAST(d.vcpus + coalesce(w.vcpus * coalesce(max_autoscale_workers, worker_count, 0), 0) AS INT) AS total_vcpus,
 CAST(d.memory_gb + coalesce(w.memory_gb * coalesce(max_autoscale_workers, worker_count, 0), 0) AS DOUBLE) AS total_memory_gb"""
CAPJ = f"LEFT JOIN {SPECS} d ON c.driver_node_type = d.node_type LEFT JOIN {SPECS} w ON c.worker_node_type = w.node_type"
INV = "cluster_id, cluster_name, workspace_id, owned_by, driver_node_type, worker_node_type, driver_vcpus, driver_memory_gb, driver_family, driver_has_gpu, effective_workers, total_vcpus, total_memory_gb".split(", ")


@check("cluster_inventory", f"SELECT {', '.join(INV)} FROM ({CAP} FROM clusters c {CAPJ})")
def _(t):
    return compute.cluster_inventory(t.clusters, page_size=None).select(*INV)


@check(
    "cluster_inventory_page",
    f"""SELECT {', '.join(INV)} FROM ({CAP} FROM clusters c {CAPJ}) WHERE (cluster_name ILIKE '%supplier%' OR cluster_id ILIKE '%supplier%' OR owned_by ILIKE '%supplier%')
    AND driver_has_gpu = FALSE AND total_vcpus >= 8 ORDER BY total_memory_gb DESC NULLS LAST, cluster_name, cluster_id LIMIT 20 OFFSET 20""",
)
def _(t):
    return compute.cluster_inventory(
        t.clusters, search="supplier", has_gpu=False, min_vcpus=8, sort_by="total_memory_gb", descending=True, page=2
    ).select(*INV)


@check("warehouse_inventory", "SELECT * FROM warehouses WHERE warehouse_name ILIKE '%WH-1%' OR warehouse_id ILIKE '%WH-1%'")
def _(t):
    return compute.warehouse_inventory(t.warehouses, search="WH-1", page_size=None)


@check(
    "node_specs",
    f"""SELECT u.node_type, u.n_configs, s.cloud, s.family, s.vcpus, CAST(s.memory_gb AS DOUBLE) AS memory_gb, CAST(s.local_disk_gb AS DOUBLE) AS local_disk_gb, s.gpu_count, s.gpu_type
    FROM (SELECT node_type, count(*) AS n_configs FROM (SELECT driver_node_type AS node_type FROM clusters UNION ALL SELECT worker_node_type FROM clusters)
    WHERE node_type IS NOT NULL GROUP BY 1) u LEFT JOIN {SPECS} s ON u.node_type = s.node_type""",
)
def _(t):
    return compute.node_spec_coverage(t.clusters)


WSIZE = f"""SELECT w.*, s.label AS size_label, s.dbu AS size_dbu_per_hour, s.n AS size_cluster_count,
 CAST(s.dbu * CASE WHEN coalesce(max_clusters, 0) = 0 THEN 1 ELSE max_clusters END AS INT) AS max_dbu_per_hour"""


@check("warehouse_sizes", f"{WSIZE} FROM warehouses w LEFT JOIN {SIZES} s ON upper(w.warehouse_size) = s.size")
def _(t):
    return compute.with_warehouse_size(t.warehouses)


LPRICED = f"(SELECT * EXCLUDE (list_cost), list_cost AS cost FROM ({PRICED}))"


def list_priced(t):
    return billing.cost_from_prices(scope_origin(t.billing_usage), t.lp)


def life(key):
    return f"""(SELECT {key}, {SUMS}, max(usage_date) AS last_usage_date, coalesce(bool_or(is_photon), FALSE) AS is_photon_observed,
    coalesce(bool_or(is_serverless), FALSE) AS is_serverless_observed FROM {LPRICED} WHERE {key} IS NOT NULL GROUP BY 1)"""


LIFE = "coalesce(l.total_usage, 0) AS total_usage, coalesce(l.total_cost, 0) AS total_cost, l.last_usage_date, coalesce(l.is_photon_observed, FALSE) AS is_photon_observed, coalesce(l.is_serverless_observed, FALSE) AS is_serverless_observed"
DET = ["cluster_id", "cluster_name", "driver_vcpus", "total_vcpus", "total_memory_gb", "total_usage", "total_cost", "last_usage_date", "is_photon_observed", "is_serverless_observed"]


@check("cluster_detail", f"SELECT c.cluster_id, cluster_name, driver_vcpus, total_vcpus, total_memory_gb, {LIFE} FROM ({CAP} FROM {LATEST_C} c {CAPJ}) c LEFT JOIN {life('cluster_id')} l ON c.cluster_id = l.cluster_id", num=UC)
def _(t):
    return compute.cluster_detail(t.clusters, list_priced(t)).select(*DET)


@check("cluster_sku_breakdown", f"SELECT cluster_id, sku_name, {SUMS} FROM {LPRICED} WHERE cluster_id IS NOT NULL GROUP BY 1, 2", num=UC)
def _(t):
    return compute.cluster_sku_breakdown(list_priced(t))


@check("warehouse_detail", f"SELECT c.warehouse_id, warehouse_name, size_label, max_dbu_per_hour, {LIFE} FROM ({WSIZE} FROM {LATEST_W} w LEFT JOIN {SIZES} s ON upper(w.warehouse_size) = s.size) c LEFT JOIN {life('warehouse_id')} l ON c.warehouse_id = l.warehouse_id", num=UC)
def _(t):
    return compute.warehouse_detail(t.warehouses, list_priced(t)).select(
        "warehouse_id", "warehouse_name", "size_label", "max_dbu_per_hour", "total_usage", "total_cost",
        "last_usage_date", "is_photon_observed", "is_serverless_observed",
    )


@check("warehouse_sku_breakdown", f"SELECT warehouse_id, sku_name, {SUMS} FROM {LPRICED} WHERE warehouse_id IS NOT NULL GROUP BY 1, 2", num=UC)
def _(t):
    return compute.warehouse_sku_breakdown(list_priced(t))


@check("cluster_cost", f"SELECT 'c-7' AS resource_id, coalesce(sum(usage_quantity), 0) AS total_usage, coalesce(sum(cost), 0) AS total_cost FROM {LPRICED} WHERE cluster_id = 'c-7' AND usage_date >= DATE '1997-01-01'", num=UC)
def _(t):
    return compute.cluster_cost(list_priced(t), "c-7", start=date(1997, 1, 1))


@check("warehouse_cost", f"SELECT 'w-3' AS resource_id, coalesce(sum(usage_quantity), 0) AS total_usage, coalesce(sum(cost), 0) AS total_cost FROM {LPRICED} WHERE warehouse_id = 'w-3'", num=UC)
def _(t):
    return compute.warehouse_cost(list_priced(t), "w-3")
