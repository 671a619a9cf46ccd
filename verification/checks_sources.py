"""Extracts, ingest, scoping and inventory."""

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from lakegauge.functions.checkpoints import ensure_checkpoint_dir
from lakegauge.operators import scope
from lakegauge.sources import extracts, files, ingest
from verification.fixtures import VIEWS
from verification.registry import check

START, END, AS_OF = date(1996, 12, 1), date(2000, 1, 31), date(2001, 11, 4)
RANGE = f"usage_date BETWEEN DATE '{START}' AND DATE '{END}'"
EV_START, EV_END = date(2024, 1, 1), date(2024, 1, 31)


def scratch(t):
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(t.spark)}/scratch-{uuid.uuid4().hex}"


# ---- snapshots and sinks ----
def _snapshots(t):
    root = scratch(t)
    c = t.clusters
    files.write_snapshot(c.filter("change_time IS NULL"), root, "clusters", date(2026, 4, 9))
    files.write_snapshot(c, root, "clusters", date(2026, 5, 9))
    files.write_snapshot(c.limit(0), root, "clusters", date(2026, 4, 24))
    files.write_snapshot(c.limit(1), root, "clusters", date(2026, 6, 1), prefix=files.DEMO_PREFIX)
    return root


CL = "cluster_id, cluster_name, workspace_id, owned_by, change_time"
check("src_latest_snapshot", f"SELECT {CL} FROM clusters")(lambda t: files.latest_snapshot(t.spark, _snapshots(t), "clusters").select(*CL.split(", ")))
check("sink_snapshot", "SELECT DATE '2026-04-09' AS snapshot_date, count(*) AS n FROM clusters WHERE change_time IS NULL UNION ALL SELECT DATE '2026-05-09', count(*) FROM clusters")(
    lambda t: files.snapshot_history(t.spark, _snapshots(t), "clusters").groupBy("snapshot_date").agg(F.count("*").alias("n"))
)


@check("sink_csv", "SELECT cluster_id, cluster_name, coalesce(owned_by, '') AS owned_by FROM clusters")
def _(t):
    path = scratch(t)
    files.write_csv(t.clusters.select("cluster_id", "cluster_name", "owned_by"), path)
    back = t.spark.read.option("header", True).option("lineSep", "\r\n").csv(path).toDF("cluster_id", "cluster_name", "owned_by")
    return back.fillna("")


# ---- extracts ----
def nested_usage(t):
    """Usage in its source shape, with nested metadata."""
    u = t.billing_usage
    return u.select(
        "account_id", "workspace_id", "record_id", "sku_name", "cloud", "usage_start_time", "usage_end_time", "usage_date", "usage_unit",
        "usage_quantity", "billing_origin_product", "usage_type", "record_type",
        F.struct("cluster_id", "warehouse_id", "job_id").alias("usage_metadata"),
        F.struct("run_as").alias("identity_metadata"),
        F.struct("is_serverless", "is_photon").alias("product_features"),
    )


def nested_prices(t):
    return t.list_prices.select(
        "account_id", "sku_name", "cloud", "currency_code", "usage_unit", "price_start_time", "price_end_time",
        F.struct(
            F.col("effective_list_price").cast("string").alias("default"),
            F.struct(F.when(F.col("sku_name") == "Brand#11", F.lit("n/a")).otherwise(F.col("effective_list_price").cast("string")).alias("default")).alias("effective_list"),
        ).alias("pricing"),
    )


PRICE = "CASE WHEN sku_name = 'Brand#11' THEN NULL ELSE effective_list_price END"
check("prices_extract", f"SELECT sku_name, cloud, price_start_time, price_end_time, effective_list_price AS default_price, {PRICE} AS effective_list_price FROM list_prices", num=("default_price", "effective_list_price"))(
    lambda t: extracts.extract_prices(nested_prices(t)).select("sku_name", "cloud", "price_start_time", "price_end_time", "default_price", "effective_list_price")
)
check("usage_extract", f"""SELECT u.record_id, u.usage_date, u.cluster_id, u.warehouse_id, u.job_id, u.run_as, u.is_serverless, u.usage_quantity,
 coalesce(u.usage_quantity * p.price, 0) AS usage_usd FROM (SELECT * FROM billing_usage WHERE {RANGE}) u LEFT JOIN
 (SELECT sku_name, usage_unit, price_start_time AS f, coalesce(price_end_time, TIMESTAMP '2001-11-05 00:00:00') AS e, {PRICE} AS price FROM list_prices) p
 ON u.sku_name = p.sku_name AND u.usage_unit = p.usage_unit AND u.usage_end_time BETWEEN p.f AND p.e""", num=("usage_quantity", "usage_usd"))(
    lambda t: extracts.extract_usage(nested_usage(t), nested_prices(t), START, END, AS_OF).select(
        "record_id", "usage_date", "cluster_id", "warehouse_id", "job_id", "run_as", "is_serverless", "usage_quantity", "usage_usd"
    )
)
check("flatten_config_tables", """SELECT 'clusters' AS table_name, cluster_id AS id, change_time AS at, CAST(NULL AS VARCHAR) AS category FROM clusters UNION ALL SELECT 'warehouses', warehouse_id, change_time, NULL FROM warehouses
 UNION ALL SELECT 'jobs', job_id, change_time, NULL FROM jobs UNION ALL SELECT 'workspaces', workspace_id, NULL, NULL FROM workspaces UNION ALL SELECT 'node_types', node_type, NULL, NULL FROM node_types
 UNION ALL SELECT 'instance_pools', instance_pool_id, NULL, NULL FROM instance_pools""")(lambda t: _config(t))


def _config(t):
    keys = {"clusters": "cluster_id", "warehouses": "warehouse_id", "jobs": "job_id", "workspaces": "workspace_id", "node_types": "node_type", "instance_pools": "instance_pool_id"}
    out = None
    for table, key in keys.items():
        source = t.view(table).drop("category")
        flat = extracts.extract_config(source, table)
        moment = F.col("change_time") if "change_time" in flat.columns else F.lit(None).cast("timestamp_ntz")
        category = F.col("category") if "category" in flat.columns else F.lit(None).cast("string")
        one = flat.select(F.lit(table).alias("table_name"), F.col(key).alias("id"), moment.alias("at"), category.alias("category"))
        out = one if out is None else out.unionByName(one)
    return out


check("query_history_extract", "SELECT statement_id, workspace_id, compute_type, job_id, start_time FROM query_history WHERE start_time >= TIMESTAMP '2024-01-05 00:00:00' AND start_time < TIMESTAMP '2024-01-13 00:00:00'")(
    lambda t: extracts.extract_query_history(t.nested_history, date(2024, 1, 5), date(2024, 1, 12)).select(
        "statement_id", "workspace_id", F.col("compute.type").alias("compute_type"), F.col("query_source.job_info.job_id").alias("job_id"), "start_time"
    )
)
LIN = "record_id, event_date, source_table_full_name, target_table_full_name, entity_id, statement_id, direct_access"
check("lineage_extract", f"SELECT {LIN} FROM table_lineage WHERE event_date BETWEEN DATE '2024-01-18' AND DATE '2024-01-31'")(
    lambda t: extracts.extract_table_lineage(t.table_lineage.withColumn("statement_id", F.col("statement_id").cast("bigint")), *extracts.lookback_window("table_lineage", EV_START, EV_END)).select(*LIN.split(", "))
)
CLIN = LIN + ", source_column_name, target_column_name"
check("column_lineage_extract", f"SELECT {CLIN} FROM column_lineage WHERE event_date BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' AND source_table_full_name IS NOT NULL")(
    lambda t: extracts.drop_sourceless(extracts.extract_column_lineage(t.column_lineage, *extracts.lookback_window("column_lineage", EV_START, EV_END))).select(*CLIN.split(", "))
)


@check("audit_extract", "SELECT event_id, user_identity_email, response_status_code, response_error_message, CASE WHEN user_identity_email IS NULL THEN '{}' ELSE concat('{\"email\":\"', user_identity_email, '\"}') END AS user_identity FROM audit_events WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'")
def _(t):
    nested = t.audit_events.withColumns(
        {
            "user_identity": F.struct(F.col("user_identity_email").alias("email")),
            "response": F.struct(F.col("response_status_code").alias("status_code"), F.col("response_error_message").alias("error_message")),
        }
    ).drop("user_identity_email", "response_status_code", "response_error_message")
    return extracts.extract_audit(nested, date(2024, 1, 10), date(2024, 1, 12)).select(
        "event_id", "user_identity_email", "response_status_code", "response_error_message", "user_identity"
    )


check("assistant_extract", "SELECT event_id, workspace_id, event_time, event_date, initiated_by FROM assistant_events WHERE event_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-31'")(
    lambda t: extracts.extract_assistant(t.assistant_events, *extracts.lookback_window("assistant_events", EV_START, EV_END)).select("event_id", "workspace_id", "event_time", "event_date", "initiated_by")
)


@check("node_events_extract", """SELECT 'node_timeline' AS table_name, event_date, count(*) AS n FROM node_timeline WHERE event_date >= DATE '2024-01-20' GROUP BY 2
 UNION ALL SELECT 'warehouse_events', event_date, count(*) FROM warehouse_events WHERE event_date >= DATE '2024-01-20' GROUP BY 2
 UNION ALL SELECT 'instance_events', CAST(event_time AS DATE), count(*) FROM instance_events WHERE event_time >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 2""")
def _(t):
    out = None
    for table in extracts.EVENT_TIMES:
        flat = extracts.extract_node_events(t.view(table).drop("event_date"), table, date(2024, 1, 20), EV_END)
        one = flat.groupBy("event_date").agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), "event_date", "n")
        out = one if out is None else out.unionByName(one)
    return out


EVENT_DATED = ["table_lineage", "column_lineage", "audit_events", "assistant_events", "node_timeline", "warehouse_events"]


@check("lookback_window", " UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS n, min(event_date) AS first_day FROM {x} WHERE event_date > DATE '2024-01-30' - {extracts.LOOKBACK_DAYS[x]} AND event_date >= DATE '2024-01-05' AND event_date <= DATE '2024-01-30'" for x in EVENT_DATED))
def _(t):
    out = None
    for table in EVENT_DATED:
        rows = extracts.read_days(t.view(table), "event_date", *extracts.lookback_window(table, date(2024, 1, 5), date(2024, 1, 30)))
        one = rows.agg(F.count("*").alias("n"), F.min("event_date").alias("first_day")).select(F.lit(table).alias("table_name"), "n", "first_day")
        out = one if out is None else out.unionByName(one)
    return out


check("chunked_read", "SELECT event_date, count(*) AS n FROM column_lineage WHERE event_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-17' GROUP BY 1")(
    lambda t: extracts.read_days(t.column_lineage, "event_date", date(2024, 1, 17), date(2024, 1, 3)).groupBy("event_date").agg(F.count("*").alias("n"))
)
check("missing_days", "SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT event_date FROM audit_events)")(
    lambda t: extracts.missing_days(t.audit_events, "event_date", date(2023, 12, 28), date(2024, 2, 5))
)


@check("catalog_crawl", "SELECT catalog, database, table_name, col_name, data_type, comment, CASE WHEN catalog = 'main' THEN table_owner END AS table_owner, DATE '2024-03-01' AS as_of FROM catalog_columns")
def _(t):
    c = t.catalog_columns

    def views(catalog, with_owner):
        part = c.filter(F.col("catalog") == catalog)
        columns = part.select("table_name", F.col("database").alias("table_schema"), F.col("col_name").alias("column_name"), "data_type", "comment")
        tables = part.groupBy("table_name", F.col("database").alias("table_schema")).agg(F.max("table_type").alias("table_type"), F.max("table_owner").alias("table_owner"))
        return columns, tables if with_owner else tables.drop("table_owner")

    sources = {"main": views("main", True), "sandbox": views("sandbox", False), "other": views("main", True)}
    crawled = extracts.catalog_crawl(sources, date(2024, 3, 1), exclude=["other"])
    return crawled.select("catalog", "database", "table_name", "col_name", "data_type", "comment", "table_owner", "as_of")


check("normalise_nested", "SELECT event_id, concat('{\"ip\":\"', source_ip_address, '\",\"level\":\"', audit_level, '\"}') AS params, concat('[\"', action_name, '\",\"', request_id, '\"]') AS parts FROM audit_events")(
    lambda t: extracts.normalise_nested(t.audit_events.select("event_id", F.create_map(F.lit("ip"), "source_ip_address", F.lit("level"), "audit_level").alias("params"), F.array("action_name", "request_id").alias("parts")))
)


@check("conform_columns", "SELECT workspace_id, CAST(NULL AS VARCHAR) AS account_id, workspace_name, status FROM workspaces")
def _(t):
    from lakegauge.functions.common import conform
    from lakegauge.schemas import struct

    return conform(t.workspaces.withColumn("extra", F.lit(1)), struct("workspaces")).select("workspace_id", "account_id", "workspace_name", "status")


# ---- ingest ----
SPLIT = "usage_date < DATE '1999-01-01'"


@check("append_dedup", """WITH r AS (SELECT record_id, data_origin, usage_date FROM billing_usage), e AS (SELECT * FROM r WHERE usage_date < DATE '1999-01-01'), n AS (SELECT * FROM r WHERE usage_date >= DATE '1998-06-01')
 SELECT n.data_origin, count(*) AS appended, count(DISTINCT n.record_id) AS records FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.record_id = n.record_id AND e.data_origin = n.data_origin) GROUP BY 1""")
def _(t):
    u = t.billing_usage.select("record_id", "data_origin", "usage_date")
    new = ingest.rows_to_append(u.filter("usage_date >= DATE '1998-06-01'"), u.filter(SPLIT), "record_id")
    return new.groupBy("data_origin").agg(F.count("*").alias("appended"), F.countDistinct("record_id").alias("records"))


def _load_usage(t):
    root = scratch(t) + "/billing_usage"
    u = t.billing_usage.select("record_id", "usage_date", "usage_quantity", "data_origin", "deleted_at")
    for origin in ("real", "demo"):
        files.replace_partition(u.filter(F.col("data_origin") == origin), root, origin)
    return root


@check("replace_partition", f"SELECT data_origin, count(*) AS n, sum(usage_quantity) AS qty FROM billing_usage WHERE data_origin = 'demo' OR {SPLIT} GROUP BY 1", num=("qty",))
def _(t):
    root = _load_usage(t)
    loaded = files.read_table(t.spark, root)
    files.replace_partition(loaded.filter((F.col("data_origin") == "real") & F.expr(SPLIT)), root, "real")
    return files.read_table(t.spark, root).groupBy("data_origin").agg(F.count("*").alias("n"), F.sum("usage_quantity").alias("qty"))


@check("upsert_keep_existing", """SELECT coalesce(n.workspace_id, e.workspace_id) AS workspace_id, coalesce(n.workspace_name, e.workspace_name) AS workspace_name, coalesce(n.status, e.status) AS status FROM
 (SELECT * FROM workspaces WHERE workspace_id <> 'ws-7') e FULL JOIN (SELECT workspace_id, CASE WHEN workspace_id = 'ws-3' THEN NULL ELSE workspace_name || ' 2' END AS workspace_name, 'NEW' AS status FROM workspaces WHERE workspace_id <> 'ws-0') n ON n.workspace_id = e.workspace_id""")
def _(t):
    w = t.workspaces.select("workspace_id", "workspace_name", "status")
    new = w.filter("workspace_id <> 'ws-0'").select(
        "workspace_id", F.when(F.col("workspace_id") != "ws-3", F.concat("workspace_name", F.lit(" 2"))).alias("workspace_name"), F.lit("NEW").alias("status")
    )
    return ingest.upsert_keep_existing(w.filter("workspace_id <> 'ws-7'"), new)


check("backfill_stubs", "SELECT workspace_id, workspace_name, status FROM workspaces UNION ALL SELECT DISTINCT workspace_id, NULL, NULL FROM billing_usage WHERE workspace_id NOT IN (SELECT workspace_id FROM workspaces)")(
    lambda t: ingest.backfill_stubs(t.workspaces.select("workspace_id", "workspace_name", "status"), t.billing_usage)
)


@check("ingest_all", """SELECT 'clusters' AS table_name, count(*) AS rows FROM clusters UNION ALL SELECT 'workspaces', count(*) FROM workspaces UNION ALL SELECT 'audit_events', count(*) FROM audit_events
 UNION ALL SELECT 'column_lineage', count(*) FROM column_lineage WHERE source_table_full_name IS NOT NULL""")
def _(t):
    frames = {x: t.view(x) for x in ("workspaces", "clusters", "audit_events", "column_lineage", "jobs")}
    return ingest.ingest_all(t.spark, frames, scratch(t), only={"workspaces", "clusters", "audit_events", "column_lineage"})


@check("incremental_load", """SELECT 'billing_usage' AS table_name, count(*) AS rows_ingested, max(usage_end_time) AS max_update_time, max(record_id) AS max_record_id FROM billing_usage WHERE usage_end_time > (SELECT max(usage_end_time) FROM billing_usage WHERE usage_date < DATE '1999-01-01')""")
def _(t):
    root = scratch(t)
    u = t.billing_usage.drop("data_origin", "deleted_at")
    ingest.incremental_load(t.spark, {"billing_usage": u.filter(SPLIT)}, root)
    run = ingest.incremental_load(t.spark, {"billing_usage": u}, root)
    return run.select("table_name", "rows_ingested", "max_update_time", "max_record_id")


AT = datetime(2030, 1, 1)
STATE = "count(*) AS n, count(deleted_at) AS deleted"
check("soft_delete", f"SELECT data_origin, count(*) AS n, CASE WHEN data_origin = 'demo' THEN count(*) ELSE count(deleted_at) END AS deleted FROM billing_usage GROUP BY 1")(
    lambda t: ingest.soft_delete(t.billing_usage, "demo", AT).groupBy("data_origin").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))
)
check("restore", "SELECT data_origin, count(*) AS n, CASE WHEN data_origin = 'real' THEN 0 ELSE count(deleted_at) END AS deleted FROM billing_usage GROUP BY 1")(
    lambda t: ingest.restore(t.billing_usage, "real").groupBy("data_origin").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))
)
check("hard_delete", f"SELECT data_origin, {STATE} FROM billing_usage WHERE data_origin = 'real' GROUP BY 1")(
    lambda t: ingest.hard_delete(t.billing_usage, "demo").groupBy("data_origin").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))
)
ORIGINATED = ["billing_usage", "list_prices", "query_history", "table_lineage", "audit_events", "catalog_columns"]


def _state(x):
    state = "'live'" if "deleted_at" not in VIEWS[x][1] else "CASE WHEN deleted_at IS NULL THEN 'live' ELSE 'deleted' END"
    return f"SELECT '{x}' AS table_name, o.origin, s.state, count(d.st) AS n FROM (SELECT unnest(['real', 'demo']) AS origin) o CROSS JOIN (SELECT unnest(['live', 'deleted']) AS state) s LEFT JOIN (SELECT data_origin, {state} AS st FROM {x}) d ON d.data_origin = o.origin AND d.st = s.state GROUP BY 1, 2, 3"


check("origin_state_counts", " UNION ALL ".join(_state(x) for x in ORIGINATED))(lambda t: ingest.origin_state_counts({x: t.view(x) for x in ORIGINATED}))
check("table_counts", " UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS rows FROM {x}" for x in VIEWS))(lambda t: ingest.table_counts({x: t.view(x) for x in VIEWS}))
PROFILED = ["workspace_id", "cluster_id", "owned_by", "driver_node_type", "worker_count"]
check("profile_columns", " UNION ALL ".join(f"SELECT 'clusters' AS table_name, '{c}' AS column_name, '{'int' if c == 'worker_count' else 'string'}' AS data_type, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM clusters WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)) AS sample_values" for c in PROFILED))(
    lambda t: ingest.profile_columns(t.clusters.select(*PROFILED), "clusters").withColumn("sample_values", F.array_join("sample_values", "|"))
)
check("relationship_coverage", " UNION ALL ".join(f"SELECT '{a}' AS table_name, '{b}' AS column_name, '{c}' AS related_table, '{d}' AS related_column, (SELECT count(DISTINCT {b}) FROM {a}) AS keys, (SELECT count(DISTINCT {b}) FROM {a} WHERE {b} IN (SELECT {d} FROM {c})) AS matched" for a, b, c, d in ingest.RELATIONSHIPS if d in VIEWS[c][1]))(
    lambda t: ingest.relationship_coverage({x: t.view(x) for x in ("billing_usage", "list_prices", "clusters", "warehouses", "jobs", "workspaces")})
)
MATERIALISED = ["clusters", "workspaces", "jobs", "list_prices"]
check("materialise_tables", " UNION ALL ".join(f"SELECT '{x}_copy' AS table_name, count(*) AS rows FROM {x}" for x in MATERIALISED))(
    lambda t: files.materialise_tables(t.spark, {f"{x}_copy": t.view(x) for x in MATERIALISED}, scratch(t))
)


@check("safe_timestamp", "SELECT statement_id, CASE WHEN CAST(statement_id AS BIGINT) % 4 = 3 THEN NULL WHEN CAST(statement_id AS BIGINT) % 4 = 0 THEN date_trunc('second', start_time) ELSE date_trunc('day', start_time) END AS parsed FROM query_history")
def _(t):
    k = F.col("statement_id").cast("bigint") % 4
    text = (
        F.when(k == 0, F.date_format("start_time", "dd.MM.yyyy HH:mm:ss")).when(k == 1, F.date_format("start_time", "yyyy-MM-dd"))
        .when(k == 2, F.date_format("start_time", "MM/dd/yyyy")).otherwise(F.lit("soon"))
    )
    rows = t.query_history.select("statement_id", text.alias("text"))
    return rows.select("statement_id", extracts.safe_timestamp(F.col("text"), ["dd.MM.yyyy HH:mm:ss"]).cast("timestamp_ntz").alias("parsed"))


LOG = "(SELECT client_application AS provider, statement_type AS execution_type, execution_status FROM query_history WHERE start_time > TIMESTAMP '2024-01-16 00:00:00')"
OK = "avg(CASE WHEN execution_status = 'FINISHED' THEN 100.0 ELSE 0.0 END) AS success_rate"


@check("interaction_log_stats", f"SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS label, count(*) AS executions, {OK} FROM {LOG} UNION ALL SELECT 'provider', provider, count(*), {OK} FROM {LOG} GROUP BY 2 UNION ALL SELECT 'type', execution_type, count(*), {OK} FROM {LOG} GROUP BY 2", num=("success_rate",))
def _(t):
    log = t.query_history.select(
        F.col("start_time").alias("timestamp"), F.col("client_application").alias("provider"), F.col("statement_type").alias("execution_type"),
        F.when(F.col("execution_status") == "FINISHED", "success").otherwise("error").alias("execution_status"),
    )
    return ingest.interaction_log_stats(log, datetime(2024, 1, 31), 15)


# ---- scoping ----
check("scope_origin", "SELECT 'real' AS mode, count(*) AS n FROM billing_usage WHERE data_origin = 'real' AND deleted_at IS NULL UNION ALL SELECT 'demo', count(*) FROM billing_usage WHERE data_origin = 'demo' AND deleted_at IS NULL UNION ALL SELECT 'none', count(*) FROM billing_usage")(
    lambda t: scope.scope_origin(t.billing_usage, "bogus").agg(F.lit("real").alias("mode"), F.count("*").alias("n"))
    .unionByName(scope.scope_origin(t.billing_usage, "demo").agg(F.lit("demo").alias("mode"), F.count("*").alias("n")))
    .unionByName(scope.scope_origin(t.billing_usage, None).agg(F.lit("none").alias("mode"), F.count("*").alias("n")))
)
POLICY = {"workspace_ids": ["ws-1", "ws-2", "ws-3"], "clouds": ["AZURE"], "billing_origins": ["JOBS", "SQL"], "sku_name_patterns": ["brand#1%", "%#25"]}
check("scope_billing_policy", "SELECT workspace_id, sku_name, count(*) AS n FROM billing_usage WHERE workspace_id IN ('ws-1', 'ws-2', 'ws-3') AND cloud = 'AZURE' AND billing_origin_product IN ('JOBS', 'SQL') AND (sku_name ILIKE 'brand#1%' OR sku_name ILIKE '%#25') GROUP BY 1, 2")(
    lambda t: scope.scope_billing_policy(t.billing_usage, POLICY).groupBy("workspace_id", "sku_name").agg(F.count("*").alias("n"))
)
check("scope_cluster_policy", "SELECT * FROM clusters WHERE workspace_id IN ('ws-1', 'ws-2') AND cluster_source IN ('JOB', 'UI')")(
    lambda t: scope.scope_cluster_policy(t.clusters, {"workspace_ids": ["ws-1", "ws-2"], "cluster_sources": ["JOB", "UI"]})
)
check("scope_workspace_policy", "SELECT warehouse_id AS id FROM warehouses WHERE workspace_id IN ('ws-1') UNION ALL SELECT statement_id FROM query_history WHERE workspace_id IN ('ws-1')")(
    lambda t: scope.scope_workspace_policy(t.warehouses, {"workspace_ids": ["ws-1"]}).select(F.col("warehouse_id").alias("id"))
    .unionByName(scope.scope_workspace_policy(t.query_history, {"workspace_ids": ["ws-1"]}).select(F.col("statement_id").alias("id")))
)


def role_rows(t):
    """Roles derived from cluster ownership: each owner has one role per cluster source they use."""
    c = t.clusters.filter("owned_by IS NOT NULL")
    rows = c.select(F.col("owned_by").alias("user"), F.col("cluster_source").alias("role"), F.lit(False).alias("is_system"), F.lit("workspace_ids").alias("dim"), F.col("workspace_id").alias("value")).filter("NOT (role = 'UI' AND value IN ('ws-4', 'ws-7'))")
    bare = c.filter("cluster_source = 'UI'").select(F.col("owned_by").alias("user"), F.col("cluster_source").alias("role"), F.lit(False).alias("is_system"), F.lit(None).cast("string").alias("dim"), F.lit(None).cast("string").alias("value"))
    return rows.unionByName(bare).distinct()


ROLES = """(SELECT DISTINCT owned_by AS u, cluster_source AS role, workspace_id AS v FROM clusters WHERE owned_by IS NOT NULL AND NOT (cluster_source = 'UI' AND workspace_id IN ('ws-4', 'ws-7'))
 UNION SELECT owned_by, cluster_source, NULL FROM clusters WHERE owned_by IS NOT NULL AND cluster_source = 'UI')"""
EFF = f"""SELECT DISTINCT r.u AS "user", 'workspace_ids' AS dim, r.v AS value FROM {ROLES} r JOIN (SELECT u FROM {ROLES} GROUP BY 1 HAVING count(DISTINCT role) = count(DISTINCT CASE WHEN v IS NOT NULL THEN role END)) k ON r.u = k.u WHERE r.v IS NOT NULL"""
check("effective_policy", EFF)(lambda t: scope.effective_policy_table(role_rows(t)))


@check("policy_join", f"""SELECT e."user", b.workspace_id, b.total_cost FROM ({EFF}) e JOIN (SELECT workspace_id, sum(cost) AS total_cost FROM bu GROUP BY 1) b ON b.workspace_id = e.value""", num=("total_cost",))
def _(t):
    sums = t.bu.groupBy("workspace_id").agg(F.sum("cost").alias("total_cost"))
    return scope.policy_join(sums, scope.effective_policy_table(role_rows(t)), "workspace_ids", "workspace_id")


@check("scoped_views", "SELECT b.workspace_id, count(*) AS n, count(DISTINCT c.cluster_id) AS clusters FROM bu b JOIN clusters c ON b.cluster_id = c.cluster_id WHERE b.workspace_id IN ('ws-1', 'ws-5') AND c.workspace_id IN ('ws-1', 'ws-5') GROUP BY 1")
def _(t):
    scope.scoped_views(t.spark, {"billing_usage": t.billing_usage, "clusters": t.clusters}, "real", {"workspace_ids": ["ws-1", "ws-5"]})
    answer = t.spark.sql("SELECT b.workspace_id, count(*) AS n, count(DISTINCT c.cluster_id) AS clusters FROM billing_usage b JOIN clusters c ON b.cluster_id = c.cluster_id GROUP BY 1")
    for name in ("billing_usage", "clusters"):
        t.spark.catalog.dropTempView(name)
    return answer


check("policy_dimension_values", """SELECT DISTINCT 'workspace_ids' AS dimension, workspace_id AS value FROM billing_usage UNION ALL SELECT DISTINCT 'clouds', cloud FROM billing_usage
 UNION ALL SELECT DISTINCT 'billing_origins', billing_origin_product FROM billing_usage UNION ALL SELECT DISTINCT 'cluster_sources', cluster_source FROM clusters""")(lambda t: scope.policy_dimension_values(t.billing_usage, t.clusters))

_REFUSED = "|".join(scope.SAFETY_RULES["spark"]["refused"])
_FIRST = "|".join(scope.SAFETY_RULES["spark"]["first"])
check("sql_text_safety", f"""SELECT statement_id, reason, reason IS NULL AS is_safe FROM (SELECT statement_id, CASE WHEN b = '' THEN 'empty' WHEN contains(regexp_replace(b, ';+$', ''), ';') THEN 'multiple_statements'
 WHEN NOT regexp_matches(b, '(?i)^({_FIRST})\\b') THEN 'first_keyword' WHEN regexp_matches(b, '(?i)\\b({_REFUSED})\\b') THEN 'refused:' || upper(regexp_extract(b, '(?i)\\b({_REFUSED})\\b', 1)) END AS reason
 FROM (SELECT statement_id, trim(regexp_replace(statement_text, '--[^\\n]*', '', 'g')) AS b FROM query_history))""")(
    lambda t: scope.sql_text_safety(t.query_history, "statement_text").select("statement_id", "reason", "is_safe")
)
