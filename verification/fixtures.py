"""The driver's tables presented as platform telemetry (see FIXTURES.md).

Each view is defined once, in SQL that Spark and DuckDB read alike: Spark gets a DataFrame, the oracle a CTE.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.operators import scope

DRIVER_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
_EVENTS = f"(SELECT *, {_K} AS k FROM events) e"
_ORIGIN = "CASE WHEN event_id % 20 = 0 THEN 'demo' ELSE 'real' END"
_DELETED = "CASE WHEN event_id % 97 = 0 THEN TIMESTAMP_NTZ '2024-02-01 00:00:00' END"

_STATEMENTS = """CASE event_id % 8
 WHEN 0 THEN concat('SELECT * FROM main.silver.t', CAST(user_id % 20 AS STRING), ' WHERE id = ', CAST(k AS STRING))
 WHEN 1 THEN concat('WITH c AS (SELECT a, b FROM main.bronze.t', CAST(user_id % 20 AS STRING), ') SELECT a, count(b) FROM c GROUP BY a')
 WHEN 2 THEN concat('INSERT INTO main.gold.t', CAST(user_id % 20 AS STRING), ' SELECT x.a FROM main.silver.t', CAST(k % 20 AS STRING), ' x JOIN main.bronze.t', CAST(user_id % 20 AS STRING), ' y ON x.id = y.id')
 WHEN 3 THEN concat('GRANT SELECT ON TABLE main.gold.t', CAST(user_id % 20 AS STRING), ' TO analysts')
 WHEN 4 THEN concat('df = spark.read.table("`main`.`bronze`.`t', CAST(user_id % 20 AS STRING), '`")')
 WHEN 5 THEN 'SHOW TABLES IN main.silver'
 WHEN 6 THEN concat('SELECT a, row_number() OVER (PARTITION BY b ORDER BY c) AS rn FROM main.silver.t', CAST(user_id % 20 AS STRING), ' ORDER BY rn')
 ELSE concat('MERGE INTO main.gold.t', CAST(user_id % 20 AS STRING), ' t USING main.silver.t', CAST(k % 20 AS STRING), ' s ON t.id = s.id WHEN MATCHED THEN UPDATE SET t.v = s.v') END"""

_ERRORS = """CASE WHEN event_type <> 'error' THEN NULL
 WHEN k % 4 = 0 THEN concat('[INSUFFICIENT_PERMISSIONS] User user', CAST(user_id AS STRING), '@acme.example cannot read `main`.`gold`.`t', CAST(user_id % 20 AS STRING), '`. SQLSTATE: 42501')
 WHEN k % 4 = 1 THEN concat('[TABLE_OR_VIEW_NOT_FOUND] The table `main`.`gold`.`t', CAST(user_id % 20 AS STRING), '` cannot be found. SQLSTATE: 42P01')
 WHEN k % 4 = 2 THEN '[PARSE_SYNTAX_ERROR] Syntax error near end. SQLSTATE: 42601'
 ELSE 'executor lost: no room left' END"""

_LINEAGE = {
    "record_id": "CAST(event_id AS STRING)",
    "event_time": "ts",
    "event_date": "CAST(ts AS DATE)",
    "source_table_full_name": "CASE WHEN event_type = 'signup' THEN NULL ELSE concat('main.', CASE WHEN event_id % 2 = 0 THEN 'bronze' ELSE 'silver' END, '.t', CAST(user_id % 20 AS STRING)) END",
    "target_table_full_name": "CASE WHEN event_type = 'view' THEN NULL ELSE concat('main.', CASE WHEN k = 55 THEN 'bronze' WHEN event_id % 2 = 0 THEN 'silver' ELSE 'gold' END, '.t', CAST((user_id * 7 + event_id) % 20 AS STRING)) END",
    "source_type": "CASE WHEN event_type = 'signup' THEN NULL WHEN k % 10 = 0 THEN 'VIEW' ELSE 'TABLE' END",
    "target_type": "CASE WHEN event_type = 'view' THEN NULL ELSE 'TABLE' END",
    "entity_type": "CASE k % 5 WHEN 0 THEN 'JOB' WHEN 1 THEN 'NOTEBOOK' WHEN 2 THEN 'PIPELINE' WHEN 3 THEN 'DASHBOARD_V3' END",
    "entity_id": "CASE WHEN k % 5 = 4 THEN NULL ELSE concat('e-', CAST(k AS STRING)) END",
    "statement_id": "CAST(event_id AS STRING)",
    "direct_access": "CASE k % 5 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END",
}
_TAIL = {"data_origin": _ORIGIN, "deleted_at": _DELETED}

#: name -> (FROM clause, {column: expression})
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "billing_usage": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
        {
            "account_id": "'acct-1'",
            "workspace_id": "concat('ws-', CAST(l_suppkey % 10 AS STRING))",
            "record_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
            "sku_name": "p_brand",
            "cloud": "CASE WHEN l_linestatus = 'O' THEN 'AZURE' ELSE 'AWS' END",
            "usage_start_time": "l_shipdate",
            "usage_end_time": "l_shipdate + INTERVAL '24' HOUR",
            "usage_date": "CAST(l_shipdate AS DATE)",
            "usage_unit": "'DBU'",
            "usage_quantity": "CAST(l_quantity AS DECIMAL(20,6))",
            "billing_origin_product": "CASE o_orderpriority WHEN '1-URGENT' THEN 'JOBS' WHEN '2-HIGH' THEN 'SQL' WHEN '3-MEDIUM' THEN 'ALL_PURPOSE' WHEN '4-NOT SPECIFIED' THEN 'DLT' ELSE 'SERVING' END",
            "usage_type": "p_type",
            "record_type": "CASE WHEN l_orderkey % 40 = 1 THEN 'RETRACTION' WHEN l_orderkey % 40 = 2 THEN 'RESTATEMENT' ELSE 'ORIGINAL' END",
            "cluster_id": "CASE WHEN o_orderpriority IN ('1-URGENT','3-MEDIUM','4-NOT SPECIFIED') THEN concat('c-', CAST(l_suppkey AS STRING)) END",
            "warehouse_id": "CASE WHEN o_orderpriority = '2-HIGH' THEN concat('w-', CAST(l_suppkey % 20 AS STRING)) END",
            "job_id": "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('j-', CAST(l_partkey % 50 AS STRING)) END",
            "run_as": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE concat('user', CAST(o_custkey % 40 AS STRING), '@acme.example') END",
            "is_serverless": "CASE l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE END",
            "is_photon": "l_linenumber % 3 = 0",
            "usage_usd": "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,6))",
            "data_origin": "CASE WHEN l_orderkey % 20 = 0 THEN 'demo' ELSE 'real' END",
            "deleted_at": "CASE WHEN l_orderkey % 97 = 0 THEN TIMESTAMP_NTZ '2002-01-01 00:00:00' END",
        },
    ),
    "list_prices": (
        "(SELECT DISTINCT p_brand FROM part) b CROSS JOIN (VALUES ('AZURE'), ('AWS')) AS c(cloud) CROSS JOIN "
        "(VALUES (TIMESTAMP_NTZ '1990-01-01 00:00:00', TIMESTAMP_NTZ '1997-01-01 00:00:00', 15), "
        "(TIMESTAMP_NTZ '1997-01-01 00:00:00', TIMESTAMP_NTZ '2000-01-01 00:00:00', 25), "
        "(TIMESTAMP_NTZ '2000-01-01 00:00:00', CAST(NULL AS TIMESTAMP_NTZ), 40)) AS w(s, e, p)",
        {
            "account_id": "'acct-1'",
            "sku_name": "p_brand",
            "cloud": "cloud",
            "currency_code": "'USD'",
            "usage_unit": "'DBU'",
            "price_start_time": "s",
            "price_end_time": "e",
            "effective_list_price": "CAST(CAST(p + length(p_brand) AS DOUBLE) / 100 AS DECIMAL(20,6))",
            "data_origin": "'real'",
            "deleted_at": "CAST(NULL AS TIMESTAMP_NTZ)",
        },
    ),
    "clusters": (
        "supplier CROSS JOIN (VALUES (1, TIMESTAMP_NTZ '1995-01-01 00:00:00'), (2, TIMESTAMP_NTZ '1997-06-01 00:00:00'), "
        "(3, CAST(NULL AS TIMESTAMP_NTZ))) AS v(n, t)",
        {
            "cluster_id": "concat('c-', CAST(s_suppkey AS STRING))",
            "cluster_name": "concat(s_name, '-v', CAST(n AS STRING))",
            "workspace_id": "concat('ws-', CAST(s_suppkey % 10 AS STRING))",
            "owned_by": "CASE WHEN s_nationkey = 0 THEN NULL ELSE concat('user', CAST(s_nationkey AS STRING), '@acme.example') END",
            "driver_node_type": "CASE s_suppkey % 6 WHEN 0 THEN 'Standard_DS3_v2' WHEN 1 THEN 'm5.xlarge' WHEN 2 THEN 'p3.2xlarge' WHEN 3 THEN 'n2-highmem-8' WHEN 4 THEN 'unknown-type' END",
            "worker_node_type": "CASE WHEN s_suppkey % 3 = 0 THEN 'm5.xlarge' ELSE 'n1-standard-4' END",
            "worker_count": "CAST(s_suppkey % 3 AS INT)",
            "max_autoscale_workers": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 4 * 2 AS INT) END",
            "cluster_source": "CASE s_suppkey % 3 WHEN 0 THEN 'JOB' WHEN 1 THEN 'UI' ELSE 'PIPELINE' END",
            "create_time": "TIMESTAMP_NTZ '1994-12-31 00:00:00'",
            "change_time": "t",
        },
    ),
    "warehouses": (
        "supplier CROSS JOIN (VALUES (1, TIMESTAMP_NTZ '1995-01-01 00:00:00'), (2, TIMESTAMP_NTZ '1998-01-01 00:00:00')) "
        "AS v(n, t) WHERE s_suppkey < 20",
        {
            "warehouse_id": "concat('w-', CAST(s_suppkey AS STRING))",
            "warehouse_name": "concat('wh-', CAST(s_suppkey AS STRING), '-v', CAST(n AS STRING))",
            "workspace_id": "concat('ws-', CAST(s_suppkey % 10 AS STRING))",
            "warehouse_size": "CASE s_suppkey % 5 WHEN 0 THEN '2X_SMALL' WHEN 1 THEN 'small' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN '4X_LARGE' ELSE 'HUGE' END",
            "max_clusters": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 4 - 1 AS INT) END",
            "created_by": "concat('user', CAST(s_suppkey % 7 AS STRING), '@acme.example')",
            "change_time": "t",
        },
    ),
    "jobs": (
        "part WHERE p_partkey < 50",
        {
            "job_id": "concat('j-', CAST(p_partkey AS STRING))",
            "name": "p_name",
            "creator_id": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE concat('user', CAST(p_partkey % 12 AS STRING), '@acme.example') END",
            "change_time": "TIMESTAMP_NTZ '1995-01-01 00:00:00'",
        },
    ),
    "workspaces": (
        "nation WHERE n_nationkey < 8",
        {
            "workspace_id": "concat('ws-', CAST(n_nationkey AS STRING))",
            "workspace_name": "CASE WHEN n_nationkey = 5 THEN NULL ELSE n_name END",
            "workspace_url": "concat('https://', lower(n_name), '.acme.example')",
            "status": "CASE WHEN n_nationkey = 6 THEN 'CANCELLED' ELSE 'RUNNING' END",
        },
    ),
    "query_history": (
        _EVENTS,
        {
            "statement_id": "CAST(event_id AS STRING)",
            "workspace_id": "concat('ws-', CAST(user_id % 10 AS STRING))",
            "executed_by": "CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 5 = 0 THEN concat('sp-', CAST(user_id AS STRING)) ELSE concat('user', CAST(user_id AS STRING), '@acme.example') END",
            "executed_by_user_id": "CAST(user_id AS STRING)",
            "executed_as": "CASE WHEN k % 7 = 0 THEN 'owner@acme.example' ELSE concat('user', CAST(user_id AS STRING), '@acme.example') END",
            "session_id": "CASE WHEN k % 13 = 0 THEN NULL ELSE concat('s-', CAST(user_id AS STRING), '-', CAST(event_id % 6 AS STRING)) END",
            "execution_status": "CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'CANCELED' ELSE 'FINISHED' END",
            "compute_type": "CASE WHEN k % 3 = 0 THEN 'SERVERLESS_COMPUTE' ELSE 'WAREHOUSE' END",
            "warehouse_id": "CASE WHEN k % 3 = 0 THEN NULL ELSE concat('w-', CAST(user_id % 20 AS STRING)) END",
            "statement_type": "CASE event_id % 8 WHEN 2 THEN 'INSERT' WHEN 3 THEN 'GRANT' WHEN 4 THEN NULL WHEN 5 THEN 'SHOW' WHEN 7 THEN 'MERGE' ELSE 'SELECT' END",
            "statement_text": _STATEMENTS,
            "error_message": _ERRORS,
            "client_application": "CASE k % 5 WHEN 0 THEN 'PowerBI' WHEN 1 THEN 'Tableau' WHEN 2 THEN 'SQL Editor' WHEN 3 THEN 'Notebooks' END",
            "client_driver": "CASE k % 6 WHEN 0 THEN 'PyDatabricksSqlConnector, 4.2.6' WHEN 1 THEN 'SimbaJDBC, 2.6' WHEN 2 THEN 'SimbaODBC, 2.8' WHEN 3 THEN 'Exec Api' WHEN 4 THEN 'nodejs-client, 1.1' END",
            "job_id": "CASE WHEN k % 9 = 1 THEN concat('j-', CAST(k % 50 AS STRING)) END",
            "pipeline_id": "CASE WHEN k % 9 = 2 THEN concat('p-', CAST(k AS STRING)) END",
            "notebook_id": "CASE WHEN k % 9 = 3 THEN concat('n-', CAST(k AS STRING)) END",
            "dashboard_id": "CASE WHEN k % 9 IN (4, 5) THEN concat('d-', CAST(k AS STRING)) END",
            "genie_space_id": "CASE WHEN k % 9 = 6 THEN concat('g-', CAST(k AS STRING)) END",
            "tag_team": "CASE WHEN k % 4 = 0 THEN concat('Team-', CAST(k % 3 AS STRING)) END",
            "tag_env": "CASE WHEN k % 8 = 0 THEN 'prod' END",
            "param_region": "CASE WHEN k % 6 = 1 THEN concat('r', CAST(k AS STRING)) END",
            "total_duration_ms": "CASE WHEN k % 31 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END",
            "waiting_at_capacity_duration_ms": "CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END",
            "waiting_for_compute_duration_ms": "CAST(floor(value * 5) AS BIGINT)",
            "compilation_duration_ms": "CAST(floor(value * (k % 60)) AS BIGINT)",
            "start_time": "ts",
            "end_time": "ts + INTERVAL '1' SECOND * CAST(floor(value) AS BIGINT)",
            "read_files": "CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k AS BIGINT) END",
            "pruned_files": "CAST(event_id % 40 AS BIGINT)",
            "read_rows": "CAST(k * 100 AS BIGINT)",
            "produced_rows": "CAST(event_id % 2000 AS BIGINT)",
            "read_bytes": "CASE WHEN event_id % 50 = 0 THEN CAST(200 AS BIGINT) * 1073741824 ELSE CAST(floor(value * 1000000) AS BIGINT) END",
            "spilled_local_bytes": "CASE WHEN k % 10 = 0 THEN CAST(floor(value * 1000) AS BIGINT) ELSE CAST(0 AS BIGINT) END",
            "from_result_cache": "CASE WHEN k % 12 = 0 THEN NULL ELSE k % 4 = 1 END",
            "data_origin": _ORIGIN,
        },
    ),
    "table_lineage": (_EVENTS, {**_LINEAGE, **_TAIL}),
    "column_lineage": (
        _EVENTS + " WHERE event_type <> 'signup'",
        {
            **_LINEAGE,
            "source_column_name": "concat('c', CAST(k % 8 AS STRING))",
            "target_column_name": "CASE WHEN event_type = 'view' THEN NULL ELSE concat('c', CAST(event_id % 8 AS STRING)) END",
            **_TAIL,
        },
    ),
    "audit_events": (
        _EVENTS,
        {
            "event_id": "CAST(event_id AS STRING)",
            "event_time": "ts",
            "event_date": "CAST(ts AS DATE)",
            "workspace_id": "CASE WHEN k % 10 = 0 THEN '0' ELSE concat('ws-', CAST(user_id % 8 AS STRING)) END",
            "user_identity_email": "CASE WHEN user_id % 13 = 0 THEN NULL ELSE concat('user', CAST(user_id AS STRING), '@acme.example') END",
            "service_name": "CASE k % 6 WHEN 0 THEN 'accounts' WHEN 1 THEN 'unityCatalog' WHEN 2 THEN 'clusters' WHEN 3 THEN 'jobs' WHEN 4 THEN 'notebook' END",
            "action_name": "CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'getTable' WHEN 'click' THEN 'runCommand' WHEN 'view' THEN 'list' ELSE 'updatePermissions' END",
            "source_ip_address": "concat('10.0.', CAST(user_id % 5 AS STRING), '.', CAST(k % 10 AS STRING))",
            "request_id": "concat('r-', CAST(event_id % 4000 AS STRING))",
            "audit_level": "CASE WHEN k % 10 = 0 THEN 'ACCOUNT_LEVEL' ELSE 'WORKSPACE_LEVEL' END",
            "response_status_code": "CASE WHEN event_type = 'error' THEN CASE k % 3 WHEN 0 THEN 403 WHEN 1 THEN 500 ELSE 302 END WHEN k % 19 = 0 THEN NULL ELSE 200 END",
            "response_error_message": "CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'INSUFFICIENT_PERMISSIONS on object' END",
            **_TAIL,
        },
    ),
    "assistant_events": (
        "events WHERE event_type = 'click'",
        {
            "event_id": "CAST(event_id AS STRING)",
            "workspace_id": "concat('ws-', CAST(user_id % 10 AS STRING))",
            "event_time": "ts",
            "event_date": "CAST(ts AS DATE)",
            "initiated_by": "CASE WHEN user_id % 13 = 0 THEN NULL ELSE concat('user', CAST(user_id AS STRING), '@acme.example') END",
            **_TAIL,
        },
    ),
    "node_timeline": (
        _EVENTS,
        {
            "cluster_id": "CASE WHEN user_id % 29 = 0 THEN NULL ELSE concat('c-', CAST(user_id % 100 AS STRING)) END",
            "instance_id": "concat('i-', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING))",
            "start_time": "CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ)",
            "event_date": "CAST(ts AS DATE)",
            "driver": "event_id % 3 = 0",
            "node_type": "CASE WHEN user_id % 2 = 0 THEN 'm5.xlarge' ELSE 'Standard_DS3_v2' END",
            "cpu_user_percent": "CAST(k * (user_id % 4) AS DOUBLE) / 4",
            "cpu_system_percent": "CAST(event_id % 20 AS DOUBLE)",
            "mem_used_percent": "CASE WHEN k % 23 = 0 THEN NULL ELSE CAST((user_id * 3 + event_id) % 101 AS DOUBLE) END",
            "mem_swap_percent": "CAST(CASE WHEN k = 7 THEN 2.0 ELSE 0.0 END AS DOUBLE)",
            **_TAIL,
        },
    ),
    "warehouse_events": (
        _EVENTS,
        {
            "warehouse_id": "concat('w-', CAST(user_id % 20 AS STRING))",
            "workspace_id": "concat('ws-', CAST(user_id % 10 AS STRING))",
            "event_type": "CASE event_type WHEN 'signup' THEN 'STARTING' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'SCALED_UP' WHEN 'purchase' THEN 'SCALED_DOWN' ELSE 'STOPPED' END",
            "cluster_count": "k % 5",
            "event_time": "ts",
            "event_date": "CAST(ts AS DATE)",
            **_TAIL,
        },
    ),
    "instance_events": (
        _EVENTS,
        {
            "cluster_id": "concat('c-', CAST(user_id % 100 AS STRING))",
            "instance_id": "concat('i-', CAST(user_id AS STRING), '-', CAST(event_id % 3 AS STRING))",
            "instance_pool_id": "CASE WHEN k % 3 = 0 THEN NULL ELSE concat('pool-', CAST(k % 4 AS STRING)) END",
            "event_type": "CASE event_type WHEN 'signup' THEN 'PROVISIONED' WHEN 'error' THEN 'PREEMPTED' WHEN 'purchase' THEN 'TERMINATED' ELSE 'RUNNING' END",
            "event_time": "ts",
            "node_type": "CASE WHEN user_id % 2 = 0 THEN 'm5.xlarge' ELSE 'Standard_DS3_v2' END",
            **_TAIL,
        },
    ),
    "catalog_columns": (
        "part",
        {
            "catalog": "CASE WHEN p_partkey % 4 = 3 THEN 'sandbox' ELSE 'main' END",
            "database": "CASE p_partkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END",
            "table_name": "concat('t', CAST(p_size AS STRING))",
            "col_name": "CASE WHEN p_partkey % 10 = 0 THEN 'customer_email' WHEN p_partkey % 10 = 1 THEN 'account_id' ELSE concat('c', CAST(p_partkey % 37 AS STRING)) END",
            "data_type": "CASE p_partkey % 5 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'DOUBLE' WHEN 3 THEN 'STRUCT<a:INT>' ELSE 'TIMESTAMP' END",
            "comment": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END",
            "table_type": "CASE WHEN p_size % 7 = 0 THEN 'VIEW' ELSE 'MANAGED' END",
            "table_owner": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE concat('user', CAST(p_size % 6 AS STRING), '@acme.example') END",
            "table_comment": "CASE WHEN p_size % 2 = 0 THEN 'documented table' END",
            "as_of": "CASE WHEN p_partkey % 11 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END",
            "data_origin": "'real'",
            "deleted_at": "CAST(NULL AS TIMESTAMP_NTZ)",
        },
    ),
    # Billing intervals inside the period the events cover, so that statements and spend overlap.
    "compute_spend": (
        "lineitem",
        {
            "record_id": "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))",
            "compute_id": "concat('w-', CAST(l_suppkey % 20 AS STRING))",
            "usage_start_time": "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(l_orderkey % 720 AS BIGINT) + INTERVAL '1' MINUTE * CAST(l_linenumber * 7 AS BIGINT)",
            "usage_end_time": "TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(l_orderkey % 720 AS BIGINT) + INTERVAL '1' MINUTE * CAST(l_linenumber * 7 + 90 AS BIGINT)",
            "cost": "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20,6))",
        },
    ),
    # Reference tables without a counterpart in the driver's data: derived from the event tables.
    "node_types": (
        "(SELECT DISTINCT user_id % 2 AS m FROM events) e",
        {
            "node_type": "CASE WHEN m = 0 THEN 'm5.xlarge' ELSE 'Standard_DS3_v2' END",
            "core_count": "CAST(4 AS DOUBLE)",
            "memory_mb": "CAST(CASE WHEN m = 0 THEN 16384 ELSE 14336 END AS BIGINT)",
            "gpu_count": "CAST(0 AS BIGINT)",
            "category": "CASE WHEN m = 0 THEN 'General Purpose' END",
            "data_origin": "'real'",
            "deleted_at": "CAST(NULL AS TIMESTAMP_NTZ)",
        },
    ),
    "instance_pools": (
        f"(SELECT DISTINCT k % 4 AS p FROM (SELECT {_K} AS k FROM events) x) e",
        {
            "instance_pool_id": "concat('pool-', CAST(p AS STRING))",
            "instance_pool_name": "CASE WHEN p = 3 THEN NULL ELSE concat('pool ', CAST(9 - p AS STRING)) END",
            "workspace_id": "concat('ws-', CAST(p AS STRING))",
            "node_type": "CASE WHEN p % 2 = 0 THEN 'm5.xlarge' ELSE 'Standard_DS3_v2' END",
            "min_idle_instances": "p * 2",
            "max_capacity": "p * 10",
            "data_origin": "'real'",
            "deleted_at": "CAST(NULL AS TIMESTAMP_NTZ)",
        },
    ),
}

#: scoped short names used by the oracles
SCOPED = {
    "bu": ("billing_usage", "*, coalesce(usage_usd, 0) AS cost"),
    "lp": ("list_prices", "*"),
    "tl": ("table_lineage", "*"),
    "cl": ("column_lineage", "*"),
    "au": ("audit_events", "*"),
    "aa": ("assistant_events", "*"),
    "nt": ("node_timeline", "*"),
    "we": ("warehouse_events", "*"),
    "ie": ("instance_events", "*"),
    "cc": ("catalog_columns", "*"),
}


def _duck(text: str) -> str:
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP")


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    return "SELECT " + ", ".join(f"{expr} AS {col}" for col, expr in columns.items()) + " FROM " + source


CTES: dict[str, str] = {name: _duck(view_sql(name)) for name in VIEWS}
for _name, (_table, _cols) in SCOPED.items():
    CTES[_name] = f"SELECT {_cols} FROM {_table} WHERE data_origin = 'real' AND deleted_at IS NULL"


def with_ctes(sql: str) -> str:
    """Prefix a query with the fixture views it mentions, in dependency order."""
    ordered: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text))
        for name in CTES:
            if name in words and name not in seen and name not in ordered:
                need(CTES[name], (*seen, name))
                ordered.append(name)

    need(sql, ())
    if not ordered:
        return sql
    prefix = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {prefix},\n{rest[10:]}"
        return f"WITH {prefix},\n{rest}"
    return f"WITH {prefix}\n{body}"


class Tables:
    """The fixture views as DataFrames, plus scoped short names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        self._views: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{self.path}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            sql = view_sql(name)
            words = set(re.findall(r"[A-Za-z_]+", VIEWS[name][0]))
            frames = {t: self.raw(t) for t in DRIVER_SCHEMAS if t in words}
            for t in frames:
                sql = re.sub(rf"\b{t}\b(?=[\s)]|$)", "{" + t + "}", sql)
            self._views[name] = self.spark.sql(sql, **frames)
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in SCOPED:
            return scope.scope_origin(self.view(SCOPED[name][0]), "real")
        raise AttributeError(name)

    @cached_property
    def bu(self) -> DataFrame:
        """Live real billing usage with its cost column."""
        from lakegauge.operators import billing

        return billing.cost_from_usd(scope.scope_origin(self.billing_usage, "real"))

    @cached_property
    def analysed(self) -> DataFrame:
        """The wide ETL frame of the real query history."""
        from lakegauge.operators import query_etl

        return query_etl.analyse(scope.scope_origin(self.nested_history, "real"))

    @cached_property
    def allocated(self) -> DataFrame:
        """Compute spend shared out to statements."""
        from lakegauge.operators import spend

        ran = self.qs.select("statement_id", F.col("warehouse_id").alias("compute_id"), "start_time", "end_time")
        return spend.query_cost_allocation(self.compute_spend, ran)

    def _child(self, name: str) -> DataFrame:
        from lakegauge.operators import query_etl

        return getattr(query_etl, name)(self.analysed)

    @cached_property
    def qs(self) -> DataFrame:
        return self._child("qi_statements")

    @cached_property
    def qt(self) -> DataFrame:
        return self._child("qi_tables")

    @cached_property
    def qc(self) -> DataFrame:
        return self._child("qi_columns")

    @cached_property
    def qe(self) -> DataFrame:
        return self._child("qi_errors")

    @cached_property
    def qg(self) -> DataFrame:
        return self._child("qi_tags")

    @cached_property
    def nested_history(self) -> DataFrame:
        """Query history in its source shape: structs and maps instead of flat columns."""
        h = self.query_history
        compute = F.struct(F.col("compute_type").alias("type"), "warehouse_id", F.lit(None).cast("string").alias("cluster_id"))
        missing = F.lit(None).cast("string")
        source = F.struct(
            F.struct("job_id", missing.alias("job_run_id"), missing.alias("job_task_run_id")).alias("job_info"),
            F.struct("pipeline_id", missing.alias("update_id")).alias("pipeline_info"),
            "notebook_id",
            "dashboard_id",
            missing.alias("legacy_dashboard_id"),
            missing.alias("alert_id"),
            missing.alias("sql_query_id"),
            "genie_space_id",
        )
        tags = F.when(
            F.col("tag_env").isNotNull(), F.create_map(F.lit("team"), "tag_team", F.lit("env"), "tag_env")
        ).when(F.col("tag_team").isNotNull(), F.create_map(F.lit("team"), "tag_team"))
        literal = F.struct(
            F.col("param_region").alias("string_value"),
            F.lit(None).cast("int").alias("int_value"),
            F.lit(None).cast("bigint").alias("long_value"),
            F.lit(None).cast("double").alias("double_value"),
            F.lit(None).cast("boolean").alias("boolean_value"),
            missing.alias("date_value"),
            missing.alias("timestamp_value"),
        )
        ast = F.struct(F.array(F.struct(literal.alias("literal"), F.struct(F.lit("STRING").alias("type_name")).alias("data_type"))).alias("exprs"))
        params = F.when(
            F.col("param_region").isNotNull(), F.struct(F.create_map(F.lit("p_region"), ast).alias("named_parameters"))
        )
        flat = ["compute_type", "warehouse_id", "job_id", "pipeline_id", "notebook_id", "dashboard_id", "genie_space_id", "tag_team", "tag_env", "param_region"]
        return h.select(
            *[c for c in h.columns if c not in flat],
            compute.alias("compute"),
            source.alias("query_source"),
            tags.alias("query_tags"),
            params.alias("query_parameters"),
        )
