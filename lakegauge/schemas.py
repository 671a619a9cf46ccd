"""Declared schemas of the tables, in Spark types. Ingest projects every source to these."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "billing_usage": "account_id string, workspace_id string, record_id string, sku_name string, cloud string, "
    "usage_start_time timestamp_ntz, usage_end_time timestamp_ntz, usage_date date, usage_unit string, "
    "usage_quantity decimal(20,6), billing_origin_product string, usage_type string, record_type string, "
    "ingestion_date date, cluster_id string, warehouse_id string, instance_pool_id string, node_type string, "
    "job_id string, run_name string, run_as string, jobs_tier string, sql_tier string, dlt_tier string, "
    "is_serverless boolean, is_photon boolean, serving_type string, usage_usd decimal(20,6)",
    "list_prices": "account_id string, sku_name string, cloud string, currency_code string, usage_unit string, "
    "price_start_time timestamp_ntz, price_end_time timestamp_ntz, default_price decimal(20,6), "
    "effective_list_price decimal(20,6)",
    "clusters": "account_id string, workspace_id string, cluster_id string, cluster_name string, owned_by string, "
    "driver_node_type string, worker_node_type string, worker_count int, min_autoscale_workers int, "
    "max_autoscale_workers int, dbr_version string, cluster_source string, data_security_mode string, "
    "create_time timestamp_ntz, delete_time timestamp_ntz, change_time timestamp_ntz",
    "warehouses": "account_id string, workspace_id string, warehouse_id string, warehouse_name string, "
    "warehouse_type string, warehouse_size string, min_clusters int, max_clusters int, auto_stop_minutes int, "
    "created_by string, change_time timestamp_ntz, delete_time timestamp_ntz",
    "jobs": "account_id string, workspace_id string, job_id string, name string, creator_id string, run_as string, "
    "change_time timestamp_ntz, delete_time timestamp_ntz",
    "workspaces": "workspace_id string, account_id string, workspace_name string, workspace_url string, "
    "create_time timestamp_ntz, status string",
    "table_lineage": "account_id string, metastore_id string, workspace_id string, event_time timestamp_ntz, "
    "event_date date, record_id string, event_id string, source_table_full_name string, "
    "source_table_catalog string, source_table_schema string, source_table_name string, source_type string, "
    "source_path string, target_table_full_name string, target_table_catalog string, target_table_schema string, "
    "target_table_name string, target_type string, target_path string, created_by string, entity_type string, "
    "entity_id string, entity_run_id string, entity_metadata string, statement_id string, direct_access boolean",
    "audit_events": "account_id string, workspace_id string, version string, event_time timestamp_ntz, "
    "event_date date, source_ip_address string, user_agent string, session_id string, user_identity string, "
    "user_identity_email string, service_name string, action_name string, request_id string, "
    "request_params string, response string, response_status_code int, response_error_message string, "
    "audit_level string, event_id string, identity_metadata string",
    "assistant_events": "event_id string, account_id string, workspace_id string, event_time timestamp_ntz, "
    "event_date date, user_agent string, initiated_by string",
    "node_timeline": "account_id string, workspace_id string, cluster_id string, instance_id string, "
    "start_time timestamp_ntz, end_time timestamp_ntz, event_date date, driver boolean, node_type string, "
    "cpu_user_percent double, cpu_system_percent double, cpu_wait_percent double, mem_used_percent double, "
    "mem_swap_percent double, network_sent_bytes bigint, network_received_bytes bigint, "
    "disk_free_bytes_per_mount_point string",
    "warehouse_events": "account_id string, workspace_id string, warehouse_id string, event_type string, "
    "cluster_count int, event_time timestamp_ntz, event_date date",
    "instance_events": "account_id string, workspace_id string, cluster_id string, instance_id string, "
    "instance_pool_id string, event_type string, event_time timestamp_ntz, event_date date, node_type string, "
    "event_details string",
    "node_types": "account_id string, node_type string, core_count double, memory_mb bigint, gpu_count bigint, "
    "category string",
    "instance_pools": "account_id string, workspace_id string, instance_pool_id string, instance_pool_name string, "
    "node_type string, min_idle_instances int, max_capacity int, idle_instance_autotermination_minutes int, "
    "enable_elastic_disk boolean, create_time timestamp_ntz, delete_time timestamp_ntz, change_time timestamp_ntz",
    "catalog_columns": "catalog string, database string, table_name string, col_name string, data_type string, "
    "comment string, table_type string, table_owner string, table_comment string, as_of date",
}
SCHEMAS["column_lineage"] = SCHEMAS["table_lineage"].replace(
    "source_type string", "source_column_name string, source_type string"
).replace("target_type string", "target_column_name string, target_type string")

#: Tables of the query-history ETL; they carry an origin but no tombstone.
ORIGIN_ONLY = ("qi_statements", "qi_statement_tables", "qi_statement_columns", "qi_statement_tags",
               "qi_statement_parameters", "qi_statement_errors")

#: Order in which a full load fills the tables.
LOAD_ORDER = ("list_prices", "clusters", "warehouses", "jobs", "workspaces", "billing_usage", "query_history",
              "catalog_columns", "table_lineage", "column_lineage", "audit_events", "assistant_events",
              "node_timeline", "warehouse_events", "node_types", "instance_events", "instance_pools")

# Time and key column of each table that loads incrementally.
CURSOR_COLUMNS = {
    "billing_usage": ("usage_end_time", "record_id"),
    "list_prices": ("price_start_time", None),
    "clusters": ("change_time", "cluster_id"),
    "warehouses": ("change_time", "warehouse_id"),
    "jobs": ("change_time", "job_id"),
    "workspaces": ("create_time", "workspace_id"),
    "query_history": ("update_time", "statement_id"),
}

#: Tables whose appended rows skip keys already present in the same origin.
DEDUP_KEYS = {"billing_usage": "record_id", "query_history": "statement_id"}


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])
