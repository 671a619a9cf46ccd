"""Projections from the platform's own tables to the declared schemas.

Each function takes the source frame and returns the flat table. Date bounds are put on the raw date or time column so
that partition pruning and file statistics apply.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegauge.functions.common import MONEY, conform, date_range
from lakegauge.schemas import struct


def _has(df: DataFrame, path: str) -> bool:
    node: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(node, T.StructType) or name not in node.names:
            return False
        node = node[name].dataType
    return True


def _lift(df: DataFrame, paths: Mapping[str, str]) -> DataFrame:
    """Add flat columns for nested fields; fields the source lacks are left to ``conform``."""
    return df.withColumns({name: F.col(path) for name, path in paths.items() if _has(df, path)})


def _as_json(df: DataFrame, *columns: str) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    found = {c: F.to_json(F.col(c)) for c in columns if c in df.columns and isinstance(df.schema[c].dataType, nested)}
    return df.withColumns(found) if found else df


def normalise_nested(df: DataFrame) -> DataFrame:
    """Every struct, map and array column as JSON text; everything else unchanged."""
    return _as_json(df, *df.columns)


USAGE_FIELDS = {
    **{c: f"usage_metadata.{c}" for c in ("cluster_id", "warehouse_id", "instance_pool_id", "node_type", "job_id", "run_name")},
    "run_as": "identity_metadata.run_as",
    **{c: f"product_features.{c}" for c in ("jobs_tier", "sql_tier", "dlt_tier", "is_serverless", "is_photon", "serving_type")},
}


def extract_prices(prices: DataFrame, currency: str = "USD") -> DataFrame:
    """Prices in one currency with the nested amounts lifted and unreadable numbers turned into NULL."""
    lifted = _lift(
        prices.filter(F.col("currency_code") == currency),
        {"default_price": "pricing.default", "effective_list_price": "pricing.effective_list.default"},
    )
    numbers = {c: F.col(c).try_cast(MONEY) for c in ("default_price", "effective_list_price") if c in lifted.columns}
    return conform(lifted.withColumns(numbers), struct("list_prices"))


def extract_usage(usage: DataFrame, prices: DataFrame, start: date, end: date, as_of: date) -> DataFrame:
    """Flat usage of a date range with its dollar amount.

    Unlike the dashboards' pricing this is a left join on SKU and unit only, both interval ends count, an open end
    means the day after ``as_of``, and usage without a price costs 0. A row ending exactly where one price hands over
    to the next matches both and appears twice.
    """
    flat = _lift(date_range(usage, "usage_date", start, end), USAGE_FIELDS)
    tomorrow = F.lit(datetime.combine(as_of + timedelta(days=1), datetime.min.time())).cast("timestamp_ntz")
    p = extract_prices(prices).select(
        F.col("sku_name").alias("_sku"),
        F.col("usage_unit").alias("_unit"),
        F.col("price_start_time").alias("_from"),
        F.coalesce("price_end_time", tomorrow).alias("_until"),
        F.col("effective_list_price").cast("decimal(18,6)").alias("_price"),
    )
    on = (
        (F.col("sku_name") == F.col("_sku"))
        & (F.col("usage_unit") == F.col("_unit"))
        & F.col("usage_end_time").between(F.col("_from"), F.col("_until"))
    )
    amount = F.coalesce(F.col("usage_quantity").cast("decimal(18,6)") * F.col("_price"), F.lit(0))
    priced = flat.join(p, on, "left").withColumn("usage_usd", amount)
    return conform(priced, struct("billing_usage"))


#: Columns that hold identifiers and become text everywhere.
ID_COLUMNS = ("account_id", "workspace_id", "metastore_id", "cluster_id", "instance_id", "instance_pool_id",
              "warehouse_id", "record_id", "event_id", "entity_id", "entity_run_id", "statement_id", "job_id")


def extract_config(df: DataFrame, table: str) -> DataFrame:
    """Clusters, warehouses, jobs, workspaces, node types and instance pools: plain projections."""
    return conform(df, struct(table))


def extract_query_history(history: DataFrame, start: date, end: date) -> DataFrame:
    """Statements started from ``start`` up to the end of ``end``; ids as text, nested columns kept nested."""
    begin = F.lit(datetime.combine(start, datetime.min.time())).cast("timestamp_ntz")
    stop = F.lit(datetime.combine(end + timedelta(days=1), datetime.min.time())).cast("timestamp_ntz")
    df = history.filter((F.col("start_time") >= begin) & (F.col("start_time") < stop))
    ids = [c for c in ("workspace_id", "account_id", "executed_by_user_id", "executed_as_user_id") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in ids}) if ids else df


def extract_table_lineage(df: DataFrame, start: date, end: date) -> DataFrame:
    bounded = date_range(df, "event_date", start, end)
    return conform(_as_json(bounded, "entity_metadata"), struct("table_lineage"))


def extract_column_lineage(df: DataFrame, start: date, end: date) -> DataFrame:
    bounded = date_range(df, "event_date", start, end)
    return conform(_as_json(bounded, "entity_metadata"), struct("column_lineage"))


def drop_sourceless(columns: DataFrame) -> DataFrame:
    """Column lineage is stored without events that name no source column's table."""
    return columns.filter(F.col("source_table_full_name").isNotNull())


def extract_audit(df: DataFrame, start: date, end: date) -> DataFrame:
    lifted = _lift(
        date_range(df, "event_date", start, end),
        {
            "user_identity_email": "user_identity.email",
            "response_status_code": "response.status_code",
            "response_error_message": "response.error_message",
        },
    )
    nested = _as_json(lifted, "user_identity", "request_params", "response", "identity_metadata")
    return conform(nested, struct("audit_events"))


def extract_assistant(df: DataFrame, start: date, end: date) -> DataFrame:
    return conform(date_range(df, "event_date", start, end), struct("assistant_events"))


#: table -> time column its date is taken from
EVENT_TIMES = {"node_timeline": "start_time", "warehouse_events": "event_time", "instance_events": "event_time"}


def extract_node_events(df: DataFrame, table: str, start: date, end: date) -> DataFrame:
    """Node timeline, warehouse or instance events of a date range; the bound is on the time column itself."""
    moment = EVENT_TIMES[table]
    begin = F.lit(datetime.combine(start, datetime.min.time())).cast("timestamp_ntz")
    stop = F.lit(datetime.combine(end + timedelta(days=1), datetime.min.time())).cast("timestamp_ntz")
    bounded = df.filter((F.col(moment) >= begin) & (F.col(moment) < stop))
    dated = bounded.withColumn("event_date", F.to_date(moment))
    return conform(_as_json(dated, "disk_free_bytes_per_mount_point", "event_details"), struct(table))


# Default days of history per table.
LOOKBACK_DAYS = {
    "table_lineage": 14,
    "column_lineage": 7,
    "audit_events": 3,
    "assistant_events": 30,
    "node_timeline": 3,
    "warehouse_events": 30,
    "instance_events": 14,
}


def lookback_window(table: str, start: date, end: date, days_back: int | None = None) -> tuple[date, date]:
    """Narrow a range to the table's lookback without widening it."""
    days = LOOKBACK_DAYS[table] if days_back is None else days_back
    return max(start, end - timedelta(days=max(1, days) - 1)), end


def ordered_dates(start: date, end: date) -> tuple[date, date]:
    return (end, start) if end < start else (start, end)


def read_days(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Rows of a date range; inverted bounds are swapped. Spark reads it lazily, so no chunking is needed."""
    return date_range(df, column, *ordered_dates(start, end))


def missing_days(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Days of the range without a single row, to be reported instead of silently skipped."""
    first, last = ordered_dates(start, end)
    present = read_days(df, column, first, last).select(F.col(column).alias("day")).distinct()
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return days.join(present, "day", "left_anti").orderBy("day")


SKIPPED_SCHEMAS = ("_delta_log", "sys")


def catalog_crawl(
    sources: Mapping[str, tuple[DataFrame, DataFrame]],
    as_of: date,
    include: Iterable[str] | None = None,
    exclude: Iterable[str] | None = None,
) -> DataFrame:
    """Column inventory of the chosen catalogs.

    ``sources`` maps a catalog to its information-schema views (columns, tables). Catalogs may lack the optional
    comment and owner columns.
    """
    wanted = [c for c in sources if c not in set(exclude or ()) and (not include or c in set(include))]
    out: DataFrame | None = None
    for catalog in wanted:
        columns, tables = sources[catalog]
        t = tables.select(
            "table_name",
            "table_schema",
            "table_type",
            *[F.col(c) for c in ("table_owner",) if c in tables.columns],
            *[F.col("comment").alias("table_comment") for c in ("comment",) if c in tables.columns],
        )
        kept = columns.filter(~F.col("table_schema").isin(*SKIPPED_SCHEMAS))
        one = (
            kept.join(t, ["table_name", "table_schema"])
            .withColumnRenamed("column_name", "col_name")
            .withColumnRenamed("table_schema", "database")
            .withColumn("catalog", F.lit(catalog))
        )
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no catalog left to scan")
    return conform(out.withColumn("as_of", F.lit(as_of)), struct("catalog_columns"))


def safe_timestamp(column: Column, formats: Iterable[str] = ()) -> Column:
    """First format that reads the text, else NULL."""
    # Formats tried after the caller's.
    fallback = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")
    tries = [*formats, *[f for f in fallback if f not in formats]]
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in tries])
