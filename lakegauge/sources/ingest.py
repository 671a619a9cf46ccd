"""Loading tables: replace, append, upsert, incremental loads, tombstones and inventory of what is loaded.

The row logic is plain DataFrame to DataFrame; the functions that write say so and work on ``root/<table>`` folders
partitioned by ``data_origin``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.common import conform
from lakegauge.operators.scope import ORIGINS
from lakegauge.schemas import CURSOR_COLUMNS, DEDUP_KEYS, LOAD_ORDER, SCHEMAS, struct
from lakegauge.sources import files


def rows_to_append(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose (key, origin) is not loaded yet. Repeats inside the new batch are kept."""
    keys = [key, "data_origin"]
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert_keep_existing(existing: DataFrame, new: DataFrame, key: str = "workspace_id") -> DataFrame:
    """Merge on the key: new values win unless they are NULL; an existing row keeps its origin."""
    new = new.withColumn(key, F.col(key).cast("string"))
    columns = [c for c in existing.columns if c != key]

    def merged(column: str) -> Column:
        if column not in new.columns:
            return F.col(f"e.{column}")
        first, second = ("e", "n") if column == "data_origin" else ("n", "e")
        return F.coalesce(F.col(f"{first}.{column}"), F.col(f"{second}.{column}"))

    joined = existing.alias("e").join(new.alias("n"), F.col(f"e.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"e.{key}")).alias(key), *[merged(c).alias(c) for c in columns]
    )


def backfill_stubs(workspaces: DataFrame, usage: DataFrame) -> DataFrame:
    """The workspaces plus an otherwise empty row for every id seen in usage but not listed."""
    seen = usage.filter(F.col("workspace_id").isNotNull()).select(F.col("workspace_id").cast("string")).distinct()
    missing = seen.join(workspaces.select("workspace_id"), "workspace_id", "left_anti")
    return workspaces.unionByName(missing, allowMissingColumns=True)


def rows_after(df: DataFrame, time_column: str, cursor: datetime | None) -> DataFrame:
    """Rows strictly newer than the cursor and rows without a time; without a cursor, everything."""
    if cursor is None or time_column not in df.columns:
        return df
    return df.filter((F.col(time_column) > F.lit(cursor).cast("timestamp_ntz")) | F.col(time_column).isNull())


def rows_not_in(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows that no existing row equals in all columns, NULLs alike. Repeats inside the new batch are kept."""
    columns = [c for c in new.columns if c in existing.columns]

    def row(df: DataFrame) -> Column:
        return F.sha2(F.to_json(F.struct(*[df[c] for c in columns]), {"ignoreNullFields": "false"}), 256)

    return new.withColumn("_row", row(new)).join(existing.select(row(existing).alias("_row")).distinct(), "_row", "left_anti").drop("_row")


def next_cursor(rows: DataFrame, table: str, origin: str) -> DataFrame:
    """Cursor row after loading ``rows``: newest time, greatest key and row count."""
    time_column, key = CURSOR_COLUMNS[table]
    greatest = F.max(F.col(key).cast("string")) if key else F.lit(None).cast("string")
    return rows.agg(
        F.max(time_column).alias("max_update_time"), greatest.alias("max_record_id"), F.count(F.lit(1)).alias("rows_ingested")
    ).select(F.lit(table).alias("table_name"), F.lit(origin).alias("data_origin"), "max_update_time", "max_record_id", "rows_ingested")


def soft_delete(df: DataFrame, origin: str, at: datetime) -> DataFrame:
    """Put a tombstone on the live rows of one origin."""
    moment = F.lit(at).cast("timestamp_ntz")
    hit = (F.col("data_origin") == origin) & F.col("deleted_at").isNull()
    return df.withColumn("deleted_at", F.when(hit, moment).otherwise(F.col("deleted_at")))


def restore(df: DataFrame, origin: str) -> DataFrame:
    """Take the tombstones of one origin away."""
    return df.withColumn("deleted_at", F.when(F.col("data_origin") != origin, F.col("deleted_at")))


def hard_delete(df: DataFrame, origin: str) -> DataFrame:
    return df.filter(F.col("data_origin") != origin)


def origin_state_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Live and deleted rows per table and origin with a row for every combination.

    Tables without a tombstone column are all live; a missing origin reads as real.
    """
    counted = []
    for name, df in tables.items():
        state = F.lit("live")
        if "deleted_at" in df.columns:
            state = F.when(F.col("deleted_at").isNull(), "live").otherwise("deleted")
        origin = F.coalesce(F.col("data_origin"), F.lit("real"))
        sums = df.groupBy(origin.alias("origin"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
        counted.append(sums.select(F.lit(name).alias("table_name"), "origin", "state", "n"))
    spark = next(iter(tables.values())).sparkSession
    empty = [(t, o, s, 0) for t in tables for o in ORIGINS for s in ("live", "deleted")]
    out = spark.createDataFrame(empty, "table_name string, origin string, state string, n bigint")
    for sums in counted:
        out = out.unionByName(sums.filter(F.col("origin").isin(*ORIGINS)))
    return out.groupBy("table_name", "origin", "state").agg(F.sum("n").alias("n"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out: DataFrame | None = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables given")
    return out


def profile_columns(df: DataFrame, table: str, samples: int = 5) -> DataFrame:
    """Type and first distinct values (in text order) of every column.

    Values are made distinct first, so a column with few values comes to a window of few rows; of a column with many, each task keeps
    the few smallest before the shuffle (window group limit).
    """
    typed = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in typed])
    values = df.select(F.inline(pairs)).filter(F.col("v").isNotNull())
    rank = F.row_number().over(Window.partitionBy("column_name").orderBy("v"))
    head = values.distinct().withColumn("_rn", rank).filter(F.col("_rn") <= samples).drop("_rn")
    packed = head.groupBy("column_name").agg(F.array_sort(F.collect_list("v")).alias("sample_values"))
    names = df.sparkSession.createDataFrame([(table, c, k) for c, k in typed.items()], "table_name string, column_name string, data_type string")
    return names.join(packed, "column_name", "left").select(
        "table_name", "column_name", "data_type", F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values")
    )


# How the tables relate (table, column, related table, related column).
RELATIONSHIPS = (
    ("billing_usage", "sku_name", "list_prices", "sku_name"),
    ("billing_usage", "cloud", "list_prices", "cloud"),
    ("billing_usage", "usage_unit", "list_prices", "usage_unit"),
    ("billing_usage", "cluster_id", "clusters", "cluster_id"),
    ("billing_usage", "warehouse_id", "warehouses", "warehouse_id"),
    ("billing_usage", "job_id", "jobs", "job_id"),
    ("billing_usage", "workspace_id", "clusters", "workspace_id"),
    ("billing_usage", "workspace_id", "warehouses", "workspace_id"),
    ("billing_usage", "workspace_id", "jobs", "workspace_id"),
    ("billing_usage", "account_id", "list_prices", "account_id"),
    ("billing_usage", "account_id", "clusters", "account_id"),
    ("billing_usage", "account_id", "warehouses", "account_id"),
    ("billing_usage", "account_id", "jobs", "account_id"),
)


def relationship_coverage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """For every known relationship, the distinct keys on the left and how many of them the right side has."""
    out: DataFrame | None = None
    for table, column, other, other_column in RELATIONSHIPS:
        if table not in tables or other not in tables:
            continue
        if column not in tables[table].columns or other_column not in tables[other].columns:
            continue
        left = tables[table].filter(F.col(column).isNotNull()).select(F.col(column).alias("k")).distinct()
        right = tables[other].select(F.col(other_column).alias("k"), F.lit(1).alias("_hit")).distinct()
        one = left.join(right, "k", "left").agg(F.count(F.lit(1)).alias("keys"), F.count("_hit").alias("matched"))
        one = one.select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(other).alias("related_table"),
            F.lit(other_column).alias("related_column"), "keys", "matched",
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no related tables given")
    return out


def interaction_log_stats(log: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Rollup of an interaction log over the last days: total, by provider, by type and the success rate.

    Input columns: ``timestamp``, ``provider``, ``execution_type``, ``execution_status``. One scan with grouping sets.
    """
    moment = F.lit(as_of).cast("timestamp_ntz")
    recent = log.filter(F.col("timestamp") > moment - F.make_dt_interval(F.lit(days)))
    success = F.avg(F.when(F.col("execution_status") == "success", 100.0).otherwise(0.0))
    kind = F.grouping_id("provider", "execution_type")
    sums = recent.groupingSets(
        [[F.col("provider")], [F.col("execution_type")], []], F.col("provider"), F.col("execution_type")
    ).agg(F.count(F.lit(1)).alias("executions"), F.coalesce(success, F.lit(0.0)).alias("success_rate"), kind.alias("_g"))
    return sums.select(
        F.when(F.col("_g") == 1, "provider").when(F.col("_g") == 2, "type").otherwise("total").alias("kind"),
        F.coalesce("provider", "execution_type").alias("label"),
        "executions",
        "success_rate",
    )


def _prepared(table: str, df: DataFrame, origin: str) -> DataFrame:
    out = conform(df, struct(table)) if table in SCHEMAS else df.drop("data_origin", "deleted_at")
    if table == "column_lineage":
        out = out.filter(F.col("source_table_full_name").isNotNull())
    return out.withColumn("data_origin", F.lit(origin)).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))


def load_table(df: DataFrame, root: str, table: str, origin: str, replace: bool = True) -> None:
    """Write one table: replace its origin, or append (skipping loaded keys), or upsert workspaces."""
    spark = df.sparkSession
    path = f"{root}/{table}"
    new = _prepared(table, df, origin)
    if table == "workspaces" and files.has_rows_for(spark, path, origin):
        existing = files.read_table(spark, path).filter(F.col("data_origin") == origin)
        files.replace_partition(upsert_keep_existing(existing, new), path, origin)
    elif replace or table == "workspaces" or not files.has_rows_for(spark, path, origin):
        files.replace_partition(new, path, origin)
    else:
        if table not in DEDUP_KEYS:
            files.append_partition(new, path, origin)
            return
        # Keys meet keys; what they share is mostly little, so that whole rows need not travel to meet it.
        keys = [DEDUP_KEYS[table], "data_origin"]
        shared = files.read_table(spark, path).select(*keys).join(new.select(*keys), keys, "left_semi").distinct()
        folder = files.staged_folder(shared, path)
        try:
            files.append_partition(rows_to_append(new, spark.read.schema(shared.schema).parquet(folder), keys[0]), path, origin)
        finally:
            files.drop_folder(spark, folder)


def ingest_all(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    root: str,
    origin: str = "real",
    replace: bool = False,
    only: set[str] | None = None,
    on_table: Callable[[str], None] | None = None,
) -> DataFrame:
    """Load the given tables in the fixed order and return the rows each now holds for the origin.

    Event tables and configuration are always replaced; usage and query history append unless ``replace`` is set.
    """
    loaded = {}
    for table in LOAD_ORDER:
        if table not in frames or (only is not None and table not in only):
            continue
        load_table(frames[table], root, table, origin, replace or table not in DEDUP_KEYS)
        loaded[table] = files.read_table(spark, f"{root}/{table}").filter(F.col("data_origin") == origin)
        if on_table is not None:
            on_table(table)
    return table_counts(loaded)


CURSOR_SCHEMA = (
    "table_name string, data_origin string, max_update_time timestamp_ntz, max_record_id string, rows_ingested bigint"
)


def read_cursors(spark: SparkSession, root: str) -> DataFrame:
    """Newest cursor of each (table, origin); cursors are an append-only log of at most one row per load."""
    from lakegauge.sources.files import _fs

    fs, path = _fs(spark, f"{root}/ingest_cursors")
    if not fs.exists(path):
        return spark.createDataFrame([], CURSOR_SCHEMA)
    log = spark.read.schema(CURSOR_SCHEMA).parquet(f"{root}/ingest_cursors")
    return log.groupBy("table_name", "data_origin").agg(
        F.max("max_update_time").alias("max_update_time"),
        F.max_by("max_record_id", "max_update_time").alias("max_record_id"),
        F.sum("rows_ingested").alias("rows_ingested"),
    )


def incremental_load(spark: SparkSession, frames: Mapping[str, DataFrame], root: str, origin: str = "real") -> DataFrame:
    """Append what is newer than each table's cursor and advance the cursors; returns the cursor rows of this run.

    The new rows are taken once, as a written snapshot that goes after the load. Rows that the table already holds are left out, so a run that
    died after its rows and before its cursor does not load them twice, and rows without a time load once. Only loaded rows after the cursor and
    those without a time can equal a new one, so no others are compared. A row sent again under a known key with a newer time does not replace the
    loaded one, as in every append.
    """
    known = {
        r["table_name"]: r["max_update_time"]
        for r in read_cursors(spark, root).filter(F.col("data_origin") == origin).collect()
    }
    run: DataFrame | None = None
    for table, (time_column, _) in CURSOR_COLUMNS.items():
        if table not in frames:
            continue
        if time_column not in frames[table].columns:
            continue
        path = f"{root}/{table}"
        new = conform(rows_after(frames[table], time_column, known.get(table)), struct(table))
        if files.has_rows_for(spark, path, origin):
            loaded = files.read_table(spark, path).filter(F.col("data_origin") == origin).drop("data_origin")
            recent = rows_after(loaded, time_column, known.get(table))
            if not recent.isEmpty():
                new = rows_not_in(new, recent)
        snapshot = files.staged_folder(new, root)
        try:
            new = spark.read.schema(new.schema).parquet(snapshot)
            # The cursor is taken before the load, from the same rows.
            cursor = next_cursor(new, table, origin).collect()
            if not cursor[0]["rows_ingested"]:
                continue
            load_table(new, root, table, origin, replace=False)
        finally:
            files.drop_folder(spark, snapshot)
        moved = spark.createDataFrame(cursor, CURSOR_SCHEMA)
        moved.write.mode("append").parquet(f"{root}/ingest_cursors")
        run = moved if run is None else run.unionByName(moved)
    return run if run is not None else spark.createDataFrame([], CURSOR_SCHEMA)
