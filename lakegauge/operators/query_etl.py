"""Query history to normalised statements, tables, columns, tags, parameters and errors.

One lazy plan of built-in expressions: no Python runs per row. ``analyse`` makes the wide frame with the nested child
arrays; the ``qi_*`` functions project it. To write all six tables use ``lakegauge.plans.qi_build``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakegauge.functions import errors, sqltext
from lakegauge.functions.common import latest_by_key, let
from lakegauge.functions.quantiles import ranked_values

# Words that never become project keywords.
KEYWORD_STOPLIST = (
    "default", "main", "system", "hive_metastore", "information_schema", "tmp", "test", "dev", "prod", "uat",
    "staging", "demo", "sandbox", "schema", "table", "user", "users",
)

#: A full scan reads more than this many bytes and returns fewer than FULL_SCAN_ROWS rows.
FULL_SCAN_BYTES = 107374182400
FULL_SCAN_ROWS = 1000

TEXT_IDS = ("statement_id", "account_id", "workspace_id", "executed_by", "executed_by_user_id", "executed_as",
            "executed_as_user_id", "session_id", "statement_type", "execution_status", "client_application",
            "client_driver", "cache_origin_statement_id")
NUMBERS = ("total_duration_ms", "waiting_for_compute_duration_ms", "waiting_at_capacity_duration_ms",
           "execution_duration_ms", "compilation_duration_ms", "total_task_duration_ms", "result_fetch_duration_ms",
           "read_partitions", "pruned_files", "read_files", "read_rows", "produced_rows", "read_bytes",
           "read_io_cache_percent", "spilled_local_bytes", "written_bytes", "shuffle_read_bytes", "written_rows",
           "written_files", "pruned_files_bytes", "read_files_bytes")
TIMES = ("start_time", "end_time", "update_time")

#: output column -> path in the source structs
NESTED_TEXT = {
    "compute_type": "compute.type",
    "warehouse_id": "compute.warehouse_id",
    "cluster_id": "compute.cluster_id",
    "job_id": "query_source.job_info.job_id",
    "job_run_id": "query_source.job_info.job_run_id",
    "job_task_run_id": "query_source.job_info.job_task_run_id",
    "pipeline_id": "query_source.pipeline_info.pipeline_id",
    "update_id": "query_source.pipeline_info.update_id",
    "notebook_id": "query_source.notebook_id",
    "dashboard_id": "query_source.dashboard_id",
    "legacy_dashboard_id": "query_source.legacy_dashboard_id",
    "alert_id": "query_source.alert_id",
    "sql_query_id": "query_source.sql_query_id",
    "genie_space_id": "query_source.genie_space_id",
}
LITERAL_FIELDS = ("string_value", "int_value", "long_value", "double_value", "boolean_value", "date_value",
                  "timestamp_value")
PARAM_TYPE = "array<struct<param_name:string,param_value:string,param_type:string>>"
TAG_TYPE = "array<struct<tag_key:string,tag_value:string>>"


def _type_at(schema: T.StructType, path: str) -> T.DataType | None:
    node: T.DataType = schema
    for name in path.split("."):
        if not isinstance(node, T.StructType) or name not in node.names:
            return None
        node = node[name].dataType
    return node


def _at(df: DataFrame, path: str, kind: str) -> Column:
    """A possibly nested column, NULL where the source does not have it."""
    found = _type_at(df.schema, path)
    return F.lit(None).cast(kind) if found is None or isinstance(found, T.NullType) else F.col(path)


def clean_text(column: Column) -> Column:
    return F.nullif(F.btrim(column.cast("string"), F.lit(sqltext.WHITE)), F.lit(""))


def qi_flatten(history: DataFrame) -> DataFrame:
    """Flat statement columns: trimmed text, tolerant numbers, nested identifiers lifted to the top."""
    out = [clean_text(_at(history, c, "string")).alias(c) for c in TEXT_IDS]
    out += [clean_text(_at(history, path, "string")).alias(c) for c, path in NESTED_TEXT.items()]
    out += [_at(history, c, "bigint").try_cast("bigint").alias(c) for c in NUMBERS]
    out += [_at(history, c, "timestamp_ntz").try_cast("timestamp_ntz").alias(c) for c in TIMES]
    out.append(_at(history, "from_result_cache", "boolean").try_cast("boolean").alias("from_result_cache"))
    out.append(clean_text(_at(history, "statement_text", "string")).alias("statement_text"))
    out.append(clean_text(_at(history, "error_message", "string")).alias("error_message"))
    out.append(_parameters(history).alias("_params"))
    out.append(_tags(history).alias("_tags"))
    if "data_origin" in history.columns:
        out.append(F.col("data_origin"))
    return history.select(*out)


def _parameters(history: DataFrame) -> Column:
    kind = _type_at(history.schema, "query_parameters.named_parameters")
    if not isinstance(kind, T.MapType):
        return F.array().cast(PARAM_TYPE)
    literal_type = kind.valueType["exprs"].dataType.elementType["literal"].dataType

    def describe(entry: Column) -> Column:
        first = F.get(entry["value"]["exprs"], F.lit(0))
        texts = []
        for name in LITERAL_FIELDS:
            if name in literal_type.names:
                text = first["literal"][name].cast("string")
                texts.append(F.initcap(text) if name == "boolean_value" else text)
        value = F.coalesce(*texts) if texts else F.lit(None).cast("string")
        return F.struct(
            entry["key"].alias("param_name"),
            value.alias("param_value"),
            first["data_type"]["type_name"].alias("param_type"),
        )

    entries = F.map_entries(F.col("query_parameters.named_parameters"))
    return F.coalesce(F.transform(entries, describe).cast(PARAM_TYPE), F.array().cast(PARAM_TYPE))


def _tags(history: DataFrame) -> Column:
    kind = _type_at(history.schema, "query_tags")
    if not isinstance(kind, T.MapType):
        return F.array().cast(TAG_TYPE)
    pairs = F.transform(
        F.map_entries(F.col("query_tags")),
        lambda e: F.struct(e["key"].cast("string").alias("tag_key"), e["value"].cast("string").alias("tag_value")),
    )
    return F.coalesce(pairs.cast(TAG_TYPE), F.array().cast(TAG_TYPE))


def source_category() -> Column:
    present = [
        ("JOB", F.col("job_id")),
        ("PIPELINE", F.col("pipeline_id")),
        ("NOTEBOOK", F.col("notebook_id")),
        ("DASHBOARD", F.coalesce("dashboard_id", "legacy_dashboard_id")),
        ("ALERT", F.col("alert_id")),
        ("SQL_QUERY", F.col("sql_query_id")),
        ("GENIE", F.col("genie_space_id")),
    ]
    out = F
    for name, column in present:
        out = out.when(column.isNotNull(), name)
    return out.otherwise("AD_HOC")


def _four_places(value: Column) -> Column:
    """Rounding in binary arithmetic only, so that every engine gives the same double on ties."""
    return F.floor(value * 10000 + 0.5) / F.lit(10000.0)


def _share(part: Column, whole: Column) -> Column:
    """Quotient to four places, NULL unless the whole is positive."""
    return F.when(whole > 0, _four_places(part.cast("double") / whole.cast("double")))


def metric_columns() -> dict[str, Column]:
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("total_duration_ms", zero)
    waiting = F.coalesce("waiting_for_compute_duration_ms", zero) + F.coalesce("waiting_at_capacity_duration_ms", zero)
    files = F.col("read_files") + F.col("pruned_files")
    selectivity = F.when(
        F.col("read_rows") != 0,
        _four_places(F.col("produced_rows").cast("double") / F.col("read_rows").cast("double")),
    )
    scan = (F.col("read_bytes") > F.lit(FULL_SCAN_BYTES)) & (F.col("produced_rows") < FULL_SCAN_ROWS)
    return {
        "pruning_ratio": _share(F.col("pruned_files"), files),
        "selectivity_ratio": selectivity,
        "waiting_pct": _share(waiting, total),
        "compile_pct": _share(F.coalesce("compilation_duration_ms", zero), total),
        "is_full_scan": F.coalesce(scan, F.lit(False)),
        "is_cache_hit": F.col("from_result_cache"),
    }


def time_columns() -> dict[str, Column]:
    start = F.col("start_time")
    hour = F.hour(start)
    return {
        "start_date": F.to_date(start),
        "start_hour": hour,
        "start_day_of_week": F.weekday(start),
        "is_off_hours": (hour < 7) | (hour >= 19),
        "is_weekend": F.weekday(start) >= 5,
    }


def identity_columns() -> dict[str, Column]:
    return {
        "is_delegated": F.coalesce(F.col("executed_by") != F.col("executed_as"), F.lit(False)),
        "principal_kind": errors.principal_kind(F.col("executed_by"), F.col("executed_by_user_id")),
        "client_driver_family": errors.driver_family(F.col("client_driver")),
        "client_driver_version": errors.driver_version(F.col("client_driver")),
        "source_category": source_category(),
        "is_parameterized": F.size("_params") > 0,
    }


def error_columns() -> dict[str, Column]:
    message = F.col("error_message")
    return {
        "error_category": errors.error_category(message),
        "error_code": errors.error_code(message),
        "sqlstate": errors.sqlstate(message),
    }


def text_columns() -> dict[str, Column]:
    text = F.col("statement_text")
    return {
        "statement_text_length": F.coalesce(F.length(text), F.lit(0)),
        "statement_text_sha1": F.sha1(text.cast("binary")),
        "statement_text_excerpt": F.left(text, F.lit(2000)),
    }


def _non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda p: p.isNotNull() & (p != ""))


def project_keywords(tables: Column, tags: Column, params: Column, cap: int | None = None) -> Column:
    """Lower-case tokens of catalogs and schemas, tag values and parameter names; sorted, the first ``cap`` if given."""
    names = F.flatten(F.transform(tables, lambda t: F.array(t["catalog"], t["schema"])))
    tokens = F.flatten(F.transform(_non_empty(names), lambda n: F.split(F.lower(n), r"[_\-.\s]+")))
    long_tokens = F.filter(
        F.concat(tokens, F.transform(params, lambda p: F.lower(p["param_name"]))), lambda t: F.length(t) > 2
    )
    values = _non_empty(F.transform(tags, lambda t: F.lower(t["tag_value"])))
    stop = F.split(F.lit(",".join(KEYWORD_STOPLIST)), ",")
    words = F.array_sort(F.array_except(F.concat(long_tokens, values), stop))
    return words if cap is None else F.slice(words, 1, cap)


def touched(tables: Column, field: str, cap: int | None = None) -> Column:
    """Sorted distinct values of one field of the table references."""
    values = F.array_sort(F.array_distinct(_non_empty(F.transform(tables, lambda t: t[field]))))
    return values if cap is None else F.slice(values, 1, cap)


def text_analysis(df: DataFrame, text: str = "statement_text") -> DataFrame:
    """Add ``is_sql``, the reduced text, flags, the normal-form hash and the ``_tables`` / ``_columns`` arrays.

    The keyword and the reduced text are bound inside each expression, so a filter on one result, pushed down to the
    scan, recomputes that result only.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"is_sql": sqltext.looks_like_sql(value), "_kw": sqltext.first_keyword(value)})
    df = df.withColumn("_clean", F.when(F.col("is_sql"), sqltext.reduced(value)).otherwise(F.lit("")))
    sql, clean, keyword = F.col("is_sql"), F.col("_clean"), F.col("_kw")
    marks = {name: sql & flag for name, flag in sqltext.flags(clean, keyword).items()}
    bound = F.struct(clean.alias("c"), keyword.alias("k"))
    tables = let(bound, lambda b: sqltext.sql_tables(b["c"], b["k"]))
    columns = let(bound, lambda b: sqltext.sql_columns(b["c"], b["k"]))
    return df.withColumns(
        {
            **marks,
            "normalized_sql_hash": F.when(sql, F.sha1(sqltext.normalised(clean).cast("binary"))),
            "_tables": F.when(sql, tables).otherwise(let(value, sqltext.freetext_tables)),
            "_columns": F.when(sql, columns).otherwise(F.array().cast(sqltext.COLUMN_TYPE)),
        }
    ).drop("_kw", "_clean")


def analyse(history: DataFrame, keywords_cap: int | None = None, tables_cap: int | None = None) -> DataFrame:
    """Everything derived from one history row, child rows still nested in arrays. The caps cut the two lists if given."""
    df = text_analysis(qi_flatten(history))
    df = df.withColumns(
        {**metric_columns(), **time_columns(), **identity_columns(), **error_columns(), **text_columns()}
    )
    tables = F.col("_tables")
    return df.withColumns(
        {
            "project_keywords": project_keywords(tables, F.col("_tags"), F.col("_params"), keywords_cap),
            "catalogs_touched": touched(tables, "catalog"),
            "schemas_touched": touched(tables, "schema"),
            "tables_touched": touched(tables, "fully_qualified", tables_cap),
        }
    )


def _origin(df: DataFrame) -> list[str]:
    return ["data_origin"] if "data_origin" in df.columns else []


def qi_statements(analysed: DataFrame) -> DataFrame:
    """One row per statement, without the full texts and the nested child rows."""
    return analysed.drop("_tables", "_columns", "_tags", "_params", "statement_text", "error_message")


def _children(analysed: DataFrame, array: str) -> DataFrame:
    """Child rows of one array. The outer form with a filter behind it avoids the emptiness test that Spark would push
    below the projection, which would compute the array twice."""
    fields = analysed.schema[array].dataType.elementType.names
    rows = analysed.select("statement_id", *_origin(analysed), F.inline_outer(F.col(array)))
    return rows.filter(F.col(fields[0 if array != "_tables" else 2]).isNotNull())


def qi_tables(analysed: DataFrame) -> DataFrame:
    return _children(analysed, "_tables")


def qi_columns(analysed: DataFrame) -> DataFrame:
    return _children(analysed, "_columns")


def qi_tags(analysed: DataFrame) -> DataFrame:
    return _children(analysed, "_tags")


def qi_parameters(analysed: DataFrame) -> DataFrame:
    return _children(analysed, "_params")


def qi_errors(analysed: DataFrame) -> DataFrame:
    """One row per failed statement or statement with a message; the earliest row wins."""
    failed = analysed.filter((F.col("execution_status") == "FAILED") | F.col("error_message").isNotNull())
    message = F.col("error_message")
    rows = failed.select(
        "statement_id",
        *_origin(analysed),
        "error_category",
        "error_code",
        "sqlstate",
        F.left(message, F.lit(2000)).alias("error_message_excerpt"),
        errors.error_object(message).alias("referenced_object"),
        errors.error_user(message).alias("referenced_user"),
        F.col("start_time").alias("_at"),
    )
    order = [F.col("_at").asc_nulls_last(), F.col("error_message_excerpt").asc_nulls_last()]
    return latest_by_key(rows, ["statement_id", *_origin(analysed)], order).drop("_at")


def expensive_threshold(statements: DataFrame, share: float = 0.99) -> DataFrame:
    """Duration at 1-based rank ``max(1, floor(share * n))``, a missing duration counting as 0. One row."""
    durations = statements.select(F.coalesce("total_duration_ms", F.lit(0).cast("bigint")).alias("_d"))
    rank = F.greatest(F.lit(0).cast("bigint"), F.floor(F.col("n") * F.lit(share)) - 1)
    return ranked_values(durations, [], "_d", {"threshold": rank}).select("threshold")


def qi_expensive(statements: DataFrame, share: float = 0.99) -> DataFrame:
    """Add ``is_expensive``: at or above the threshold duration, unless that is 0."""
    threshold = expensive_threshold(statements, share).scalar()
    duration = F.coalesce("total_duration_ms", F.lit(0).cast("bigint"))
    return statements.withColumn("is_expensive", F.coalesce((duration >= threshold) & (threshold > 0), F.lit(False)))
