"""Analytics over the ``qi_*`` tables.

``s`` is qi_statements, ``t`` qi_statement_tables, ``c`` qi_statement_columns, ``e`` qi_statement_errors, all scoped to
one origin. Percentiles are exact and computed from value counts (see ``functions.quantiles``), so that a dashboard or
an application with a third of all statements does not end up in one task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.common import count_if, date_range, ratio, top
from lakegauge.functions.quantiles import add_percentiles

GRAINS = ("day", "week", "month", "quarter", "year")
P50 = {"p50_ms": 0.5}
P50_P95 = {"p50_ms": 0.5, "p95_ms": 0.95}


#: A session that read more than this is a bulk export.
FIVE_GIB = 5368709120


def select_statements(
    s: DataFrame,
    start: date | None = None,
    end: date | None = None,
    workspace_id: str | None = None,
    source_category: str | None = None,
) -> DataFrame:
    """The optional filters every operator here accepts, applied before it."""
    s = date_range(s, "start_date", start, end)
    if workspace_id:
        s = s.filter(F.col("workspace_id") == workspace_id)
    if source_category:
        s = s.filter(F.col("source_category") == source_category)
    return s


def status(value: str) -> Column:
    return F.col("execution_status") == value


def _n() -> Column:
    return F.count(F.lit(1))


def overview(s: DataFrame) -> DataFrame:
    """Headline figures in one aggregation, with the median and 95th percentile attached."""
    sums = s.agg(
        _n().alias("total_statements"),
        F.countDistinct("executed_by").alias("distinct_users"),
        F.countDistinct("workspace_id").alias("distinct_workspaces"),
        count_if(status("FINISHED")).alias("_finished"),
        count_if(status("FAILED")).alias("failed_count"),
        count_if(status("CANCELED")).alias("canceled_count"),
        count_if(F.col("from_result_cache")).alias("_cached"),
        count_if(F.col("compute_type") == "SERVERLESS_COMPUTE").alias("_serverless"),
        *[
            count_if(F.col("source_category") == c).alias(f"{c.lower()}_query_count")
            for c in ("GENIE", "DASHBOARD", "JOB", "NOTEBOOK")
        ],
        F.min("start_date").alias("date_min"),
        F.max("start_date").alias("date_max"),
    )
    n = F.greatest(F.col("total_statements"), F.lit(1))
    rated = sums.withColumns(
        {
            "success_rate": ratio(F.col("_finished"), n, 4),
            "cache_hit_rate": ratio(F.col("_cached"), n, 4),
            "serverless_share": ratio(F.col("_serverless"), n, 4),
        }
    ).drop("_finished", "_cached", "_serverless")
    return add_percentiles(rated, s, [], "total_duration_ms", {"median_duration_ms": 0.5, "p95_duration_ms": 0.95})


def expensive_queries(s: DataFrame, limit: int = 50) -> DataFrame:
    columns = ["statement_id", "executed_by", "workspace_id", "warehouse_id", "compute_type", "total_duration_ms",
               "read_bytes", "shuffle_read_bytes", "spilled_local_bytes", "produced_rows", "statement_type",
               "statement_text_excerpt", "start_time"]
    return top(s.select(*columns), [F.col("total_duration_ms").desc_nulls_last(), F.col("statement_id")], limit)


def full_scans(s: DataFrame, limit: int = 50) -> DataFrame:
    columns = ["statement_id", "executed_by", "workspace_id", "read_bytes", "produced_rows", "total_duration_ms",
               "statement_text_excerpt", "start_time"]
    found = s.filter(F.col("is_full_scan")).select(*columns)
    return top(found, [F.col("read_bytes").desc_nulls_last(), F.col("statement_id")], limit)


def spill_leaders(s: DataFrame, limit: int = 20) -> DataFrame:
    sums = (
        s.filter(F.col("spilled_local_bytes") > 0)
        .groupBy(F.col("executed_by").alias("user"))
        .agg(F.sum("spilled_local_bytes").alias("spill_bytes"), _n().alias("statements"))
    )
    return top(sums, [F.col("spill_bytes").desc(), F.col("user").asc_nulls_last()], limit)


def error_trends(s: DataFrame) -> DataFrame:
    found = s.filter(F.col("error_category").isNotNull())
    return (
        found.groupBy(F.col("start_date").alias("d"), F.col("error_category").alias("category"))
        .agg(_n().alias("n"))
        .orderBy("d", "category")
    )


def error_trends_wide(trends: DataFrame, categories: list[str]) -> DataFrame:
    """Chart form: one column per category."""
    return trends.groupBy("d").pivot("category", categories).agg(F.sum("n")).fillna(0, categories).orderBy("d")


def error_categories(s: DataFrame) -> DataFrame:
    found = s.filter(F.col("error_category").isNotNull())
    sums = found.groupBy(F.col("error_category").alias("category"), F.col("error_code").alias("code")).agg(
        _n().alias("n")
    )
    return sums.orderBy(F.col("n").desc(), "category", F.col("code").asc_nulls_last())


def error_category_totals(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "category")


def capacity_queueing(s: DataFrame) -> DataFrame:
    return (
        s.filter(F.col("start_hour").isNotNull())
        .groupBy(F.col("start_hour").alias("hour"), F.col("workspace_id").alias("workspace"))
        .agg(F.avg("waiting_at_capacity_duration_ms").alias("avg_wait_ms"), _n().alias("statements"))
        .orderBy("hour", "workspace")
    )


def cache_effectiveness(s: DataFrame, limit: int = 50) -> DataFrame:
    sums = (
        s.filter(F.col("dashboard_id").isNotNull())
        .groupBy(F.col("dashboard_id").alias("dashboard"))
        .agg(_n().alias("total"), count_if(F.col("from_result_cache")).alias("cache_hits"))
    )
    head = top(sums, [F.col("total").desc(), F.col("dashboard")], limit)
    return head.withColumn("cache_rate", ratio(F.col("cache_hits"), F.col("total")))


def _with_statements(child: DataFrame, s: DataFrame, *columns: str) -> DataFrame:
    return child.select("statement_id", *[c for c in child.columns if c not in ("statement_id", "data_origin")]).join(
        s.select("statement_id", *columns), "statement_id"
    )


def top_tables(s: DataFrame, t: DataFrame, limit: int = 20, role: str | None = None) -> DataFrame:
    if role:
        t = t.filter(F.col("role") == role)
    names = ["fully_qualified", "catalog", "schema", "table_name"]
    sums = (
        _with_statements(t.select("statement_id", *names), s, "executed_by")
        .groupBy(*names)
        .agg(F.countDistinct("statement_id").alias("statements"), F.countDistinct("executed_by").alias("users"))
        .withColumnRenamed("fully_qualified", "table")
    )
    return top(
        sums, [F.col("statements").desc(), F.col("table"), F.col("catalog").asc_nulls_last(), F.col("schema").asc_nulls_last()], limit
    )


def top_columns(c: DataFrame, limit: int = 20, role: str | None = None) -> DataFrame:
    if role:
        c = c.filter(F.col("role") == role)
    sums = c.groupBy("column_name", "role").agg(F.countDistinct("statement_id").alias("statements"))
    return top(sums, [F.col("statements").desc(), F.col("column_name"), F.col("role")], limit)


def partitioning_candidates(s: DataFrame, t: DataFrame, limit: int = 20, min_statements: int = 5) -> DataFrame:
    reads = t.filter(F.col("role") == "read").select("statement_id", "fully_qualified")
    sums = (
        _with_statements(reads, s.filter(F.col("pruning_ratio").isNotNull()), "pruning_ratio", "read_bytes")
        .groupBy(F.col("fully_qualified").alias("table"))
        .agg(
            F.avg("pruning_ratio").alias("avg_pruning"),
            F.sum("read_bytes").alias("read_bytes"),
            F.countDistinct("statement_id").alias("statements"),
        )
        .filter(F.col("statements") >= min_statements)
    )
    return top(sums, [F.round("avg_pruning", 9).asc(), F.col("table")], limit)


def zombie_tables(t: DataFrame, limit: int = 20) -> DataFrame:
    """Tables that are written and never read."""
    read = t.filter(F.col("role") == "read").select("fully_qualified").distinct()
    sums = (
        t.filter(F.col("role") == "write")
        .groupBy("fully_qualified")
        .agg(F.countDistinct("statement_id").alias("write_count"))
        .join(read, "fully_qualified", "left_anti")
        .withColumnRenamed("fully_qualified", "table")
    )
    return top(sums, [F.col("write_count").desc(), F.col("table")], limit)


def parameterised_share(s: DataFrame) -> DataFrame:
    return s.agg(_n().alias("total"), count_if(F.col("is_parameterized")).alias("parameterized")).withColumn(
        "unparameterized", F.col("total") - F.col("parameterized")
    )


def failed_cost(s: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    duration = F.col("total_duration_ms")
    sums = s.agg(
        F.coalesce(F.sum(duration), zero).alias("total_ms"),
        F.coalesce(F.sum(F.when(status("FAILED"), duration)), zero).alias("failed_ms"),
        F.coalesce(F.sum(F.when(status("CANCELED"), duration)), zero).alias("canceled_ms"),
    )
    wasted = ratio(F.col("failed_ms") + F.col("canceled_ms"), F.col("total_ms"), 4)
    return sums.withColumn("wasted_share", F.coalesce(wasted, F.lit(0.0)))


def source_attribution(s: DataFrame) -> DataFrame:
    return (
        s.groupBy(F.col("source_category").alias("category"))
        .agg(
            _n().alias("statements"),
            F.sum("total_duration_ms").alias("total_ms"),
            F.avg("total_duration_ms").alias("avg_ms"),
        )
        .orderBy(F.col("total_ms").desc_nulls_last(), "category")
    )


def project_statements(s: DataFrame, t: DataFrame, keyword: str) -> DataFrame:
    """Statements that touch a table whose name matches the keyword; ``%`` and ``_`` act as wildcards."""
    pattern = f"%{keyword.lower()}%"
    hit = F.lit(False)
    for column in ("catalog", "schema", "table_name", "fully_qualified"):
        hit = hit | F.lower(column).like(pattern)
    return s.join(t.filter(hit).select("statement_id"), "statement_id", "left_semi")


def project_search_summary(s: DataFrame, t: DataFrame, keyword: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return project_statements(s, t, keyword).agg(
        _n().alias("statements"),
        F.countDistinct("executed_by").alias("users"),
        F.countDistinct("workspace_id").alias("workspaces"),
        F.coalesce(F.sum("total_duration_ms"), zero).alias("total_ms"),
        F.coalesce(F.sum("read_bytes"), zero).alias("read_bytes"),
        count_if(status("FAILED")).alias("failed"),
    )


def project_search_daily(s: DataFrame, t: DataFrame, keyword: str) -> DataFrame:
    return (
        project_statements(s, t, keyword)
        .groupBy(F.col("start_date").alias("d"))
        .agg(_n().alias("statements"), F.sum("total_duration_ms").alias("total_ms"))
        .orderBy("d")
    )


def project_search_users(s: DataFrame, t: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    sums = project_statements(s, t, keyword).groupBy(F.col("executed_by").alias("user")).agg(_n().alias("statements"))
    return top(sums, [F.col("statements").desc(), F.col("user").asc_nulls_last()], limit)


def safe_grain(grain: str | None, default: str) -> str:
    grain = (grain or "").strip().lower()
    return grain if grain in GRAINS else default


def _period(grain: str) -> Column:
    return F.to_date(F.date_trunc(grain, F.col("start_date"))).alias("period")


def adoption_trend(s: DataFrame, grain: str | None = None) -> DataFrame:
    """Distinct users, dashboards, jobs, notebooks and spaces per period.

    The five distinct counts are reduced one id at a time: rows become (period, kind, id) pairs, are made distinct with
    map-side combining and only then counted, so no period collects its ids in one task.
    """
    kinds = {"users": "executed_by", "dashboards": "dashboard_id", "jobs": "job_id", "notebooks": "notebook_id",
             "genie_spaces": "genie_space_id"}
    dated = s.filter(F.col("start_date").isNotNull()).withColumn("period", _period(safe_grain(grain, "month")))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in kinds.items()])
    long = dated.select("period", F.inline(pairs)).filter(F.col("id").isNotNull()).distinct()
    per_kind = long.groupBy("period").agg(*[count_if(F.col("kind") == k).alias(k) for k in kinds])
    counts = dated.groupBy("period").agg(_n().alias("statements"))
    return counts.join(per_kind, "period", "left").select(
        "period", *[F.coalesce(k, F.lit(0).cast("bigint")).alias(k) for k in kinds], "statements"
    ).orderBy("period")


def compute_share_trend(s: DataFrame, grain: str | None = None) -> DataFrame:
    dated = s.filter(F.col("start_date").isNotNull())
    return (
        dated.groupBy(_period(safe_grain(grain, "day")))
        .agg(
            count_if(F.col("compute_type") == "SERVERLESS_COMPUTE").alias("serverless"),
            count_if(F.col("compute_type") == "WAREHOUSE").alias("warehouse"),
            _n().alias("total"),
        )
        .orderBy("period")
    )


def reliability(s: DataFrame, grain: str | None = None) -> DataFrame:
    dated = s.filter(F.col("start_date").isNotNull())
    sums = dated.groupBy(_period(safe_grain(grain, "week"))).agg(
        _n().alias("total"),
        count_if(status("FINISHED")).alias("finished"),
        count_if(status("FAILED")).alias("failed"),
        count_if(status("CANCELED")).alias("canceled"),
    )
    return sums.withColumn("success_rate", ratio(F.col("finished"), F.col("total"))).orderBy("period")


def job_failure_rates(s: DataFrame, limit: int = 20, min_statements: int = 5) -> DataFrame:
    sums = (
        s.filter(F.col("job_id").isNotNull())
        .groupBy("job_id")
        .agg(
            _n().alias("statements"),
            count_if(status("FAILED")).alias("failed"),
            F.avg("total_duration_ms").alias("avg_duration_ms"),
        )
        .filter(F.col("statements") >= min_statements)
        .withColumn("failure_rate", ratio(F.col("failed"), F.col("statements"), 4))
    )
    rate = ratio(F.col("failed"), F.col("statements"))
    return top(sums, [rate.desc(), F.col("statements").desc(), F.col("job_id")], limit)


def slowest_pipelines(s: DataFrame, limit: int = 20) -> DataFrame:
    sums = (
        s.filter(F.col("pipeline_id").isNotNull())
        .groupBy("pipeline_id")
        .agg(
            _n().alias("statements"),
            F.avg("total_duration_ms").alias("avg_ms"),
            F.max("total_duration_ms").alias("max_ms"),
            count_if(status("FAILED")).alias("failed"),
        )
    )
    return top(sums, [F.col("avg_ms").desc_nulls_last(), F.col("pipeline_id")], limit)


def compile_heavy(s: DataFrame, limit: int = 20) -> DataFrame:
    found = s.filter((F.col("compile_pct") > 0.25) & (F.col("total_duration_ms") > 500)).select(
        "statement_id", "executed_by", "statement_text_excerpt", "total_duration_ms", "compilation_duration_ms",
        "compile_pct",
    )
    return top(found, [F.col("compile_pct").desc(), F.col("total_duration_ms").desc(), F.col("statement_id")], limit)


def slowest_dashboards(s: DataFrame, limit: int = 20) -> DataFrame:
    found = s.filter(F.col("dashboard_id").isNotNull())
    sums = found.groupBy("dashboard_id").agg(
        _n().alias("query_count"), count_if(F.col("from_result_cache")).alias("cache_hits")
    )
    rated = add_percentiles(sums, found, ["dashboard_id"], "total_duration_ms", P50_P95)
    head = top(rated, [F.col("p95_ms").desc_nulls_last(), F.col("dashboard_id")], limit)
    return head.withColumn("cache_rate", ratio(F.col("cache_hits"), F.col("query_count")))


def _by_application(s: DataFrame) -> DataFrame:
    return s.withColumn("application", F.coalesce("client_application", F.lit("Unknown")))


def vendor_footprint(s: DataFrame, limit: int = 20) -> DataFrame:
    named = _by_application(s)
    sums = named.groupBy("application").agg(
        _n().alias("statements"),
        F.countDistinct("executed_by").alias("users"),
        count_if(status("FAILED")).alias("failed"),
    )
    head = top(sums, [F.col("statements").desc(), F.col("application")], limit)
    rated = head.withColumn("failure_rate", ratio(F.col("failed"), F.col("statements")))
    return add_percentiles(rated, named, ["application"], "total_duration_ms", P50_P95)


def select_star_dashboards(s: DataFrame, limit: int = 20) -> DataFrame:
    sums = (
        s.filter(F.col("dashboard_id").isNotNull())
        .groupBy("dashboard_id")
        .agg(_n().alias("total"), count_if(F.col("has_select_star")).alias("star_count"))
        .filter(F.col("star_count") > 0)
    )
    return top(sums, [F.col("star_count").desc(), F.col("total").desc(), F.col("dashboard_id")], limit)


def notebook_activity(s: DataFrame, limit: int = 20) -> DataFrame:
    found = s.filter(F.col("notebook_id").isNotNull())
    sums = found.groupBy("notebook_id").agg(
        _n().alias("queries"),
        F.countDistinct("executed_by").alias("users"),
        count_if(status("FAILED")).alias("failed"),
    )
    head = top(sums, [F.col("queries").desc(), F.col("notebook_id")], limit)
    return add_percentiles(head, found, ["notebook_id"], "total_duration_ms", P50)


def genie_adoption(s: DataFrame) -> DataFrame:
    found = s.filter(F.col("genie_space_id").isNotNull() & F.col("start_date").isNotNull())
    sums = found.groupBy(_period("week").alias("week")).agg(
        _n().alias("queries"),
        F.countDistinct("genie_space_id").alias("spaces"),
        F.countDistinct("executed_by").alias("users"),
        count_if(status("FINISHED")).alias("finished"),
    )
    return sums.withColumn("success_rate", ratio(F.col("finished"), F.col("queries"))).orderBy("week")


def permission_denied(s: DataFrame, e: DataFrame, limit: int = 50) -> DataFrame:
    denied = e.filter(F.col("error_category") == "PERMISSION").select("statement_id", "referenced_object")
    sums = (
        _with_statements(denied, s, "executed_by", "start_time")
        .groupBy(F.col("executed_by").alias("user"), "referenced_object")
        .agg(
            _n().alias("denials"), F.min("start_time").alias("first_seen"), F.max("start_time").alias("last_seen")
        )
    )
    ties = [F.col("user").asc_nulls_last(), F.col("referenced_object").asc_nulls_last()]
    return top(sums, [F.col("denials").desc(), *ties], limit)


def off_hours_humans(s: DataFrame, limit: int = 50, min_queries: int = 5) -> DataFrame:
    sums = (
        s.filter(F.col("is_off_hours") & (F.col("principal_kind") == "human"))
        .groupBy(F.col("executed_by").alias("user"), "workspace_id")
        .agg(_n().alias("off_hour_queries"), F.sum("read_bytes").alias("read_bytes"))
        .filter(F.col("off_hour_queries") >= min_queries)
    )
    return top(sums, [F.col("off_hour_queries").desc(), F.col("user"), F.col("workspace_id")], limit)


def bulk_export(s: DataFrame, limit: int = 50, min_bytes: int = FIVE_GIB) -> DataFrame:
    sums = (
        s.filter(F.col("session_id").isNotNull())
        .groupBy(F.col("executed_by").alias("user"), "session_id")
        .agg(
            _n().alias("queries"), F.sum("read_rows").alias("read_rows"), F.sum("read_bytes").alias("read_bytes")
        )
        .filter(F.col("read_bytes") > F.lit(min_bytes))
    )
    return top(sums, [F.col("read_bytes").desc(), F.col("user").asc_nulls_last(), F.col("session_id")], limit)


def grant_revoke(s: DataFrame, limit: int = 50) -> DataFrame:
    found = s.filter(F.col("is_grant_revoke")).select(
        "statement_id", "executed_by", "workspace_id", "start_time", "statement_text_excerpt", "execution_status"
    )
    return top(found, [F.col("start_time").desc_nulls_last(), F.col("statement_id")], limit)


def driver_versions(s: DataFrame, limit: int = 50) -> DataFrame:
    family = F.coalesce("client_driver_family", F.lit("Unknown")).alias("family")
    version = F.coalesce("client_driver_version", F.lit("?")).alias("version")
    sums = (
        s.filter(F.col("client_driver").isNotNull())
        .groupBy(family, version)
        .agg(_n().alias("statements"), F.countDistinct("executed_by").alias("users"))
    )
    return top(sums, [F.col("statements").desc(), F.col("family"), F.col("version")], limit)


def delegated_execution(s: DataFrame, limit: int = 50) -> DataFrame:
    sums = (
        s.filter(F.col("is_delegated"))
        .groupBy("executed_by", "executed_as")
        .agg(_n().alias("statements"), F.countDistinct("statement_id").alias("distinct_stmts"))
    )
    return top(sums, [F.col("statements").desc(), F.col("executed_by"), F.col("executed_as")], limit)


def user_footprint(s: DataFrame, limit: int = 30) -> DataFrame:
    found = s.filter(F.col("executed_by").isNotNull()).withColumnRenamed("executed_by", "user")
    sums = found.groupBy("user").agg(
        _n().alias("total"),
        F.countDistinct("client_application").alias("tools"),
        count_if(status("FAILED")).alias("failed"),
        F.sum("read_bytes").alias("read_bytes"),
    )
    head = top(sums, [F.col("total").desc(), F.col("user")], limit)
    return add_percentiles(head, found, ["user"], "total_duration_ms", P50)


def tool_mix(s: DataFrame) -> DataFrame:
    sums = _by_application(s).groupBy("application").agg(
        _n().alias("queries"), F.countDistinct("executed_by").alias("users")
    )
    return sums.orderBy(F.col("queries").desc(), "application")


def syntax_errors(s: DataFrame, e: DataFrame, limit: int = 20) -> DataFrame:
    found = e.filter(F.col("error_category").isin("PARSE", "NOT_FOUND", "ANALYSIS")).select(
        "statement_id", "error_category"
    )
    sums = (
        _with_statements(found, s, "executed_by")
        .groupBy(F.col("executed_by").alias("user"), "error_category")
        .agg(_n().alias("errors"))
    )
    return top(sums, [F.col("errors").desc(), F.col("user").asc_nulls_last(), F.col("error_category")], limit)


FEATURES = {
    "cte": "has_cte", "subquery": "has_subquery", "window": "has_window", "select_star": "has_select_star",
    "cross_join": "has_cross_join", "parameterized": "is_parameterized", "describe_show": "is_describe_or_show",
}


def sql_feature_mix(s: DataFrame) -> DataFrame:
    return s.filter(F.col("is_sql")).agg(
        *[count_if(F.col(c)).alias(k) for k, c in FEATURES.items()], _n().alias("total")
    )


def sql_feature_mix_long(mix: DataFrame) -> DataFrame:
    """Chart form: one row per feature with its percentage of all SQL statements."""
    long = mix.unpivot(["total"], list(FEATURES), "feature", "n")
    return long.withColumn("pct", ratio(F.col("n") * 100, F.col("total"))).select("feature", "n", "pct")


def hour_of_day(s: DataFrame) -> DataFrame:
    found = s.filter(F.col("start_hour").isNotNull()).withColumnRenamed("start_hour", "hour")
    sums = found.groupBy("hour").agg(_n().alias("queries"))
    return add_percentiles(sums, found, ["hour"], "total_duration_ms", P50).orderBy("hour")


def duplicate_queries(s: DataFrame, limit: int = 20, min_runs: int = 5) -> DataFrame:
    sums = (
        s.filter(F.col("normalized_sql_hash").isNotNull())
        .groupBy("normalized_sql_hash")
        .agg(
            _n().alias("runs"),
            F.min("statement_text_excerpt").alias("sample_excerpt"),
            F.avg("total_duration_ms").alias("avg_ms"),
            F.sum("total_duration_ms").alias("total_ms"),
            F.countDistinct("executed_by").alias("users"),
        )
        .filter(F.col("runs") >= min_runs)
    )
    ties = [F.col("total_ms").desc_nulls_last(), F.col("normalized_sql_hash")]
    return top(sums, [F.col("runs").desc(), *ties], limit)


def statement_type_mix(s: DataFrame) -> DataFrame:
    kind = F.coalesce("statement_type", F.lit("UNKNOWN")).alias("statement_type")
    return s.groupBy(kind).agg(_n().alias("n")).orderBy(F.col("n").desc(), "statement_type")
