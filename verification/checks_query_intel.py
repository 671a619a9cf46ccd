"""Analytics over the qi_* tables."""

from pyspark.sql import functions as F

import verification.qi_sql  # noqa: F401
from lakegauge.operators import query_intel as qi
from verification.registry import check

FAILED = "sum(CASE WHEN execution_status = 'FAILED' THEN 1 ELSE 0 END)::BIGINT"
FINISHED = "sum(CASE WHEN execution_status = 'FINISHED' THEN 1 ELSE 0 END)::BIGINT"
CANCELED = "sum(CASE WHEN execution_status = 'CANCELED' THEN 1 ELSE 0 END)::BIGINT"
CACHE = "sum(CASE WHEN from_result_cache THEN 1 ELSE 0 END)::BIGINT"


def p(q, name):
    return f"quantile_cont(total_duration_ms, {q}) AS {name}"


def big(expr, name):
    return f"CAST(sum({expr}) AS BIGINT) AS {name}"


def on_s(key, sql, num=(), fn=None, **kw):
    check(key, sql, num=num)(lambda t: getattr(qi, fn or key)(t.qs, **kw))


check(
    "qi_overview",
    f"""SELECT count(*) AS total_statements, count(DISTINCT executed_by) AS distinct_users, count(DISTINCT workspace_id) AS distinct_workspaces,
    {FAILED} AS failed_count, {CANCELED} AS canceled_count, sum(CASE WHEN source_category = 'GENIE' THEN 1 ELSE 0 END)::BIGINT AS genie_query_count,
    sum(CASE WHEN source_category = 'DASHBOARD' THEN 1 ELSE 0 END)::BIGINT AS dashboard_query_count, sum(CASE WHEN source_category = 'JOB' THEN 1 ELSE 0 END)::BIGINT AS job_query_count,
    sum(CASE WHEN source_category = 'NOTEBOOK' THEN 1 ELSE 0 END)::BIGINT AS notebook_query_count, min(start_date) AS date_min, max(start_date) AS date_max,
    {FINISHED} / count(*)::DOUBLE AS success_rate, {CACHE} / count(*)::DOUBLE AS cache_hit_rate,
    sum(CASE WHEN compute_type = 'SERVERLESS_COMPUTE' THEN 1 ELSE 0 END) / count(*)::DOUBLE AS serverless_share, {p(0.5, 'median_duration_ms')}, {p(0.95, 'p95_duration_ms')} FROM qi_statements""",
    num=("success_rate", "cache_hit_rate", "serverless_share", "median_duration_ms", "p95_duration_ms"),
)(lambda t: qi.overview(t.qs))

on_s("expensive_queries", """SELECT statement_id, executed_by, workspace_id, warehouse_id, compute_type, total_duration_ms, read_bytes, shuffle_read_bytes, spilled_local_bytes,
 produced_rows, statement_type, statement_text_excerpt, start_time FROM qi_statements ORDER BY total_duration_ms DESC NULLS LAST, statement_id LIMIT 50""")
on_s("full_scans", """SELECT statement_id, executed_by, workspace_id, read_bytes, produced_rows, total_duration_ms, statement_text_excerpt, start_time FROM qi_statements
 WHERE is_full_scan ORDER BY read_bytes DESC NULLS LAST, statement_id LIMIT 50""")
on_s("spill_leaders", f"""SELECT executed_by AS "user", {big('spilled_local_bytes', 'spill_bytes')}, count(*) AS statements FROM qi_statements WHERE spilled_local_bytes > 0
 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
on_s("error_trends", "SELECT start_date AS d, error_category AS category, count(*) AS n FROM qi_statements WHERE error_category IS NOT NULL GROUP BY 1, 2")
check("error_trends_wide", "SELECT start_date AS d, " + ", ".join(f"sum(CASE WHEN error_category = '{c}' THEN 1 ELSE 0 END)::BIGINT AS \"{c}\"" for c in ("PERMISSION", "NOT_FOUND", "PARSE", "OOM"))
      + " FROM qi_statements WHERE error_category IS NOT NULL GROUP BY 1")(
    lambda t: qi.error_trends_wide(qi.error_trends(t.qs), ["PERMISSION", "NOT_FOUND", "PARSE", "OOM"])
)
on_s("error_categories", "SELECT error_category AS category, error_code AS code, count(*) AS n FROM qi_statements WHERE error_category IS NOT NULL GROUP BY 1, 2")
check("error_category_totals", "SELECT error_category AS category, count(*) AS n FROM qi_statements WHERE error_category IS NOT NULL GROUP BY 1")(
    lambda t: qi.error_category_totals(qi.error_categories(t.qs))
)
on_s("capacity_queueing", "SELECT start_hour AS hour, workspace_id AS workspace, avg(waiting_at_capacity_duration_ms) AS avg_wait_ms, count(*) AS statements FROM qi_statements GROUP BY 1, 2", num=("avg_wait_ms",))
on_s("cache_effectiveness", f"""SELECT *, cache_hits / total::DOUBLE AS cache_rate FROM (SELECT dashboard_id AS dashboard, count(*) AS total, {CACHE} AS cache_hits FROM qi_statements
 WHERE dashboard_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)""", num=("cache_rate",))

check("top_tables", """SELECT t.fully_qualified AS "table", t.catalog, t.schema, t.table_name, count(DISTINCT t.statement_id) AS statements, count(DISTINCT s.executed_by) AS users
 FROM qi_statement_tables t JOIN qi_statements s ON s.statement_id = t.statement_id WHERE t.role = 'read' GROUP BY 1, 2, 3, 4 ORDER BY 5 DESC, 1, 2 NULLS LAST, 3 NULLS LAST LIMIT 20""")(
    lambda t: qi.top_tables(t.qs, t.qt, role="read")
)
check("top_columns", "SELECT column_name, role, count(DISTINCT statement_id) AS statements FROM qi_statement_columns GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20")(
    lambda t: qi.top_columns(t.qc)
)
check("partitioning_candidates", f"""SELECT * FROM (SELECT t.fully_qualified AS "table", avg(s.pruning_ratio) AS avg_pruning, {big('s.read_bytes', 'read_bytes')}, count(DISTINCT t.statement_id) AS statements
 FROM qi_statement_tables t JOIN qi_statements s ON s.statement_id = t.statement_id WHERE t.role = 'read' AND s.pruning_ratio IS NOT NULL GROUP BY 1 HAVING count(DISTINCT t.statement_id) >= 5)
 ORDER BY round(avg_pruning, 9), 1 LIMIT 20""", num=("avg_pruning",))(lambda t: qi.partitioning_candidates(t.qs, t.qt))
# Fixture grants touch every gold table, so writes to the t1* tables go to tables of another name, which nothing reads.
WRITTEN = "CASE WHEN role = 'write' THEN replace(fully_qualified, 'main.gold.t1', 'main.gold.unread1') ELSE fully_qualified END"
check("zombie_tables", f"""WITH q AS (SELECT statement_id, role, {WRITTEN} AS f FROM qi_statement_tables)
 SELECT f AS "table", count(DISTINCT statement_id) AS write_count FROM q WHERE role = 'write'
 AND f NOT IN (SELECT f FROM q WHERE role = 'read' AND f IS NOT NULL) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")(lambda t: qi.zombie_tables(t.qt.withColumn("fully_qualified", F.expr(WRITTEN))))
on_s("parameterised_share", "SELECT count(*) AS total, sum(CASE WHEN is_parameterized THEN 1 ELSE 0 END)::BIGINT AS parameterized, sum(CASE WHEN is_parameterized THEN 0 ELSE 1 END)::BIGINT AS unparameterized FROM qi_statements")
on_s("failed_cost", """SELECT *, (failed_ms + canceled_ms) / total_ms::DOUBLE AS wasted_share FROM (SELECT sum(total_duration_ms)::BIGINT AS total_ms,
 sum(CASE WHEN execution_status = 'FAILED' THEN total_duration_ms ELSE 0 END)::BIGINT AS failed_ms, sum(CASE WHEN execution_status = 'CANCELED' THEN total_duration_ms ELSE 0 END)::BIGINT AS canceled_ms FROM qi_statements)""", num=("wasted_share",))
on_s("source_attribution", f"SELECT source_category AS category, count(*) AS statements, {big('total_duration_ms', 'total_ms')}, avg(total_duration_ms) AS avg_ms FROM qi_statements GROUP BY 1", num=("avg_ms",))

HIT = """(SELECT DISTINCT statement_id FROM qi_statement_tables WHERE lower(catalog) LIKE '%gold%' OR lower(schema) LIKE '%gold%' OR lower(table_name) LIKE '%gold%' OR lower(fully_qualified) LIKE '%gold%')"""
check("project_search_summary", f"""SELECT count(*) AS statements, count(DISTINCT executed_by) AS users, count(DISTINCT workspace_id) AS workspaces, {big('total_duration_ms', 'total_ms')}, {big('read_bytes', 'read_bytes')},
 {FAILED} AS failed FROM qi_statements WHERE statement_id IN {HIT}""")(lambda t: qi.project_search_summary(t.qs, t.qt, "Gold"))
check("project_search_daily", f"SELECT start_date AS d, count(*) AS statements, {big('total_duration_ms', 'total_ms')} FROM qi_statements WHERE statement_id IN {HIT} GROUP BY 1")(lambda t: qi.project_search_daily(t.qs, t.qt, "gold"))
check("project_search_users", f'SELECT executed_by AS "user", count(*) AS statements FROM qi_statements WHERE statement_id IN {HIT} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 10')(lambda t: qi.project_search_users(t.qs, t.qt, "gold"))

on_s("adoption_trend", """SELECT CAST(date_trunc('week', start_date) AS DATE) AS period, count(DISTINCT executed_by) AS users, count(DISTINCT dashboard_id) AS dashboards, count(DISTINCT job_id) AS jobs,
 count(DISTINCT notebook_id) AS notebooks, count(DISTINCT genie_space_id) AS genie_spaces, count(*) AS statements FROM qi_statements GROUP BY 1""", grain="week")
on_s("compute_share_trend", """SELECT start_date AS period, sum(CASE WHEN compute_type = 'SERVERLESS_COMPUTE' THEN 1 ELSE 0 END)::BIGINT AS serverless,
 sum(CASE WHEN compute_type = 'WAREHOUSE' THEN 1 ELSE 0 END)::BIGINT AS warehouse, count(*) AS total FROM qi_statements GROUP BY 1""")
on_s("reliability", f"SELECT *, finished / total::DOUBLE AS success_rate FROM (SELECT CAST(date_trunc('week', start_date) AS DATE) AS period, count(*) AS total, {FINISHED} AS finished, {FAILED} AS failed, {CANCELED} AS canceled FROM qi_statements GROUP BY 1)", num=("success_rate",))
on_s("job_failure_rates", f"""SELECT *, failed / statements::DOUBLE AS failure_rate FROM (SELECT job_id, count(*) AS statements, {FAILED} AS failed, avg(total_duration_ms) AS avg_duration_ms FROM qi_statements
 WHERE job_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) ORDER BY failed / statements::DOUBLE DESC, statements DESC, job_id LIMIT 20""", num=("failure_rate", "avg_duration_ms"))
on_s("slowest_pipelines", f"""SELECT pipeline_id, count(*) AS statements, avg(total_duration_ms) AS avg_ms, max(total_duration_ms) AS max_ms, {FAILED} AS failed FROM qi_statements
 WHERE pipeline_id IS NOT NULL GROUP BY 1 ORDER BY avg_ms DESC NULLS LAST, 1 LIMIT 20""", num=("avg_ms",))
on_s("compile_heavy", """SELECT statement_id, executed_by, statement_text_excerpt, total_duration_ms, compilation_duration_ms, compile_pct FROM qi_statements
 WHERE compile_pct > 0.25 AND total_duration_ms > 500 ORDER BY compile_pct DESC, total_duration_ms DESC, statement_id LIMIT 20""", num=("compile_pct",))
on_s("slowest_dashboards", f"""SELECT *, cache_hits / query_count::DOUBLE AS cache_rate FROM (SELECT dashboard_id, count(*) AS query_count, {p(0.5, 'p50_ms')}, {p(0.95, 'p95_ms')}, {CACHE} AS cache_hits
 FROM qi_statements WHERE dashboard_id IS NOT NULL GROUP BY 1) ORDER BY p95_ms DESC NULLS LAST, dashboard_id LIMIT 20""", num=("p50_ms", "p95_ms", "cache_rate"))
APP = "coalesce(client_application, 'Unknown')"
on_s("vendor_footprint", f"""SELECT *, failed / statements::DOUBLE AS failure_rate FROM (SELECT {APP} AS application, count(*) AS statements, count(DISTINCT executed_by) AS users, {p(0.5, 'p50_ms')}, {p(0.95, 'p95_ms')},
 {FAILED} AS failed FROM qi_statements GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)""", num=("p50_ms", "p95_ms", "failure_rate"))
on_s("select_star_dashboards", """SELECT dashboard_id, count(*) AS total, sum(CASE WHEN has_select_star THEN 1 ELSE 0 END)::BIGINT AS star_count FROM qi_statements WHERE dashboard_id IS NOT NULL
 GROUP BY 1 HAVING sum(CASE WHEN has_select_star THEN 1 ELSE 0 END) > 0 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 20""")
on_s("notebook_activity", f"SELECT notebook_id, count(*) AS queries, count(DISTINCT executed_by) AS users, {p(0.5, 'p50_ms')}, {FAILED} AS failed FROM qi_statements WHERE notebook_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", num=("p50_ms",))
on_s("genie_adoption", f"""SELECT *, finished / queries::DOUBLE AS success_rate FROM (SELECT CAST(date_trunc('week', start_date) AS DATE) AS week, count(*) AS queries, count(DISTINCT genie_space_id) AS spaces,
 count(DISTINCT executed_by) AS users, {FINISHED} AS finished FROM qi_statements WHERE genie_space_id IS NOT NULL GROUP BY 1)""", num=("success_rate",))
check("permission_denied", """SELECT s.executed_by AS "user", e.referenced_object, count(*) AS denials, min(s.start_time) AS first_seen, max(s.start_time) AS last_seen FROM qi_statement_errors e
 JOIN qi_statements s ON s.statement_id = e.statement_id WHERE e.error_category = 'PERMISSION' GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS LAST, 2 NULLS LAST LIMIT 50""")(lambda t: qi.permission_denied(t.qs, t.qe))
on_s("off_hours_humans", f"""SELECT executed_by AS "user", workspace_id, count(*) AS off_hour_queries, {big('read_bytes', 'read_bytes')} FROM qi_statements WHERE is_off_hours AND principal_kind = 'human'
 GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
on_s("bulk_export", f"""SELECT executed_by AS "user", session_id, count(*) AS queries, {big('read_rows', 'read_rows')}, {big('read_bytes', 'read_bytes')} FROM qi_statements WHERE session_id IS NOT NULL
 GROUP BY 1, 2 HAVING sum(read_bytes) > 5368709120 ORDER BY 5 DESC, 1 NULLS LAST, 2 LIMIT 50""")
on_s("grant_revoke", "SELECT statement_id, executed_by, workspace_id, start_time, statement_text_excerpt, execution_status FROM qi_statements WHERE is_grant_revoke ORDER BY start_time DESC NULLS LAST, 1 LIMIT 50")
on_s("driver_versions", """SELECT coalesce(client_driver_family, 'Unknown') AS family, coalesce(client_driver_version, '?') AS version, count(*) AS statements, count(DISTINCT executed_by) AS users
 FROM qi_statements WHERE client_driver IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50""")
on_s("delegated_execution", "SELECT executed_by, executed_as, count(*) AS statements, count(DISTINCT statement_id) AS distinct_stmts FROM qi_statements WHERE is_delegated GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50")
on_s("user_footprint", f"""SELECT executed_by AS "user", count(*) AS total, count(DISTINCT client_application) AS tools, {FAILED} AS failed, {p(0.5, 'p50_ms')}, {big('read_bytes', 'read_bytes')} FROM qi_statements
 WHERE executed_by IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""", num=("p50_ms",))
on_s("tool_mix", f"SELECT {APP} AS application, count(*) AS queries, count(DISTINCT executed_by) AS users FROM qi_statements GROUP BY 1")
check("syntax_errors", """SELECT s.executed_by AS "user", e.error_category, count(*) AS errors FROM qi_statement_errors e JOIN qi_statements s ON s.statement_id = e.statement_id
 WHERE e.error_category IN ('PARSE', 'NOT_FOUND', 'ANALYSIS') GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS LAST, 2 LIMIT 20""")(lambda t: qi.syntax_errors(t.qs, t.qe))
MIX = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)::BIGINT AS \"{k}\"" for k, c in qi.FEATURES.items())
on_s("sql_feature_mix", f"SELECT {MIX}, count(*) AS total FROM qi_statements WHERE is_sql")
check("sql_feature_mix_long", " UNION ALL ".join(f"SELECT '{k}' AS feature, sum(CASE WHEN {c} THEN 1 ELSE 0 END)::BIGINT AS n, sum(CASE WHEN {c} THEN 1 ELSE 0 END) * 100.0 / count(*) AS pct FROM qi_statements WHERE is_sql" for k, c in qi.FEATURES.items()), num=("pct",))(
    lambda t: qi.sql_feature_mix_long(qi.sql_feature_mix(t.qs))
)
on_s("hour_of_day", f"SELECT start_hour AS hour, count(*) AS queries, {p(0.5, 'p50_ms')} FROM qi_statements GROUP BY 1", num=("p50_ms",))
on_s("duplicate_queries", f"""SELECT normalized_sql_hash, count(*) AS runs, min(statement_text_excerpt) AS sample_excerpt, avg(total_duration_ms) AS avg_ms, {big('total_duration_ms', 'total_ms')},
 count(DISTINCT executed_by) AS users FROM qi_statements WHERE normalized_sql_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 5 DESC NULLS LAST, 1 LIMIT 20""", num=("avg_ms",))
on_s("statement_type_mix", "SELECT coalesce(statement_type, 'UNKNOWN') AS statement_type, count(*) AS n FROM qi_statements GROUP BY 1")
