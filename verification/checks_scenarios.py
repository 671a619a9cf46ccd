"""Documented scenarios that cross several tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

import verification.qi_sql  # noqa: F401
from lakegauge.operators import governance, infrastructure, lineage, spend, usage_patterns
from verification import fixtures
from verification.registry import check

S, T = "source_table_full_name", "target_table_full_name"
FQ = "concat(catalog, '.', database, '.', table_name)"


def _segments(table, key, start, end):
    return f"""(SELECT *, unnest(generate_series(date_trunc('hour', {start}), greatest(date_trunc('hour', {start}), date_trunc('hour', {end} - INTERVAL 1 MICROSECOND)), INTERVAL 1 HOUR)) AS h FROM {table})"""


fixtures.CTES["allocated"] = f"""WITH hourly AS (SELECT compute_id, h, sum(CAST(cost AS DOUBLE) * (epoch(least(usage_end_time, h + INTERVAL 1 HOUR)) - epoch(greatest(usage_start_time, h))) / (epoch(usage_end_time) - epoch(usage_start_time))) AS c
  FROM {_segments('compute_spend', 'compute_id', 'usage_start_time', 'usage_end_time')} GROUP BY 1, 2),
 w AS (SELECT statement_id, warehouse_id AS compute_id, h, greatest(epoch(least(end_time, h + INTERVAL 1 HOUR)) - epoch(greatest(start_time, h)), 0.001) AS w
  FROM {_segments('qi_statements', 'warehouse_id', 'start_time', 'end_time')} WHERE warehouse_id IS NOT NULL),
 r AS (SELECT hourly.compute_id, hourly.h, c, c / (SELECT sum(w) FROM w WHERE w.compute_id = hourly.compute_id AND w.h = hourly.h) AS rate FROM hourly)
 SELECT statement_id, sum(w.w * r.rate) AS cost FROM w JOIN r ON w.compute_id = r.compute_id AND w.h = r.h WHERE r.rate IS NOT NULL GROUP BY 1
 UNION ALL SELECT NULL, sum(c) FROM r WHERE rate IS NULL HAVING sum(c) IS NOT NULL"""

# ---- spend ----
check("cumulative_share", "SELECT label, total_cost, CAST(sum(total_cost) OVER (ORDER BY total_cost DESC, label NULLS LAST) AS DOUBLE) / CAST(sum(total_cost) OVER () AS DOUBLE) AS cum_share FROM (SELECT run_as AS label, sum(cost) AS total_cost FROM bu GROUP BY 1)", num=("total_cost", "cum_share"))(
    lambda t: spend.cumulative_share(t.bu.groupBy(F.col("run_as").alias("label")).agg(F.sum("cost").alias("total_cost")))
)
check("monthly_cost_original", "SELECT strftime(usage_date, '%Y-%m') AS month, sum(cost) AS total_cost FROM bu WHERE record_type = 'ORIGINAL' GROUP BY 1", num=("total_cost",))(lambda t: spend.monthly_cost_original(t.bu))
check("top_jobs", "SELECT b.job_id, j.name AS job_name, sum(cost) AS total_cost, sum(usage_quantity) AS total_usage FROM bu b LEFT JOIN jobs j ON b.job_id = j.job_id WHERE b.job_id IS NOT NULL AND record_type = 'ORIGINAL' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10", num=("total_cost", "total_usage"))(
    lambda t: spend.top_jobs(t.bu, t.jobs)
)
check("sku_cost_original", "SELECT sku_name, sum(usage_quantity) AS total_usage, sum(cost) AS total_cost FROM bu WHERE record_type = 'ORIGINAL' AND usage_date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31' GROUP BY 1", num=("total_cost", "total_usage"))(
    lambda t: spend.sku_cost_original(t.bu, date(2000, 3, 1), date(2000, 3, 31))
)
check("correction_split", "SELECT record_type, count(*) AS records, sum(usage_quantity) AS total_usage, sum(cost) AS total_cost FROM bu GROUP BY 1", num=("total_cost", "total_usage"))(lambda t: spend.correction_split(t.bu))
check("cost_per_cpu_point", """SELECT cluster_id, active_cpu, cost, CAST(cost AS DOUBLE) / active_cpu AS cost_per_cpu_pt FROM (SELECT cluster_id, avg(cpu_user_percent + cpu_system_percent) AS active_cpu FROM nt WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' AND cluster_id IS NOT NULL GROUP BY 1)
 JOIN (SELECT cluster_id, sum(cost) AS cost FROM bu WHERE usage_date >= DATE '2001-08-06' AND cluster_id IS NOT NULL GROUP BY 1) USING (cluster_id) ORDER BY 4 DESC NULLS LAST, 1 LIMIT 25""", num=("active_cpu", "cost", "cost_per_cpu_pt"))(
    lambda t: spend.cost_per_cpu_point(t.bu, t.nt, date(2001, 8, 13), date(2024, 1, 31))
)
check("phantom_workspaces", "SELECT workspace_id, sum(cost) AS cost FROM bu WHERE usage_date >= DATE '2001-10-05' AND workspace_id NOT IN (SELECT workspace_id FROM au WHERE event_time >= TIMESTAMP '2024-01-01 00:00:00') GROUP BY 1", num=("cost",))(
    lambda t: spend.phantom_workspaces(t.bu, t.au, date(2001, 11, 4), date(2024, 1, 31))
)
check("query_cost_allocation", "SELECT * FROM allocated", num=("cost",), digits=2)(lambda t: t.allocated)
check("tag_spend", "SELECT tag_key, tag_value, sum(cost) AS total_cost, count(DISTINCT statement_id) AS statements FROM qi_statement_tags JOIN allocated USING (statement_id) GROUP BY 1, 2", num=("total_cost",), digits=2)(lambda t: spend.tag_spend(t.allocated, t.qg))
check("untagged_share", "SELECT *, untagged_cost * 100 / total_cost AS untagged_pct FROM (SELECT sum(cost) AS total_cost, sum(CASE WHEN statement_id IS NULL OR statement_id NOT IN (SELECT statement_id FROM qi_statement_tags) THEN cost ELSE 0 END) AS untagged_cost FROM allocated)", num=("total_cost", "untagged_cost", "untagged_pct"), digits=2)(
    lambda t: spend.untagged_share(t.allocated, t.qg)
)
check("project_review", """SELECT count(*) AS statement_count, count(DISTINCT executed_by) AS distinct_users, coalesce(sum(cost), 0) AS total_cost, avg(CASE WHEN execution_status = 'FAILED' THEN 1.0 ELSE 0 END) AS failure_rate
 FROM qi_base b LEFT JOIN allocated a USING (statement_id) WHERE statement_text ILIKE '%gold%' OR statement_id IN (SELECT statement_id FROM qi_statement_tables WHERE fully_qualified ILIKE '%gold%') OR statement_id IN (SELECT statement_id FROM qi_statement_tags WHERE tag_value ILIKE '%gold%')""", num=("total_cost", "failure_rate"), digits=2)(
    lambda t: spend.project_review(t.analysed, t.qt, t.qg, t.allocated, "gold")
)
PII = "(ssn|dob|birth|email|phone|credit_card|mrn|patient|diagnosis)"
check("pii_spend", f"""WITH p AS (SELECT DISTINCT {FQ} AS full_name FROM cc WHERE regexp_matches(col_name, '(?i){PII}')),
 u AS (SELECT t.fully_qualified AS full_name, coalesce(sum(cost), 0) AS cost, count(*) AS reads, count(DISTINCT executed_by) AS users FROM qi_statement_tables t JOIN qi_statements s USING (statement_id) LEFT JOIN allocated a USING (statement_id) WHERE t.role IN ('read', 'reference') GROUP BY 1),
 d AS (SELECT {S} AS full_name, count(DISTINCT {T}) AS n FROM tl WHERE {T} IS NOT NULL GROUP BY 1)
 SELECT full_name, coalesce(cost, 0) AS cost, coalesce(reads, 0) AS reads, coalesce(users, 0) AS users, coalesce(n, 0) AS downstream_tables FROM p LEFT JOIN u USING (full_name) LEFT JOIN d USING (full_name)""", num=("cost",), digits=2)(
    lambda t: spend.pii_spend(t.cc, t.qt, t.qs, t.allocated, t.tl)
)
check("deprecation_impact", f"SELECT entity_type, entity_id, count(*) AS edge_count FROM tl WHERE {S} = 'main.silver.t5' GROUP BY 1, 2")(lambda t: spend.deprecation_impact(t.tl, "main.silver.t5"))
OUT = "main.gold.t7"
ECOST = "(SELECT concat('e-', substr(job_id, 3)) AS entity_id, sum(cost) AS cost FROM bu WHERE job_id IS NOT NULL GROUP BY 1)"


@check("upstream_cost", f"""WITH RECURSIVE pairs AS (SELECT DISTINCT {T} AS a, {S} AS b FROM tl WHERE {S} IS NOT NULL AND {T} IS NOT NULL),
 walk(n) AS (SELECT '{OUT}' UNION SELECT p.b FROM walk w JOIN pairs p ON p.a = w.n),
 ents AS (SELECT DISTINCT entity_id FROM tl WHERE {T} IN (SELECT n FROM walk) AND entity_id IS NOT NULL)
 SELECT '{OUT}' AS root, count(*) AS entities, coalesce(sum(cost), 0) AS total_cost FROM ents LEFT JOIN {ECOST} c USING (entity_id)""", num=("total_cost",))
def _(t):
    outputs = t.tl.filter(F.col(T) == OUT).select(F.col(T).alias("root")).distinct()
    costs = t.bu.filter("job_id IS NOT NULL").groupBy(F.concat(F.lit("e-"), F.expr("substring(job_id, 3)")).alias("entity_id")).agg(F.sum("cost").alias("cost"))
    return spend.upstream_cost(t.tl, outputs, costs)


check("cost_per_consumer", "SELECT *, CAST(total_cost AS DOUBLE) / nullif(consumers, 0) AS cost_per_consumer FROM (SELECT strftime(usage_date, '%Y-%m') AS month, sum(cost) AS total_cost, count(DISTINCT run_as) AS consumers FROM bu GROUP BY 1)", num=("total_cost", "cost_per_consumer"))(
    lambda t: spend.cost_per_consumer(t.bu)
)

# ---- usage patterns ----
up = usage_patterns
check("cold_start_first_query", """SELECT count(*) AS sessions, median(w) AS median_wait_ms FROM (SELECT session_id, arg_min_null(waiting_for_compute_duration_ms, (start_time, statement_id)) AS w FROM qi_statements WHERE session_id IS NOT NULL GROUP BY 1)""".replace("arg_min_null", "arg_min"), num=("median_wait_ms",))(
    lambda t: up.cold_start_first_query(t.qs)
)
check("iteration_gap", """SELECT count(*) AS gaps, median(g) AS median_gap_ms FROM (SELECT epoch_us(start_time) / 1000.0 - lag(epoch_us(start_time) / 1000.0) OVER (PARTITION BY session_id ORDER BY start_time, statement_id) AS g FROM qi_statements WHERE session_id IS NOT NULL) WHERE g IS NOT NULL""", num=("median_gap_ms",), digits=2)(
    lambda t: up.iteration_gap(t.qs)
)
check("session_length", """SELECT count(*) AS sessions, avg(n) AS avg_queries, median(span) AS median_span_ms FROM (SELECT session_id, count(*) AS n, (epoch_us(max(coalesce(end_time, start_time))) - epoch_us(min(start_time))) / 1000.0 AS span FROM qi_statements WHERE session_id IS NOT NULL GROUP BY 1)""", num=("avg_queries", "median_span_ms"), digits=2)(
    lambda t: up.session_length(t.qs)
)
check("user_volume_outliers", """SELECT executed_by, start_date, queries, baseline, deviation FROM (SELECT *, avg(queries) OVER w AS baseline, stddev_pop(queries) OVER w AS deviation, count(queries) OVER w AS n FROM (SELECT executed_by, start_date, count(*) AS queries FROM qi_statements WHERE executed_by IS NOT NULL GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY executed_by ORDER BY start_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE n >= 2 AND deviation > 0 AND queries > baseline + 3.3 * deviation""", num=("baseline", "deviation"))(
    lambda t: up.user_volume_outliers(t.qs, sigma=3.3)
)
check("latency_regression", """SELECT client_application, period, p95_ms, lag(p95_ms) OVER w AS previous_p95_ms, p95_ms / lag(p95_ms) OVER w AS change FROM (SELECT client_application, CAST(date_trunc('week', start_date) AS DATE) AS period, quantile_cont(total_duration_ms, 0.95) AS p95_ms FROM qi_statements
 WHERE client_application IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY client_application ORDER BY period)""", num=("p95_ms", "previous_p95_ms", "change"))(lambda t: up.latency_regression(t.qs))
check("pipeline_drift", """WITH r AS (SELECT pipeline_id, start_date, min(start_time) AS started, sum(total_duration_ms)::BIGINT AS duration_ms, sum(produced_rows)::BIGINT AS produced_rows FROM qi_statements WHERE pipeline_id IS NOT NULL GROUP BY 1, 2),
 b AS (SELECT *, quantile_cont(duration_ms, 0.5) OVER w AS median_ms, avg(produced_rows) OVER w AS m, stddev_pop(produced_rows) OVER w AS s FROM r WINDOW w AS (PARTITION BY pipeline_id ORDER BY started, start_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
 SELECT pipeline_id, start_date, duration_ms, median_ms, produced_rows, coalesce(duration_ms > median_ms * 2, FALSE) AS is_slow, coalesce(abs(produced_rows - m) > 3.1 * s, FALSE) AS is_row_outlier FROM b""", num=("median_ms",))(
    lambda t: up.pipeline_drift(t.qs, run="start_date", sigma=3.1)
)
check("error_growth_wow", """SELECT *, (errors - previous) * 100.0 / previous AS growth_pct FROM (SELECT *, lag(errors) OVER (PARTITION BY pattern ORDER BY week) AS previous FROM (SELECT coalesce(error_code, error_category) AS pattern, CAST(date_trunc('week', start_date) AS DATE) AS week, count(*) AS errors FROM qi_statements WHERE error_category IS NOT NULL GROUP BY 1, 2))""", num=("growth_pct",))(
    lambda t: up.error_growth_wow(t.qs)
)


@check("multi_workspace_hour", """SELECT concat('team-', regexp_replace(executed_by, '[0-9]+', '')) AS executed_by, CAST(date_trunc('hour', start_time) AS TIMESTAMP) AS hour, count(DISTINCT workspace_id) AS workspaces, count(*) AS queries FROM qi_statements WHERE executed_by IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT workspace_id) >= 2""")
def _(t):
    # A fixture user stays in one workspace, so names that differ in their number only stand for a shared account.
    shared = t.qs.withColumn("executed_by", F.concat(F.lit("team-"), F.regexp_replace("executed_by", "[0-9]+", "")))
    return up.multi_workspace_hour(shared)


check("read_build_ratio", """SELECT *, reads::DOUBLE / nullif(builds, 0) AS read_build_ratio FROM (SELECT fully_qualified AS "table", count(DISTINCT CASE WHEN role = 'read' THEN statement_id END) AS reads, count(DISTINCT CASE WHEN role = 'write' THEN statement_id END) AS builds FROM qi_statement_tables WHERE role IN ('read', 'write') GROUP BY 1)""", num=("read_build_ratio",))(
    lambda t: up.read_build_ratio(t.qt)
)


@check("freshness_lag", """WITH e AS (SELECT CASE WHEN role = 'write' THEN replace(fully_qualified, 'gold', 'silver') ELSE fully_qualified END AS tb, role = 'write' AS w, start_time FROM qi_statement_tables JOIN qi_statements USING (statement_id) WHERE role IN ('read', 'write')),
 r AS (SELECT tb, start_time, w, max(CASE WHEN w THEN start_time END) OVER (PARTITION BY tb ORDER BY start_time RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM e)
 SELECT tb AS "table", count(*) AS reads, avg((epoch_us(start_time) - epoch_us(last)) / 1000.0) AS avg_lag_ms, max((epoch_us(start_time) - epoch_us(last)) / 1000.0) AS max_lag_ms FROM r WHERE NOT w AND last IS NOT NULL GROUP BY 1""", num=("avg_lag_ms", "max_lag_ms"), digits=1)
def _(t):
    # Fixture statements write gold and read silver; writes are renamed so that they meet.
    moved = t.qt.withColumn("fully_qualified", F.when(F.col("role") == "write", F.replace("fully_qualified", F.lit("gold"), F.lit("silver"))).otherwise(F.col("fully_qualified")))
    return up.freshness_lag(t.qs, moved)


check("new_users_weekly", "SELECT CAST(date_trunc('week', f) AS DATE) AS week, count(*) AS new_users FROM (SELECT executed_by, min(start_date) AS f FROM qi_statements WHERE executed_by IS NOT NULL GROUP BY 1) GROUP BY 1")(lambda t: up.new_users_weekly(t.qs))
check("monthly_active_consumers", "SELECT strftime(start_date, '%Y-%m') AS month, count(DISTINCT executed_by) AS consumers FROM qi_statements WHERE statement_id IN (SELECT statement_id FROM qi_statement_tables WHERE role = 'read' AND fully_qualified IN ('main.silver.t1', 'main.silver.t2')) GROUP BY 1")(
    lambda t: up.monthly_active_consumers(t.qs, t.qt, ["main.silver.t1", "main.silver.t2"])
)
check("stale_dashboards", "SELECT dashboard_id, max(start_time) AS last_query FROM qi_statements WHERE dashboard_id IS NOT NULL GROUP BY 1 HAVING max(start_time) < TIMESTAMP '2024-01-30 00:00:00'")(lambda t: up.stale_dashboards(t.qs, date(2024, 1, 31), 1))
check("cacheable_repeats", """SELECT statement_text_sha1, count(*) AS repeats, coalesce(sum(total_duration_ms), 0)::BIGINT AS repeat_ms FROM (SELECT *, row_number() OVER (PARTITION BY statement_text_sha1 ORDER BY start_time, statement_id) AS rn FROM qi_statements)
 WHERE rn > 1 AND NOT coalesce(from_result_cache, FALSE) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""")(lambda t: up.cacheable_repeats(t.qs))
check("warehouse_sizing", """SELECT *, CASE WHEN avg_wait_ms >= 190 OR spilled_bytes >= 700000 THEN 'under' WHEN avg_wait_ms < 180 THEN 'over' ELSE 'fit' END AS sizing FROM (SELECT warehouse_id, count(*) AS statements, avg(coalesce(waiting_at_capacity_duration_ms, 0)) AS avg_wait_ms,
 coalesce(sum(spilled_local_bytes), 0)::BIGINT AS spilled_bytes, coalesce(sum(total_duration_ms), 0)::BIGINT AS total_ms FROM qi_statements WHERE warehouse_id IS NOT NULL GROUP BY 1)""", num=("avg_wait_ms",))(lambda t: up.warehouse_sizing(t.qs, 190, 180, 700000))
check("ai_adoption", """SELECT *, assistant_users::DOUBLE / nullif(query_users, 0) AS adoption FROM (SELECT month, coalesce(q.n, 0) AS query_users, coalesce(a.n, 0) AS assistant_users FROM (SELECT strftime(start_date, '%Y-%m') AS month, count(DISTINCT executed_by) AS n FROM qi_statements WHERE executed_by IS NOT NULL GROUP BY 1) q
 FULL JOIN (SELECT strftime(event_date, '%Y-%m') AS month, count(DISTINCT initiated_by) AS n FROM aa WHERE initiated_by IS NOT NULL GROUP BY 1) a USING (month))""", num=("adoption",))(lambda t: up.ai_adoption(t.aa, t.qs))
check("user_timeline", """SELECT event_time AS at, 'audit' AS kind, event_id AS id, concat_ws(':', service_name, action_name) AS what, CAST(response_status_code AS VARCHAR) AS outcome FROM au WHERE user_identity_email = 'user12@acme.example' AND event_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
 UNION ALL SELECT start_time, 'query', statement_id, statement_type, execution_status FROM qi_statements WHERE executed_by = 'user12@acme.example' AND start_time BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""")(
    lambda t: up.user_timeline(t.au, t.qs, "user12@acme.example", datetime(2024, 1, 5), datetime(2024, 1, 20))
)
PRODUCT = ["main.gold.t1", "main.gold.t2", "main.silver.t3", "main.bronze.t4"]
IN_P = "(" + ", ".join(f"'{x}'" for x in PRODUCT) + ")"
check("data_product_card", f"""WITH e AS (SELECT fully_qualified AS tb, role = 'write' AS w, start_time, executed_by, execution_status FROM qi_statement_tables JOIN qi_statements USING (statement_id) WHERE role IN ('read', 'write') AND fully_qualified IN {IN_P})
 SELECT u.*, documented_pct, fan_out FROM (SELECT tb AS "table", count(DISTINCT CASE WHEN NOT w THEN executed_by END) AS consumers, sum(CASE WHEN w THEN 0 ELSE 1 END)::BIGINT AS reads, max(CASE WHEN w THEN start_time END) AS last_write, max(CASE WHEN NOT w THEN start_time END) AS last_read,
 sum(CASE WHEN execution_status = 'FAILED' THEN 1 ELSE 0 END)::BIGINT AS failed FROM e GROUP BY 1) u LEFT JOIN (SELECT {FQ} AS tb, count(comment) * 100.0 / count(*) AS documented_pct FROM cc GROUP BY 1) d ON u."table" = d.tb
 LEFT JOIN (SELECT {S} AS tb, count(DISTINCT {T}) AS fan_out FROM tl GROUP BY 1) f ON u."table" = f.tb""", num=("documented_pct",))(lambda t: up.data_product_card(t.qs, t.qt, t.cc, t.tl, PRODUCT))

# ---- infrastructure ----
inf = infrastructure
check("underused_clusters", """SELECT * FROM (SELECT cluster_id, avg(cpu_user_percent + cpu_system_percent) AS avg_cpu_active, avg(mem_used_percent) AS avg_mem, max(cpu_user_percent + cpu_system_percent) AS peak_cpu, count(*) AS samples FROM nt WHERE start_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1)
 WHERE avg_cpu_active < 25 AND avg_mem < 50 ORDER BY samples DESC, cluster_id NULLS LAST LIMIT 50""", num=("avg_cpu_active", "avg_mem", "peak_cpu"))(lambda t: inf.underused_clusters(t.nt, date(2024, 1, 31)))
check("cold_start_duration", """SELECT warehouse_id, count(*) AS starts, avg(g) AS avg_seconds, max(g) AS max_seconds FROM (SELECT warehouse_id, event_type, (epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 1000000.0 AS g, lag(event_type) OVER w AS p FROM we WHERE event_type IN ('STARTING', 'RUNNING')
 WINDOW w AS (PARTITION BY warehouse_id ORDER BY event_time, event_type)) WHERE event_type = 'RUNNING' AND p = 'STARTING' GROUP BY 1""", num=("avg_seconds", "max_seconds"))(lambda t: inf.cold_start_duration(t.we))
check("autoscale_gap", """SELECT cluster_id, count(*) AS gaps, median(g) AS median_gap_seconds FROM (SELECT cluster_id, (epoch_us(event_time) - epoch_us(lag(event_time) OVER (PARTITION BY cluster_id ORDER BY event_time, instance_id))) / 1000000.0 AS g FROM ie WHERE event_type = 'PROVISIONED') WHERE g IS NOT NULL GROUP BY 1""", num=("median_gap_seconds",))(
    lambda t: inf.autoscale_gap(t.ie)
)
check("memory_pressure", "SELECT * FROM (SELECT cluster_id, count(*) AS samples, sum(CASE WHEN mem_used_percent > 90 THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN mem_used_percent > 90 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS high_share FROM nt GROUP BY 1) WHERE high_share > 0.1", num=("high_share",))(lambda t: inf.memory_pressure(t.nt, 90, 0.1))
check("swap_use", "SELECT cluster_id, count(*) AS samples, max(mem_swap_percent) AS max_swap_percent, max(start_time) AS last_seen FROM nt WHERE mem_swap_percent > 1 GROUP BY 1", num=("max_swap_percent",))(lambda t: inf.swap_use(t.nt))
check("preemption_rate", "SELECT *, preempted::DOUBLE / (preempted + terminated) AS preempted_share FROM (SELECT node_type, sum(CASE WHEN event_type = 'PREEMPTED' THEN 1 ELSE 0 END)::BIGINT AS preempted, sum(CASE WHEN event_type = 'TERMINATED' THEN 1 ELSE 0 END)::BIGINT AS terminated FROM ie WHERE event_type IN ('PREEMPTED', 'TERMINATED') GROUP BY 1)", num=("preempted_share",))(
    lambda t: inf.preemption_rate(t.ie, "node_type")
)
check("warehouse_demand_curve", "SELECT warehouse_id, CAST(hour(event_time) AS INT) AS hour, count(*) AS starts FROM we WHERE event_type = 'STARTING' GROUP BY 1, 2")(lambda t: inf.warehouse_demand_curve(t.we))


@check("query_window_utilization", """WITH q AS (SELECT statement_id, concat('c-', CAST(CAST(executed_by_user_id AS BIGINT) % 100 AS VARCHAR)) AS cluster_id, date_trunc('minute', start_time) AS a, end_time + INTERVAL 20 MINUTE AS b FROM qi_statements)
 SELECT q.statement_id, count(*) AS samples, avg(n.cpu_user_percent + n.cpu_system_percent) AS avg_cpu, avg(n.mem_used_percent) AS avg_mem FROM q JOIN nt n ON n.cluster_id = q.cluster_id AND n.start_time >= q.a AND n.start_time <= q.b GROUP BY 1""", num=("avg_cpu", "avg_mem"))
def _(t):
    # Fixture statements run on warehouses and end within a minute; they get a cluster and a longer run here.
    ran = t.qs.select(
        "statement_id", F.concat(F.lit("c-"), (F.col("executed_by_user_id").cast("bigint") % 100).cast("string")).alias("cluster_id"),
        "start_time", (F.col("end_time") + F.expr("interval 20 minutes")).alias("end_time"),
    )
    return inf.query_window_utilization(ran, t.nt)


@check("preempt_restart_match", """WITH r AS (SELECT concat('c-', CAST(CAST(split_part(source_ip_address, '.', 3) AS INT) % 5 AS VARCHAR)) AS c, event_time FROM au WHERE action_name = 'runCommand'), p AS (SELECT concat('c-', CAST(CAST(substr(cluster_id, 3) AS INT) % 5 AS VARCHAR)) AS c, instance_id, event_time FROM ie WHERE event_type = 'PREEMPTED'),
 m AS (SELECT c AS cluster_id, instance_id, event_time, (SELECT min(r.event_time) FROM r WHERE r.c = p.c AND r.event_time >= p.event_time) AS restarted_at FROM p)
 SELECT *, (epoch_us(restarted_at) - epoch_us(event_time)) / 1000000.0 AS seconds FROM m WHERE restarted_at - event_time <= INTERVAL 5 MINUTE""", num=("seconds",), digits=3)
def _(t):
    # Audit fixtures name no cluster; the third number of the address stands for one of five clusters.
    restarts = t.au.filter("action_name = 'runCommand'").select(F.concat(F.lit("c-"), (F.split_part("source_ip_address", F.lit("."), F.lit(3)).cast("int") % 5).cast("string")).alias("cluster_id"), "event_time")
    events = t.ie.withColumn("cluster_id", F.concat(F.lit("c-"), (F.expr("substring(cluster_id, 3)").cast("int") % 5).cast("string")))
    return inf.preempt_restart_match(events, restarts)


check("pool_idle", """WITH m AS (SELECT instance_pool_id, sum(CASE event_type WHEN 'PROVISIONED' THEN 1 ELSE -1 END) OVER (PARTITION BY instance_pool_id ORDER BY event_time, instance_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM ie WHERE instance_pool_id IS NOT NULL AND event_type IN ('PROVISIONED', 'PREEMPTED', 'TERMINATED'))
 SELECT p.instance_pool_id, p.min_idle_instances, CAST(max(l) AS BIGINT) AS peak_instances FROM instance_pools p LEFT JOIN m USING (instance_pool_id) GROUP BY 1, 2""")(lambda t: inf.pool_idle(t.ie, t.instance_pools))

# ---- governance ----
gov = governance
check("table_type_mix", f"SELECT table_type, count(DISTINCT {FQ}) AS tables FROM cc GROUP BY 1")(lambda t: gov.table_type_mix(t.cc))
check("pii_columns", f"SELECT catalog, database, table_name, col_name, data_type FROM cc WHERE regexp_matches(lower(col_name), '{gov.PII_COLUMNS}')")(lambda t: gov.pii_columns(t.cc))
check("canonical_keys", f"SELECT col_name, count(DISTINCT {FQ}) AS tables FROM cc GROUP BY 1 HAVING count(DISTINCT {FQ}) >= 5 ORDER BY 2 DESC, 1 LIMIT 50")(lambda t: gov.canonical_keys(t.cc))
check("terminal_edges", f"SELECT DISTINCT {T} AS table_full_name FROM tl WHERE {T} IS NOT NULL AND {T} NOT IN (SELECT {S} FROM tl WHERE {S} IS NOT NULL)")(lambda t: gov.terminal_edges(t.tl))
check("schema_drift", """WITH o AS (SELECT DISTINCT catalog, database, table_name, col_name FROM cc WHERE as_of = DATE '2024-01-01'), n AS (SELECT DISTINCT catalog, database, table_name, col_name FROM cc WHERE as_of = DATE '2024-02-01'),
 c AS (SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n))
 SELECT c.*, NOT (EXISTS (SELECT 1 FROM o WHERE o.catalog = c.catalog AND o.database = c.database AND o.table_name = c.table_name) AND EXISTS (SELECT 1 FROM n WHERE n.catalog = c.catalog AND n.database = c.database AND n.table_name = c.table_name)) AS whole_table FROM c""")(
    lambda t: gov.schema_drift(t.cc, date(2024, 1, 1), date(2024, 2, 1))
)
check("type_conflicts", "SELECT col_name, count(DISTINCT data_type) AS types FROM cc GROUP BY 1 HAVING count(DISTINCT data_type) >= 2")(lambda t: gov.type_conflicts(t.cc))
TB = "(SELECT catalog, database, table_name, count(table_comment) AS tc, count(table_owner) AS ow, max(table_owner) AS owner, count(*) AS c, count(comment) AS cm FROM cc GROUP BY 1, 2, 3)"
check("doc_coverage", f"SELECT *, documented_tables * 100.0 / tables AS table_pct, documented_columns * 100.0 / columns AS column_pct FROM (SELECT catalog, count(*) AS tables, sum(CASE WHEN tc > 0 THEN 1 ELSE 0 END)::BIGINT AS documented_tables, sum(c)::BIGINT AS columns, sum(cm)::BIGINT AS documented_columns FROM {TB} GROUP BY 1)", num=("table_pct", "column_pct"))(
    lambda t: gov.doc_coverage(t.cc)
)
check("owner_coverage", f"SELECT *, owned_tables * 100.0 / tables AS owned_pct FROM (SELECT catalog, count(*) AS tables, sum(CASE WHEN ow > 0 THEN 1 ELSE 0 END)::BIGINT AS owned_tables FROM {TB} GROUP BY 1)", num=("owned_pct",))(lambda t: gov.owner_coverage(t.cc))
check("owner_concentration", f"SELECT catalog, owner AS table_owner, n AS tables, share FROM (SELECT catalog, owner, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY catalog) AS share FROM {TB} GROUP BY 1, 2) WHERE owner IS NOT NULL AND share > 0.13", num=("share",))(lambda t: gov.owner_concentration(t.cc, 0.13))
check("wide_tables", "SELECT catalog, database, table_name, count(col_name) AS columns FROM cc GROUP BY 1, 2, 3 HAVING count(col_name) >= 12")(lambda t: gov.wide_tables(t.cc, 12))
check("naming_conventions", "SELECT catalog, CASE WHEN regexp_matches(lower(table_name), '^(t1|t2|dim_)') THEN regexp_extract(lower(table_name), '^(t1|t2|dim_)', 1) ELSE 'other' END AS prefix, count(DISTINCT concat(database, '.', table_name)) AS tables FROM cc GROUP BY 1, 2")(
    lambda t: gov.naming_conventions(t.cc, ("t1", "t2", "dim_"))
)
check("never_queried", f"SELECT DISTINCT {FQ} AS full_name FROM cc WHERE {FQ} NOT IN (SELECT fully_qualified FROM qi_statement_tables WHERE role <> 'cte')")(lambda t: gov.never_queried(t.cc, t.qt))
check("queried_undocumented", f"SELECT {FQ} AS full_name FROM cc GROUP BY 1 HAVING count(table_comment) = 0 AND {FQ} IN (SELECT fully_qualified FROM qi_statement_tables WHERE role <> 'cte')".replace(f"AND {FQ} IN", "AND full_name IN"))(lambda t: gov.queried_undocumented(t.cc, t.qt))
check("zombie_candidates", f"SELECT DISTINCT {FQ} AS full_name FROM cc WHERE {FQ} NOT IN (SELECT fully_qualified FROM qi_statement_tables WHERE role <> 'cte') AND {FQ} NOT IN (SELECT {S} FROM tl WHERE {S} IS NOT NULL UNION SELECT {T} FROM tl WHERE {T} IS NOT NULL)")(
    lambda t: gov.zombie_candidates(t.cc, t.tl, t.qt)
)
# Fixture tables only feed the next layer; without the layer's name the tables feed each other.
check("cycles", f"""WITH RECURSIVE pairs AS (SELECT DISTINCT split_part({S}, '.', 3) AS a, split_part({T}, '.', 3) AS b FROM tl WHERE {S} IS NOT NULL AND {T} IS NOT NULL),
 walk(root, n, d) AS (SELECT a, b, 1 FROM pairs UNION SELECT w.root, p.b, w.d + 1 FROM walk w JOIN pairs p ON p.a = w.n WHERE w.d < (SELECT count(DISTINCT a) FROM pairs))
 SELECT root AS full_name, min(d) AS length FROM walk WHERE root = n GROUP BY 1""")(
    lambda t: lineage.cycles(lineage.table_pairs(t.tl.withColumns({c: F.split_part(F.col(c), F.lit("."), F.lit(3)) for c in (S, T)})))
)
check("hubs", f"""SELECT full_name, edges_out, edges_in FROM (SELECT {S} AS full_name, count(*) AS edges_out FROM tl WHERE {S} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) JOIN (SELECT {T} AS full_name, count(*) AS edges_in FROM tl WHERE {T} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15) USING (full_name)""")(
    lambda t: gov.hubs(t.tl)
)


@check("cross_catalog_flows", f"""SELECT split_part(s, '.', 1) AS source_catalog, split_part(t, '.', 1) AS target_catalog, count(*) AS edges FROM (SELECT {S} AS s, replace({T}, 'main.gold', 'mart.gold') AS t FROM tl WHERE {S} IS NOT NULL AND {T} IS NOT NULL) WHERE split_part(s, '.', 1) <> split_part(t, '.', 1) GROUP BY 1, 2""")
def _(t):
    # All fixture tables live in one catalog; gold is moved to a second one.
    return gov.cross_catalog_flows(t.tl.withColumn(T, F.replace(T, F.lit("main.gold"), F.lit("mart.gold"))))


check("connectivity", f"""SELECT *, connected * 100.0 / tables AS connected_pct FROM (SELECT count(*) AS tables, count(CASE WHEN f IN (SELECT {S} FROM tl WHERE {S} IS NOT NULL UNION SELECT {T} FROM tl WHERE {T} IS NOT NULL) THEN 1 END) AS connected FROM (SELECT DISTINCT {FQ} AS f FROM cc))""", num=("connected_pct",))(
    lambda t: gov.connectivity(t.cc, t.tl)
)
check("new_login_pairs", """SELECT user_identity_email, source_ip_address, count(*) AS cnt, min(event_time) AS first_seen FROM au WHERE action_name = 'login' AND user_identity_email IS NOT NULL AND event_time >= TIMESTAMP '2024-01-24 00:00:00'
 AND (user_identity_email, source_ip_address) NOT IN (SELECT (user_identity_email, source_ip_address) FROM au WHERE action_name = 'login' AND user_identity_email IS NOT NULL AND event_time < TIMESTAMP '2024-01-17 00:00:00') GROUP BY 1, 2""")(
    lambda t: gov.new_login_pairs(t.au, date(2024, 1, 31), 7, 14)
)
check("service_error_rate", "SELECT *, (errors_4xx + errors_5xx)::DOUBLE / events AS error_rate FROM (SELECT coalesce(service_name, '(none)') AS service, count(*) AS events, sum(CASE WHEN response_status_code BETWEEN 400 AND 499 THEN 1 ELSE 0 END)::BIGINT AS errors_4xx, sum(CASE WHEN response_status_code >= 500 THEN 1 ELSE 0 END)::BIGINT AS errors_5xx FROM au GROUP BY 1)", num=("error_rate",))(
    lambda t: gov.service_error_rate(t.au)
)
check("success_rate_daily", "SELECT *, ok::DOUBLE / events AS success_rate FROM (SELECT event_date, count(*) AS events, sum(CASE WHEN response_status_code < 300 THEN 1 ELSE 0 END)::BIGINT AS ok FROM au GROUP BY 1)", num=("success_rate",))(lambda t: gov.success_rate_daily(t.au))
check("duplicate_audit_calls", "SELECT request_id, count(*) AS events, min(event_time) AS first_event, arg_min(action_name, (event_time, event_id)) AS action_name, arg_min(event_id, (event_time, event_id)) AS event_id FROM au GROUP BY 1")(lambda t: gov.duplicate_audit_calls(t.au))
