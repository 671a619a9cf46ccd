"""Billing and cost analytics."""

from datetime import date

from pyspark.sql import functions as F

from lakegauge.operators import analytics, billing
from verification.registry import check

UC = ("total_usage", "total_cost")
SUMS = "sum(usage_quantity) AS total_usage, sum(cost) AS total_cost"
AS_OF = date(2001, 11, 4)
W = dict(start=date(1998, 1, 1), end=date(1999, 6, 30))
IN_W = "usage_date BETWEEN DATE '1998-01-01' AND DATE '1999-06-30'"

PRICED = """SELECT u.*, CAST(u.usage_quantity AS DECIMAL(18,6)) * CAST(p.effective_list_price AS DECIMAL(18,6)) AS list_cost
 FROM (SELECT * FROM billing_usage WHERE data_origin='real' AND deleted_at IS NULL) u JOIN lp p
 ON u.sku_name = p.sku_name AND u.cloud = p.cloud AND u.usage_unit = p.usage_unit
 AND u.usage_end_time >= p.price_start_time AND (p.price_end_time IS NULL OR u.usage_end_time < p.price_end_time)"""


@check("usage_with_cost", "SELECT record_id, sku_name, usage_date, cost FROM bu", num=("cost",))
def _(t):
    return t.bu.select("record_id", "sku_name", "usage_date", "cost")


@check("cost_expr", f"SELECT cloud, count(*) AS n, sum(list_cost) AS total_cost FROM ({PRICED}) GROUP BY cloud", num=("total_cost",))
def _(t):
    from lakegauge.operators.scope import scope_origin

    priced = billing.usage_with_cost(scope_origin(t.billing_usage), t.lp, mode="list")
    return priced.groupBy("cloud").agg(F.count("*").alias("n"), F.sum("cost").alias("total_cost"))


@check("cost_from_prices_by_month", f"SELECT sku_name, count(*) AS n, sum(list_cost) AS total_cost FROM ({PRICED}) GROUP BY sku_name", num=("total_cost",))
def _(t):
    from lakegauge.operators.scope import scope_origin

    priced = billing.cost_from_prices(scope_origin(t.billing_usage), t.lp, by_month=True)
    return priced.groupBy("sku_name").agg(F.count("*").alias("n"), F.sum("cost").alias("total_cost"))


for _grain, _label in {
    "day": "strftime(usage_date, '%Y-%m-%d')",
    "week": "strftime(date_trunc('week', usage_date), '%Y-%m-%d')",
    "month": "strftime(usage_date, '%Y-%m')",
}.items():
    check("usage_summary" if _grain == "month" else f"usage_summary_{_grain}", f"SELECT {_label} AS period, {SUMS} FROM bu GROUP BY 1", num=UC)(
        lambda t, g=_grain: billing.usage_summary(t.bu, g)
    )


@check(
    "usage_summary_by_sku",
    f"""SELECT strftime(usage_date, '%Y-%m') AS period, sku_name, {SUMS} FROM bu
    WHERE sku_name IN (SELECT sku_name FROM bu GROUP BY sku_name ORDER BY sum(cost) DESC, sku_name LIMIT 5) GROUP BY 1, 2""",
    num=UC,
)
def _(t):
    return billing.usage_summary_by_sku(t.bu, "month", 5)


for _key, _col in {
    "by_sku": "sku_name",
    "by_workspace": "workspace_id",
    "by_origin": "billing_origin_product",
    "by_usage_type": "usage_type",
    "by_cloud": "cloud",
}.items():
    check(_key, f"SELECT coalesce(CAST({_col} AS VARCHAR), 'None') AS label, {SUMS} FROM bu GROUP BY {_col}", num=UC)(
        lambda t, k=_key: getattr(billing, k)(t.bu)
    )


@check("by_user", f'SELECT run_as AS "user", {SUMS} FROM bu WHERE run_as IS NOT NULL GROUP BY run_as ORDER BY total_cost DESC, 1 LIMIT 10', num=UC)
def _(t):
    return billing.by_user(t.bu, 10)


@check("daily_trend", f"SELECT usage_date, {SUMS} FROM bu WHERE {IN_W} AND sku_name = 'Brand#12' AND workspace_id = 'ws-3' GROUP BY usage_date", num=UC)
def _(t):
    return billing.daily_trend(t.bu, sku_name="Brand#12", workspace_id="ws-3", **W)


USER = "user7@acme.example"


@check("user_totals", f"SELECT {SUMS} FROM bu WHERE run_as = '{USER}'", num=UC)
def _(t):
    return billing.user_totals(t.bu, USER)


@check("user_sku_breakdown", f"SELECT sku_name, {SUMS} FROM bu WHERE run_as = '{USER}' GROUP BY sku_name", num=UC)
def _(t):
    return billing.user_sku_breakdown(t.bu, USER)


LATEST_C = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY change_time DESC NULLS LAST, create_time DESC NULLS LAST) AS rn FROM clusters) WHERE rn = 1)"""
LATEST_W = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY warehouse_id ORDER BY change_time DESC NULLS LAST) AS rn FROM warehouses) WHERE rn = 1)"""


@check(
    "user_cluster_breakdown",
    f"""SELECT b.cluster_id AS resource_id, c.cluster_name AS resource_name, {SUMS} FROM bu b LEFT JOIN {LATEST_C} c
    ON b.cluster_id = c.cluster_id WHERE run_as = '{USER}' AND b.cluster_id IS NOT NULL GROUP BY 1, 2""",
    num=UC,
)
def _(t):
    return billing.user_cluster_breakdown(t.bu, t.clusters, USER)


@check(
    "user_warehouse_breakdown",
    f"""SELECT w.warehouse_id AS resource_id, w.warehouse_name AS resource_name, {SUMS} FROM bu b JOIN
    {LATEST_W.replace('FROM warehouses)', "FROM warehouses WHERE created_by = 'user3@acme.example')")} w ON b.warehouse_id = w.warehouse_id GROUP BY 1, 2""",
    num=UC,
)
def _(t):
    return billing.user_warehouse_breakdown(t.bu, t.warehouses, "user3@acme.example")


@check(
    "sku_user_matrix",
    f"""WITH x AS (SELECT * FROM bu WHERE run_as IS NOT NULL)
    SELECT sku_name, run_as, {SUMS} FROM x
    WHERE sku_name IN (SELECT sku_name FROM x GROUP BY 1 ORDER BY sum(cost) DESC, 1 LIMIT 10)
      AND run_as IN (SELECT run_as FROM x GROUP BY 1 ORDER BY sum(cost) DESC, 1 LIMIT 10)
    GROUP BY 1, 2 HAVING sum(cost) > 0""",
    num=UC,
)
def _(t):
    return billing.sku_user_matrix(t.bu)


@check(
    "top_skus",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY total_cost DESC, sku_name) AS INT) AS rank FROM
    (SELECT sku_name, {SUMS} FROM bu GROUP BY 1 ORDER BY total_cost DESC, 1 LIMIT 10)""",
    num=UC,
)
def _(t):
    return billing.top_skus(t.bu)


@check(
    "share_of_total",
    """WITH s AS (SELECT sku_name, sum(cost) AS c FROM bu GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, sku_name) AS rn FROM s)
    SELECT CASE WHEN rn <= 9 THEN sku_name ELSE 'Other' END AS label, sum(c) AS total_cost,
    CAST(sum(c) * 100 AS DOUBLE) / (SELECT CAST(sum(c) AS DOUBLE) FROM s) AS pct FROM r GROUP BY 1""",
    num=("total_cost", "pct"),
)
def _(t):
    return billing.share_of_total(billing.by_sku(t.bu).select("label", "total_cost"))


@check(
    "unit_cost_by_period",
    f"""SELECT *, CASE WHEN total_usage > 0 THEN CAST(total_cost AS DOUBLE) / CAST(total_usage AS DOUBLE) ELSE 0 END AS unit_cost
    FROM (SELECT strftime(usage_date, '%Y-%m') AS period, {SUMS} FROM bu GROUP BY 1)""",
    num=(*UC, "unit_cost"),
)
def _(t):
    return billing.unit_cost_by_period(billing.usage_summary(t.bu, "month"))


@check("workspace_names", "SELECT workspace_id, workspace_name, workspace_url, status FROM workspaces WHERE workspace_id IN ('ws-1', 'ws-5', 'ws-6')")
def _(t):
    from lakegauge.operators.scope import scope_workspace_policy

    return billing.workspace_names(scope_workspace_policy(t.workspaces, {"workspace_ids": ["ws-1", "ws-5", "ws-6"]}))


DAILY = "(SELECT usage_date, sum(cost) AS total_cost FROM bu GROUP BY 1)"


@check("daily_costs", f"SELECT * FROM {DAILY}", num=("total_cost",))
def _(t):
    return analytics.daily_costs(t.bu)


ROLL = f"""(SELECT usage_date, v, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, stddev_samp(v) OVER w AS ss, count(v) OVER w AS n
 FROM (SELECT usage_date, CAST(total_cost AS DOUBLE) AS v FROM {DAILY}) WINDOW w AS (ORDER BY usage_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


@check(
    "cost_anomalies",
    f"""SELECT usage_date, round(v, 2) AS actual_cost, round(m, 2) AS expected_cost, round(s, 2) AS std_dev, round((v - m) / s, 3) AS z_score
    FROM {ROLL} WHERE n = 30 AND s > 0 AND abs((v - m) / s) >= 2""",
)
def _(t):
    return analytics.cost_anomalies(analytics.daily_costs(t.bu))


@check(
    "anomaly_bands",
    f"""SELECT usage_date, v AS actual_cost, greatest(0.0, m - 2 * s) AS lower_band, m + 2 * s AS upper_band,
    coalesce((v - m) / nullif(s, 0) > 2, FALSE) AS is_anomaly FROM {ROLL} WHERE n = 30""",
    num=("actual_cost", "lower_band", "upper_band"),
)
def _(t):
    return analytics.anomaly_bands(analytics.daily_costs(t.bu))


@check("rolling_z", f"SELECT usage_date, v AS total_cost, (v - m) / nullif(ss, 0) AS z FROM {ROLL} WHERE abs((v - m) / nullif(ss, 0)) > 2", num=("total_cost", "z"))
def _(t):
    return analytics.rolling_z(analytics.daily_costs(t.bu))


@check(
    "cost_forecast",
    f"""WITH h AS (SELECT usage_date, CAST(total_cost AS DOUBLE) AS y, CAST(row_number() OVER (ORDER BY usage_date) - 1 AS DOUBLE) AS x
      FROM {DAILY} WHERE usage_date BETWEEN DATE '2001-11-04' - INTERVAL 90 DAY AND DATE '2001-11-04'),
    f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, max(usage_date) AS last FROM h)
    SELECT CAST(last + CAST(i AS INT) AS DATE) AS forecast_date, round(greatest(a + b * (n - 1 + i), 0), 2) AS forecasted_cost
    FROM f, (SELECT unnest(range(1, 31)) AS i) WHERE n >= 2""",
)
def _(t):
    return analytics.cost_forecast(analytics.daily_costs(t.bu), AS_OF)


@check(
    "mom_growth",
    """WITH m AS (SELECT strftime(usage_date, '%Y-%m') AS month, sum(cost) AS total_cost FROM bu GROUP BY 1),
    l AS (SELECT *, lag(total_cost) OVER (ORDER BY month) AS prior_month_cost FROM m)
    SELECT *, round(CAST((total_cost - prior_month_cost) * 100 AS DOUBLE) / CAST(nullif(prior_month_cost, 0) AS DOUBLE), 2) AS growth_pct FROM l""",
    num=("total_cost", "prior_month_cost", "growth_pct"),
)
def _(t):
    return analytics.mom_growth(t.bu)


@check("cost_matrix", "SELECT workspace_id, billing_origin_product AS billing_origin, sum(cost) AS total_cost FROM bu GROUP BY 1, 2", num=("total_cost",))
def _(t):
    return analytics.cost_matrix(t.bu)


@check(
    "utilization_summary",
    """SELECT workspace_id, avg(CAST(u AS DOUBLE)) AS avg_dbu_per_day, max(u) AS peak_dbu_per_day, sum(c) AS total_cost FROM
    (SELECT workspace_id, usage_date, sum(usage_quantity) AS u, sum(cost) AS c FROM bu GROUP BY 1, 2) GROUP BY 1""",
    num=("avg_dbu_per_day", "peak_dbu_per_day", "total_cost"),
    digits=2,
)
def _(t):
    return analytics.utilization_summary(t.bu)


@check(
    "kpi_summary",
    """WITH c AS (SELECT coalesce(sum(cost), 0) AS total_cost, coalesce(sum(usage_quantity), 0) AS total_dbus, count(DISTINCT workspace_id) AS active_workspaces,
      count(DISTINCT sku_name) AS active_skus FROM bu WHERE usage_date BETWEEN DATE '2000-01-01' AND DATE '2000-01-31'),
    p AS (SELECT coalesce(sum(cost), 0) AS prior FROM bu WHERE usage_date BETWEEN DATE '1999-12-01' AND DATE '1999-12-31')
    SELECT total_cost, total_dbus, round(CAST(total_cost AS DOUBLE) / 30, 2) AS avg_daily_cost, active_workspaces, active_skus,
    round(CAST((total_cost - prior) * 100 AS DOUBLE) / CAST(nullif(prior, 0) AS DOUBLE), 2) AS cost_trend_pct FROM c, p""",
    num=("total_cost", "total_dbus", "avg_daily_cost", "cost_trend_pct"),
    digits=2,
)
def _(t):
    return analytics.kpi_summary(t.bu, date(2000, 1, 1), date(2000, 1, 31))
