"""Physical plans of the operators over plain parquet tables."""

import re
from datetime import date

import pytest

from lakegauge.operators import analytics, audit, billing, compute, governance, lineage, query_etl, query_intel, sku_origin, spend, usage_patterns
from lakegauge.operators.scope import scope_origin


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))

    def keep(name, df):
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return {
        "usage": keep("usage", tables.billing_usage),
        "prices": keep("prices", tables.list_prices),
        "clusters": keep("clusters", tables.clusters),
        "edges": keep("edges", tables.table_lineage),
        "audit": keep("audit", tables.audit_events),
        "catalog": keep("catalog", tables.catalog_columns),
        "history": keep("history", tables.nested_history),
        "s": keep("s", tables.qs),
        "t": keep("t", tables.qt),
    }


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(d):
    priced = billing.cost_from_usd(scope_origin(d["usage"]))
    a, b = date(2001, 8, 7), date(2001, 11, 4)
    yield "usage_summary", billing.usage_summary(priced, "month")
    yield "list_prices", billing.by_sku(billing.cost_from_prices(scope_origin(d["usage"]), d["prices"]))
    yield "by_month", billing.by_sku(billing.cost_from_prices(scope_origin(d["usage"]), d["prices"], by_month=True))
    yield "share", billing.share_of_total(billing.by_sku(priced))
    yield "anomalies", analytics.cost_anomalies(analytics.daily_costs(priced))
    yield "leaderboard", sku_origin.sku_leaderboard(priced, a, b)
    yield "stacked", sku_origin.cost_trend_stacked(priced, a, b)
    yield "concentration", sku_origin.concentration_by_sku(priced)
    yield "clusters", compute.cluster_detail(d["clusters"], priced)
    yield "overview", query_intel.overview(d["s"])
    yield "dashboards", query_intel.slowest_dashboards(d["s"])
    yield "adoption", query_intel.adoption_trend(d["s"])
    yield "rollups", lineage.lineage_rollups(d["edges"])
    yield "neighbours", lineage.table_neighbours(d["edges"], "main.silver.t5")
    yield "audit", audit.audit_stats(d["audit"], d["audit"].withColumnRenamed("user_identity_email", "initiated_by"))
    yield "drift", governance.schema_drift(d["catalog"], a, b)
    yield "pareto", spend.cumulative_share(billing.by_sku(priced))
    yield "gaps", usage_patterns.iteration_gap(d["s"])
    yield "freshness", usage_patterns.freshness_lag(d["s"], d["t"])
    yield "etl", query_etl.analyse(d["history"])


def test_no_python_and_no_pairing_of_everything(stored):
    for name, df in operators(stored):
        text = plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
            assert bad not in text, f"{name}: {bad}"


def test_filters_and_columns_reach_the_scan(stored):
    df = billing.usage_summary(billing.cost_from_usd(scope_origin(stored["usage"])), "month", date(2000, 1, 1), date(2000, 12, 31))
    text = plan(df)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    for part in ("GreaterThanOrEqual(usage_date", "LessThanOrEqual(usage_date", "EqualTo(data_origin,real)", "IsNull(deleted_at)"):
        assert part in pushed
    columns = set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", text).group(1)))
    assert columns == {"usage_date", "usage_quantity", "usage_usd", "data_origin", "deleted_at"}


def test_only_needed_statement_columns_are_read(stored):
    text = plan(query_intel.error_trends(stored["s"]))
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", text).group(1))) == {"error_category", "start_date"}


def test_newest_rows_are_pruned_before_the_shuffle(stored):
    text = plan(billing.latest_clusters(stored["clusters"]))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_heads_are_kept_per_task(stored):
    assert "TakeOrderedAndProject" in plan(query_intel.expensive_queries(stored["s"]))
    assert "TakeOrderedAndProject" in plan(audit.audit_recent(stored["audit"]))


def test_text_is_reduced_once_per_row(stored):
    text = plan(query_etl.qi_tables(query_etl.analyse(stored["history"])))
    assert text.count("OVERWRITE|UPDATE") == 1
