"""Literal input and output pairs."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lakegauge.functions import errors, sqltext
from lakegauge.operators import analytics, audit, billing, compute, lineage, query_etl, scope, sku_origin
from lakegauge.sources import extracts, files


def column(df, name):
    return [r[name] for r in df.collect()]


def shares(spark, totals):
    schema = "p string, c int, cost decimal(20,6)"
    df = spark.createDataFrame([("x", i, Decimal(v)) for i, v in enumerate(totals)], schema)
    rows = sku_origin.top_child_shares(df, "p", "c", "child").collect()
    return rows[0].asDict() if rows else {}


@pytest.mark.parametrize(
    "totals, n, expected", [([0, 0, 0], 1, None), ([80, 15, 5], 1, 80.0), ([50, 30, 15, 5], 3, 95.0), ([70, 30], 5, 100.0)]
)
def test_top_share(spark, totals, n, expected):
    assert shares(spark, totals)[f"top{n}_child_pct"] == expected


def test_top_share_of_nothing(spark):
    assert shares(spark, []) == {}


@pytest.mark.parametrize(
    "day, step, n, expected",
    [("2025-12-31", 1, 10, 0), ("2026-01-01", 1, 30, 0), ("2026-01-30", 1, 30, 29), ("2026-01-18", 9, 10, 1), ("2027-01-01", 1, 5, 4)],
)
def test_bucket_index(spark, day, step, n, expected):
    df = spark.createDataFrame([(date.fromisoformat(day),)], "d date")
    assert df.select(sku_origin.bucket_index(F.col("d"), date(2026, 1, 1), step, n).alias("b")).first().b == expected


def test_default_window():
    a, b = date(2026, 1, 1), date(2026, 2, 1)
    assert sku_origin.default_window(a, b, b) == (a, b)
    start, end = sku_origin.default_window(None, None, b)
    assert (end - start).days == 89
    assert sku_origin.default_window(b, a, b) == (a, b)


def test_drill_needs_exactly_one(spark):
    with pytest.raises(ValueError):
        sku_origin.drill_slice(None, date(2026, 1, 1), date(2026, 1, 2))
    with pytest.raises(ValueError):
        sku_origin.drill_slice(None, date(2026, 1, 1), date(2026, 1, 2), "a", "b")


def test_node_specs(spark):
    specs = {r.node_type: r for r in compute.node_specs(spark).collect()}
    assert (specs["Standard_DS3_v2"].vcpus, specs["Standard_DS3_v2"].memory_gb, specs["Standard_DS3_v2"].cloud) == (4, 14.0, "azure")
    assert (specs["m5.xlarge"].vcpus, specs["m5.xlarge"].memory_gb, specs["m5.xlarge"].cloud) == (4, 16.0, "aws")
    assert (specs["n1-standard-4"].vcpus, specs["n1-standard-4"].cloud) == (4, "gcp")
    assert "unknown" not in specs


def test_warehouse_peak(spark):
    rows = [("a", "MEDIUM", None), ("b", "MEDIUM", 0), ("c", "medium", 3), ("d", "HUGE", 1), ("e", None, 1)]
    df = compute.with_warehouse_size(spark.createDataFrame(rows, "id string, warehouse_size string, max_clusters int"))
    assert {r.id: r.max_dbu_per_hour for r in df.collect()} == {"a": 24, "b": 24, "c": 72, "d": None, "e": None}
    sizes = [r.max_dbu_per_hour for r in compute.warehouse_sizes(spark).orderBy("max_dbu_per_hour").collect()]
    assert sizes == [4, 6, 12, 24, 40, 80, 144, 272, 528]


USER = {"is_system": True, "filters": {}}


def role(**filters):
    return {"is_system": False, "filters": filters}


@pytest.mark.parametrize(
    "roles, admin, expected",
    [
        ([role(workspace_ids=["ws-1"])], True, None),
        ([USER], False, None),
        ([], False, {"__deny_all__": True}),
        ([role(workspace_ids=["ws-1"]), role(workspace_ids=["ws-2", "ws-3"])], False, {"workspace_ids": ["ws-1", "ws-2", "ws-3"]}),
        ([role(workspace_ids=["ws-1"]), role()], False, None),
        ([USER, role(workspace_ids=["ws-1"])], False, {"workspace_ids": ["ws-1"]}),
        ([role(sku_name_pattern="a%"), role(sku_name_pattern="b%")], False, {"sku_name_patterns": ["a%", "b%"]}),
        ([role(sku_name_pattern="a%"), role(clouds=["AWS"])], False, None),
    ],
)
def test_effective_policy(roles, admin, expected):
    assert scope.effective_policy(roles, admin) == expected


def test_policy_values_compare_as_text(spark):
    df = spark.createDataFrame([("4206644426758546",), ("x",)], "workspace_id string")
    assert scope.scope_workspace_policy(df, {"workspace_ids": [4206644426758546]}).count() == 1
    assert scope.scope_billing_policy(df, {"__deny_all__": True}).count() == 0


USAGE = "sku_name string, cloud string, usage_unit string, usage_date date, usage_end_time timestamp_ntz, usage_quantity decimal(20,6)"
PRICES = (
    "sku_name string, cloud string, usage_unit string, currency_code string, price_start_time timestamp_ntz, "
    "price_end_time timestamp_ntz, effective_list_price decimal(20,6)"
)


def prices(spark, *windows):
    return spark.createDataFrame([("s", "AWS", "DBU", "USD", a, b, Decimal(p)) for a, b, p in windows], PRICES)


def usage(spark, *ends):
    return spark.createDataFrame([("s", "AWS", "DBU", e.date(), e, Decimal("10.5")) for e in ends], USAGE)


@pytest.mark.parametrize("by_month", [False, True])
def test_price_boundary_is_half_open(spark, by_month):
    edge = datetime(2026, 1, 1)
    p = prices(spark, (datetime(2025, 1, 1), edge, "0.10"), (edge, None, "0.30"))
    rows = billing.cost_from_prices(usage(spark, edge, datetime(2025, 12, 31), datetime(2024, 1, 1)), p, by_month).collect()
    assert sorted(float(r.cost) for r in rows) == [1.05, 3.15]


def test_extract_counts_both_ends_and_keeps_unpriced(spark):
    edge = datetime(2026, 1, 1)
    p = prices(spark, (datetime(2025, 1, 1), edge, "0.10"), (edge, None, "0.30"))
    u = usage(spark, edge, datetime(2024, 1, 1), datetime(2026, 3, 15, 6))
    out = extracts.extract_usage(u, p, date(2020, 1, 1), date(2030, 1, 1), date(2026, 4, 9))
    assert sorted(float(r.usage_usd) for r in out.collect()) == [0.0, 1.05, 3.15, 3.15]


def test_extract_open_end_is_the_day_after(spark):
    p = prices(spark, (datetime(2025, 1, 1), None, "0.30"))
    u = usage(spark, datetime(2026, 4, 10), datetime(2026, 4, 10, 1))
    out = extracts.extract_usage(u, p, date(2020, 1, 1), date(2030, 1, 1), date(2026, 4, 9))
    assert sorted(float(r.usage_usd) for r in out.collect()) == [0.0, 3.15]


def test_latest_snapshot(spark, tmp_path):
    root = str(tmp_path)
    assert files.list_snapshots(spark, root + "/none", "t") == []
    assert files.latest_snapshot(spark, root, "t") is None
    for day in ("2026-04-09", "2026-05-09", "2026-04-24"):
        files.write_snapshot(spark.createDataFrame([(day,)], "y string"), root, "t", date.fromisoformat(day))
    assert files.latest_snapshot(spark, root, "t").first().y == "2026-05-09"
    assert files.latest_snapshot(spark, root, "t", files.DEMO_PREFIX) is None
    assert files.latest_snapshot(spark, root, "t", files.DEMO_PREFIX, fallback_to_real=True).first().y == "2026-05-09"


@pytest.mark.parametrize(
    "text, safe",
    [
        ("SELECT 1;", True),
        ("WITH c AS (SELECT 1) SELECT * FROM c", True),
        ("SELECT 1 -- DELETE everything", True),
        ("/* DROP */ SELECT 1", True),
        ("SELECT 1; SELECT 2", False),
        ("DROP TABLE t", False),
        ("/* x */ DROP TABLE t", False),
        ("-- only", False),
        ("", False),
        (None, False),
    ],
)
@pytest.mark.parametrize("rules", list(scope.SAFETY_RULES))
def test_sql_safety(spark, text, safe, rules):
    df = spark.createDataFrame([(text,)], "q string")
    assert scope.sql_text_safety(df, "q", rules).first().is_safe is safe


def daily(spark, values, start=date(2026, 1, 1)):
    rows = [(date.fromordinal(start.toordinal() + i), Decimal(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "usage_date date, total_cost decimal(20,6)")


def test_anomalies(spark):
    assert analytics.cost_anomalies(daily(spark, [10] * 30 + [99])).count() == 0
    assert analytics.cost_anomalies(daily(spark, list(range(29)))).count() == 0
    found = analytics.cost_anomalies(daily(spark, [10, 12] * 15 + [99])).collect()
    assert [(r.usage_date, r.actual_cost, r.expected_cost, r.std_dev, r.z_score) for r in found] == [(date(2026, 1, 31), 99.0, 11.0, 1.0, 88.0)]


def test_forecast(spark):
    assert analytics.cost_forecast(daily(spark, [5]), date(2026, 1, 1)).count() == 0
    falling = analytics.cost_forecast(daily(spark, [30, 20, 10]), date(2026, 1, 3)).orderBy("forecast_date").collect()
    assert len(falling) == 30 and falling[0].forecast_date == date(2026, 1, 4) and {r.forecasted_cost for r in falling} == {0.0}


def test_kpi_windows(spark):
    rows = [(date(2023, 11, 30), 1), (date(2023, 12, 1), 10), (date(2023, 12, 31), 10), (date(2024, 1, 1), 15), (date(2024, 1, 31), 15), (date(2024, 2, 1), 7)]
    df = spark.createDataFrame([(d, Decimal(v), Decimal(1), "w", "s") for d, v in rows], "usage_date date, cost decimal(20,6), usage_quantity decimal(20,6), workspace_id string, sku_name string")
    k = analytics.kpi_summary(df, date(2024, 1, 1), date(2024, 1, 31)).first()
    assert (float(k.total_cost), float(k.avg_daily_cost), k.cost_trend_pct) == (30.0, 1.0, 50.0)


@pytest.mark.parametrize(
    "text, expected",
    [("-- note\nselect 1", True), ("df = [1]", False), ("DESC t", False), ("", False), ("  \n SELECT 1", True), ("-- a\n\n  -- b\nMERGE into x", True), ("import os", False), ("select;", True), ("x" * 300 + " import ", False)],
)
def test_looks_like_sql(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sqltext.looks_like_sql(F.col("t")).alias("x")).first().x is expected


@pytest.mark.parametrize("text, expected", [("[PERMISSION_DENIED] x", "PERMISSION"), ("no room left", "OOM"), ("kaput", "OTHER"), ("boom", "OOM"), (None, None), ("[WHAT] a timeout", "TIMEOUT"), ("[PARSE_ERROR] ACCESS_DENIED", "PARSE")])
def test_error_category(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(errors.error_category(F.col("t")).alias("x")).first().x == expected


@pytest.mark.parametrize("text, expected", [("PyDatabricksSqlConnector, 4.2.6", ("PyConnector", "4.2.6")), ("Exec Api", ("ExecApi", None)), (None, (None, None)), ("SimbaJDBC, 2, 6", ("JDBC", "2, 6")), ("x", ("Other", None))])
def test_driver(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(errors.driver_family(F.col("t")), errors.driver_version(F.col("t"))).first()) == expected


def test_full_scan(spark):
    big = 107374182400
    rows = [(None, 5), (big, 5), (big + 1, 999), (big + 1, 1000), (big + 1, None)]
    df = spark.createDataFrame(
        [(b, p, None, None, None, None, None, None, None) for b, p in rows],
        "read_bytes bigint, produced_rows bigint, read_files bigint, pruned_files bigint, read_rows bigint, total_duration_ms bigint, "
        "waiting_for_compute_duration_ms bigint, waiting_at_capacity_duration_ms bigint, compilation_duration_ms bigint",
    ).withColumn("from_result_cache", F.lit(None).cast("boolean"))
    assert column(df.select(query_etl.metric_columns()["is_full_scan"].alias("x")), "x") == [False, False, True, False, False]


@pytest.mark.parametrize("hour, minute, off", [(6, 59, True), (7, 0, False), (18, 59, False), (19, 0, True)])
def test_off_hours(spark, hour, minute, off):
    df = spark.createDataFrame([(datetime(2026, 1, 5, hour, minute),)], "start_time timestamp_ntz")
    row = df.select(*[c.alias(n) for n, c in query_etl.time_columns().items()]).first()
    assert (row.is_off_hours, row.start_day_of_week, row.is_weekend) == (off, 0, False)


@pytest.mark.parametrize("durations, expected", [([7], [7]), (list(range(1, 101)), [99, 100]), ([0, 0, None], []), ([5, None, 0], []), ([5] * 99 + [9], [5] * 99 + [9])])
def test_expensive(spark, durations, expected):
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(durations)], "statement_id string, total_duration_ms bigint")
    found = query_etl.qi_expensive(df).filter("is_expensive").collect()
    assert sorted(r.total_duration_ms for r in found if r.total_duration_ms) == expected


def test_project_keywords(spark):
    t = sqltext.TABLE_TYPE
    df = spark.sql(
        f"""SELECT from_json('[{{"catalog":"acme_prod","schema":"gold"}},{{"catalog":"main","schema":"x-y"}}]', '{t}') AS t,
        from_json('[{{"tag_key":"k","tag_value":"Team-X"}},{{"tag_key":"e","tag_value":"PROD"}}]', '{query_etl.TAG_TYPE}') AS g,
        from_json('[{{"param_name":"Region"}},{{"param_name":"ab"}}]', '{query_etl.PARAM_TYPE}') AS p"""
    )
    assert df.select(query_etl.project_keywords(F.col("t"), F.col("g"), F.col("p")).alias("k")).first().k == ["acme", "gold", "region", "team-x"]


@pytest.mark.parametrize("code, expected", [(100, "2xx"), (299, "2xx"), (300, "3xx"), (404, "4xx"), (600, "5xx"), (None, "(none)")])
def test_status_class(spark, code, expected):
    df = spark.createDataFrame([(code,)], "c int")
    assert df.select(audit.status_class(F.col("c")).alias("x")).first().x == expected


def test_rollup_counts_unknown_as_indirect(spark):
    rows = [Row(source_table_full_name="a", target_table_full_name=t, entity_id="e", direct_access=d, event_time=datetime(2026, 1, 1)) for t, d in [("b", True), ("c", False), ("d", None)]]
    df = spark.createDataFrame(rows, "source_table_full_name string, target_table_full_name string, entity_id string, direct_access boolean, event_time timestamp_ntz")
    row = lineage.lineage_rollups(df).filter("full_name = 'a'").first()
    assert (row.edges_out, row.direct_edges, row.indirect_edges, row.edges_in) == (3, 1, 2, 0)


def test_ingest_timestamps(spark):
    df = spark.createDataFrame([("2026-01-02 03:04:05",), ("2026/01/02",), ("nope",), (None,)], "t string")
    got = column(df.select(extracts.safe_timestamp(F.col("t")).alias("x")), "x")
    assert got == [datetime(2026, 1, 2, 3, 4, 5), datetime(2026, 1, 2), None, None]


@pytest.mark.parametrize("text, expected", [("My Report (v2)!", "my-report-v2"), (None, "chatbot-result"), ("***", "chatbot-result"), ("x" * 90, "x" * 80)])
def test_file_stem(text, expected):
    assert files.safe_stem(text, longest=80) == expected
