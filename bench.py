"""Benchmark: the query-history build and headline queries; prints one JSON line.

Queries run like dashboard tiles: on built tables, three times, the best time counts. The build runs once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")

    from datetime import date

    from pyspark.sql import functions as F

    from lakegauge.operators import analytics, audit, billing, compute, lineage, node_pool, query_intel, sku_origin, usage_patterns
    from lakegauge.operators.scope import scope_origin
    from lakegauge.plans import qi_build
    from lakegauge.session import local_session
    from verification.fixtures import Tables

    spark = local_session(cores, "bench", **{"spark.sql.shuffle.partitions": cores})
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, path)
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")

    def stored(name, df):
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    # The telemetry tables as a platform would hold them: parquet files in several splits.
    history = stored("history", scope_origin(t.nested_history).repartition(2 * int(cores)))
    usage = stored("usage", t.billing_usage.repartitionByRange(int(cores), "usage_date"))
    prices = stored("prices", t.list_prices)
    edges = stored("edges", t.table_lineage)
    events = stored("audit", t.audit_events)
    nodes = stored("nodes", t.node_timeline)

    times: dict[str, float] = {}
    began = time.time()
    qi_build.qi_build(spark, history, f"{work}/qi")
    times["qi_build"] = round(time.time() - began, 3)

    s = qi_build.read_qi(spark, f"{work}/qi", "qi_statements")
    qt = qi_build.read_qi(spark, f"{work}/qi", "qi_statement_tables")
    qe = qi_build.read_qi(spark, f"{work}/qi", "qi_statement_errors")
    statements = s.count()
    live = scope_origin(usage)
    priced = billing.cost_from_usd(live)
    end = date(2001, 11, 4)
    start = date(2001, 8, 7)
    tl, au, nt = scope_origin(edges), scope_origin(events), scope_origin(nodes)

    queries = {
        "usage_summary": lambda: billing.usage_summary(priced, "month"),
        "usage_summary_by_sku": lambda: billing.usage_summary_by_sku(priced, "month"),
        "cost_from_prices": lambda: billing.by_sku(billing.cost_from_prices(live, scope_origin(prices))),
        "cost_anomalies": lambda: analytics.cost_anomalies(analytics.daily_costs(priced)),
        "cost_forecast": lambda: analytics.cost_forecast(analytics.daily_costs(priced), end),
        "kpi_summary": lambda: analytics.kpi_summary(priced, date(2000, 1, 1), date(2000, 1, 31)),
        "sku_leaderboard": lambda: sku_origin.sku_leaderboard(priced, start, end),
        "sku_workspace_matrix": lambda: sku_origin.sku_workspace_matrix(priced),
        "concentration_by_origin": lambda: sku_origin.concentration_by_origin(priced),
        "cluster_detail": lambda: compute.cluster_detail(t.clusters, billing.cost_from_prices(live, scope_origin(prices))),
        "qi_overview": lambda: query_intel.overview(s),
        "expensive_queries": lambda: query_intel.expensive_queries(s),
        "top_tables": lambda: query_intel.top_tables(s, qt),
        "adoption_trend": lambda: query_intel.adoption_trend(s),
        "slowest_dashboards": lambda: query_intel.slowest_dashboards(s),
        "duplicate_queries": lambda: query_intel.duplicate_queries(s),
        "permission_denied": lambda: query_intel.permission_denied(s, qe),
        "iteration_gap": lambda: usage_patterns.iteration_gap(s),
        "lineage_rollups": lambda: lineage.lineage_rollups(tl),
        "audit_status_class": lambda: audit.audit_status_class(au),
        "cluster_utilization": lambda: node_pool.cluster_utilization(nt),
    }
    for name, build in queries.items():
        runs = []
        for _ in range(3):
            began = time.time()
            build().write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(min(runs), 3)
    closure_start = tl.filter(F.col("source_table_full_name") == "main.bronze.t3").select(F.lit("main.bronze.t3").alias("root")).distinct()
    began = time.time()
    lineage.lineage_closure(lineage.table_pairs(tl), closure_start).write.format("noop").mode("overwrite").save()
    times["lineage_closure"] = round(time.time() - began, 3)

    print(
        json.dumps(
            {
                "metric": "total seconds over the build and all headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": path.rstrip("/").split("sf")[-1],
                "statements": statements,
                "qi_build_statements_per_min": round(statements / times["qi_build"] * 60),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
