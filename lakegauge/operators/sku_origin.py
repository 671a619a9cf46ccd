"""SKU and billing-origin views: leaderboards, matrices, concentration, trends and drill-downs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.common import MONEY, date_range, latest_by_key, ratio, top, total
from lakegauge.operators.billing import (
    by_cost,
    latest_clusters,
    latest_warehouses,
    top_labels,
    usage_and_cost,
)


def default_window(start: date | None, end: date | None, as_of: date) -> tuple[date, date]:
    """Ninety days up to ``as_of`` unless given; inverted dates are swapped."""
    end = end or as_of
    start = start or end - timedelta(days=89)
    return (end, start) if start > end else (start, end)


def treemap(priced: DataFrame, limit: int = 200, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    totals = df.groupBy("sku_name", "billing_origin_product").agg(*usage_and_cost())
    return top(totals, by_cost("sku_name", "billing_origin_product"), limit)


def treemap_folded(cells: DataFrame) -> DataFrame:
    """Nested form of ``treemap``: one row per origin, its SKUs as an array, costliest first.

    The arrays together hold the rows of ``treemap``, which is limited.
    """
    child = F.struct((-F.col("total_cost")).alias("_order"), "sku_name", "total_cost", "total_usage")
    folded = cells.groupBy("billing_origin_product").agg(
        F.sum("total_cost").alias("total_cost"), F.array_sort(F.collect_list(child)).alias("_children")
    )
    children = F.transform(
        "_children", lambda c: F.struct(c["sku_name"].alias("sku_name"), c["total_cost"].alias("total_cost"))
    )
    return folded.select("billing_origin_product", "total_cost", children.alias("children")).orderBy(
        *by_cost("billing_origin_product")
    )


def bucket_count(start: date, end: date, buckets: int) -> tuple[int, float]:
    """Number of sparkline buckets and the days each one spans."""
    days = max((end - start).days + 1, 1)
    n = max(1, min(buckets, days))
    return n, days / n


def bucket_index(day: Column, start: date, step: float, n: int) -> Column:
    offset = F.floor(F.datediff(day, F.lit(start)) / F.lit(float(step))).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), offset))


def sparkline(priced: DataFrame, key: str, start: date, end: date, buckets: int = 30) -> DataFrame:
    """Cost per time bucket and key as a dense array; a bucket without data is 0."""
    n, step = bucket_count(start, end, buckets)
    df = date_range(priced, "usage_date", start, end)
    sums = df.groupBy(key, bucket_index(F.col("usage_date"), start, step, n).alias("_bucket")).agg(
        total("cost").alias("_cost")
    )
    filled = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_bucket", "_cost"))).alias("_by"))
    zero = F.lit(0).cast(MONEY)
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at("_by", i).cast(MONEY), zero)
    )
    return filled.select(key, dense.alias("sparkline"))


def sku_leaderboard(priced: DataFrame, start: date, end: date, limit: int = 15, buckets: int = 30) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    totals = df.groupBy("sku_name").agg(*usage_and_cost(), F.countDistinct("workspace_id").alias("workspace_count"))
    head = top(totals, by_cost("sku_name"), limit)
    kept = df.join(head.select("sku_name"), "sku_name", "left_semi")
    per_origin = kept.groupBy("sku_name", "billing_origin_product").agg(total("cost").alias("_c"))
    # Equal costs resolve to the first origin by name.
    primary = latest_by_key(per_origin, ["sku_name"], [F.col("_c").desc(), F.col("billing_origin_product").asc_nulls_last()])
    primary = primary.select("sku_name", F.col("billing_origin_product").alias("primary_billing_origin"))
    lines = sparkline(kept, "sku_name", start, end, buckets)
    return (
        head.join(primary, "sku_name", "left")
        .join(lines, "sku_name", "left")
        .select(
            "sku_name",
            "total_cost",
            "total_usage",
            ratio(F.col("total_cost"), F.col("total_usage")).alias("cost_per_unit"),
            "workspace_count",
            "primary_billing_origin",
            "sparkline",
        )
        .orderBy(*by_cost("sku_name"))
    )


def _serverless_sums() -> list[Column]:
    flag = F.col("is_serverless")
    return [
        total(F.when(flag, F.col("cost"))).alias("serverless_cost"),
        total(F.when(~flag, F.col("cost"))).alias("classic_cost"),
        total(F.when(flag.isNull(), F.col("cost"))).alias("unknown_cost"),
    ]


def _serverless_pct() -> Column:
    known = F.col("serverless_cost") + F.col("classic_cost")
    return F.when(known > 0, ratio(F.col("serverless_cost") * 100, known))


def origin_leaderboard(priced: DataFrame, start: date, end: date, limit: int = 15, buckets: int = 30) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    totals = df.groupBy("billing_origin_product").agg(
        *usage_and_cost(),
        F.countDistinct("sku_name").alias("sku_count"),
        F.countDistinct("workspace_id").alias("workspace_count"),
        *_serverless_sums(),
    )
    head = top(totals, by_cost("billing_origin_product"), limit)
    lines = sparkline(df, "billing_origin_product", start, end, buckets)
    flat = F.array_repeat(F.lit(0).cast(MONEY), bucket_count(start, end, buckets)[0])
    return (
        head.join(lines, "billing_origin_product", "left")
        .select(
            "billing_origin_product",
            "total_cost",
            "total_usage",
            "sku_count",
            "workspace_count",
            _serverless_pct().alias("serverless_share_pct"),
            F.coalesce("sparkline", flat).alias("sparkline"),
        )
        .orderBy(*by_cost("billing_origin_product"))
    )


def pivot_topn(
    priced: DataFrame,
    row: str,
    col: str,
    top_rows: int = 15,
    top_cols: int = 15,
    skip_null_col: bool = False,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Cells (row, col, total_cost) of the costliest rows and columns.

    The limits count the NULL label, which is dropped afterwards; with ``skip_null_col`` a NULL column does not use up
    a slot. All three results come from one (row, col) aggregate, so usage is scanned in aggregated form only.
    """
    df = date_range(priced, "usage_date", start, end)
    cells = df.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(total("cost").alias("total_cost"))

    def head(name: str, limit: int, source: DataFrame) -> DataFrame:
        sums = source.groupBy(name).agg(F.sum("total_cost").alias("total_cost"))
        return top(sums, by_cost(name), limit).select(name).filter(F.col(name).isNotNull())

    columns = cells.filter(F.col("col").isNotNull()) if skip_null_col else cells
    return cells.join(head("row", top_rows, cells), "row", "left_semi").join(
        head("col", top_cols, columns), "col", "left_semi"
    ).select("row", "col", "total_cost")


def pivot_wide(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Wide form of pivot cells for a given list of column labels."""
    return cells.groupBy("row").pivot("col", columns).agg(F.first("total_cost"))


def null_column_total(priced: DataFrame, col: str, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end).filter(F.col(col).isNull())
    return df.agg(total("cost").alias("null_cost"))


def sku_workspace_matrix(priced: DataFrame, top_skus: int = 15, top_workspaces: int = 15, **window) -> DataFrame:
    return pivot_topn(priced, "sku_name", "workspace_id", top_skus, top_workspaces, **window)


def origin_workspace_matrix(priced: DataFrame, top_origins: int = 15, top_workspaces: int = 15, **window) -> DataFrame:
    return pivot_topn(priced, "billing_origin_product", "workspace_id", top_origins, top_workspaces, **window)


def sku_identity(priced: DataFrame, top_skus: int = 15, top_identities: int = 15, **window) -> DataFrame:
    return pivot_topn(priced, "sku_name", "run_as", top_skus, top_identities, skip_null_col=True, **window)


def origin_identity(priced: DataFrame, top_origins: int = 15, top_identities: int = 15, **window) -> DataFrame:
    return pivot_topn(priced, "billing_origin_product", "run_as", top_origins, top_identities, skip_null_col=True, **window)


def top_child_shares(priced: DataFrame, parent: str, child: str, name: str) -> DataFrame:
    """Share of each parent's cost held by its 1, 3 and 5 costliest children; NULL when the parent has no cost.

    Children beyond the fifth only enter through the parent's total, so the ranking window keeps five rows a parent.
    """
    sums = priced.filter(F.col(parent).isNotNull()).groupBy(parent, child).agg(total("cost").alias("_c"))
    whole = sums.groupBy(parent).agg(F.sum("_c").alias("_total"))
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.col("_c").desc(), F.col(child).asc_nulls_last()))
    best = sums.withColumn("_rn", rank).filter(F.col("_rn") <= 5)
    tops = best.groupBy(parent).agg(
        *[F.sum(F.when(F.col("_rn") <= n, F.col("_c"))).alias(f"_top{n}") for n in (1, 3, 5)]
    )
    shares = [
        F.when(F.col("_total") > 0, ratio(F.col(f"_top{n}") * 100, F.col("_total"))).alias(f"top{n}_{name}_pct")
        for n in (1, 3, 5)
    ]
    return tops.join(whole, parent).select(parent, *shares)


def _concentration(priced: DataFrame, parent: str, other: str, name: str, limit: int) -> DataFrame:
    head = top_labels(priced, parent, limit).filter(F.col(parent).isNotNull())
    return (
        head.join(top_child_shares(priced, parent, other, name), parent, "left")
        .join(top_child_shares(priced, parent, "workspace_id", "workspace"), parent, "left")
        .withColumnRenamed(parent, "label")
        .orderBy(*by_cost("label"))
    )


def concentration_by_origin(priced: DataFrame, limit: int = 8, start: date | None = None, end: date | None = None) -> DataFrame:
    return _concentration(date_range(priced, "usage_date", start, end), "billing_origin_product", "sku_name", "sku", limit)


def concentration_by_sku(priced: DataFrame, limit: int = 8, start: date | None = None, end: date | None = None) -> DataFrame:
    return _concentration(date_range(priced, "usage_date", start, end), "sku_name", "billing_origin_product", "origin", limit)


def _slice(priced: DataFrame, start: date, end: date, sku_name: str | None, billing_origin: str | None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    if sku_name:
        df = df.filter(F.col("sku_name") == sku_name)
    if billing_origin:
        df = df.filter(F.col("billing_origin_product") == billing_origin)
    return df


def cost_trend_stacked(
    priced: DataFrame,
    start: date,
    end: date,
    top_workspaces: int = 5,
    sku_name: str | None = None,
    billing_origin: str | None = None,
) -> DataFrame:
    """Daily cost of the costliest workspaces, ``other`` and ``total``, long form with zeros filled in."""
    df = _slice(priced, start, end, sku_name, billing_origin)
    daily = df.groupBy("usage_date", "workspace_id").agg(total("cost").alias("total_cost"))
    sums = daily.groupBy("workspace_id").agg(F.sum("total_cost").alias("total_cost"))
    head = top(sums, by_cost("workspace_id"), top_workspaces).filter(F.col("workspace_id").isNotNull())
    labels = head.agg(F.concat(F.collect_list("workspace_id"), F.array(F.lit("other"), F.lit("total")))).scalar()
    known = daily.join(head.select("workspace_id", F.col("workspace_id").alias("_kept")), "workspace_id", "left")
    by_label = known.groupBy("usage_date", F.coalesce("_kept", F.lit("other")).alias("label")).agg(
        F.sum("total_cost").alias("_c")
    )
    days = by_label.groupBy("usage_date").agg(
        F.map_concat(
            F.map_from_entries(F.collect_list(F.struct("label", "_c"))), F.create_map(F.lit("total"), F.sum("_c"))
        ).alias("_by")
    )
    filled = days.withColumn("label", F.explode(labels))
    value = F.coalesce(F.element_at("_by", F.col("label")), F.lit(0).cast(MONEY))
    return filled.select("usage_date", "label", value.alias("total_cost")).orderBy("usage_date", "label")


def serverless_share(priced: DataFrame, limit: int = 20, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    sums = df.groupBy("billing_origin_product").agg(*_serverless_sums())
    shown = sums.withColumn(
        "total_cost", F.col("serverless_cost") + F.col("classic_cost") + F.col("unknown_cost")
    ).withColumn("serverless_pct", _serverless_pct())
    return top(shown, by_cost("billing_origin_product"), limit)


def drill_slice(
    priced: DataFrame, start: date, end: date, sku_name: str | None = None, billing_origin: str | None = None
) -> DataFrame:
    """Usage of exactly one SKU or one billing origin."""
    if bool(sku_name) == bool(billing_origin):
        raise ValueError("give exactly one of sku_name and billing_origin")
    return _slice(priced, start, end, sku_name, billing_origin)


def drill_totals(part: DataFrame) -> DataFrame:
    return part.agg(*usage_and_cost())


def drill_trend(part: DataFrame) -> DataFrame:
    return part.groupBy("usage_date").agg(total("cost").alias("total_cost")).orderBy("usage_date")


def drill_top_workspaces(part: DataFrame, limit: int = 10) -> DataFrame:
    """The limit counts the NULL workspace, which is then dropped."""
    totals = part.groupBy(F.col("workspace_id").alias("label")).agg(*usage_and_cost())
    return top(totals, by_cost("label"), limit).filter(F.col("label").isNotNull())


def drill_top_identities(part: DataFrame, limit: int = 10) -> DataFrame:
    totals = part.filter(F.col("run_as").isNotNull()).groupBy(F.col("run_as").alias("label")).agg(*usage_and_cost())
    return top(totals, by_cost("label"), limit)


def drill_owners(
    part: DataFrame, clusters: DataFrame, warehouses: DataFrame, jobs: DataFrame, limit: int = 10
) -> DataFrame:
    """Owners behind the slice's clusters, warehouses and jobs.

    Each resource counts under its newest configuration row, so configuration history never multiplies cost. Usage is
    summed per resource before the join.
    """

    def owners(config: DataFrame, key: str, owner: str, source: str) -> DataFrame:
        per_resource = part.filter(F.col(key).isNotNull()).groupBy(key).agg(total("cost").alias("_c"))
        named = config.select(key, F.col(owner).alias("owner")).filter(F.col("owner").isNotNull())
        totals = (
            per_resource.join(named, key)
            .groupBy("owner")
            .agg(F.sum("_c").alias("total_cost"), F.count(F.lit(1)).alias("resource_count"))
        )
        head = top(totals, by_cost("owner"), limit)
        return head.select("owner", F.lit(source).alias("source"), "resource_count", "total_cost")

    latest_jobs = latest_by_key(jobs, ["job_id"], [F.col("change_time").desc_nulls_last()])
    return (
        owners(latest_clusters(clusters), "cluster_id", "owned_by", "cluster")
        .unionByName(owners(latest_warehouses(warehouses), "warehouse_id", "created_by", "warehouse"))
        .unionByName(owners(latest_jobs, "job_id", "creator_id", "job"))
    )
