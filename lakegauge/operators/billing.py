"""Billing usage: pricing, summaries, breakdowns and per-user views.

Operators other than the pricing ones take a *priced* frame: usage rows with a ``cost`` column, made by
``cost_from_usd`` or ``cost_from_prices``. The choice is the caller's, so no hidden probe job decides it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakegauge.functions.common import MONEY, date_range, latest_by_key, ratio, top, total

#: Quantities as they are declared, and unit prices; the widest pair whose product is exact in 38 digits.
_QUANTITY, _PRICE = T.DecimalType(20, 6), T.DecimalType(17, 6)

#: Supported periods with the pattern of their label; a week is named by its Monday.
_PERIODS = {"day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM"}


def cost_from_usd(usage: DataFrame) -> DataFrame:
    """Cost from the pre-computed dollar amount; rows without one cost nothing."""
    return usage.withColumn("cost", F.coalesce(F.col("usage_usd").cast(MONEY), F.lit(0).cast(MONEY)))


def cost_from_prices(usage: DataFrame, prices: DataFrame, by_month: bool = False) -> DataFrame:
    """Cost from the price valid when the usage ended: ``start <= usage_end < end``, an open end never closes.

    Usage without a matching price is dropped. The join is an equi join on (sku, cloud, unit) with the validity
    interval as a residual filter. No hint is given: Spark broadcasts the price list while its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, splitting hot SKUs by the adaptive skew join.
    ``by_month`` adds the calendar month to the join key for a long price history, so that one SKU is spread over its
    months and a row only meets the prices of its own month.
    """
    p = prices.select(
        F.col("sku_name").alias("_sku"),
        F.col("cloud").alias("_cloud"),
        F.col("usage_unit").alias("_unit"),
        F.col("price_start_time").alias("_from"),
        F.col("price_end_time").alias("_until"),
        F.col("effective_list_price").cast(_PRICE).alias("_price"),
    )
    on = (
        (F.col("sku_name") == F.col("_sku"))
        & (F.col("cloud") == F.col("_cloud"))
        & (F.col("usage_unit") == F.col("_unit"))
        & (F.col("usage_end_time") >= F.col("_from"))
        & (F.col("_until").isNull() | (F.col("usage_end_time") < F.col("_until")))
    )
    helper = ["_sku", "_cloud", "_unit", "_from", "_until", "_price"]
    if by_month:
        horizon = usage.agg(F.max("usage_end_time")).scalar()
        last = F.least(F.coalesce(F.col("_until"), horizon), horizon)
        months = F.sequence(F.trunc("_from", "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
        p = p.filter(F.col("_from") <= last).withColumn("_month", F.explode(months))
        usage = usage.withColumn("_usage_month", F.trunc("usage_end_time", "month"))
        on = on & (F.col("_usage_month") == F.col("_month"))
        helper += ["_month", "_usage_month"]
    cost = F.col("usage_quantity").cast(_QUANTITY) * F.col("_price")
    return usage.join(p, on, "inner").withColumn("cost", cost).drop(*helper)


def usage_with_cost(usage: DataFrame, prices: DataFrame | None = None, mode: str = "usd") -> DataFrame:
    """Price usage by ``mode``: ``usd`` (amount on the row) or ``list`` (price list)."""
    if mode == "usd":
        return cost_from_usd(usage)
    if mode == "list":
        if prices is None:
            raise ValueError("list pricing needs a price table")
        return cost_from_prices(usage, prices)
    raise ValueError(f"unknown cost mode {mode!r}")


def usage_and_cost() -> list[Column]:
    return [total("usage_quantity").alias("total_usage"), total("cost").alias("total_cost")]


def _by_period(df: DataFrame, grain: str, *keys: str) -> DataFrame:
    """Usage and cost per period. Rows are grouped by the first date of their period; labels are made afterwards."""
    if grain not in _PERIODS:
        raise ValueError(f"grain must be one of {sorted(_PERIODS)}")
    first = F.col("usage_date") if grain == "day" else F.trunc("usage_date", grain)
    sums = df.groupBy(first.alias("_first"), *keys).agg(*usage_and_cost())
    label = F.date_format("_first", _PERIODS[grain]).alias("period")
    return sums.select(label, *keys, "total_usage", "total_cost").orderBy("period", *keys)


def by_cost(*ties: str) -> list[Column]:
    return [F.col("total_cost").desc(), *[F.col(t).asc_nulls_last() for t in ties]]


def usage_summary(priced: DataFrame, grain: str = "day", start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    return _by_period(df, grain)


def top_labels(priced: DataFrame, column: str, limit: int) -> DataFrame:
    """The ``limit`` costliest values of a column, NULL included."""
    totals = priced.groupBy(column).agg(total("cost").alias("total_cost"))
    return top(totals, by_cost(column), limit)


def usage_summary_by_sku(
    priced: DataFrame, grain: str = "day", top_skus: int = 5, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Period totals of the costliest SKUs, long form."""
    df = date_range(priced, "usage_date", start, end)
    winners = top_labels(df, "sku_name", top_skus).select("sku_name")
    return _by_period(df.join(winners, "sku_name", "left_semi"), grain, "sku_name")


def breakdown(priced: DataFrame, column: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Usage and cost by one column; a missing value is shown as ``None``."""
    df = date_range(priced, "usage_date", start, end)
    totals = df.groupBy(column).agg(*usage_and_cost())
    label = F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("label")
    return totals.select(label, "total_usage", "total_cost").orderBy(*by_cost("label"))


def by_sku(priced: DataFrame, **window) -> DataFrame:
    return breakdown(priced, "sku_name", **window)


def by_workspace(priced: DataFrame, **window) -> DataFrame:
    return breakdown(priced, "workspace_id", **window)


def by_origin(priced: DataFrame, **window) -> DataFrame:
    return breakdown(priced, "billing_origin_product", **window)


def by_usage_type(priced: DataFrame, **window) -> DataFrame:
    return breakdown(priced, "usage_type", **window)


def by_cloud(priced: DataFrame, **window) -> DataFrame:
    return breakdown(priced, "cloud", **window)


def by_user(priced: DataFrame, limit: int = 10, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end).filter(F.col("run_as").isNotNull())
    totals = df.groupBy(F.col("run_as").alias("user")).agg(*usage_and_cost())
    return top(totals, by_cost("user"), limit)


def daily_trend(
    priced: DataFrame,
    start: date | None = None,
    end: date | None = None,
    sku_name: str | None = None,
    workspace_id: str | None = None,
    run_as: str | None = None,
) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    for column, value in {"sku_name": sku_name, "workspace_id": workspace_id, "run_as": run_as}.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df.groupBy("usage_date").agg(*usage_and_cost()).orderBy("usage_date")


def user_totals(priced: DataFrame, user: str, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end).filter(F.col("run_as") == user)
    return df.agg(*usage_and_cost())


def user_sku_breakdown(priced: DataFrame, user: str, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end).filter(F.col("run_as") == user)
    return df.groupBy("sku_name").agg(*usage_and_cost()).orderBy(*by_cost("sku_name"))


def latest_clusters(clusters: DataFrame) -> DataFrame:
    return latest_by_key(
        clusters, ["cluster_id"], [F.col("change_time").desc_nulls_last(), F.col("create_time").desc_nulls_last()]
    )


def latest_warehouses(warehouses: DataFrame) -> DataFrame:
    return latest_by_key(warehouses, ["warehouse_id"], [F.col("change_time").desc_nulls_last()])


def user_cluster_breakdown(
    priced: DataFrame, clusters: DataFrame, user: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """One user's cost by cluster, named by the newest configuration. Totals first: the join sees clusters, not rows."""
    df = date_range(priced, "usage_date", start, end).filter(
        (F.col("run_as") == user) & F.col("cluster_id").isNotNull()
    )
    totals = df.groupBy("cluster_id").agg(*usage_and_cost())
    names = latest_clusters(clusters).select("cluster_id", F.col("cluster_name").alias("resource_name"))
    return (
        totals.join(names, "cluster_id", "left")
        .select(F.col("cluster_id").alias("resource_id"), "resource_name", "total_usage", "total_cost")
        .orderBy(*by_cost("resource_id"))
    )


def user_warehouse_breakdown(
    priced: DataFrame, warehouses: DataFrame, user: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """All billing on the warehouses a user created, whoever ran it."""
    owned = latest_warehouses(warehouses.filter(F.col("created_by") == user)).select(
        "warehouse_id", F.col("warehouse_name").alias("resource_name")
    )
    df = date_range(priced, "usage_date", start, end).filter(F.col("warehouse_id").isNotNull())
    totals = df.groupBy("warehouse_id").agg(*usage_and_cost())
    return (
        totals.join(owned, "warehouse_id")
        .select(F.col("warehouse_id").alias("resource_id"), "resource_name", "total_usage", "total_cost")
        .orderBy(*by_cost("resource_id"))
    )


def sku_user_matrix(
    priced: DataFrame, top_skus: int = 10, top_users: int = 10, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Cells of the costliest SKUs and users with a positive cost."""
    df = date_range(priced, "usage_date", start, end).filter(F.col("run_as").isNotNull())
    cells = df.groupBy("sku_name", "run_as").agg(*usage_and_cost())
    skus = top_labels(df, "sku_name", top_skus).select("sku_name")
    users = top_labels(df, "run_as", top_users).select("run_as")
    return (
        cells.join(skus, "sku_name", "left_semi")
        .join(users, "run_as", "left_semi")
        .filter(F.col("total_cost") > 0)
        .select("sku_name", "run_as", "total_usage", "total_cost")
    )


def top_skus(priced: DataFrame, limit: int = 10, start: date | None = None, end: date | None = None) -> DataFrame:
    """Costliest SKUs with their 1-based rank; the ranking window only sees ``limit`` rows."""
    df = date_range(priced, "usage_date", start, end)
    head = top(df.groupBy("sku_name").agg(*usage_and_cost()), by_cost("sku_name"), limit)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by_cost("sku_name")))
    return head.withColumn("rank", rank)


def share_of_total(labelled: DataFrame, keep: int = 9) -> DataFrame:
    """Percentage of the total per label, everything past the first ``keep`` labels folded into ``Other``.

    Input: (label, total_cost). Output: (label, total_cost, pct).
    """
    whole = labelled.agg(F.sum("total_cost")).scalar()
    head = top(labelled, by_cost("label"), keep).select("label", F.lit(True).alias("_kept"))
    folded = labelled.join(head, "label", "left").groupBy(
        F.when(F.col("_kept"), F.col("label")).otherwise(F.lit("Other")).alias("label")
    )
    sums = folded.agg(F.sum("total_cost").alias("total_cost"))
    return sums.withColumn("pct", ratio(F.col("total_cost") * 100, whole))


def unit_cost_by_period(summary: DataFrame) -> DataFrame:
    """Add cost per unit to a period summary; periods without usage show 0."""
    unit = F.when(F.col("total_usage") > 0, ratio(F.col("total_cost"), F.col("total_usage"))).otherwise(F.lit(0.0))
    return summary.withColumn("unit_cost", unit)


def unit_cost_wide(summary_by_sku: DataFrame, skus: Sequence[str]) -> DataFrame:
    """Chart form of the per-SKU unit cost: one column per given SKU."""
    priced = unit_cost_by_period(summary_by_sku)
    return priced.groupBy("period").pivot("sku_name", list(skus)).agg(F.first("unit_cost")).orderBy("period")


def workspace_names(workspaces: DataFrame) -> DataFrame:
    return workspaces.select("workspace_id", "workspace_name", "workspace_url", "status").orderBy("workspace_id")
