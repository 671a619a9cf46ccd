"""Cost analytics: anomalies, forecast, growth and key figures.

Windows without a partition key only ever run over day or month totals.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.common import date_range, ratio, total


def daily_costs(priced: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    return df.groupBy("usage_date").agg(total("cost").alias("total_cost")).orderBy("usage_date")


def _series() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("usage_date")


def rolling_baseline(daily: DataFrame, window: int = 30, sample: bool = False) -> DataFrame:
    """Mean, deviation and row count of the ``window`` previous rows (rows, not calendar days; current one excluded)."""
    frame = _series().rowsBetween(-window, -1)
    value = F.col("total_cost").cast("double")
    deviation = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return (
        daily.withColumn("_value", value)
        .withColumn("_mean", F.avg(value).over(frame))
        .withColumn("_std", deviation.over(frame))
        .withColumn("_rows", F.count(value).over(frame))
    )


def cost_anomalies(daily: DataFrame, window: int = 30, threshold: float = 2.0) -> DataFrame:
    """Days at least ``threshold`` population deviations off their trailing mean. The first ``window`` rows are never
    reported, nor is a day whose window is flat."""
    based = rolling_baseline(daily, window).filter((F.col("_rows") == window) & (F.col("_std") > 0))
    z = (F.col("_value") - F.col("_mean")) / F.col("_std")
    return (
        based.withColumn("_z", z)
        .filter(F.abs("_z") >= threshold)
        .select(
            "usage_date",
            F.round("_value", 2).alias("actual_cost"),
            F.round("_mean", 2).alias("expected_cost"),
            F.round("_std", 2).alias("std_dev"),
            F.round("_z", 3).alias("z_score"),
        )
        .orderBy("usage_date")
    )


def anomaly_bands(daily: DataFrame, window: int = 30, width: float = 2.0) -> DataFrame:
    """Chart band around the trailing mean, clamped at zero, and a flag for upward outliers only."""
    based = rolling_baseline(daily, window).filter(F.col("_rows") == window)
    z = F.try_divide(F.col("_value") - F.col("_mean"), F.col("_std"))
    return based.select(
        "usage_date",
        F.col("_value").alias("actual_cost"),
        F.greatest(F.lit(0.0), F.col("_mean") - width * F.col("_std")).alias("lower_band"),
        (F.col("_mean") + width * F.col("_std")).alias("upper_band"),
        F.coalesce(z > width, F.lit(False)).alias("is_anomaly"),
    ).orderBy("usage_date")


def rolling_z(daily: DataFrame, window: int = 30, threshold: float = 2.0) -> DataFrame:
    """The sample-deviation variant, without a minimum row count."""
    based = rolling_baseline(daily, window, sample=True)
    z = F.try_divide(F.col("_value") - F.col("_mean"), F.col("_std"))
    return based.withColumn("z", z).filter(F.abs("z") > threshold).select("usage_date", "total_cost", "z")


def cost_forecast(daily: DataFrame, as_of: date, history_days: int = 90, horizon: int = 30) -> DataFrame:
    """Straight-line forecast from the history up to ``as_of``; fewer than two days give nothing."""
    history = date_range(daily, "usage_date", as_of - timedelta(days=history_days), as_of)
    x = (F.row_number().over(_series()) - 1).cast("double")
    fitted = (
        history.select("usage_date", F.col("total_cost").cast("double").alias("_y"), x.alias("_x"))
        .agg(
            F.regr_slope("_y", "_x").alias("_slope"),
            F.regr_intercept("_y", "_x").alias("_intercept"),
            F.count(F.lit(1)).alias("_n"),
            F.max("usage_date").alias("_last"),
        )
        .filter(F.col("_n") >= 2)
    )
    ahead = fitted.withColumn("_ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    predicted = F.col("_intercept") + F.col("_slope") * (F.col("_n") - 1 + F.col("_ahead"))
    return ahead.select(
        F.date_add("_last", F.col("_ahead")).alias("forecast_date"),
        F.round(F.greatest(predicted, F.lit(0.0)), 2).alias("forecasted_cost"),
    )


def mom_growth(priced: DataFrame) -> DataFrame:
    """Month cost against the previous month that has data."""
    months = priced.groupBy(F.date_format("usage_date", "yyyy-MM").alias("month")).agg(
        total("cost").alias("total_cost")
    )
    prior = F.lag("total_cost").over(Window.partitionBy(F.lit(0)).orderBy("month"))
    change = ratio((F.col("total_cost") - F.col("prior_month_cost")) * 100, F.col("prior_month_cost"), 2)
    return months.withColumn("prior_month_cost", prior).withColumn("growth_pct", change).orderBy("month")


def cost_matrix(priced: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    df = date_range(priced, "usage_date", start, end)
    return (
        df.groupBy("workspace_id", F.col("billing_origin_product").alias("billing_origin"))
        .agg(total("cost").alias("total_cost"))
        .orderBy("workspace_id", "billing_origin")
    )


def utilization_summary(priced: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Average and peak daily usage per workspace over the days it has data."""
    df = date_range(priced, "usage_date", start, end)
    days = df.groupBy("workspace_id", "usage_date").agg(
        F.sum("usage_quantity").alias("daily_usage"), total("cost").alias("daily_cost")
    )
    return days.groupBy("workspace_id").agg(
        F.round(F.avg("daily_usage"), 2).alias("avg_dbu_per_day"),
        F.max("daily_usage").alias("peak_dbu_per_day"),
        F.sum("daily_cost").alias("total_cost"),
    )


def kpi_summary(priced: DataFrame, start: date, end: date) -> DataFrame:
    """Totals of a window and the change against the window of equal length before it, from one scan of both."""
    length = end - start
    prior_end = start - timedelta(days=1)
    prior_start = prior_end - length
    df = date_range(priced, "usage_date", prior_start, end)
    current = F.col("usage_date") >= F.lit(start)
    sums = df.agg(
        total(F.when(current, F.col("cost"))).alias("total_cost"),
        total(F.when(current, F.col("usage_quantity"))).alias("total_dbus"),
        F.countDistinct(F.when(current, F.col("workspace_id"))).alias("active_workspaces"),
        F.countDistinct(F.when(current, F.col("sku_name"))).alias("active_skus"),
        total(F.when(~current, F.col("cost"))).alias("_prior"),
    )
    days = max(length.days, 1)
    return sums.select(
        "total_cost",
        "total_dbus",
        F.round(F.col("total_cost") / days, 2).alias("avg_daily_cost"),
        "active_workspaces",
        "active_skus",
        ratio((F.col("total_cost") - F.col("_prior")) * 100, F.col("_prior"), 2).alias("cost_trend_pct"),
    )
