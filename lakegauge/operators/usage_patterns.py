"""How people and tools use the platform: sessions, latency, errors, freshness and adoption."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.common import count_if, ratio, top
from lakegauge.functions.ordered import with_history, with_nearest, with_previous
from lakegauge.functions.quantiles import add_percentiles, exact_percentiles


def _n() -> Column:
    return F.count(F.lit(1))


def _millis(later: Column, earlier: Column) -> Column:
    return ((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1000).cast("double")


def cold_start_first_query(s: DataFrame) -> DataFrame:
    """Median compute wait of the first statement of each session."""
    first = s.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.min_by("waiting_for_compute_duration_ms", F.struct("start_time", "statement_id")).alias("wait_ms")
    )
    return add_percentiles(first.agg(_n().alias("sessions")), first, [], "wait_ms", {"median_wait_ms": 0.5})


def iteration_gap(s: DataFrame) -> DataFrame:
    """Median time between consecutive statements of a session, over all sessions."""
    rows = s.filter(F.col("session_id").isNotNull() & F.col("start_time").isNotNull()).select(
        "session_id", "start_time", "statement_id"
    )
    paired = with_previous(rows, ["session_id"], ["start_time", "statement_id"], ["start_time"])
    gaps = paired.filter(F.col("prev_start_time").isNotNull()).withColumn(
        "gap_ms", _millis(F.col("start_time"), F.col("prev_start_time"))
    )
    return exact_percentiles(gaps, [], "gap_ms", {"median_gap_ms": 0.5}, count_as="gaps")


def session_length(s: DataFrame) -> DataFrame:
    """Median span and mean number of statements of a session."""
    sessions = s.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.min("start_time").alias("_from"),
        F.max(F.coalesce("end_time", "start_time")).alias("_to"),
        _n().alias("queries"),
    )
    spans = sessions.withColumn("span_ms", _millis(F.col("_to"), F.col("_from")))
    summary = spans.agg(_n().alias("sessions"), F.avg("queries").alias("avg_queries"))
    return add_percentiles(summary, spans, [], "span_ms", {"median_span_ms": 0.5})


def user_volume_outliers(s: DataFrame, sigma: float = 5.0, window: int = 30, min_days: int = 2) -> DataFrame:
    """Days on which a user ran far more than over their own previous active days."""
    days = s.filter(F.col("executed_by").isNotNull()).groupBy("executed_by", "start_date").agg(_n().alias("queries"))
    frame = Window.partitionBy("executed_by").orderBy("start_date").rowsBetween(-window, -1)
    based = (
        days.withColumn("baseline", F.avg("queries").over(frame))
        .withColumn("deviation", F.stddev_pop("queries").over(frame))
        .withColumn("_days", F.count("queries").over(frame))
    )
    hit = (F.col("_days") >= min_days) & (F.col("queries") > F.col("baseline") + sigma * F.col("deviation"))
    return based.filter(hit & (F.col("deviation") > 0)).drop("_days")


def latency_regression(s: DataFrame, key: str = "client_application", grain: str = "week") -> DataFrame:
    """95th percentile per key and period against the previous period that has data."""
    rows = s.filter(F.col(key).isNotNull()).withColumn("period", F.to_date(F.date_trunc(grain, F.col("start_date"))))
    p95 = exact_percentiles(rows, [key, "period"], "total_duration_ms", {"p95_ms": 0.95})
    before = F.lag("p95_ms").over(Window.partitionBy(key).orderBy("period"))
    return p95.withColumn("previous_p95_ms", before).withColumn("change", ratio(F.col("p95_ms"), F.col("previous_p95_ms")))


def pipeline_drift(s: DataFrame, run: str = "update_id", window: int = 7, factor: float = 2.0, sigma: float = 3.0) -> DataFrame:
    """Runs of a pipeline against the median duration and the spread of output rows of its previous runs."""
    runs = s.filter(F.col("pipeline_id").isNotNull()).groupBy("pipeline_id", run).agg(
        F.min("start_time").alias("started"),
        F.sum("total_duration_ms").alias("duration_ms"),
        F.sum("produced_rows").alias("produced_rows"),
    )
    spread = with_history(runs, ["pipeline_id"], ["started", run], window)
    frame = Window.partitionBy("_k", "_bucket").orderBy("started", run).rowsBetween(-window, -1)
    based = (
        spread.withColumn("median_ms", F.percentile("duration_ms", F.lit(0.5)).over(frame))
        .withColumn("_mean", F.avg("produced_rows").over(frame))
        .withColumn("_std", F.stddev_pop("produced_rows").over(frame))
        .filter(~F.col("_copy"))
    )
    slow = F.coalesce(F.col("duration_ms") > F.col("median_ms") * factor, F.lit(False))
    odd = F.coalesce(F.abs(F.col("produced_rows") - F.col("_mean")) > sigma * F.col("_std"), F.lit(False))
    return based.select("pipeline_id", run, "duration_ms", "median_ms", "produced_rows", slow.alias("is_slow"), odd.alias("is_row_outlier"))


def error_growth_wow(s: DataFrame) -> DataFrame:
    """Errors per pattern and week against the previous week with that pattern."""
    found = s.filter(F.col("error_category").isNotNull())
    weeks = found.groupBy(
        F.coalesce("error_code", "error_category").alias("pattern"),
        F.to_date(F.date_trunc("week", F.col("start_date"))).alias("week"),
    ).agg(_n().alias("errors"))
    before = F.lag("errors").over(Window.partitionBy("pattern").orderBy("week"))
    return weeks.withColumn("previous", before).withColumn(
        "growth_pct", ratio((F.col("errors") - F.col("previous")) * 100, F.col("previous"))
    )


def multi_workspace_hour(s: DataFrame, min_workspaces: int = 2) -> DataFrame:
    """Users active in several workspaces within one hour."""
    rows = s.filter(F.col("executed_by").isNotNull()).withColumn(
        "hour", F.date_trunc("hour", F.col("start_time")).cast("timestamp_ntz")
    )
    return (
        rows.groupBy("executed_by", "hour")
        .agg(F.countDistinct("workspace_id").alias("workspaces"), _n().alias("queries"))
        .filter(F.col("workspaces") >= min_workspaces)
    )


def read_build_ratio(t: DataFrame) -> DataFrame:
    """Reading against writing statements of each table."""
    pairs = t.filter(F.col("role").isin("read", "write")).select("fully_qualified", "role", "statement_id").distinct()
    sums = pairs.groupBy(F.col("fully_qualified").alias("table")).agg(
        count_if(F.col("role") == "read").alias("reads"), count_if(F.col("role") == "write").alias("builds")
    )
    return sums.withColumn("read_build_ratio", ratio(F.col("reads"), F.col("builds")))


def _table_events(s: DataFrame, t: DataFrame) -> DataFrame:
    named = t.filter(F.col("role").isin("read", "write")).select(
        "statement_id", F.col("fully_qualified").alias("table"), (F.col("role") == "write").alias("is_write")
    )
    return named.join(s.select("statement_id", "start_time", "executed_by", "execution_status"), "statement_id")


def freshness_lag(s: DataFrame, t: DataFrame) -> DataFrame:
    """Time from the last write to each read of a table: mean and number of reads that had a write before them."""
    events = _table_events(s, t).filter(F.col("start_time").isNotNull()).select("table", "start_time", "is_write")
    known = with_nearest(events, ["table"], "start_time", "is_write", "_written")
    reads = known.filter(~F.col("is_write") & F.col("_written").isNotNull())
    lag = _millis(F.col("start_time"), F.col("_written"))
    return reads.groupBy("table").agg(_n().alias("reads"), F.avg(lag).alias("avg_lag_ms"), F.max(lag).alias("max_lag_ms"))


def new_users_weekly(s: DataFrame) -> DataFrame:
    first = s.filter(F.col("executed_by").isNotNull()).groupBy("executed_by").agg(F.min("start_date").alias("_first"))
    week = F.to_date(F.date_trunc("week", F.col("_first"))).alias("week")
    return first.groupBy(week).agg(_n().alias("new_users")).orderBy("week")


def monthly_active_consumers(s: DataFrame, t: DataFrame, tables: Sequence[str] | None = None) -> DataFrame:
    """Distinct readers of a set of tables per month."""
    reads = t.filter(F.col("role") == "read")
    if tables is not None:
        reads = reads.filter(F.col("fully_qualified").isin(*tables))
    users = (
        s.join(reads.select("statement_id"), "statement_id", "left_semi")
        .filter(F.col("executed_by").isNotNull())
        .select(F.date_format("start_date", "yyyy-MM").alias("month"), "executed_by")
        .distinct()
    )
    return users.groupBy("month").agg(_n().alias("consumers")).orderBy("month")


def stale_dashboards(s: DataFrame, as_of: date, days: int = 60) -> DataFrame:
    last = s.filter(F.col("dashboard_id").isNotNull()).groupBy("dashboard_id").agg(F.max("start_time").alias("last_query"))
    limit = F.lit(datetime.combine(as_of - timedelta(days=days), datetime.min.time())).cast("timestamp_ntz")
    return last.filter(F.col("last_query") < limit)


def cacheable_repeats(s: DataFrame, limit: int = 20) -> DataFrame:
    """Texts run again without the result cache: repeats and the time spent on them.

    A run is a repeat unless it is the first of its text, which one aggregation per text finds.
    """
    rows = s.filter(F.col("statement_text_sha1").isNotNull()).select(
        "statement_text_sha1", "statement_id", "start_time", "from_result_cache", "total_duration_ms"
    )
    first = rows.groupBy("statement_text_sha1").agg(
        F.min_by("statement_id", F.struct("start_time", "statement_id")).alias("_first")
    )
    again = rows.join(first, "statement_text_sha1").filter(
        (F.col("statement_id") != F.col("_first")) & ~F.coalesce("from_result_cache", F.lit(False))
    )
    sums = again.groupBy("statement_text_sha1").agg(
        _n().alias("repeats"), F.coalesce(F.sum("total_duration_ms"), F.lit(0)).alias("repeat_ms")
    )
    return top(sums, [F.col("repeats").desc(), F.col("repeat_ms").desc(), F.col("statement_text_sha1")], limit)


def warehouse_sizing(s: DataFrame, busy_wait_ms: float = 100.0, idle_wait_ms: float = 50.0, spill_bytes: int = 100_000) -> DataFrame:
    """Over- or under-provisioned by mean queueing and total spill."""
    sums = s.filter(F.col("warehouse_id").isNotNull()).groupBy("warehouse_id").agg(
        _n().alias("statements"),
        F.avg(F.coalesce("waiting_at_capacity_duration_ms", F.lit(0))).alias("avg_wait_ms"),
        F.coalesce(F.sum("spilled_local_bytes"), F.lit(0)).alias("spilled_bytes"),
        F.coalesce(F.sum("total_duration_ms"), F.lit(0)).alias("total_ms"),
    )
    verdict = (
        F.when((F.col("avg_wait_ms") >= busy_wait_ms) | (F.col("spilled_bytes") >= spill_bytes), "under")
        .when(F.col("avg_wait_ms") < idle_wait_ms, "over")
        .otherwise("fit")
    )
    return sums.withColumn("sizing", verdict)


def ai_adoption(assistant: DataFrame, s: DataFrame) -> DataFrame:
    """Assistant users against query users per month that has either."""

    def users(df: DataFrame, who: str, when: str, name: str) -> DataFrame:
        pairs = df.filter(F.col(who).isNotNull()).select(F.date_format(when, "yyyy-MM").alias("month"), F.col(who).alias("u"))
        return pairs.distinct().groupBy("month").agg(_n().alias(name))

    a = users(assistant, "initiated_by", "event_date", "assistant_users")
    q = users(s, "executed_by", "start_date", "query_users")
    none = F.lit(0).cast("bigint")
    joined = q.join(a, "month", "full").select(
        "month", F.coalesce("query_users", none).alias("query_users"), F.coalesce("assistant_users", none).alias("assistant_users")
    )
    return joined.withColumn("adoption", ratio(F.col("assistant_users"), F.col("query_users"))).orderBy("month")


def user_timeline(audit: DataFrame, s: DataFrame, user: str, start: datetime, end: datetime) -> DataFrame:
    """Everything one user did between two moments, audit events and statements together, oldest first."""

    def window(df: DataFrame, who: str, when: str) -> DataFrame:
        first, last = (F.lit(m).cast("timestamp_ntz") for m in (start, end))
        return df.filter((F.col(who) == user) & (F.col(when) >= first) & (F.col(when) <= last))

    events = window(audit, "user_identity_email", "event_time").select(
        F.col("event_time").alias("at"), F.lit("audit").alias("kind"), F.col("event_id").alias("id"),
        F.concat_ws(":", "service_name", "action_name").alias("what"), F.col("response_status_code").cast("string").alias("outcome"),
    )
    queries = window(s, "executed_by", "start_time").select(
        F.col("start_time").alias("at"), F.lit("query").alias("kind"), F.col("statement_id").alias("id"),
        F.col("statement_type").alias("what"), F.col("execution_status").alias("outcome"),
    )
    return events.unionByName(queries).orderBy("at", "kind", "id")


def data_product_card(
    s: DataFrame, t: DataFrame, catalog: DataFrame, edges: DataFrame, tables: Sequence[str]
) -> DataFrame:
    """One row per table of a product: consumers, reads, last write and read, documentation, fan-out and failures."""
    wanted = t.filter(F.col("fully_qualified").isin(*tables))
    events = _table_events(s, wanted)
    use = events.groupBy("table").agg(
        F.countDistinct(F.when(~F.col("is_write"), F.col("executed_by"))).alias("consumers"),
        count_if(~F.col("is_write")).alias("reads"),
        F.max(F.when(F.col("is_write"), F.col("start_time"))).alias("last_write"),
        F.max(F.when(~F.col("is_write"), F.col("start_time"))).alias("last_read"),
        count_if(F.col("execution_status") == "FAILED").alias("failed"),
    )
    name = F.concat_ws(".", "catalog", "database", "table_name")
    docs = catalog.withColumn("table", name).filter(F.col("table").isin(*tables)).groupBy("table").agg(
        (F.count("comment") * 100.0 / F.count(F.lit(1))).alias("documented_pct")
    )
    fan = edges.filter(F.col("source_table_full_name").isin(*tables)).groupBy(
        F.col("source_table_full_name").alias("table")
    ).agg(F.countDistinct("target_table_full_name").alias("fan_out"))
    return use.join(docs, "table", "left").join(fan, "table", "left")
