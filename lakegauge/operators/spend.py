"""Spend questions that cross several tables: shares, attribution to statements, tags and tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.common import date_range, latest_by_key, let, ratio, top, total
from lakegauge.functions.quantiles import running_total
from lakegauge.operators.billing import by_cost, usage_and_cost
from lakegauge.operators.lineage import SRC, TGT, lineage_closure, table_pairs


def cumulative_share(labelled: DataFrame) -> DataFrame:
    """Pareto curve: running share of the total by descending cost. Input: (label, total_cost)."""
    whole = labelled.agg(F.sum("total_cost")).scalar()
    order = [F.col("total_cost").desc(), F.col("label").asc_nulls_last()]
    running = running_total(labelled, "total_cost", order, "_running")
    return running.select("label", "total_cost", ratio(F.col("_running"), whole).alias("cum_share"))


def originals(priced: DataFrame) -> DataFrame:
    return priced.filter(F.col("record_type") == "ORIGINAL")


def monthly_cost_original(priced: DataFrame) -> DataFrame:
    month = F.date_format("usage_date", "yyyy-MM").alias("month")
    return originals(priced).groupBy(month).agg(total("cost").alias("total_cost")).orderBy("month")


def top_jobs(priced: DataFrame, jobs: DataFrame, limit: int = 10) -> DataFrame:
    """Costliest jobs with the name of their newest configuration row."""
    rows = originals(priced).filter(F.col("job_id").isNotNull())
    head = top(rows.groupBy("job_id").agg(*usage_and_cost()), by_cost("job_id"), limit)
    names = latest_by_key(jobs, ["job_id"], [F.col("change_time").desc_nulls_last()])
    return head.join(names.select("job_id", F.col("name").alias("job_name")), "job_id", "left").select(
        "job_id", "job_name", "total_cost", "total_usage"
    )


def sku_cost_original(priced: DataFrame, start: date, end: date) -> DataFrame:
    rows = date_range(originals(priced), "usage_date", start, end)
    return rows.groupBy("sku_name").agg(*usage_and_cost()).orderBy(*by_cost("sku_name"))


def correction_split(priced: DataFrame) -> DataFrame:
    return priced.groupBy("record_type").agg(F.count(F.lit(1)).alias("records"), *usage_and_cost()).orderBy("record_type")


def _since(df: DataFrame, column: str, as_of: date, days: int) -> DataFrame:
    """Rows of the last ``days`` days, the boundary day included."""
    first = as_of - timedelta(days=days)
    if dict(df.dtypes)[column] != "date":
        moment = F.lit(datetime.combine(first, datetime.min.time())).cast("timestamp_ntz")
        return df.filter(F.col(column) >= moment)
    return df.filter(F.col(column) >= F.lit(first))


def cost_per_cpu_point(
    priced: DataFrame, timeline: DataFrame, as_of_cost: date, as_of_load: date, days: int = 7, limit: int = 25
) -> DataFrame:
    """Cluster cost of the last days divided by its mean active CPU."""
    load = (
        _since(timeline, "start_time", as_of_load, days)
        .filter(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(F.avg(F.col("cpu_user_percent") + F.col("cpu_system_percent")).alias("active_cpu"))
    )
    cost = (
        _since(priced, "usage_date", as_of_cost, days)
        .filter(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(total("cost").alias("cost"))
    )
    joined = load.join(cost, "cluster_id").withColumn("cost_per_cpu_pt", ratio(F.col("cost"), F.col("active_cpu")))
    return top(joined, [F.col("cost_per_cpu_pt").desc_nulls_last(), F.col("cluster_id")], limit)


def phantom_workspaces(priced: DataFrame, audit: DataFrame, as_of_cost: date, as_of_audit: date, days: int = 30) -> DataFrame:
    """Workspaces with recent spend and no recent audit event."""
    spend = _since(priced, "usage_date", as_of_cost, days).groupBy("workspace_id").agg(total("cost").alias("cost"))
    active = _since(audit, "event_time", as_of_audit, days).select("workspace_id").distinct()
    return spend.join(active, "workspace_id", "left_anti")


def _hours(start: str, end: str) -> Column:
    """Hour buckets an interval touches; the end itself is not part of it."""
    first, last = F.date_trunc("hour", F.col(start)), F.col(end)
    steps = F.sequence(first, F.greatest(first, F.date_trunc("hour", last)), F.expr("interval 1 hour"))
    return let(steps, lambda s: F.filter(s, lambda h: (h == first) | (h < last)))


def _seconds(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp")) / F.lit(1_000_000.0)


def query_cost_allocation(spend: DataFrame, statements: DataFrame) -> DataFrame:
    """Billed cost shared out to the statements that ran on the same compute in the same hour: (statement_id, cost).

    ``spend`` has (compute_id, usage_start_time, usage_end_time, cost), ``statements`` has (statement_id, compute_id,
    start_time, end_time). Cost is spread evenly over the hours of its interval and summed per (compute, hour); each
    statement takes the part of that sum which its running time is of all running time there. What was billed for hours
    in which nothing ran is one row without a statement, so the rows add up to the billed cost. Both sides are linear in
    their rows: billing rows and statements are never paired.
    """
    billed = (
        spend.filter(F.col("compute_id").isNotNull())
        .withColumn("_hour", F.explode(_hours("usage_start_time", "usage_end_time")))
        .withColumn("_next", F.col("_hour") + F.expr("interval 1 hour"))
    )
    part = _seconds(F.least("usage_end_time", "_next")) - _seconds(F.greatest("usage_start_time", "_hour"))
    whole = _seconds(F.col("usage_end_time")) - _seconds(F.col("usage_start_time"))
    hourly = billed.groupBy("compute_id", "_hour").agg(
        F.sum(F.col("cost").cast("double") * F.coalesce(F.try_divide(part, whole), F.lit(1.0))).alias("_cost")
    )
    ran = (
        statements.filter(F.col("compute_id").isNotNull() & F.col("start_time").isNotNull())
        .withColumn("end_time", F.coalesce("end_time", "start_time"))
        .withColumn("_hour", F.explode(_hours("start_time", "end_time")))
        .withColumn("_next", F.col("_hour") + F.expr("interval 1 hour"))
    )
    busy = _seconds(F.least("end_time", "_next")) - _seconds(F.greatest("start_time", "_hour"))
    weighted = ran.select("statement_id", "compute_id", "_hour", F.greatest(busy, F.lit(0.001)).alias("_w"))
    totals = weighted.groupBy("compute_id", "_hour").agg(F.sum("_w").alias("_all"))
    rates = hourly.join(totals, ["compute_id", "_hour"], "left").withColumn("_rate", F.col("_cost") / F.col("_all"))
    shared = (
        weighted.join(rates.select("compute_id", "_hour", "_rate"), ["compute_id", "_hour"])
        .groupBy("statement_id")
        .agg(F.sum(F.col("_w") * F.col("_rate")).alias("cost"))
    )
    idle = rates.filter(F.col("_all").isNull()).agg(F.sum("_cost").alias("cost")).filter(F.col("cost").isNotNull())
    return shared.unionByName(idle.withColumn("statement_id", F.lit(None).cast(shared.schema["statement_id"].dataType)))


def tag_spend(allocated: DataFrame, tags: DataFrame) -> DataFrame:
    """Allocated cost by statement tag. A statement with several tags counts under each."""
    return (
        tags.select("statement_id", "tag_key", "tag_value")
        .join(allocated, "statement_id")
        .groupBy("tag_key", "tag_value")
        .agg(F.sum("cost").alias("total_cost"), F.countDistinct("statement_id").alias("statements"))
        .orderBy(F.col("total_cost").desc(), "tag_key", "tag_value")
    )


def untagged_share(allocated: DataFrame, tags: DataFrame) -> DataFrame:
    """Cost without a tag; what no statement used counts as untagged."""
    tagged = tags.select("statement_id", F.lit(1).alias("_tagged")).distinct()
    sums = allocated.join(tagged, "statement_id", "left").agg(
        F.sum("cost").alias("total_cost"),
        F.coalesce(F.sum(F.when(F.col("_tagged").isNull(), F.col("cost"))), F.lit(0.0)).alias("untagged_cost"),
    )
    return sums.withColumn("untagged_pct", ratio(F.col("untagged_cost") * 100, F.col("total_cost")))


def project_review(statements: DataFrame, tables: DataFrame, tags: DataFrame, allocated: DataFrame, keyword: str) -> DataFrame:
    """One row about everything that mentions a keyword in its text, tables or tags.

    ``statements`` carries the full ``statement_text``; the three sources of matches are combined as ids.
    """
    pattern = f"%{keyword}%"
    ids = (
        statements.filter(F.col("statement_text").ilike(pattern)).select("statement_id")
        .unionByName(tables.filter(F.col("fully_qualified").ilike(pattern)).select("statement_id"))
        .unionByName(tags.filter(F.col("tag_value").ilike(pattern)).select("statement_id"))
        .distinct()
    )
    matched = statements.select("statement_id", "executed_by", "execution_status").join(ids, "statement_id", "left_semi")
    return matched.join(allocated, "statement_id", "left").agg(
        F.count(F.lit(1)).alias("statement_count"),
        F.countDistinct("executed_by").alias("distinct_users"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
        F.avg(F.when(F.col("execution_status") == "FAILED", 1.0).otherwise(0.0)).alias("failure_rate"),
    )


# Fixed value: column names that suggest personal data, short list of the spend review.
PII_SPEND = "(?i)(ssn|dob|birth|email|phone|credit_card|mrn|patient|diagnosis)"


def pii_spend(catalog: DataFrame, tables: DataFrame, statements: DataFrame, allocated: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables with personal-data column names: cost and number of reads, users, and tables fed by them."""
    name = F.concat_ws(".", "catalog", "database", "table_name")
    pii = catalog.filter(F.col("col_name").rlike(PII_SPEND)).select(name.alias("full_name")).distinct()
    touched = (
        tables.filter(F.col("role").isin("read", "reference"))
        .select("statement_id", F.col("fully_qualified").alias("full_name"))
        .join(pii, "full_name", "left_semi")
        .join(statements.select("statement_id", "executed_by"), "statement_id")
        .join(allocated, "statement_id", "left")
        .groupBy("full_name")
        .agg(
            F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
            F.count(F.lit(1)).alias("reads"),
            F.countDistinct("executed_by").alias("users"),
        )
    )
    fed = (
        edges.filter(F.col(TGT).isNotNull())
        .join(pii.withColumnRenamed("full_name", SRC), SRC, "left_semi")
        .groupBy(F.col(SRC).alias("full_name"))
        .agg(F.countDistinct(TGT).alias("downstream_tables"))
    )
    zero = F.lit(0).cast("bigint")
    joined = pii.join(touched, "full_name", "left").join(fed, "full_name", "left")
    return joined.select(
        "full_name",
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("reads", zero).alias("reads"),
        F.coalesce("users", zero).alias("users"),
        F.coalesce("downstream_tables", zero).alias("downstream_tables"),
    ).orderBy(F.col("cost").desc(), "full_name")


def deprecation_impact(edges: DataFrame, full_name: str) -> DataFrame:
    """Entities that read a table, by number of edges."""
    return (
        edges.filter(F.col(SRC) == full_name)
        .groupBy("entity_type", "entity_id")
        .agg(F.count(F.lit(1)).alias("edge_count"))
        .orderBy(F.col("edge_count").desc(), F.col("entity_type").asc_nulls_last(), F.col("entity_id").asc_nulls_last())
    )


def upstream_cost(edges: DataFrame, outputs: DataFrame, entity_cost: DataFrame) -> DataFrame:
    """Cost of every entity that writes an output or any table upstream of it.

    ``outputs`` has a column ``root``; ``entity_cost`` has (entity_id, cost). Result: (root, entities, total_cost).
    """
    above = lineage_closure(table_pairs(edges), outputs, "upstream").select("root", "full_name")
    scope = above.unionByName(outputs.select("root", F.col("root").alias("full_name"))).distinct()
    writers = edges.filter(F.col(TGT).isNotNull() & F.col("entity_id").isNotNull()).select(
        F.col(TGT).alias("full_name"), "entity_id"
    ).distinct()
    involved = scope.join(writers, "full_name").select("root", "entity_id").distinct()
    return involved.join(entity_cost, "entity_id", "left").groupBy("root").agg(
        F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("cost"), F.lit(0)).alias("total_cost")
    )


def cost_per_consumer(priced: DataFrame) -> DataFrame:
    """Monthly cost per distinct identity."""
    months = priced.groupBy(F.date_format("usage_date", "yyyy-MM").alias("month")).agg(
        total("cost").alias("total_cost"), F.countDistinct("run_as").alias("consumers")
    )
    return months.withColumn("cost_per_consumer", ratio(F.col("total_cost"), F.col("consumers"))).orderBy("month")
