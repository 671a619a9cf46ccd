"""Audit and assistant events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.common import contains_text, count_if, top


def _n() -> Column:
    return F.count(F.lit(1))


def action_label() -> Column:
    return F.concat(F.coalesce("service_name", F.lit("?")), F.lit(":"), F.coalesce("action_name", F.lit("?")))


def audit_stats(audit: DataFrame, assistant: DataFrame) -> DataFrame:
    a = audit.agg(
        _n().alias("audit_events"),
        F.countDistinct("user_identity_email").alias("distinct_users"),
        F.countDistinct(action_label()).alias("distinct_actions"),
        F.countDistinct("service_name").alias("distinct_services"),
        count_if(F.col("response_status_code") >= 400).alias("error_events"),
        F.max("event_time").alias("last_event"),
    )
    b = assistant.agg(
        _n().alias("assistant_events"),
        F.countDistinct("initiated_by").alias("assistant_distinct_users"),
        F.max("event_time").alias("assistant_last_event"),
    )
    return a.withColumn("_b", b.select(F.struct(*b.columns)).scalar()).select(*a.columns, "_b.*")


def count_by(df: DataFrame, label: Column, limit: int | None) -> DataFrame:
    """Most frequent labels, ties by name."""
    sums = df.groupBy(label.alias("label")).agg(_n().alias("count"))
    return top(sums, [F.col("count").desc(), F.col("label")], limit)


def audit_by_service(audit: DataFrame, limit: int = 20) -> DataFrame:
    return count_by(audit, F.coalesce("service_name", F.lit("(none)")), limit)


def audit_by_level(audit: DataFrame, limit: int = 5) -> DataFrame:
    return count_by(audit, F.coalesce("audit_level", F.lit("(none)")), limit)


def status_class(code: Column) -> Column:
    """Everything below 300 is ``2xx`` and everything from 500 on is ``5xx``."""
    return (
        F.when(code.isNull(), "(none)")
        .when(code < 300, "2xx")
        .when(code < 400, "3xx")
        .when(code < 500, "4xx")
        .otherwise("5xx")
    )


def audit_status_class(audit: DataFrame, limit: int = 10) -> DataFrame:
    return count_by(audit, status_class(F.col("response_status_code")), limit)


def audit_top_actions(audit: DataFrame, limit: int = 15) -> DataFrame:
    return count_by(audit, action_label(), limit)


def audit_top_users(audit: DataFrame, limit: int = 15) -> DataFrame:
    return count_by(audit.filter(F.col("user_identity_email").isNotNull()), F.col("user_identity_email"), limit)


def assistant_top_users(assistant: DataFrame, limit: int = 15) -> DataFrame:
    return count_by(assistant.filter(F.col("initiated_by").isNotNull()), F.col("initiated_by"), limit)


SHOWN = ["event_time", "user_identity_email", "service_name", "action_name", "audit_level", "response_status_code",
         "response_error_message", "source_ip_address", "workspace_id", "request_id", "event_id"]

#: searched column -> label
SEARCHED = {"user_identity_email": "user", "service_name": "service", "action_name": "action", "source_ip_address": "ip",
            "response_error_message": "error"}


def _newest() -> list[Column]:
    return [F.col("event_time").desc_nulls_last(), F.col("event_id")]


def audit_recent(
    audit: DataFrame,
    limit: int = 50,
    errors_only: bool = False,
    service: str | None = None,
    user_email: str | None = None,
) -> DataFrame:
    if errors_only:
        audit = audit.filter(F.col("response_status_code") >= 400)
    if service:
        audit = audit.filter(F.col("service_name") == service)
    if user_email:
        audit = audit.filter(F.col("user_identity_email") == user_email)
    return top(audit.select(*SHOWN), _newest(), limit)


def audit_search(audit: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Events with the text in one of five columns, labelled by the first of them."""
    matched = F.coalesce(*[F.when(contains_text(c, text), F.lit(label)) for c, label in SEARCHED.items()])
    found = audit.select(*SHOWN, matched.alias("matched_in")).filter(F.col("matched_in").isNotNull())
    return top(found, _newest(), limit)
