"""Catalog governance, lineage coverage and audit hygiene."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.common import count_if, ratio, top
from lakegauge.operators.lineage import SRC, TGT, catalog_names

# Fixed value: column names that suggest personal data.
PII_COLUMNS = "(ssn|dob|birth|email|phone|credit_card|passport|mrn|patient|diagnosis)"

# Table-name prefixes of the naming convention.
TABLE_PREFIXES = ("dim_", "fact_", "bridge_", "stg_", "raw_")

TABLE = ("catalog", "database", "table_name")


def _n() -> Column:
    return F.count(F.lit(1))


def table_type_mix(catalog: DataFrame) -> DataFrame:
    pairs = catalog.select("table_type", *TABLE).distinct()
    return pairs.groupBy("table_type").agg(_n().alias("tables")).orderBy(F.col("tables").desc(), "table_type")


def pii_columns(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.lower("col_name").rlike(PII_COLUMNS)).select(*TABLE, "col_name", "data_type")


def canonical_keys(catalog: DataFrame, min_tables: int = 5, limit: int = 50) -> DataFrame:
    pairs = catalog.select("col_name", *TABLE).distinct()
    sums = pairs.groupBy("col_name").agg(_n().alias("tables")).filter(F.col("tables") >= min_tables)
    return top(sums, [F.col("tables").desc(), F.col("col_name")], limit)


def terminal_edges(edges: DataFrame) -> DataFrame:
    """Targets that are never a source."""
    targets = edges.filter(F.col(TGT).isNotNull()).select(F.col(TGT).alias("table_full_name")).distinct()
    sources = edges.filter(F.col(SRC).isNotNull()).select(F.col(SRC).alias("table_full_name")).distinct()
    return targets.join(sources, "table_full_name", "left_anti")


def schema_drift(catalog: DataFrame, before: date, after: date) -> DataFrame:
    """Columns added or removed between two snapshots, and whether their whole table came or went."""

    def side(day: date, name: str) -> DataFrame:
        return catalog.filter(F.col("as_of") == F.lit(day)).select(*TABLE, "col_name").distinct().withColumn(name, F.lit(True))

    both = side(before, "_old").join(side(after, "_new"), [*TABLE, "col_name"], "full")
    old, new = F.coalesce("_old", F.lit(False)), F.coalesce("_new", F.lit(False))
    per_table = both.groupBy(*TABLE).agg(F.bool_or(old).alias("_told"), F.bool_or(new).alias("_tnew"))
    changed = both.filter(old != new).withColumn("change", F.when(new, "added").otherwise("removed"))
    whole = ~(F.col("_told") & F.col("_tnew"))
    return changed.join(per_table, list(TABLE)).select(*TABLE, "col_name", "change", whole.alias("whole_table"))


def type_conflicts(catalog: DataFrame, min_types: int = 2) -> DataFrame:
    pairs = catalog.select("col_name", "data_type").distinct()
    return pairs.groupBy("col_name").agg(_n().alias("types")).filter(F.col("types") >= min_types)


def doc_coverage(catalog: DataFrame) -> DataFrame:
    """Documented share of tables and columns per catalog, in percent."""
    tables = catalog.groupBy(*TABLE).agg(
        F.count("table_comment").alias("_tc"), _n().alias("_cols"), F.count("comment").alias("_cc")
    )
    sums = tables.groupBy("catalog").agg(
        _n().alias("tables"),
        count_if(F.col("_tc") > 0).alias("documented_tables"),
        F.sum("_cols").alias("columns"),
        F.sum("_cc").alias("documented_columns"),
    )
    return sums.withColumns(
        {
            "table_pct": ratio(F.col("documented_tables") * 100, F.col("tables")),
            "column_pct": ratio(F.col("documented_columns") * 100, F.col("columns")),
        }
    )


def owner_coverage(catalog: DataFrame) -> DataFrame:
    tables = catalog.groupBy(*TABLE).agg(F.count("table_owner").alias("_o"))
    sums = tables.groupBy("catalog").agg(_n().alias("tables"), count_if(F.col("_o") > 0).alias("owned_tables"))
    return sums.withColumn("owned_pct", ratio(F.col("owned_tables") * 100, F.col("tables")))


def owner_concentration(catalog: DataFrame, share: float = 0.2) -> DataFrame:
    """Owners that hold more than a share of a catalog's tables."""
    tables = catalog.groupBy(*TABLE).agg(F.max("table_owner").alias("table_owner"))
    owners = tables.groupBy("catalog", "table_owner").agg(_n().alias("tables"))
    whole = F.sum("tables").over(Window.partitionBy("catalog"))
    rated = owners.withColumn("share", ratio(F.col("tables"), whole))
    return rated.filter(F.col("table_owner").isNotNull() & (F.col("share") > share))


def wide_tables(catalog: DataFrame, min_columns: int = 100) -> DataFrame:
    return catalog.groupBy(*TABLE).agg(F.count("col_name").alias("columns")).filter(F.col("columns") >= min_columns)


def naming_conventions(catalog: DataFrame, prefixes: tuple[str, ...] = TABLE_PREFIXES) -> DataFrame:
    """Tables per prefix and catalog; tables without a known prefix count as ``other``."""
    label = F.regexp_extract(F.lower("table_name"), "^(" + "|".join(prefixes) + ")", 1)
    tables = catalog.select(*TABLE).distinct().withColumn("prefix", F.when(label != "", label).otherwise("other"))
    return tables.groupBy("catalog", "prefix").agg(_n().alias("tables"))


def _queried(t: DataFrame) -> DataFrame:
    return t.filter(F.col("role") != "cte").select(F.col("fully_qualified").alias("full_name")).distinct()


def never_queried(catalog: DataFrame, t: DataFrame) -> DataFrame:
    return catalog_names(catalog).join(_queried(t), "full_name", "left_anti")


def queried_undocumented(catalog: DataFrame, t: DataFrame) -> DataFrame:
    named = catalog.withColumn("full_name", F.concat_ws(".", *TABLE)).groupBy("full_name").agg(F.count("table_comment").alias("_c"))
    return named.filter(F.col("_c") == 0).join(_queried(t), "full_name", "left_semi").select("full_name")


def _touched(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(SRC, TGT)).alias("full_name"))
    return ends.filter(F.col("full_name").isNotNull()).distinct()


def zombie_candidates(catalog: DataFrame, edges: DataFrame, t: DataFrame) -> DataFrame:
    """Catalog tables that neither lineage nor any statement mentions."""
    return never_queried(catalog, t).join(_touched(edges), "full_name", "left_anti")


def hubs(edges: DataFrame, limit: int = 15) -> DataFrame:
    """Tables that are among the busiest sources and the busiest targets."""

    def busiest(column: str, name: str) -> DataFrame:
        sums = edges.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("full_name")).agg(_n().alias(name))
        return top(sums, [F.col(name).desc(), F.col("full_name")], limit)

    return busiest(SRC, "edges_out").join(busiest(TGT, "edges_in"), "full_name")


def cross_catalog_flows(edges: DataFrame) -> DataFrame:
    source = F.substring_index(SRC, ".", 1).alias("source_catalog")
    target = F.substring_index(TGT, ".", 1).alias("target_catalog")
    flows = edges.filter(F.col(SRC).isNotNull() & F.col(TGT).isNotNull()).select(source, target, SRC, TGT)
    crossing = flows.filter(F.col("source_catalog") != F.col("target_catalog"))
    return crossing.groupBy("source_catalog", "target_catalog").agg(_n().alias("edges"))


def connectivity(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of catalog tables with at least one edge."""
    seen = _touched(edges).withColumn("_hit", F.lit(1))
    sums = catalog_names(catalog).join(seen, "full_name", "left").agg(_n().alias("tables"), F.count("_hit").alias("connected"))
    return sums.withColumn("connected_pct", ratio(F.col("connected") * 100, F.col("tables")))


def new_login_pairs(audit: DataFrame, as_of: date, recent_days: int = 7, baseline_days: int = 30, action: str = "login") -> DataFrame:
    """(user, address) pairs seen in the last days but not in the older baseline."""

    def moment(days: int) -> Column:
        return F.lit(datetime.combine(as_of - timedelta(days=days), datetime.min.time())).cast("timestamp_ntz")

    pair = ["user_identity_email", "source_ip_address"]
    logins = audit.filter((F.col("action_name") == action) & F.col("user_identity_email").isNotNull())
    recent = logins.filter(F.col("event_time") >= moment(recent_days)).groupBy(*pair).agg(
        _n().alias("cnt"), F.min("event_time").alias("first_seen")
    )
    baseline = logins.filter(F.col("event_time") < moment(baseline_days)).select(*pair).distinct()
    return recent.join(baseline, pair, "left_anti").orderBy("first_seen", *pair)


def service_error_rate(audit: DataFrame) -> DataFrame:
    sums = audit.groupBy(F.coalesce("service_name", F.lit("(none)")).alias("service")).agg(
        _n().alias("events"),
        count_if(F.col("response_status_code").between(400, 499)).alias("errors_4xx"),
        count_if(F.col("response_status_code") >= 500).alias("errors_5xx"),
    )
    return sums.withColumn("error_rate", ratio(F.col("errors_4xx") + F.col("errors_5xx"), F.col("events")))


def success_rate_daily(audit: DataFrame) -> DataFrame:
    sums = audit.groupBy("event_date").agg(_n().alias("events"), count_if(F.col("response_status_code") < 300).alias("ok"))
    return sums.withColumn("success_rate", ratio(F.col("ok"), F.col("events"))).orderBy("event_date")


def duplicate_audit_calls(audit: DataFrame) -> DataFrame:
    """Requests collapsed to one row each, with the number of events and the first one's action.

    The earliest event is found by an aggregation, so a request id shared by many rows costs one map-side row a task.
    """
    order = F.struct("event_time", "event_id")
    return audit.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(
        _n().alias("events"),
        F.min("event_time").alias("first_event"),
        F.min_by("action_name", order).alias("action_name"),
        F.min_by("event_id", order).alias("event_id"),
    )
