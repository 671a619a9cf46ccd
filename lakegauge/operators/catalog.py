"""Catalog inventory: one row per column of every table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.common import contains_text, top


def _n() -> Column:
    return F.count(F.lit(1))


def catalog_stats(columns: DataFrame) -> DataFrame:
    return columns.agg(
        F.countDistinct("catalog").alias("catalogs"),
        F.countDistinct(F.struct("catalog", "database")).alias("databases"),
        F.countDistinct(F.struct("catalog", "database", "table_name")).alias("tables"),
        _n().alias("columns"),
        F.max("as_of").alias("last_extract"),
    )


def catalog_list(columns: DataFrame) -> DataFrame:
    return (
        columns.groupBy("catalog")
        .agg(
            F.countDistinct("database").alias("database_count"),
            F.countDistinct(F.struct("database", "table_name")).alias("table_count"),
            _n().alias("column_count"),
        )
        .orderBy("catalog")
    )


def database_list(columns: DataFrame, catalog: str | None = None) -> DataFrame:
    if catalog:
        columns = columns.filter(F.col("catalog") == catalog)
    return (
        columns.groupBy("catalog", "database")
        .agg(F.countDistinct("table_name").alias("table_count"), _n().alias("column_count"))
        .orderBy("catalog", "database")
    )


def table_list(columns: DataFrame, catalog: str | None = None, database: str | None = None) -> DataFrame:
    """One row per table with its attributes; without filters this is the export of all tables."""
    if catalog:
        columns = columns.filter(F.col("catalog") == catalog)
    if database:
        columns = columns.filter(F.col("database") == database)
    return (
        columns.groupBy("catalog", "database", "table_name")
        .agg(
            F.max("table_type").alias("table_type"),
            F.max("table_owner").alias("table_owner"),
            F.max("table_comment").alias("table_comment"),
            _n().alias("column_count"),
        )
        .orderBy("catalog", "database", "table_name")
    )


def table_detail(columns: DataFrame, catalog: str, database: str, table_name: str) -> DataFrame:
    found = columns.filter(
        (F.col("catalog") == catalog) & (F.col("database") == database) & (F.col("table_name") == table_name)
    )
    return found.select("col_name", "data_type", "comment", "table_type", "table_owner", "table_comment")


EXPORT = ["catalog", "database", "table_name", "table_type", "table_owner", "table_comment", "col_name", "data_type",
          "comment"]


def column_export(columns: DataFrame) -> DataFrame:
    return columns.select(*EXPORT).orderBy("catalog", "database", "table_name", "col_name")


def catalog_search(columns: DataFrame, text: str, limit: int | None = 50) -> DataFrame:
    """Rows with the text in a name or comment; ``matched_in`` prefers table over column over comment."""
    hit = F.lit(False)
    for column in ("table_name", "col_name", "comment", "table_comment"):
        hit = hit | F.coalesce(contains_text(column, text), F.lit(False))
    matched = (
        F.when(contains_text("table_name", text), "table").when(contains_text("col_name", text), "column").otherwise("comment")
    )
    found = columns.filter(hit).select(
        "catalog", "database", "table_name", "col_name", "data_type", "table_comment", matched.alias("matched_in")
    )
    order = [F.col(c).asc_nulls_last() for c in ("catalog", "database", "table_name", "col_name", "data_type", "matched_in")]
    return top(found, order, limit)
