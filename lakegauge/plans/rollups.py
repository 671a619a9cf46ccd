"""Materialised rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.common import count_if
from lakegauge.operators.lineage import lineage_rollups
from lakegauge.operators.scope import scope_origin
from lakegauge.sources import files


def rebuild_lineage_rollups(tables: DataFrame, columns: DataFrame, root: str, origin: str = "real") -> DataFrame:
    """Replace one origin of the rollup table and return the headline counters."""
    t, c = scope_origin(tables, origin), scope_origin(columns, origin)
    rows = lineage_rollups(t).withColumn("rebuilt_at", F.current_timestamp().cast("timestamp_ntz"))
    files.replace_partition(rows, f"{root}/lineage_rollups", origin)
    built = files.read_table(tables.sparkSession, f"{root}/lineage_rollups").filter(F.col("data_origin") == origin)
    counters = t.agg(
        F.count(F.lit(1)).alias("table_edges"),
        count_if(F.col("direct_access")).alias("direct_edges"),
        count_if(~F.col("direct_access")).alias("indirect_edges"),
        F.countDistinct("entity_id").alias("distinct_entities"),
        F.max("event_time").alias("last_event"),
    )
    return counters.withColumns(
        {
            "data_origin": F.lit(origin),
            "rollup_rows": built.agg(F.count(F.lit(1))).scalar(),
            "column_edges": c.agg(F.count(F.lit(1))).scalar(),
        }
    )
