"""Whole builds: write, read back, compare."""

from pyspark.sql import functions as F

import verification.qi_sql  # noqa: F401
from lakegauge.operators.scope import scope_origin
from lakegauge.plans import qi_build, rollups
from verification.checks_sources import scratch
from verification.registry import check

NAMES = ["qi_statements", *qi_build.CHILDREN]


@check("qi_build", " UNION ALL ".join(f"SELECT '{n}' AS table_name, 'real' AS data_origin, count(*) AS n, count(DISTINCT statement_id) AS statements FROM {n}" for n in NAMES)
       + " UNION ALL SELECT 'expensive', 'real', count(*), count(*) FROM qi_expensive WHERE is_expensive")
def _(t):
    root = scratch(t)
    qi_build.qi_build(t.spark, scope_origin(t.nested_history, "real"), root)
    out = None
    for name in NAMES:
        table = qi_build.read_qi(t.spark, root, name)
        one = table.groupBy("data_origin").agg(F.count("*").alias("n"), F.countDistinct("statement_id").alias("statements"))
        one = one.select(F.lit(name).alias("table_name"), "data_origin", "n", "statements")
        out = one if out is None else out.unionByName(one)
    flagged = qi_build.read_qi(t.spark, root, "qi_statements").filter("is_expensive")
    return out.unionByName(flagged.groupBy("data_origin").agg(F.count("*").alias("n"), F.countDistinct("statement_id").alias("statements")).select(F.lit("expensive").alias("table_name"), "data_origin", "n", "statements"))


@check("rebuild_lineage_rollups", """SELECT 'real' AS data_origin, (SELECT count(*) FROM (SELECT source_table_full_name AS f FROM tl UNION SELECT target_table_full_name FROM tl) WHERE f IS NOT NULL) AS rollup_rows, count(*) AS table_edges,
 (SELECT count(*) FROM cl) AS column_edges, sum(CASE WHEN direct_access THEN 1 ELSE 0 END)::BIGINT AS direct_edges, sum(CASE WHEN NOT direct_access THEN 1 ELSE 0 END)::BIGINT AS indirect_edges,
 count(DISTINCT entity_id) AS distinct_entities, max(event_time) AS last_event FROM tl""")
def _(t):
    return rollups.rebuild_lineage_rollups(t.table_lineage, t.column_lineage, scratch(t))
