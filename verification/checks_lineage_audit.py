"""Lineage, catalog, audit and node pool."""

from pyspark.sql import functions as F

from lakegauge.operators import audit, catalog, governance, lineage, node_pool, reach
from verification.registry import check

S, T = "source_table_full_name", "target_table_full_name"

check("event_class", f"""SELECT record_id, CASE WHEN {S} IS NOT NULL AND {T} IS NOT NULL THEN 'read-write' WHEN {S} IS NOT NULL THEN 'read-only'
 WHEN {T} IS NOT NULL THEN 'write-only' ELSE 'path-only' END AS event_class FROM tl""")(lambda t: lineage.event_class(t.tl).select("record_id", "event_class"))


def n_if(c, name):
    return f"sum(CASE WHEN {c} THEN 1 ELSE 0 END)::BIGINT AS {name}"


check("lineage_stats", f"""SELECT * FROM (SELECT count(*) AS table_edges, count(DISTINCT coalesce({S}, {T})) AS distinct_tables, count(DISTINCT entity_id) AS distinct_entities,
 max(event_time) AS last_event, {n_if('direct_access', 'direct_edges')}, {n_if('NOT direct_access', 'indirect_edges')}, {n_if(f'{S} IS NOT NULL AND {T} IS NULL', 'read_only_events')},
 {n_if(f'{S} IS NULL AND {T} IS NOT NULL', 'write_only_events')}, {n_if(f'{S} IS NOT NULL AND {T} IS NOT NULL', 'read_write_events')} FROM tl),
 (SELECT count(*) AS column_edges, count(DISTINCT concat(coalesce({S}, {T}), ':', coalesce(source_column_name, target_column_name))) AS distinct_columns,
 count(DISTINCT coalesce({S}, {T})) AS column_distinct_tables, count(DISTINCT entity_id) AS column_distinct_entities, max(event_time) AS column_last_event FROM cl)""")(lambda t: lineage.lineage_stats(t.tl, t.cl))

KIND = """SELECT kind, label, n AS count FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) AS rn FROM (SELECT kind, label, count(*) AS n FROM ({}) GROUP BY 1, 2)) WHERE rn <= {}"""
check("lineage_breakdowns", KIND.format("""SELECT 'entity_type' AS kind, coalesce(entity_type, '(none)') AS label FROM tl UNION ALL SELECT 'source_type', source_type FROM tl WHERE source_type IS NOT NULL
 UNION ALL SELECT 'target_type', target_type FROM tl WHERE target_type IS NOT NULL""", 20))(lambda t: lineage.lineage_breakdowns(t.tl))
check("lineage_search", f"""SELECT full_name, {n_if('NOT s', 'table_edges_in')}, {n_if('s', 'table_edges_out')} FROM (SELECT {S} AS full_name, TRUE AS s FROM tl UNION ALL SELECT {T}, FALSE FROM tl)
 WHERE lower(full_name) LIKE '%silver.t1%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20""")(lambda t: lineage.lineage_search(t.tl, "SILVER.t1"))

C = "main.silver.t5"
NB = f"""(SELECT 'upstream' AS side, {S} AS full_name, source_type AS type, * FROM tl WHERE {T} = '{C}' AND {S} IS NOT NULL
 UNION ALL SELECT 'downstream', {T}, target_type, * FROM tl WHERE {S} = '{C}' AND {T} IS NOT NULL)"""
check("table_neighbours", f"""SELECT side, full_name, type, edge_count FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY edge_count DESC, full_name) AS rn FROM
 (SELECT side, full_name, max(type) AS type, count(*) AS edge_count FROM {NB} WHERE direct_access GROUP BY 1, 2)) WHERE rn <= 25""")(lambda t: lineage.table_neighbours(t.tl, C, direct_only=True))
check("neighbour_entities", f"""SELECT side, full_name, string_agg(label, ', ' ORDER BY rn) AS sample_entities FROM (SELECT *, row_number() OVER (PARTITION BY side, full_name ORDER BY c DESC, label) AS rn FROM
 (SELECT side, full_name, coalesce(entity_type, '?') || ': ' || coalesce(entity_id, '?') AS label, count(*) AS c FROM {NB} GROUP BY 1, 2, 3)) WHERE rn <= 3 GROUP BY 1, 2""")(
    lambda t: lineage.neighbour_entities(t.tl, C).withColumn("sample_entities", F.array_join("sample_entities", ", "))
)
check("column_neighbours", f"""(SELECT 'upstream' AS side, {S} AS full_name, source_column_name AS column_name, count(*) AS edge_count FROM cl WHERE {T} = '{C}' AND target_column_name = 'c2' AND {S} IS NOT NULL
 GROUP BY 1, 2, 3 ORDER BY 4 DESC, 2, 3 LIMIT 25) UNION ALL (SELECT 'downstream', {T}, target_column_name, count(*) FROM cl WHERE {S} = '{C}' AND source_column_name = 'c2' AND {T} IS NOT NULL GROUP BY 1, 2, 3 ORDER BY 4 DESC, 2, 3 LIMIT 25)""")(
    lambda t: lineage.column_neighbours(t.cl, C, "c2")
)
ENT = "coalesce(entity_type, '?') || ': ' || entity_id"
check("lineage_tops", KIND.format(f"""SELECT 'source' AS kind, {S} AS label FROM tl WHERE {S} IS NOT NULL UNION ALL SELECT 'target', {T} FROM tl WHERE {T} IS NOT NULL
 UNION ALL SELECT 'entity', {ENT} FROM tl WHERE entity_id IS NOT NULL UNION ALL SELECT 'column', concat(coalesce({T}, {S}), '::', coalesce(target_column_name, source_column_name)) FROM cl""", 15))(lambda t: lineage.lineage_tops(t.tl, t.cl))
check("terminal_tables", f"SELECT DISTINCT {T} AS full_name FROM tl WHERE {T} IS NOT NULL AND {T} NOT IN (SELECT {S} FROM tl WHERE {S} IS NOT NULL) ORDER BY 1 LIMIT 15")(lambda t: lineage.terminal_tables(t.tl))
check("orphan_tables", f"""SELECT DISTINCT concat(catalog, '.', database, '.', table_name) AS full_name FROM cc WHERE full_name NOT IN
 (SELECT {S} FROM tl WHERE {S} IS NOT NULL UNION SELECT {T} FROM tl WHERE {T} IS NOT NULL) ORDER BY 1 LIMIT 15""")(lambda t: lineage.orphan_tables(t.tl, t.cc))
check("lineage_rollups", f"""SELECT coalesce(o.f, i.f) AS full_name, coalesce(edges_in, 0) AS edges_in, coalesce(edges_out, 0) AS edges_out, coalesce(du, 0) AS distinct_upstream, coalesce(dd, 0) AS distinct_downstream,
 greatest(coalesce(eo, 0), coalesce(ei, 0)) AS distinct_entities, coalesce(d, 0) AS direct_edges, coalesce(edges_out, 0) - coalesce(d, 0) AS indirect_edges, greatest(lo, li) AS last_event
 FROM (SELECT {S} AS f, count(*) AS edges_out, count(DISTINCT {T}) AS dd, count(DISTINCT entity_id) AS eo, sum(CASE WHEN direct_access THEN 1 ELSE 0 END)::BIGINT AS d, max(event_time) AS lo FROM tl WHERE {S} IS NOT NULL GROUP BY 1) o
 FULL JOIN (SELECT {T} AS f, count(*) AS edges_in, count(DISTINCT {S}) AS du, count(DISTINCT entity_id) AS ei, max(event_time) AS li FROM tl WHERE {T} IS NOT NULL GROUP BY 1) i ON o.f = i.f""")(lambda t: lineage.lineage_rollups(t.tl))
SC, TC = f"concat({S}, '::', source_column_name)", f"concat({T}, '::', target_column_name)"
FULL = f"(SELECT DISTINCT {SC} AS s, {TC} AS t FROM cl WHERE {S} IS NOT NULL AND source_column_name IS NOT NULL AND {T} IS NOT NULL AND target_column_name IS NOT NULL)"
check("column_tops", KIND.format(f"""SELECT 'most_fanned_out' AS kind, s AS label FROM {FULL} UNION ALL SELECT 'most_depended_on', t FROM {FULL} UNION ALL SELECT 'tables_by_column_edges', {S} FROM cl WHERE {S} IS NOT NULL
 UNION ALL SELECT 'entities', {ENT} FROM cl WHERE entity_id IS NOT NULL""", 15))(lambda t: lineage.column_tops(t.cl))


def closure_sql(start, here, there, edges=None):
    # A shortest path has no more steps than there are names, so this bound cuts nothing off.
    edges = edges or f"(SELECT DISTINCT {S} AS s, {T} AS t FROM tl WHERE {S} IS NOT NULL AND {T} IS NOT NULL)"
    return f"""WITH RECURSIVE pairs AS (SELECT {here} AS a, {there} AS b FROM {edges}),
    walk(full_name, depth) AS (SELECT b, 1 FROM pairs WHERE a = '{start}' UNION SELECT p.b, w.depth + 1 FROM walk w JOIN pairs p ON p.a = w.full_name WHERE w.depth < (SELECT count(DISTINCT a) FROM pairs))
    SELECT '{start}' AS root, full_name, min(depth) AS depth FROM walk GROUP BY 2"""


def closure(t, start, direction):
    starts = t.tl.filter((F.col(S) == start) | (F.col(T) == start)).select(F.lit(start).alias("root")).distinct()
    return lineage.lineage_closure(lineage.table_pairs(t.tl), starts, direction)


check("lineage_closure", closure_sql("main.bronze.t3", "s", "t"))(lambda t: closure(t, "main.bronze.t3", "downstream"))
check("lineage_closure_upstream", closure_sql("main.gold.t7", "t", "s"))(lambda t: closure(t, "main.gold.t7", "upstream"))



@check("column_closure", f"""WITH RECURSIVE pairs AS (SELECT s AS a, t AS b FROM {FULL}),
    starts AS (SELECT DISTINCT a AS root FROM pairs),
    walk(root, full_name, depth) AS (SELECT root, b, 1 FROM pairs JOIN starts ON a = root UNION SELECT w.root, p.b, w.depth + 1 FROM walk w JOIN pairs p ON p.a = w.full_name WHERE w.depth < (SELECT count(DISTINCT a) FROM pairs))
    SELECT root, full_name, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def _(t):
    pairs = lineage.column_pairs(t.cl)
    return lineage.lineage_closure(pairs, pairs.select(F.col("source").alias("root")).distinct())


def reach_sql(edges):
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT s, t FROM {edges}), n AS (SELECT s AS full_name FROM e UNION SELECT t FROM e),
    r(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM r JOIN e ON e.s = r.b),
    p AS (SELECT full_name, least(full_name, min(x.b)) AS part FROM n LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) x ON x.a = full_name GROUP BY full_name),
    pe AS (SELECT DISTINCT x.part AS s, y.part AS t FROM e JOIN p x ON x.full_name = s JOIN p y ON y.full_name = t WHERE x.part <> y.part),
    up(part, level) AS (SELECT part, 0 FROM p UNION SELECT pe.s, level + 1 FROM up JOIN pe ON pe.t = up.part)
    SELECT full_name, (SELECT count(*) FROM p q WHERE q.part = p.part) AS part_size, (SELECT count(*) FROM r WHERE a = full_name) AS reached,
      (SELECT max(level) FROM up WHERE up.part = p.part) AS depth FROM p"""


TABLE_EDGES = f"(SELECT DISTINCT {S} AS s, {T} AS t FROM tl WHERE {S} IS NOT NULL AND {T} IS NOT NULL)"
check("lineage_reach", reach_sql(TABLE_EDGES))(lambda t: reach.reach(lineage.table_pairs(t.tl)))
check("lineage_reach_upstream", reach_sql(f"(SELECT t AS s, s AS t FROM {TABLE_EDGES})"))(lambda t: reach.reach(lineage.table_pairs(t.tl), "upstream"))
check("column_reach", reach_sql(FULL))(lambda t: reach.reach(lineage.column_pairs(t.cl)))


# Personal data: a table with a column of such a name marks its columns; what is derived from them carries the mark.
@check("pii_reach", f"""WITH RECURSIVE e AS (SELECT s, t FROM {FULL}), ends AS (SELECT s AS full_name FROM e UNION SELECT t FROM e),
    marked AS (SELECT DISTINCT concat(catalog, '.', database, '.', table_name) AS tab, regexp_extract(lower(col_name), '{governance.PII_COLUMNS}', 1) AS mark FROM cc WHERE regexp_matches(lower(col_name), '{governance.PII_COLUMNS}')),
    walk(full_name, mark, steps) AS (SELECT full_name, mark, 0 FROM ends JOIN marked ON split_part(full_name, '::', 1) = tab
      UNION SELECT t, mark, steps + 1 FROM walk JOIN e ON s = full_name WHERE steps < (SELECT count(*) FROM ends))
    SELECT full_name, mark, min(steps) AS steps FROM walk GROUP BY 1, 2""")
def _(t):
    pairs = lineage.column_pairs(t.cl)
    name = F.concat_ws(".", "catalog", "database", "table_name")
    found = governance.pii_columns(t.cc).select(name.alias("tab"), F.regexp_extract(F.lower("col_name"), governance.PII_COLUMNS, 1).alias("mark")).distinct()
    ends = pairs.select(F.col("source").alias("full_name")).union(pairs.select("target")).distinct()
    marks = ends.withColumn("tab", F.split_part("full_name", F.lit("::"), F.lit(1))).join(found, "tab").select("full_name", "mark")
    return reach.carry_marks(pairs, marks)


# Two windows of events: the closure of the first is kept up to date with what the second no longer has and has anew.
FIRST, SECOND = "day(event_time) <= 20", "day(event_time) > 8"


@check("closure_delta", f"""WITH RECURSIVE pairs AS (SELECT DISTINCT {S} AS a, {T} AS b FROM tl WHERE {S} IS NOT NULL AND {T} IS NOT NULL AND {SECOND}),
    walk(root, full_name, depth) AS (SELECT a, b, 1 FROM pairs UNION SELECT w.root, p.b, w.depth + 1 FROM walk w JOIN pairs p ON p.a = w.full_name WHERE w.depth < (SELECT count(DISTINCT a) FROM pairs))
    SELECT root, full_name, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def _(t):
    before, after = (lineage.table_pairs(t.tl.filter(window)) for window in (FIRST, SECOND))
    kept = lineage.lineage_closure(before, before.select(F.col("source").alias("root")).distinct())
    return reach.update_closure(kept, before, after.join(before, ["source", "target"], "left_anti"), before.join(after, ["source", "target"], "left_anti"))


# ---- catalog ----
check("catalog_stats", "SELECT count(DISTINCT catalog) AS catalogs, count(DISTINCT concat(catalog, '.', database)) AS databases, count(DISTINCT concat(catalog, '.', database, '.', table_name)) AS tables, count(*) AS columns, max(as_of) AS last_extract FROM cc")(
    lambda t: catalog.catalog_stats(t.cc)
)
check("catalog_list", "SELECT catalog, count(DISTINCT database) AS database_count, count(DISTINCT concat(database, '.', table_name)) AS table_count, count(*) AS column_count FROM cc GROUP BY 1")(lambda t: catalog.catalog_list(t.cc))
check("database_list", "SELECT catalog, database, count(DISTINCT table_name) AS table_count, count(*) AS column_count FROM cc WHERE catalog = 'main' GROUP BY 1, 2")(lambda t: catalog.database_list(t.cc, "main"))
check("table_list", "SELECT catalog, database, table_name, max(table_type) AS table_type, max(table_owner) AS table_owner, max(table_comment) AS table_comment, count(*) AS column_count FROM cc GROUP BY 1, 2, 3")(lambda t: catalog.table_list(t.cc))
check("table_detail", "SELECT col_name, data_type, comment, table_type, table_owner, table_comment FROM cc WHERE catalog = 'main' AND database = 'gold' AND table_name = 't8'")(lambda t: catalog.table_detail(t.cc, "main", "gold", "t8"))
check("column_export", f"SELECT {', '.join(catalog.EXPORT)} FROM cc")(lambda t: catalog.column_export(t.cc))
check("catalog_search", """SELECT catalog, database, table_name, col_name, data_type, table_comment, CASE WHEN lower(table_name) LIKE '%t2%' THEN 'table' WHEN lower(col_name) LIKE '%t2%' THEN 'column' ELSE 'comment' END AS matched_in
 FROM cc WHERE lower(table_name) LIKE '%t2%' OR lower(col_name) LIKE '%t2%' OR lower(comment) LIKE '%t2%' OR lower(table_comment) LIKE '%t2%' ORDER BY 1, 2, 3, 4, 5, 7 LIMIT 50""")(lambda t: catalog.catalog_search(t.cc, "T2"))

# ---- audit ----
ACT = "coalesce(service_name, '?') || ':' || coalesce(action_name, '?')"
check("audit_stats", f"""SELECT * FROM (SELECT count(*) AS audit_events, count(DISTINCT user_identity_email) AS distinct_users, count(DISTINCT {ACT}) AS distinct_actions, count(DISTINCT service_name) AS distinct_services,
 {n_if('response_status_code >= 400', 'error_events')}, max(event_time) AS last_event FROM au), (SELECT count(*) AS assistant_events, count(DISTINCT initiated_by) AS assistant_distinct_users, max(event_time) AS assistant_last_event FROM aa)""")(
    lambda t: audit.audit_stats(t.au, t.aa)
)


def counted(key, label, limit, table="au", where="TRUE"):
    check(key, f"SELECT {label} AS label, count(*) AS count FROM {table} WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}")(lambda t: getattr(audit, key)(getattr(t, table)))


counted("audit_by_service", "coalesce(service_name, '(none)')", 20)
counted("audit_by_level", "coalesce(audit_level, '(none)')", 5)
counted("audit_status_class", "CASE WHEN response_status_code IS NULL THEN '(none)' WHEN response_status_code < 300 THEN '2xx' WHEN response_status_code < 400 THEN '3xx' WHEN response_status_code < 500 THEN '4xx' ELSE '5xx' END", 10)
counted("audit_top_actions", ACT, 15)
counted("audit_top_users", "user_identity_email", 15, where="user_identity_email IS NOT NULL")
counted("assistant_top_users", "initiated_by", 15, "aa", "initiated_by IS NOT NULL")
SH = ", ".join(audit.SHOWN)
check("audit_recent", f"SELECT {SH} FROM au WHERE response_status_code >= 400 AND service_name = 'jobs' ORDER BY event_time DESC, event_id LIMIT 50")(lambda t: audit.audit_recent(t.au, errors_only=True, service="jobs"))
check("audit_search", f"SELECT {SH}, CASE {' '.join(f'WHEN lower({c}) LIKE $$%user1%$$ THEN $${l}$$' for c, l in audit.SEARCHED.items())} END AS matched_in FROM au WHERE matched_in IS NOT NULL ORDER BY event_time DESC, event_id LIMIT 50".replace("$$", "'"))(
    lambda t: audit.audit_search(t.au, "USER1")
)

# ---- node pool ----
check("node_stats", """SELECT * FROM (SELECT count(*) AS node_timeline_rows, count(DISTINCT cluster_id) AS distinct_clusters_in_timeline, count(DISTINCT instance_id) AS distinct_instances_in_timeline, max(start_time) AS last_node_timeline FROM nt),
 (SELECT count(*) AS warehouse_event_rows, count(DISTINCT warehouse_id) AS distinct_warehouses_in_events, max(event_time) AS last_warehouse_event FROM we),
 (SELECT count(*) AS instance_event_rows, count(DISTINCT instance_pool_id) AS distinct_pools_referenced, max(event_time) AS last_instance_event FROM ie),
 (SELECT count(*) AS node_type_rows FROM node_types), (SELECT count(*) AS instance_pool_rows FROM instance_pools)""")(lambda t: node_pool.node_stats(t.nt, t.we, t.ie, t.node_types, t.instance_pools))
check("node_breakdowns", KIND.format("SELECT 'warehouse_event_type' AS kind, coalesce(event_type, '(none)') AS label FROM we UNION ALL SELECT 'instance_event_type', coalesce(event_type, '(none)') FROM ie UNION ALL SELECT 'node_type_category', coalesce(category, '(none)') FROM node_types", 20))(
    lambda t: node_pool.node_breakdowns(t.we, t.ie, t.node_types)
)
UTIL = ("avg_cpu_user_percent", "avg_cpu_system_percent", "avg_mem_used_percent", "max_cpu_user_percent", "max_mem_used_percent")
check("cluster_utilization", """SELECT cluster_id, count(*) AS sample_count, avg(cpu_user_percent) AS avg_cpu_user_percent, avg(cpu_system_percent) AS avg_cpu_system_percent, avg(mem_used_percent) AS avg_mem_used_percent,
 max(cpu_user_percent) AS max_cpu_user_percent, max(mem_used_percent) AS max_mem_used_percent, max(start_time) AS last_sample FROM nt GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 25""", num=UTIL)(lambda t: node_pool.cluster_utilization(t.nt))
check("recent_warehouse_events", "SELECT event_time, warehouse_id, event_type, cluster_count, workspace_id FROM we ORDER BY 1 DESC NULLS LAST, 2, 3, 4, 5 LIMIT 50")(lambda t: node_pool.recent_warehouse_events(t.we))
check("recent_instance_events", "SELECT event_time, cluster_id, instance_id, instance_pool_id, event_type, node_type FROM ie ORDER BY 1 DESC NULLS LAST, 2, 3, 4 NULLS LAST, 5, 6 LIMIT 50")(lambda t: node_pool.recent_instance_events(t.ie))
check("node_type_list", "SELECT node_type, core_count, memory_mb, gpu_count, category FROM node_types")(lambda t: node_pool.node_type_list(t.node_types))
check("instance_pool_list", "SELECT instance_pool_id, instance_pool_name, node_type, min_idle_instances, max_capacity, workspace_id FROM instance_pools")(lambda t: node_pool.instance_pool_list(t.instance_pools))
