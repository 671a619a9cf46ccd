"""DuckDB twins of the query-history ETL, over the flat ``query_history`` view, real origin only."""

from lakegauge.functions import errors as E
from lakegauge.functions import sqltext as S
from lakegauge.operators import query_etl as Q
from verification import fixtures


def q(pattern: str) -> str:
    """A regular expression as a SQL literal; RE2 needs no possessive groups."""
    return "'" + pattern.replace(")*+", ")*").replace("]*+", "]*").replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def tidy(column: str) -> str:
    return f"nullif(trim({column}, e' \\t\\n\\r'), '')"


def has(text: str, needles) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, n.replace("'", "''")) for n in needles) + ")"


_TEXT = "coalesce(statement_text, '')"
_TELL = has(f"substr(trim({_TEXT}, e' \\t\\n\\r'), 1, 200)", S.PYTHON_TELLS)
_KW = f"trim(upper(regexp_extract({_TEXT}, {q(S.FIRST_TOKEN)}, 1)), ';')"


def _cat() -> str:
    code = f"nullif(regexp_extract(error_message, {q(E.ERROR_CODE)}, 1), '')"
    arms = ["WHEN error_message IS NULL THEN NULL"]
    arms += [f"WHEN {code} IN {words(c)} THEN '{k}'" for k, c in E.ERROR_CATEGORIES.items()]
    arms += [f"WHEN {has('upper(error_message)', c)} THEN '{k}'" for k, c in E.ERROR_CATEGORIES.items()]
    return "CASE " + " ".join(arms) + " ELSE 'OTHER' END"


def _family() -> str:
    name = "replace(lower(split_part(client_driver, ',', 1)), ' ', '')"
    arms = [f"WHEN {has(name, n)} THEN '{f}'" for f, n in E.DRIVER_FAMILIES]
    return f"CASE WHEN client_driver IS NULL OR {name} = '' THEN NULL " + " ".join(arms) + " ELSE 'Other' END"


def _share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 10000 + 0.5) / 10000.0 END"


_TOTAL = "coalesce(total_duration_ms, 0)"
_WAIT = "(coalesce(waiting_for_compute_duration_ms, 0) + coalesce(waiting_at_capacity_duration_ms, 0))"
_COUNT = "len(regexp_extract_all({}, {}))"


def _n(pattern: str) -> str:
    return _COUNT.format("clean", q(pattern))


_PLAIN = "kw NOT IN ('MERGE', 'GRANT', 'REVOKE')"
FLAGS = {
    "has_select_star": f"regexp_matches(clean, {q(r'(?i)(?:\b(?:SELECT|DISTINCT|ALL)|[,(.]) ?\*')})",
    "has_cross_join": f"regexp_matches(clean, {q(r'(?i)\bCROSS JOIN\b')}) OR regexp_matches(clean, {q(rf'(?i)\bFROM {S.NAME}(?: (?:AS )?{S.ID})? ?, ?{S.ID}')}) OR ({_PLAIN} AND {_n(r'(?i)\bJOIN\b')} > {_n(r'(?i)\b(?:ON|USING)\b')})",
    "has_cte": f"regexp_matches(clean, {q(rf'(?i)\bWITH (?:RECURSIVE )?{S.ID} ?(?:\([^()]*\) ?)?AS ?\(')})",
    "has_subquery": f"{_n(r'(?i)\( ?SELECT\b')} > {_n(r'(?i)\b(?:AS|EXISTS) ?\( ?SELECT\b')}",
    "has_window": f"regexp_matches(clean, {q(r'(?i)\bOVER (?:\(|[A-Z_])|\bOVER\(')})",
    "is_describe_or_show": "kw IN ('DESCRIBE', 'DESC', 'SHOW')",
    "is_dml": "kw IN ('INSERT', 'UPDATE', 'DELETE', 'MERGE')",
    "is_ddl": "kw IN ('CREATE', 'DROP', 'ALTER')",
    "is_grant_revoke": "kw IN ('GRANT', 'REVOKE')",
}

_LEX = q(S.LEXEMES)
_REDUCED = rf"""translate(trim(regexp_replace(regexp_replace(regexp_replace({_TEXT}, {_LEX}, ' \1\2\3 ', 'g'), '\s+', ' ', 'g'), ' ?\. ?', '.', 'g')), '''"', '??')"""

QI_BASE = f"""SELECT *, CASE WHEN is_sql THEN {_REDUCED} ELSE '' END AS clean FROM (
  SELECT * EXCLUDE (statement_text, error_message), {tidy('statement_text')} AS statement_text, {tidy('error_message')} AS error_message,
   {_KW} AS kw, NOT {_TELL} AND {_KW} IN {words(S.SQL_KEYWORDS)} AS is_sql
  FROM query_history WHERE data_origin = 'real')"""

QI_STATEMENTS = f"""SELECT statement_id, workspace_id, executed_by, executed_by_user_id, executed_as, session_id, statement_type, execution_status,
 client_application, client_driver, compute_type, warehouse_id, job_id, pipeline_id, notebook_id, dashboard_id, genie_space_id,
 total_duration_ms, waiting_at_capacity_duration_ms, waiting_for_compute_duration_ms, compilation_duration_ms, read_files, pruned_files, read_rows,
 produced_rows, read_bytes, spilled_local_bytes, CAST(NULL AS BIGINT) AS shuffle_read_bytes, from_result_cache, start_time, end_time, data_origin,
 is_sql, {', '.join(f'(is_sql AND ({v})) AS {k}' for k, v in FLAGS.items())},
 CASE WHEN is_sql THEN sha1(lower(regexp_replace(clean, {q(r'\b\d+(?:\.\d+)?\b')}, '?', 'g'))) END AS normalized_sql_hash,
 {_share('pruned_files', '(read_files + pruned_files)')} AS pruning_ratio,
 CASE WHEN read_rows <> 0 THEN floor(CAST(produced_rows AS DOUBLE) / CAST(read_rows AS DOUBLE) * 10000 + 0.5) / 10000.0 END AS selectivity_ratio,
 {_share(_WAIT, _TOTAL)} AS waiting_pct, {_share('coalesce(compilation_duration_ms, 0)', _TOTAL)} AS compile_pct,
 coalesce(read_bytes > {Q.FULL_SCAN_BYTES} AND produced_rows < {Q.FULL_SCAN_ROWS}, FALSE) AS is_full_scan, from_result_cache AS is_cache_hit,
 CAST(start_time AS DATE) AS start_date, CAST(hour(start_time) AS INT) AS start_hour, CAST(isodow(start_time) - 1 AS INT) AS start_day_of_week,
 hour(start_time) < 7 OR hour(start_time) >= 19 AS is_off_hours, isodow(start_time) >= 6 AS is_weekend,
 coalesce(executed_by <> executed_as, FALSE) AS is_delegated,
 CASE WHEN contains(executed_by, '@') THEN 'human' WHEN regexp_matches(executed_by_user_id, '^[0-9]+$') THEN 'service' ELSE 'unknown' END AS principal_kind,
 {_family()} AS client_driver_family, nullif(trim(split_part(client_driver, ',', 2)), '') AS client_driver_version,
 CASE WHEN job_id IS NOT NULL THEN 'JOB' WHEN pipeline_id IS NOT NULL THEN 'PIPELINE' WHEN notebook_id IS NOT NULL THEN 'NOTEBOOK'
  WHEN dashboard_id IS NOT NULL THEN 'DASHBOARD' WHEN genie_space_id IS NOT NULL THEN 'GENIE' ELSE 'AD_HOC' END AS source_category,
 param_region IS NOT NULL AS is_parameterized,
 {_cat()} AS error_category, nullif(regexp_extract(error_message, {q(E.ERROR_CODE)}, 1), '') AS error_code,
 nullif(regexp_extract(error_message, {q(E.SQLSTATE)}, 1), '') AS sqlstate,
 CAST(coalesce(length(statement_text), 0) AS INT) AS statement_text_length, sha1(statement_text) AS statement_text_sha1, left(statement_text, 2000) AS statement_text_excerpt
 FROM qi_base"""

_PRE = (
    f"regexp_replace(regexp_replace(regexp_replace(clean, {q(r'(?i)\bDISTINCT FROM\b')}, 'DISTINCT_FROM', 'g'), {q(r'(?i)\bLATERAL VIEW\b')}, 'LATERAL_VIEW', 'g'), "
    rf"{q(r'(?i)\b(EXTRACT|TRIM|SUBSTRING|OVERLAY) ?\(([^()]*) FROM ')}, '\1(\2, ', 'g')"
)
_PARTS = f"list_transform(regexp_extract_all({{}}, {q(S.ID)}, 0), lambda p: replace(p, '`', ''))"

QI_TABLES = f"""WITH refs AS (SELECT statement_id, kw, clean, generate_subscripts(m, 1) AS ri, unnest(m) AS ref FROM (
   SELECT statement_id, kw, clean, list_filter(regexp_extract_all({_PRE}, {q(S.TABLE_REF)}, 0), lambda x:
     NOT (ends_with(x, '(') AND upper(split_part(x, ' ', 1)) IN ('FROM', 'JOIN', 'USING')) AND (upper(split_part(x, ' ', 1)) <> 'USING' OR kw = 'MERGE')) AS m
   FROM qi_base WHERE is_sql AND kw NOT IN {words(S.COMMANDS)})),
 items AS (SELECT statement_id, kw, clean, ri, upper(split_part(ref, ' ', 1)) AS rkw, generate_subscripts(l, 1) AS ii, unnest(l) AS item FROM
   (SELECT *, regexp_split_to_array(regexp_replace(ref, {q(S.TABLE_LEAD)}, ''), ' ?, ?') AS l FROM refs)),
 names AS (SELECT statement_id, kw, clean, rkw, regexp_extract(item, {q(S.NAME)}, 0) AS name, ri, ii FROM items),
 kept AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY ri, ii) AS pos, {_PARTS.format('name')} AS parts FROM names
   WHERE name <> '' AND upper(name) NOT IN {words(S.NOT_TABLES)}),
 told AS (SELECT *, list_contains(list_transform(regexp_extract_all(clean, {q(S.CTE_NAME)}, 1), lambda c: lower(replace(c, '`', ''))), lower(parts[-1])) AS temp FROM kept)
 SELECT DISTINCT statement_id, 'real' AS data_origin, CASE WHEN NOT temp AND len(parts) >= 3 THEN parts[-3] END AS catalog, CASE WHEN NOT temp AND len(parts) >= 2 THEN parts[-2] END AS schema,
  parts[-1] AS table_name, CASE WHEN temp THEN parts[-1] ELSE array_to_string(parts, '.') END AS fully_qualified,
  CASE WHEN temp THEN 'cte' WHEN (pos = 1 AND kw IN {words(S.WRITES)}) OR (kw = 'WITH' AND rkw IN ('INTO', 'OVERWRITE')) THEN 'write' ELSE 'read' END AS role,
  coalesce(NOT temp AND len(parts) >= 3 AND parts[-3] = 'system', FALSE) AS is_system_table, temp AS is_temp FROM told
 UNION ALL
 SELECT DISTINCT statement_id, 'real', regexp_extract(m, {q(S.FREETEXT_NAME)}, 1), regexp_extract(m, {q(S.FREETEXT_NAME)}, 2), regexp_extract(m, {q(S.FREETEXT_NAME)}, 3),
  concat_ws('.', regexp_extract(m, {q(S.FREETEXT_NAME)}, 1), regexp_extract(m, {q(S.FREETEXT_NAME)}, 2), regexp_extract(m, {q(S.FREETEXT_NAME)}, 3)), 'reference',
  regexp_extract(m, {q(S.FREETEXT_NAME)}, 1) = 'system', FALSE
 FROM (SELECT statement_id, unnest(regexp_extract_all(statement_text, {q(S.FREETEXT_NAME)}, 0)) AS m FROM qi_base WHERE NOT is_sql)"""

# Columns, written for the flat statements of the fixtures only: the clauses as plain patterns, no nesting.
_ID = r"(?:`[^`]+`|\b[A-Za-z_][A-Za-z0-9_$]*)"
_REF = rf"(?:{_ID}\.){{0,3}}{_ID}(?: ?\()?"
_END = r"\b(?:SELECT|FROM|WHERE|GROUP BY|HAVING|ORDER BY|LIMIT|WHEN MATCHED|WHEN NOT|(?:(?:LEFT|RIGHT|FULL|INNER|CROSS) )*JOIN)\b|;|$"
_CLAUSES = {
    "where": rf"(?i)\bWHERE (.*?)(?:{_END})", "groupby": rf"(?i)\bGROUP BY (.*?)(?:{_END})", "having": rf"(?i)\bHAVING (.*?)(?:{_END})",
    "orderby": rf"(?i)\bORDER BY (.*?)(?:\)|{_END})",
}
_NO_COLUMNS = (
    "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "BETWEEN", "AS", "ASC", "DESC", "DISTINCT", "OVER", "PARTITION", "BY", "ORDER", "SELECT", "FROM",
    "WHERE", "GROUP", "USING", "ON", "SET", "VALUES",
)
_SEGMENTS = " UNION ALL ".join(
    [f"SELECT statement_id, '{role}' AS role, unnest(regexp_extract_all(clean, {q(p)}, 1)) AS seg FROM b" for role, p in _CLAUSES.items()]
    + [
        f"SELECT statement_id, 'join', unnest(regexp_extract_all(clean, {q(rf'(?i)\bON (.*?)(?:{_END})')}, 1)) FROM b WHERE regexp_matches(clean, {q(r'(?i)\bJOIN\b')}) AND {_PLAIN}",
        f"SELECT statement_id, 'select', CASE WHEN kw = 'WITH' THEN regexp_extract(clean, {q(r'(?i)\) ?SELECT (.*?)(?: FROM\b|;|$)')}, 1) ELSE regexp_extract(clean, {q(r'(?i)\bSELECT (.*?)(?: FROM\b|;|$)')}, 1) END FROM b",
        f"SELECT statement_id, 'aggregate', unnest(regexp_extract_all(clean, {q(r'(?i)\b(?:COUNT|SUM|AVG|MIN|MAX) ?\(([^()]*)\)')}, 1)) FROM b",
    ]
)
QI_COLUMNS = f"""WITH b AS (SELECT * FROM qi_base WHERE is_sql AND kw NOT IN {words((*S.COMMANDS, 'GRANT', 'REVOKE'))}), segs AS ({_SEGMENTS}),
 r AS (SELECT statement_id, role, unnest(regexp_extract_all(regexp_replace(seg, {q(rf'(?i)\bAS {_ID}')}, '', 'g'), {q(_REF)}, 0)) AS ref FROM segs),
 p AS (SELECT statement_id, role, {_PARTS.format('ref')} AS parts FROM r WHERE NOT ends_with(ref, '(') AND upper(ref) NOT IN {words(_NO_COLUMNS)})
 SELECT DISTINCT statement_id, 'real' AS data_origin, parts[-1] AS column_name, CASE WHEN len(parts) >= 2 THEN parts[-2] END AS table_hint, role FROM p"""

_OBJ = [f"nullif(regexp_extract(error_message, {q(E.ERROR_OBJECT)}, {g}), '')" for g in (1, 2, 3)]
QI_ERRORS = f"""SELECT s.statement_id, s.data_origin, s.error_category, s.error_code, s.sqlstate, left(error_message, 2000) AS error_message_excerpt,
 nullif(concat_ws('.', {', '.join(_OBJ)}), '') AS referenced_object, nullif(regexp_extract(error_message, {q(E.ERROR_USER)}, 1), '') AS referenced_user
 FROM qi_statements s JOIN qi_base b ON s.statement_id = b.statement_id WHERE s.execution_status = 'FAILED' OR error_message IS NOT NULL"""

QI_TAGS = """SELECT statement_id, data_origin, 'team' AS tag_key, tag_team AS tag_value FROM qi_base WHERE tag_team IS NOT NULL
 UNION ALL SELECT statement_id, data_origin, 'env', tag_env FROM qi_base WHERE tag_env IS NOT NULL"""
QI_PARAMETERS = """SELECT statement_id, data_origin, 'p_region' AS param_name, param_region AS param_value, 'STRING' AS param_type
 FROM qi_base WHERE param_region IS NOT NULL"""

_STOP = lst(Q.KEYWORD_STOPLIST)
QI_KEYWORDS = f"""SELECT statement_id, list_sort(list_distinct(list(w))) AS project_keywords FROM (
  SELECT statement_id, unnest(regexp_split_to_array(lower(n), '[_\\-.\\s]+')) AS w, TRUE AS long FROM (SELECT statement_id, catalog AS n FROM qi_statement_tables UNION ALL SELECT statement_id, schema FROM qi_statement_tables) WHERE n IS NOT NULL
  UNION ALL SELECT statement_id, lower(tag_value), FALSE FROM qi_statement_tags UNION ALL SELECT statement_id, lower(param_name), TRUE FROM qi_statement_parameters)
 WHERE (length(w) > 2 OR NOT long) AND w <> '' AND NOT list_contains({_STOP}, w) GROUP BY 1"""

QI_EXPENSIVE = """SELECT d.statement_id, t > 0 AND d.d >= t AS is_expensive FROM (SELECT statement_id, coalesce(total_duration_ms, 0) AS d FROM qi_statements) d,
 (SELECT d AS t FROM (SELECT coalesce(total_duration_ms, 0) AS d, row_number() OVER (ORDER BY coalesce(total_duration_ms, 0)) AS rn, count(*) OVER () AS n FROM qi_statements)
  WHERE rn = greatest(1, CAST(floor(n * 0.99) AS BIGINT)))"""

fixtures.CTES.update(
    {
        "qi_base": QI_BASE,
        "qi_statements": QI_STATEMENTS,
        "qi_statement_tables": QI_TABLES,
        "qi_statement_columns": QI_COLUMNS,
        "qi_statement_errors": QI_ERRORS,
        "qi_statement_tags": QI_TAGS,
        "qi_statement_parameters": QI_PARAMETERS,
        "qi_keywords": QI_KEYWORDS,
        "qi_expensive": QI_EXPENSIVE,
    }
)
