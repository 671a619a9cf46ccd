"""Query-history ETL rules, one query per rule."""

from pyspark.sql import functions as F

import verification.qi_sql  # noqa: F401  (registers the qi_* views of the oracle)
from lakegauge.operators import query_etl as etl
from verification.registry import check


def analysed(t):
    return t.analysed


def statement_rule(key, columns, num=()):
    names = ["statement_id", *columns]

    @check(key, f"SELECT {', '.join(names)} FROM qi_statements", num=num)
    def _(t):
        return etl.qi_statements(analysed(t)).select(*names)


statement_rule(
    "qi_flatten",
    "workspace_id executed_by compute_type warehouse_id job_id pipeline_id notebook_id dashboard_id genie_space_id "
    "session_id total_duration_ms read_bytes from_result_cache start_time end_time".split(),
)
statement_rule("qi_looks_like_sql", ["is_sql"])
statement_rule("qi_error_category", ["error_category", "error_code", "sqlstate"])
statement_rule("qi_driver", ["client_driver", "client_driver_family", "client_driver_version"])
statement_rule("qi_principal_kind", ["principal_kind"])
statement_rule("qi_source_category", ["source_category"])
RATIOS = ["pruning_ratio", "selectivity_ratio", "waiting_pct", "compile_pct"]
statement_rule("qi_metrics", [*RATIOS, "is_full_scan", "is_cache_hit"], num=RATIOS)
statement_rule("qi_time_features", ["start_date", "start_hour", "start_day_of_week", "is_off_hours", "is_weekend"])
statement_rule("qi_delegated", ["is_delegated"])
statement_rule("qi_text_features", ["statement_text_length", "statement_text_sha1", "statement_text_excerpt"])
statement_rule("qi_sql_flags", list(verification.qi_sql.FLAGS))
statement_rule("qi_normalised_hash", ["normalized_sql_hash"])


@check("qi_error_object", "SELECT statement_id, referenced_object, referenced_user FROM qi_statement_errors")
def _(t):
    return etl.qi_errors(analysed(t)).select("statement_id", "referenced_object", "referenced_user")


for _key, _view in {
    "qi_parameters": "qi_statement_parameters",
    "qi_tags": "qi_statement_tags",
    "qi_columns": "qi_statement_columns",
    "qi_errors": "qi_statement_errors",
}.items():
    check(_key, f"SELECT * FROM {_view}")(lambda t, k=_key: getattr(etl, k)(analysed(t)))


@check("qi_tables", "SELECT * FROM qi_statement_tables WHERE role <> 'reference'")
def _(t):
    return etl.qi_tables(analysed(t)).filter("role <> 'reference'")


@check("qi_freetext_tables", "SELECT * FROM qi_statement_tables WHERE role = 'reference'")
def _(t):
    return etl.qi_tables(analysed(t)).filter("role = 'reference'")


@check(
    "qi_project_keywords",
    "SELECT statement_id, coalesce(array_to_string(project_keywords, ','), '') AS project_keywords FROM qi_statements LEFT JOIN qi_keywords USING (statement_id)",
)
def _(t):
    return t.qs.select("statement_id", F.array_join("project_keywords", ",").alias("project_keywords"))


def sorted_text(column, cut=""):
    return f"coalesce(array_to_string(list_sort(list_distinct(list({column}) FILTER ({column} IS NOT NULL))){cut}, ','), '') AS"


@check(
    "qi_touched_arrays",
    f"""SELECT statement_id, {sorted_text('catalog')} catalogs_touched, {sorted_text('schema')} schemas_touched, {sorted_text('fully_qualified')} tables_touched
    FROM qi_statements LEFT JOIN qi_statement_tables USING (statement_id) GROUP BY 1""",
)
def _(t):
    names = ["catalogs_touched", "schemas_touched", "tables_touched"]
    return t.qs.select("statement_id", *[F.array_join(n, ",").alias(n) for n in names])


@check("qi_expensive", "SELECT * FROM qi_expensive")
def _(t):
    return etl.qi_expensive(etl.qi_statements(analysed(t))).select("statement_id", "is_expensive")
