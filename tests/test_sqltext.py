"""Statement text rules."""

import pytest
from pyspark.sql import functions as F

from lakegauge.functions import sqltext
from lakegauge.operators import query_etl


def analyse(spark, text):
    return query_etl.text_analysis(spark.createDataFrame([(text,)], "statement_text string")).first()


CASES = [
    ("select a.b, count(*) from x.y.z a, w b where a.id = 'it''s -- no' -- c\n and b.k in (select q from u where z=1)", {("x.y.z", "read"), ("w", "read"), ("u", "read")}, {"has_select_star", "has_cross_join", "has_subquery"}),
    ("with t1 as (select 1 from db.base), t2 (x) as (select 2 from `My Cat`.sc.tt) insert into tgt.o select t1.a from t1 join t2 on t1.i = t2.i", {("db.base", "read"), ("My Cat.sc.tt", "read"), ("tgt.o", "write"), ("t1", "cte"), ("t2", "cte")}, {"has_cte"}),
    ("update cat.s.t set a = 1 where b > 2", {("cat.s.t", "write")}, {"is_dml"}),
    ("delete from t1 where x is distinct from y", {("t1", "write")}, {"is_dml"}),
    ("create or replace table c.s.n as select extract(day from ts) d, trim(both ' ' from nm) from s.src cross join s.src2", {("c.s.n", "write"), ("s.src", "read"), ("s.src2", "read")}, {"is_ddl", "has_cross_join"}),
    ("create table if not exists a.b (x int) using delta", {("a.b", "write")}, {"is_ddl"}),
    ("explain select * from t", set(), {"has_select_star"}),
    ("select * from range(10)", set(), {"has_select_star"}),
    ("select sum(x) over (partition by y) from system.billing.usage", {("system.billing.usage", "read")}, {"has_window"}),
    ("select a from t /* from hidden */ where b = \"from 'x'\"", {("t", "read")}, set()),
    ("describe table main.a.b", {("main.a.b", "read")}, {"is_describe_or_show"}),
    ("revoke select on table g.t from someone", {("g.t", "read"), ("someone", "read")}, {"is_grant_revoke"}),
]


@pytest.mark.parametrize("text, tables, flags", CASES)
def test_tables_and_flags(spark, text, tables, flags):
    row = analyse(spark, text)
    assert row.is_sql
    assert {(t.fully_qualified, t.role) for t in row._tables} == tables
    names = [n for n in row.asDict() if n.startswith(("has_", "is_")) and n != "is_sql"]
    assert {n for n in names if row[n]} == flags


def test_columns(spark):
    row = analyse(spark, "SELECT t.a, max(b) AS m FROM t JOIN u ON t.id = u.id WHERE t.c > 1 GROUP BY t.a HAVING max(b) > 2 ORDER BY m DESC")
    got = {(c.table_hint, c.column_name, c.role) for c in row._columns}
    assert got == {("t", "a", "select"), (None, "b", "select"), ("t", "id", "join"), ("u", "id", "join"), ("t", "c", "where"), ("t", "a", "groupby"), (None, "b", "having"), (None, "m", "orderby"), (None, "b", "aggregate")}


#: Statement, then the columns it must give, as "table.column role"; written by hand from the rules.
COLUMNS = [
    ("SELECT EXTRACT(YEAR FROM d) AS y, a FROM t", "d select, a select"),
    ("SELECT SUM(COALESCE(x, 0)) FROM t", "x select, x aggregate"),
    ("SELECT * FROM t WHERE id IN (SELECT x FROM u) AND y = 1", "id where, x where, y where"),
    ("SELECT a FROM t ORDER BY COALESCE(a, b), c", "a select, a orderby, b orderby, c orderby"),
    ("SELECT a, (SELECT MAX(b) FROM u) AS m, c FROM t", "a select, b select, b aggregate, c select"),
    ("SELECT t.a, u.* FROM s.t t JOIN s.u u ON t.id = u.id AND LEFT(t.k, 2) = u.k", "t.a select, u.* select, t.id join, u.id join, t.k join, u.k join"),
    ("SELECT a FROM t LEFT JOIN u ON t.i = u.i RIGHT JOIN v USING (k) WHERE z", "a select, t.i join, u.i join, z where"),
    ("WITH c AS (SELECT a, b FROM t WHERE q > 1 GROUP BY a) SELECT c.a FROM c", "q where, a groupby, c.a select"),
    ("SELECT a FROM (SELECT b FROM t WHERE e) x WHERE f", "a select, e where, f where"),
    ("SELECT SUM(x) OVER (PARTITION BY y ORDER BY z ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "x select, x aggregate, y select, z select, z orderby"),
    ("SELECT COUNT(DISTINCT a) FILTER (WHERE b > 0) FROM t", "a select, a aggregate, b select, b where"),
    ("SELECT CASE WHEN a IS NULL THEN b ELSE CAST(c AS INT) END AS d FROM t", "a select, b select, c select"),
    ("SELECT a FROM t UNION ALL SELECT b FROM u ORDER BY a", "a select, a orderby"),
    ("INSERT INTO t (a, b) SELECT c, d FROM u", "c select, d select"),
    ("UPDATE t SET a = b WHERE c = 2", "c where"),
    ("DELETE FROM t WHERE a = (SELECT MIN(b) FROM u WHERE e)", "a where, b where, b aggregate, e where"),
    ("MERGE INTO t USING u ON t.id = u.id WHEN MATCHED THEN UPDATE SET t.v = u.v", ""),
    ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.i = t.i) GROUP BY a HAVING COUNT(b) > 1 LIMIT 5", "a select, u.i where, t.i where, a groupby, b having, b aggregate"),
    ("SELECT `My Col`, t.`x y` FROM t", "My Col select, t.x y select"),
    ("SELECT a FROM t WHERE b BETWEEN DATE '2024-01-01' AND c AND d LIKE 'x%' OR NOT e", "a select, b where, c where, d where, e where"),
    ("SHOW TABLES IN main", ""),
    ("CREATE TABLE n AS SELECT a, MAX(f(b)) AS m FROM t GROUP BY a", "a select, b select, b aggregate, a groupby"),
]


@pytest.mark.parametrize("text, columns", COLUMNS)
def test_columns_of_everyday_statements(spark, text, columns):
    want = set()
    for item in filter(None, columns.split(", ")):
        name, _, role = item.rpartition(" ")
        hint, _, column = name.rpartition(".")
        want.add((hint or None, column, role))
    assert {(c.table_hint, c.column_name, c.role) for c in analyse(spark, text)._columns} == want


def test_tables_of_a_join_in_parentheses(spark):
    for text, tables in (
        ("SELECT 1 FROM (d.e.f JOIN g.h.i ON x = y)", {"d.e.f", "g.h.i"}),
        ("SELECT 1 FROM ((a JOIN b ON x) JOIN (c JOIN d ON y) ON z)", {"a", "b", "c", "d"}),
        ("SELECT 1 FROM (SELECT 2 FROM e) s JOIN (WITH q AS (SELECT 1 FROM r) SELECT * FROM q) ON k", {"e", "r", "q"}),
    ):
        assert {t.fully_qualified for t in analyse(spark, text)._tables} == tables


def test_quotes_and_numbers_do_not_split_statements(spark):
    texts = ["SELECT a FROM t WHERE x = 'its'", "SELECT a FROM t WHERE x = 'it''s'", "SELECT a FROM t WHERE x = " + "'" * 4, "SELECT a FROM t WHERE x = 1e5", "SELECT a FROM t WHERE x = 2.5E-3", 'SELECT a FROM t WHERE x = "a""b"']
    assert len({analyse(spark, t).normalized_sql_hash for t in texts}) == 1


def test_same_statement_different_literals(spark):
    texts = ["SELECT a FROM t1 WHERE x = 1", "select  a\nfrom t1 -- hi\nwhere x = 22.5", "SELECT a FROM t1 WHERE x = 'z'", "SELECT a FROM t2 WHERE x = 1"]
    hashes = [analyse(spark, t).normalized_sql_hash for t in texts]
    assert hashes[0] == hashes[1] == hashes[2] != hashes[3]
    assert analyse(spark, "df = spark.read.table('x')").normalized_sql_hash is None


def test_free_text_names(spark):
    row = analyse(spark, "df = spark.read.table(`a-b`.`s`.t); x = `a-b`.s.`t`; `no`.`two`")
    assert [(t.fully_qualified, t.role) for t in row._tables] == [("a-b.s.t", "reference")]


def test_very_long_statements(spark):
    """Long literals, comments and lists must not exhaust the regex engine's stack."""
    literal = "SELECT a FROM t WHERE x = '" + "it\\'s " * 50_000 + "'"
    comment = "SELECT a /* " + "* x " * 50_000 + "*/ FROM t"
    wide = "SELECT " + ", ".join(f"c{i}" for i in range(20_000)) + " FROM t"
    many = "-- note\n" * 20_000 + "SELECT a FROM t"
    for text in (literal, comment, wide, many):
        row = analyse(spark, text)
        assert row.is_sql and [t.fully_qualified for t in row._tables] == ["t"]
    assert len(analyse(spark, wide)._columns) == 20_000


def test_patterns_are_shared_with_the_oracle():
    assert "*+" in sqltext.LEXEMES and ")*+" not in __import__("verification.qi_sql", fromlist=["q"]).q(sqltext.LEXEMES)


def test_nested_parameters(spark):
    df = spark.sql(
        """SELECT '1' AS statement_id, named_struct('named_parameters', map(
            'a', named_struct('exprs', array(named_struct('literal', named_struct('string_value', CAST(NULL AS STRING), 'int_value', 5, 'boolean_value', true), 'data_type', named_struct('type_name', 'INT')))),
            'b', named_struct('exprs', array(named_struct('literal', named_struct('string_value', CAST(NULL AS STRING), 'int_value', CAST(NULL AS INT), 'boolean_value', true), 'data_type', named_struct('type_name', 'BOOLEAN')))),
            'c', CAST(NULL AS STRUCT<exprs: ARRAY<STRUCT<literal: STRUCT<string_value: STRING, int_value: INT, boolean_value: BOOLEAN>, data_type: STRUCT<type_name: STRING>>>>)
        )) AS query_parameters"""
    )
    rows = {r.param_name: (r.param_value, r.param_type) for r in query_etl.qi_parameters(query_etl.analyse(df)).collect()}
    assert rows == {"a": ("5", "INT"), "b": ("True", "BOOLEAN"), "c": (None, None)}


def test_tolerant_values(spark):
    df = spark.createDataFrame([("  7 ", "12", float("nan"), " "), (None, "x", 3.9, "a")], "statement_id string, total_duration_ms string, read_bytes double, executed_by string")
    rows = query_etl.qi_flatten(df).select("statement_id", "total_duration_ms", "read_bytes", "executed_by", "job_id").collect()
    assert [tuple(r) for r in rows] == [("7", 12, None, None, None), (None, None, 3, "a", None)]


def test_missing_columns_are_null(spark):
    df = query_etl.analyse(spark.createDataFrame([("1",)], "statement_id string"))
    row = df.first()
    assert row.source_category == "AD_HOC" and row.principal_kind == "unknown" and row.is_sql is False and row.statement_text_length == 0
    assert df.select(F.size("_tables")).first()[0] == 0
