"""Rules over statement text: what a statement is, which tables and columns it names, and its normal form.

There is no SQL parser here. Text is first reduced (string literals to ``?``, comments dropped, white space collapsed),
then read with regular expressions; columns by one fold over its tokens. All patterns scan in linear time without recursion, so long
statements are safe: repeated groups are possessive. Known limits, all on unusual text: names that hold quote characters inside
backticks, aliases written without AS (read as columns), joins without a condition inside statements that also use ON elsewhere, an
outer select that is itself in parentheses (its list has no ``select`` role). ``is_sql`` means that the first word is a statement's: text
that no SQL engine could parse counts as SQL, too, so the feature mix of statements includes it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakegauge.functions.common import let

#: Characters trimmed from the ends of text values.
WHITE = " \t\n\r\x0b\x0c"

# Text that marks a notebook cell as Python or Scala when it occurs in the first 200 characters.
PYTHON_TELLS = (
    "dbutils.", "spark.sql(", "spark.read", "df.write", "df.show", "df.collect", " = set([", " = [",
    "import ", "def ", "lambda ", "F.col(", "self._", "print(", "if __name__",
)

# First keywords of a SQL statement.
SQL_KEYWORDS = (
    "SELECT", "INSERT", "MERGE", "CREATE", "DROP", "ALTER", "GRANT", "REVOKE", "USE", "SHOW", "DESCRIBE", "EXPLAIN",
    "REFRESH", "SET", "OPTIMIZE", "ANALYZE", "VACUUM", "COPY", "REPLACE", "WITH", "CALL", "DELETE", "UPDATE",
    "TRUNCATE", "COMMENT",
)

# Fixed value: three-part names in free text, the first part in backticks.
FREETEXT_NAME = r"`([A-Za-z0-9_\-]+)`\s*\.\s*`?([A-Za-z0-9_]+)`?\s*\.\s*`?([A-Za-z0-9_]+)`?"

WRITES = ("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP")
#: Statements whose operands are not read as tables.
COMMANDS = ("SHOW", "USE", "SET", "CALL", "EXPLAIN", "OPTIMIZE", "VACUUM", "ANALYZE")

FIRST_TOKEN = r"^(?:\s*--[^\r\n]*[\r\n]+)*+\s*(\S+)"
LEXEMES = (
    r"(')[^'\\]*(?:(?:\\[\s\S]|'')[^'\\]*)*+'"
    r'|(")[^"\\]*(?:(?:\\[\s\S]|"")[^"\\]*)*+"'
    r"|(`[^`]*`)"
    r"|--[^\n]*"
    r"|/\*[^*]*\*+(?:[^/*][^*]*\*+)*+/"
)

ID = r"(?:`[^`]+`|\b[A-Za-z_][A-Za-z0-9_$]*)"
NAME = rf"{ID}(?:\.{ID}){{0,2}}"
_LEAD = r"(?:(?:TABLE|VIEW|EXTENDED|FORMATTED|ONLY) )*(?:IF (?:NOT )?EXISTS )?"
TABLE_REF = (
    rf"(?i)(?:^DESC(?:RIBE)?|\b(?:FROM|JOIN|INTO|OVERWRITE|UPDATE|TABLE|VIEW|USING)) {_LEAD}"
    rf"{NAME}(?:(?: (?:AS )?{ID})? ?, ?{NAME})*(?: ?\()?"
)
TABLE_LEAD = rf"(?i)^\S+ {_LEAD}"
CTE_NAME = rf"(?i)(?:\bWITH(?: RECURSIVE)?|,) ?({ID}) ?(?:\([^()]*\) ?)?AS ?\("
NOT_TABLES = (
    "SET", "SELECT", "VALUES", "LATERAL", "WHERE", "UNNEST", "TABLE", "ON", "AS", "JOIN", "WITH", "FROM", "INTO",
    "USING", "BY", "LEFT", "RIGHT", "FULL", "INNER", "CROSS",
)

#: Words that begin a clause whose columns count, with the role they get.
CLAUSE_WORDS = {"WHERE": "where", "GROUP BY": "groupby", "ORDER BY": "orderby", "HAVING": "having"}
#: Words after which names are tables, and words that only end a clause.
TABLE_WORDS = (
    "FROM", "JOIN", "INTO", "OVERWRITE", "UPDATE", "TABLE", "VIEW", "USING", "LATERAL", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER", "SEMI",
    "ANTI", "NATURAL",
)
END_WORDS = (
    "LIMIT", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "QUALIFY", "WHEN MATCHED", "WHEN NOT MATCHED", "CLUSTER BY", "DISTRIBUTE BY",
    "SORT BY", "PARTITION BY", "SET", "VALUES",
)
AGGREGATES = (
    "COUNT", "SUM", "AVG", "MIN", "MAX", "MEAN", "MEDIAN", "STDDEV", "STDDEV_POP", "STDDEV_SAMP", "VARIANCE", "VAR_POP", "VAR_SAMP",
    "COLLECT_LIST", "COLLECT_SET", "ARRAY_AGG", "APPROX_COUNT_DISTINCT", "FIRST", "LAST", "ANY_VALUE", "MAX_BY", "MIN_BY", "COUNT_IF",
    "PERCENTILE", "APPROX_PERCENTILE",
)
ALIAS = rf"(?i)\bAS {ID}"
TOKEN = (
    rf"(?i)\b(?:GROUP|ORDER|PARTITION|CLUSTER|DISTRIBUTE|SORT) BY\b(?: ?\()?|\bWHEN (?:NOT )?MATCHED\b|"
    rf"(?:{ID}\.){{1,3}}\*|(?:{ID}\.){{0,3}}{ID}(?: ?\()?|[();]"
)
NOT_COLUMNS = (
    "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "RLIKE", "BETWEEN", "CASE", "WHEN", "THEN", "ELSE",
    "END", "AS", "ASC", "DESC", "NULLS", "FIRST", "LAST", "TRUE", "FALSE", "DISTINCT", "ALL", "OVER", "PARTITION",
    "BY", "ORDER", "ROWS", "RANGE", "UNBOUNDED", "PRECEDING", "FOLLOWING", "CURRENT", "ROW", "INTERVAL", "EXISTS",
    "SELECT", "FROM", "FILTER", "WHERE", "ESCAPE", "DIV", "DATE", "TIMESTAMP", "ANY", "SOME", "GROUPING", "SETS",
    "ROLLUP", "CUBE", "WITHIN", "GROUP", "USING", "ON", "INNER", "OUTER", "SET", "VALUES", "DAY", "DAYS", "HOUR",
    "HOURS", "MINUTE", "MINUTES", "MONTH", "MONTHS", "YEAR", "YEARS", "WEEK", "WEEKS", "SECOND", "SECONDS",
)

TABLE_TYPE = (
    "array<struct<catalog:string,schema:string,table_name:string,fully_qualified:string,role:string,"
    "is_system_table:boolean,is_temp:boolean>>"
)
COLUMN_TYPE = "array<struct<column_name:string,table_hint:string,role:string>>"


def one_of(value: Column, words: tuple[str, ...]) -> Column:
    """Membership in a fixed word list; Spark looks the value up in a hash set instead of scanning the list."""
    return value.isin(*words)


def first_keyword(text: Column) -> Column:
    """First token of the first line that is not a comment, in capitals and without semicolons."""
    return F.btrim(F.upper(F.regexp_extract(text, FIRST_TOKEN, 1)), F.lit(";"))


def looks_like_sql(text: Column) -> Column:
    head = F.substring(F.btrim(text, F.lit(WHITE)), 1, 200)
    tells = head.rlike("|".join(re.escape(tell) for tell in PYTHON_TELLS))
    return F.coalesce(~tells & one_of(first_keyword(text), SQL_KEYWORDS), F.lit(False))


def reduced(text: Column) -> Column:
    """Literals as ``?``, no comments, single spaces, no spaces around dots."""
    out = F.regexp_replace(text, LEXEMES, " $1$2$3 ")
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r" ?\. ?", ".")
    return F.translate(F.trim(out), "'\"", "??")


#: A number, with fraction and exponent.
NUMBER = r"(?i)\b\d+(?:\.\d+)?(?:e[+-]?\d+)?\b"


def normalised(clean: Column) -> Column:
    """Form in which statements that differ in literals, case, comments or spacing are equal."""
    return F.lower(F.regexp_replace(clean, NUMBER, "?"))


def _count(clean: Column, pattern: str) -> Column:
    return F.regexp_count(clean, F.lit(pattern))


def flags(clean: Column, keyword: Column) -> dict[str, Column]:
    """Feature flags of a SQL statement (``clean`` is its reduced text)."""
    joins = _count(clean, r"(?i)\bJOIN\b")
    conditions = _count(clean, r"(?i)\b(?:ON|USING)\b")
    plain = ~keyword.isin("MERGE", "GRANT", "REVOKE")
    nested = _count(clean, r"(?i)\( ?SELECT\b")
    excused = _count(clean, r"(?i)\b(?:AS|EXISTS) ?\( ?SELECT\b")
    return {
        "has_select_star": clean.rlike(r"(?i)(?:\b(?:SELECT|DISTINCT|ALL)|[,(.]) ?\*"),
        "has_cross_join": clean.rlike(r"(?i)\bCROSS JOIN\b")
        | clean.rlike(rf"(?i)\bFROM {NAME}(?: (?:AS )?{ID})? ?, ?{ID}")
        | (plain & (joins > conditions)),
        "has_cte": clean.rlike(rf"(?i)\bWITH (?:RECURSIVE )?{ID} ?(?:\([^()]*\) ?)?AS ?\("),
        "has_subquery": nested > excused,
        "has_window": clean.rlike(r"(?i)\bOVER (?:\(|[A-Z_])|\bOVER\("),
        "is_describe_or_show": keyword.isin("DESCRIBE", "DESC", "SHOW"),
        "is_dml": keyword.isin("INSERT", "UPDATE", "DELETE", "MERGE"),
        "is_ddl": keyword.isin("CREATE", "DROP", "ALTER"),
        "is_grant_revoke": keyword.isin("GRANT", "REVOKE"),
    }


def _parts(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(ID), F.lit(0)), lambda p: F.replace(p, F.lit("`"), F.lit("")))


def _nth_last(parts: Column, n: int) -> Column:
    return F.when(F.size(parts) >= n, F.try_element_at(parts, F.lit(-n)))


def _in(value: Column, words: tuple[str, ...]) -> Column:
    return one_of(F.upper(value), words)


def _describe_table(name: Column, first: Column, keyword: Column, ctes: Column) -> Column:
    def from_parts(parts: Column) -> Column:
        table = F.element_at(parts, -1)

        def role(temp: Column) -> Column:
            target = (first & one_of(keyword, WRITES)) | ((keyword == "WITH") & name["kw"].isin("INTO", "OVERWRITE"))
            return F.struct(
                F.when(~temp, _nth_last(parts, 3)).alias("catalog"),
                F.when(~temp, _nth_last(parts, 2)).alias("schema"),
                table.alias("table_name"),
                F.when(temp, table).otherwise(F.array_join(parts, ".")).alias("fully_qualified"),
                F.when(temp, "cte").when(target, "write").otherwise("read").alias("role"),
                F.coalesce(~temp & (_nth_last(parts, 3) == "system"), F.lit(False)).alias("is_system_table"),
                temp.alias("is_temp"),
            )

        return let(F.array_contains(ctes, F.lower(table)), role)

    return let(_parts(name["name"]), from_parts)


def without_inner_from(clean: Column) -> Column:
    """The text with each FROM that names no table rewritten."""
    text = F.regexp_replace(clean, r"(?i)\bDISTINCT FROM\b", "DISTINCT_FROM")
    return F.regexp_replace(text, r"(?i)\b(EXTRACT|TRIM|SUBSTRING|OVERLAY) ?\(([^()]*) FROM ", "$1($2, ")


def sql_tables(clean: Column, keyword: Column) -> Column:
    """Tables named by a SQL statement as an array of structs, each reference once per role.

    ``clean`` and ``keyword`` are mentioned often: pass columns or bound values, not expressions.
    """
    text = F.regexp_replace(without_inner_from(clean), r"(?i)\bLATERAL VIEW\b", "LATERAL_VIEW")
    # Parentheses around joined tables go, those of subqueries are kept apart meanwhile.
    text = F.regexp_replace(text, r"(?i)\( ?(SELECT|WITH|VALUES|TABLE)\b", "{$1")
    text = F.regexp_replace(text, r"(?i)\b(FROM|JOIN) ?\([( ]*", "$1 ")
    text = F.translate(text, "{", "(")
    ctes = F.transform(
        F.regexp_extract_all(clean, F.lit(CTE_NAME), F.lit(1)),
        lambda c: F.lower(F.replace(c, F.lit("`"), F.lit(""))),
    )
    refs = F.filter(
        F.transform(
            F.regexp_extract_all(text, F.lit(TABLE_REF), F.lit(0)),
            lambda m: F.struct(F.upper(F.substring_index(m, " ", 1)).alias("kw"), m.alias("text")),
        ),
        lambda r: ~(r["text"].endswith("(") & r["kw"].isin("FROM", "JOIN", "USING"))
        & ((r["kw"] != "USING") | (keyword == "MERGE")),
    )
    names = F.flatten(
        F.transform(
            refs,
            lambda r: F.transform(
                F.split(F.regexp_replace(r["text"], TABLE_LEAD, ""), " ?, ?"),
                lambda item: F.struct(r["kw"].alias("kw"), F.regexp_extract(item, NAME, 0).alias("name")),
            ),
        )
    )
    names = F.filter(names, lambda n: ~_in(n["name"], NOT_TABLES) & (n["name"] != ""))
    found = let(ctes, lambda c: F.transform(names, lambda n, i: _describe_table(n, i == 0, keyword, c)))
    return F.when(one_of(keyword, COMMANDS), F.array().cast(TABLE_TYPE)).otherwise(F.array_distinct(found).cast(TABLE_TYPE))


def freetext_tables(text: Column) -> Column:
    """Three-part names mentioned in a cell that is not SQL."""

    def describe(m: Column) -> Column:
        catalog, schema, table = (F.regexp_extract(m, FREETEXT_NAME, g) for g in (1, 2, 3))
        return let(
            F.struct(catalog.alias("c"), schema.alias("s"), table.alias("t")),
            lambda p: F.struct(
                p["c"].alias("catalog"),
                p["s"].alias("schema"),
                p["t"].alias("table_name"),
                F.concat_ws(".", p["c"], p["s"], p["t"]).alias("fully_qualified"),
                F.lit("reference").alias("role"),
                (p["c"] == "system").alias("is_system_table"),
                F.lit(False).alias("is_temp"),
            ),
        )

    matches = F.regexp_extract_all(text, F.lit(FREETEXT_NAME), F.lit(0))
    return F.array_distinct(F.transform(matches, describe)).cast(TABLE_TYPE)


def _clause_step(joined: Column):
    """One step of the fold over tokens. The state is a stack of open parentheses: the roles that hold throughout each (``inside``) and the
    role of its current clause (``clause``; ``-`` where names are tables), whether the outer select list was seen, and what was found."""

    def step(acc: Column, t: Column) -> Column:
        word, opened = t["word"], t["opened"]
        clause, inside = F.element_at(acc["clause"], -1), F.element_at(acc["inside"], -1)
        outer = (F.size(acc["clause"]) == 1) & ~acc["main"]
        # A side of a join may also be a function: LEFT(x, 2).
        table = one_of(word, TABLE_WORDS) & ~(opened & word.isin("LEFT", "RIGHT"))
        begun = F.when(word == "SELECT", F.when(outer, "select").otherwise("")).when(word == "ON", F.when(joined, "join").otherwise(""))
        for name, role in CLAUSE_WORDS.items():
            begun = begun.when(word == name, role)
        begun = begun.when(table, "-").when(one_of(word, END_WORDS) | (word == ";"), "")

        def move(n: Column) -> Column:
            now = F.coalesce(n, clause)
            roles = F.concat(inside, F.when(now.isin("", "-"), "").otherwise(F.concat(now, F.lit(","))))
            below = F.slice(acc["clause"], 1, F.size(acc["clause"]) - 1)
            column = ~opened & n.isNull() & (clause != "-") & (roles != "") & ~word.isin(")", ";") & ~one_of(word, NOT_COLUMNS)
            closes = (word == ")") & (F.size(acc["clause"]) > 1)
            changed = F.concat(below, F.array(now))
            pushed = F.concat(roles, F.when(one_of(word, AGGREGATES), "aggregate,").otherwise(""))
            return F.struct(
                F.when(closes, F.slice(acc["inside"], 1, F.size(acc["inside"]) - 1))
                .when(opened, F.concat(acc["inside"], F.array(pushed))).otherwise(acc["inside"]).alias("inside"),
                F.when(closes, below).when(opened, F.concat(changed, F.array(F.lit("")))).otherwise(changed).alias("clause"),
                (acc["main"] | (outer & (word == "SELECT"))).alias("main"),
                F.when(column, F.concat(acc["found"], F.array(F.struct(t["text"].alias("text"), roles.alias("roles"))))).otherwise(acc["found"]).alias("found"),
            )

        return let(begun, move)

    return step


def sql_columns(clean: Column, keyword: Column) -> Column:
    """Columns named by a SQL statement with the clause they stand in and the alias before the dot.

    One fold over the tokens keeps track of open parentheses, so a clause ends where its own level ends: a column within a
    subquery or a call has the roles of all clauses around it, and ``aggregate`` inside an aggregate. ``select`` is the outer
    statement's first select list. Names after FROM and JOIN are tables.
    """
    text = F.regexp_replace(without_inner_from(clean), r"(?i)\bAS (SELECT|WITH)\b", "$1")
    text = F.regexp_replace(text, ALIAS, "")
    tokens = F.transform(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)),
        lambda t: F.struct(F.rtrim(F.upper(t), F.lit("( ")).alias("word"), t.endswith("(").alias("opened"), t.alias("text")),
    )
    joined = clean.rlike(r"(?i)\bJOIN\b") & ~keyword.isin("MERGE", "GRANT", "REVOKE")
    texts = "array<string>"
    start = F.struct(
        F.array(F.lit("")).cast(texts).alias("inside"), F.array(F.lit("")).cast(texts).alias("clause"), F.lit(False).alias("main"),
        F.array().cast("array<struct<text:string,roles:string>>").alias("found"),
    )

    def describe(f: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(f["text"], F.lit(rf"{ID}|\*"), F.lit(0)), lambda p: F.replace(p, F.lit("`"), F.lit("")))
        roles = F.filter(F.array_distinct(F.split(f["roles"], ",")), lambda r: r != "")

        def with_roles(b: Column) -> Column:
            return F.transform(
                b["r"], lambda r: F.struct(F.element_at(b["p"], -1).alias("column_name"), _nth_last(b["p"], 2).alias("table_hint"), r.alias("role"))
            )

        return let(F.struct(parts.alias("p"), roles.alias("r")), with_roles)

    def folded(j: Column) -> Column:
        return F.aggregate(tokens, start, _clause_step(j), lambda acc: F.array_distinct(F.flatten(F.transform(acc["found"], describe))))

    columns = let(joined, folded).cast(COLUMN_TYPE)
    return F.when(one_of(keyword, (*COMMANDS, "GRANT", "REVOKE")), F.array().cast(COLUMN_TYPE)).otherwise(columns)
