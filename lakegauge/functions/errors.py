"""Classification of error messages, drivers and principals of the query history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakegauge.functions.common import let

ERROR_CODE = r"\[([A-Z][A-Z0-9_]+)\]"
SQLSTATE = r"(?i)SQLSTATE:\s*([A-Z0-9]+)"
ERROR_OBJECT = r"`([^`]+)`(?:\.`([^`]+)`)?(?:\.`([^`]+)`)?"
ERROR_USER = r"User\s+([\w\.-]+(?:@[\w\.-]+)?)"

# Error categories in order of precedence, with their codes.
ERROR_CATEGORIES = {
    "PERMISSION": ("INSUFFICIENT_PERMISSIONS", "PERMISSION_DENIED", "ACCESS_DENIED"),
    "NOT_FOUND": (
        "TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "UNRESOLVED_TABLE", "SCHEMA_NOT_FOUND", "DATABASE_NOT_FOUND",
        "COLUMN_NOT_FOUND",
    ),
    "PARSE": ("PARSE_SYNTAX_ERROR", "PARSE_ERROR", "INVALID_SYNTAX"),
    "OOM": ("OUT_OF_MEMORY", "OOM", "MEMORY_LIMIT_EXCEEDED"),
    "TIMEOUT": ("STATEMENT_TIMEOUT", "TIMEOUT", "QUERY_TIMEOUT"),
    "ANALYSIS": (
        "ANALYSIS_ERROR", "AMBIGUOUS_REFERENCE", "DATATYPE_MISMATCH", "GROUP_BY_POS_OUT_OF_RANGE",
        "INVALID_PARAMETER_VALUE",
    ),
    "DEPENDENCY": ("FAILED_DEPENDENCY", "DELTA_VERSIONS_NOT_CONTIGUOUS"),
}

# Driver families in order of precedence, with the text that names them.
DRIVER_FAMILIES = (
    ("PyConnector", ("pydatabricks", "pythonsql")),
    ("JDBC", ("jdbc",)),
    ("ODBC", ("odbc",)),
    ("ExecApi", ("execapi",)),
    ("ADBC", ("adbc",)),
    ("NodeJS", ("nodejs",)),
)


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def error_code(message: Column) -> Column:
    return _group(message, ERROR_CODE, 1)


def sqlstate(message: Column) -> Column:
    return _group(message, SQLSTATE, 1)


def error_category(message: Column) -> Column:
    """Exact code first, then the first category whose code occurs anywhere in the message, else ``OTHER``."""

    def classify(m: Column) -> Column:
        out = F.when(m["text"].isNull() | (m["text"] == ""), F.lit(None).cast("string"))
        for category, codes in ERROR_CATEGORIES.items():
            out = out.when(F.find_in_set(m["code"], F.lit(",".join(codes))) > 0, category)
        for category, codes in ERROR_CATEGORIES.items():
            out = out.when(m["text"].rlike("|".join(codes)), category)
        return out.otherwise("OTHER")

    return let(F.struct(error_code(message).alias("code"), F.upper(message).alias("text")), classify)


def error_object(message: Column) -> Column:
    """First backticked object of up to three parts."""
    return F.nullif(F.concat_ws(".", *[_group(message, ERROR_OBJECT, g) for g in (1, 2, 3)]), F.lit(""))


def error_user(message: Column) -> Column:
    return _group(message, ERROR_USER, 1)


def driver_family(driver: Column) -> Column:
    def classify(name: Column) -> Column:
        out = F.when(name.isNull() | (name == ""), F.lit(None).cast("string"))
        for family, needles in DRIVER_FAMILIES:
            out = out.when(name.rlike("|".join(needles)), family)
        return out.otherwise("Other")

    return let(F.lower(F.replace(F.substring_index(driver, ",", 1), F.lit(" "), F.lit(""))), classify)


def driver_version(driver: Column) -> Column:
    return F.trim(F.get(F.split(driver, ",", 2), F.lit(1)))


def principal_kind(executed_by: Column, user_id: Column) -> Column:
    return (
        F.when(executed_by.contains("@"), "human").when(user_id.rlike("^[0-9]+$"), "service").otherwise("unknown")
    )
