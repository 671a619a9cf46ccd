"""Small Column and DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MONEY = T.DecimalType(20, 6)


def date_range(df: DataFrame, column: str, start: date | None, end: date | None) -> DataFrame:
    """Inclusive range on the raw column, so that it reaches the scan and prunes partitions."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def total(column: Column | str) -> Column:
    """``sum`` that gives 0 for an all-NULL group."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(column), F.lit(0).cast(T.LongType()))


def count_if(condition: Column) -> Column:
    """Rows for which the condition holds (NULL counts as no)."""
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind a value inside one expression, so that it is computed once however often ``use`` mentions it.

    Plain column references would be inlined wherever Spark pushes a filter below the projection that made them.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """NULL when the denominator is NULL or zero."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if digits is None else F.round(value, digits)


def top(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """Ordered head of a frame. With a limit Spark keeps only ``limit`` rows per task."""
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def _sortable(column: Column, kind: T.DataType) -> Column:
    """Maps have no order of their own; their sorted entries do."""
    return F.array_sort(F.map_entries(column)) if isinstance(kind, T.MapType) else column


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row of each key. Rows that tie in ``order`` are ordered by all their other columns, so the pick does
    not depend on how the rows lie.

    Written as a max over an ordered struct would be cheaper, but configuration logs need NULLS LAST on each
    ordering column, so the row number form is used; Spark prunes it per task with a window group limit.
    """
    ties = [_sortable(F.col(f"`{f.name}`"), f.dataType).asc_nulls_last() for f in df.schema.fields if f.name not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *ties))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a declared schema: extra columns dropped, missing ones added as NULL, NaN turned into NULL."""
    present = {c.lower(): c for c in df.columns}
    out = []
    for field in schema.fields:
        if field.name.lower() in present:
            column = F.col(f"`{present[field.name.lower()]}`")
            source = df.schema[present[field.name.lower()]].dataType
            if isinstance(source, (T.DoubleType, T.FloatType)):
                column = F.when(~F.isnan(column), column)
            out.append(column.cast(field.dataType).alias(field.name))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*out)


def contains_text(column: str, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(F.col(column)).contains(needle.lower())
