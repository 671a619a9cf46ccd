"""Previous row, nearest marked row and running sums per key, without ordering a whole key in one task.

A key is cut into time buckets. Bucket summaries (few per key) are ordered first and give every bucket what came before
or after it; rows are then only ordered inside their bucket. A key with a third of all rows is spread over its buckets. Times must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.quantiles import packed_key

_BUCKET = "_bucket"


def _bucketed(df: DataFrame, keys: Sequence[str], time: str, grain: str) -> DataFrame:
    return df.withColumn("_k", packed_key(keys)).withColumn(_BUCKET, F.date_trunc(grain, F.col(time)))


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], grain: str = "hour"
) -> DataFrame:
    """Add ``prev_<column>`` from the previous row of the key. ``order`` starts with a timestamp and must be total."""
    rows = _bucketed(df, keys, order[0], grain)
    packed = F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in columns])
    last = rows.groupBy("_k", _BUCKET).agg(F.max(packed).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("_k").orderBy(_BUCKET))).drop("_last")
    inside = Window.partitionBy("_k", _BUCKET).orderBy(*order)
    found = rows.join(carry, ["_k", _BUCKET]).withColumn("_prev", F.coalesce(F.lag(packed).over(inside), F.col("_carry")))
    return found.select(*df.columns, *[F.col(f"_prev._v_{c}").alias(f"prev_{c}") for c in columns])


def with_nearest(
    df: DataFrame, keys: Sequence[str], time: str, mark: str, into: str, after: bool = False, grain: str = "hour"
) -> DataFrame:
    """Add the time of the nearest row for which ``mark`` holds, at or before each row (``after``: at or after it)."""
    rows = _bucketed(df, keys, time, grain).withColumn("_mark", F.when(F.col(mark), F.col(time)))
    pick = F.min if after else F.max
    per = rows.groupBy("_k", _BUCKET).agg(pick("_mark").alias("_m"))
    group = Window.partitionBy("_k").orderBy(_BUCKET)
    beyond = group.rowsBetween(1, Window.unboundedFollowing) if after else group.rowsBetween(Window.unboundedPreceding, -1)
    carry = per.withColumn("_carry", pick("_m").over(beyond)).drop("_m")
    inside = Window.partitionBy("_k", _BUCKET).orderBy(time)
    frame = (
        inside.rangeBetween(Window.currentRow, Window.unboundedFollowing)
        if after
        else inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = rows.join(carry, ["_k", _BUCKET])
    return found.withColumn(into, F.coalesce(pick("_mark").over(frame), F.col("_carry"))).select(*df.columns, into)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str, grain: str = "hour"
) -> DataFrame:
    """Running sum of ``value`` per key in ``order``, which starts with a timestamp and must be total."""
    rows = _bucketed(df, keys, order[0], grain)
    per = rows.groupBy("_k", _BUCKET).agg(F.sum(value).alias("_s"))
    group = Window.partitionBy("_k").orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.withColumn("_carry", F.coalesce(F.sum("_s").over(group), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_k", _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.join(carry, ["_k", _BUCKET])
    return found.withColumn(into, F.col("_carry") + F.sum(value).over(inside)).select(*df.columns, into)


def with_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, grain: str = "day") -> DataFrame:
    """Prepare a window over the ``size`` previous rows of a key that may run bucket by bucket.

    Adds ``_k`` and ``_bucket`` to partition by, and copies of the last ``size`` earlier rows to every bucket, marked by
    ``_copy``. Order the window by ``order``, and drop the copies afterwards.
    """
    rows = _bucketed(df, keys, order[0], grain)
    newest = Window.partitionBy("_k", _BUCKET).orderBy(*[F.col(c).desc() for c in order])
    last = rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= size)
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("_row"))
    tails = last.groupBy("_k", _BUCKET).agg(F.sort_array(F.collect_list(packed)).alias("_tail"))
    # Every bucket holds at least one row, so the rows wanted lie in the ``size`` buckets before it.
    before = Window.partitionBy("_k").orderBy(_BUCKET).rowsBetween(-size, -1)
    earlier = tails.select("_k", _BUCKET, F.flatten(F.collect_list("_tail").over(before)).alias("_e"))
    wanted = F.slice("_e", F.greatest(F.size("_e") - size + 1, F.lit(1)), size)
    copies = earlier.select("_k", _BUCKET, F.explode(wanted).alias("_x")).select(
        F.col("_x._row.*"), "_k", _BUCKET, F.lit(True).alias("_copy")
    )
    return rows.withColumn("_copy", F.lit(False)).unionByName(copies)
