"""Exact order statistics that stay distributed.

``percentile`` keeps every distinct value of a group in one aggregation buffer, and a plain ``row_number`` sorts a whole
group in one task. Both break on a hot group. The functions here work on value counts and split every group into
value buckets: bucket totals (a bounded number per group) locate the bucket holding a rank, and only that bucket is
then ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.checkpoints import cut

#: Buckets per doubling of the value. 64 doublings bound the buckets of one group at 32,768 per sign, and one bucket
#: spans 0.14 % of its value, so only that sliver of a group is ever ordered in one task.
_PER_DOUBLING = 512


def value_bucket(value: Column) -> Column:
    """A coarse bucket number that never decreases as the value grows."""
    magnitude = F.floor(F.log2(F.abs(value.cast("double")) + 1) * _PER_DOUBLING).cast("int")
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def packed_key(keys: Sequence[str]) -> Column:
    """The keys as one struct. Structs with NULL fields compare equal, so one plain equi join and one partitioning
    serve every step, NULL groups included."""
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Column]) -> DataFrame:
    """The values found at given 0-based ranks of each group.

    ``ranks`` maps an output column to an expression over ``n``, the number of non-NULL values of the group.
    The result has ``keys``, ``n`` and one column per rank.

    The counts serve two branches. Their bucket is never NULL, so the join adds no filter to one of them, and the input is
    scanned and shuffled once.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(packed_key(keys).alias("_k"), F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", F.coalesce(value_bucket(F.col("_v")), F.lit(0)))
    )
    group = Window.partitionBy("_k")
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (
        counts.groupBy("_k", "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("n", F.sum("_bc").over(group))
        .withColumn("_before", F.sum("_bc").over(running) - F.col("_bc"))
    )
    for name, rank in ranks.items():
        located = located.withColumn(f"_r_{name}", rank.cast("bigint"))
    wanted = F.lit(False)
    for name in ranks:
        r = F.col(f"_r_{name}")
        wanted = wanted | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_bc")))
    inside = counts.join(located.filter(wanted).drop("_bc"), ["_k", "_b"])
    order = Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_hi", F.col("_before") + F.sum("_c").over(order)).withColumn(
        "_lo", F.col("_hi") - F.col("_c")
    )
    picks = [
        F.max(F.when((F.col(f"_r_{n}") >= F.col("_lo")) & (F.col(f"_r_{n}") < F.col("_hi")), F.col("_v"))).alias(n)
        for n in ranks
    ]
    found = inside.groupBy("_k").agg(F.max("n").alias("n"), *picks)
    return found.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", *ranks)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], count_as: str | None = None
) -> DataFrame:
    """Continuous percentiles (linear interpolation, NULLs ignored) per group: ``keys`` plus one column per name.

    ``count_as`` adds the number of values under that name.
    """
    ranks: dict[str, Column] = {}
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(p)
        ranks[f"{name}__lo"] = F.floor(position)
        ranks[f"{name}__hi"] = F.ceil(position)
    found = ranked_values(df, keys, value, ranks)
    out = []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"{name}__lo").cast("double"), F.col(f"{name}__hi").cast("double")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    counted = [F.col("n").alias(count_as)] if count_as else []
    return found.select(*keys, *counted, *out)


def add_percentiles(
    summary: DataFrame, df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Attach percentiles of ``df`` to a per-group summary; groups without any value keep NULL."""
    found = exact_percentiles(df, keys, value, probabilities)
    if not keys:
        row = found.select(F.struct(*probabilities)).scalar()
        bound = summary.withColumn("_p", row)
        return bound.select(*summary.columns, *[F.col(f"_p.{name}").alias(name) for name in probabilities])
    left, right = summary.withColumn("_k", packed_key(keys)), found.withColumn("_k", packed_key(keys)).drop(*keys)
    return left.join(right, "_k", "left").drop("_k")


def running_total(df: DataFrame, value: str, order: Sequence[Column], into: str) -> DataFrame:
    """Running sum over a whole frame in descending ``value`` order, without ordering it all in one task.

    ``order`` is the full ordering. Spark's sort deals the rows into ranges of it, so rows of equal value are split as well; the
    sums of the ranges give each range its start. The ranges are written once, so that both uses see the same ones.
    """
    ranged = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_above", F.coalesce(F.sum("_sum").over(above), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(offsets, "_part").withColumn(into, F.col("_above") + F.sum(value).over(inside)).drop("_part", "_above")
