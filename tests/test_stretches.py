"""Statements against samples over aligned stretches of minutes; profiles of hot columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakegauge.operators import infrastructure
from lakegauge.sources import ingest

START = datetime(2024, 1, 1)
TIMELINE = "cluster_id string, start_time timestamp_ntz, cpu_user_percent double, cpu_system_percent double, mem_used_percent double"
STATEMENTS = "statement_id string, cluster_id string, start_time timestamp_ntz, end_time timestamp_ntz"


def covered(first, end):
    found, level = set(), 0
    while first < end:
        if first % 2:
            found.add((level, first))
            first += 1
        if end % 2:
            end -= 1
            found.add((level, end))
        first, end, level = first // 2, end // 2, level + 1
    return found


def test_stretches_cover_every_interval_once(spark):
    """All intervals of a small range, and some long ones, against a loop."""
    rng = random.Random(4)
    rows = [(a, b) for a in range(20) for b in range(a + 1, 40)] + [(a, a + rng.randrange(1, 130_000)) for a in rng.sample(range(28_000_000, 29_000_000), 40)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    for r in df.select("a", "b", infrastructure._stretches(F.col("a"), F.col("b")).alias("s")).collect():
        assert sorted(map(tuple, r.s)) == sorted(covered(r.a, r.b))
        minutes = sum(2**level for level, _ in r.s)
        assert minutes == r.b - r.a and len(r.s) <= 2 * (r.b - r.a).bit_length()


def test_window_utilization_equals_brute_force(spark):
    """A statement of 90 days, one within a minute, one without an end, one that ends first, one on a cluster without samples."""
    rng = random.Random(5)
    samples = [
        (rng.choice("abc") if i % 50 else None, START + timedelta(seconds=rng.randrange(100 * 86400)), float(rng.randrange(100)),
         float(rng.randrange(20)) if i % 9 else None, float(rng.randrange(100)) if i % 7 else None)
        for i in range(3000)
    ]
    runs = [("long", "a", START + timedelta(days=3, seconds=17), START + timedelta(days=93, seconds=5)), ("none", "z", START, START + timedelta(days=9))]
    runs += [("no_start", "a", None, START), ("no_cluster", None, START, START + timedelta(days=9))]
    for i, (c, at, *_) in enumerate(s for s in samples[:300] if s[0]):
        runs.append((f"s{i}", c, at, (None, at - timedelta(hours=1), at + timedelta(seconds=20), at + timedelta(minutes=rng.randrange(5000)))[i % 4]))

    def minute(t):
        return t.replace(second=0, microsecond=0)

    want = {}
    for s, c, a, b in runs:
        if a is None:
            continue
        last = max(minute(a), minute(b or a))
        hit = [x for x in samples if c is not None and x[0] == c and minute(a) <= minute(x[1]) <= last]
        if hit:
            cpu, mem = [x[2] + x[3] for x in hit if x[3] is not None], [x[4] for x in hit if x[4] is not None]
            want[s] = (len(hit), sum(cpu) / len(cpu) if cpu else None, sum(mem) / len(mem) if mem else None)
    found = infrastructure.query_window_utilization(spark.createDataFrame(runs, STATEMENTS), spark.createDataFrame(samples, TIMELINE))
    got = {r.statement_id: (r.samples, r.avg_cpu, r.avg_mem) for r in found.collect()}
    assert got.keys() == want.keys() and "long" in got
    for s, (n, cpu, mem) in want.items():
        assert got[s] == (n, pytest.approx(cpu) if cpu is not None else None, pytest.approx(mem) if mem is not None else None)


def test_profile_of_a_hot_column_is_distinct_before_the_window(spark):
    df = spark.range(20_000).select((F.col("id") % 2 == 0).alias("flag"), F.lit(None).cast("int").alias("none"), F.col("id").cast("string").alias("id"))
    profile = ingest.profile_columns(df, "t")
    got = {r.column_name: (r.data_type, r.sample_values) for r in profile.collect()}
    assert got == {"flag": ("boolean", ["false", "true"]), "none": ("int", []), "id": ("string", ["0", "1", "10", "100", "1000"])}
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [row_number") < plan.index("Aggregate [column_name", plan.index("Window [row_number"))
