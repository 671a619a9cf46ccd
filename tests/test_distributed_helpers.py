"""Percentiles, ordered helpers, closure and the price join against brute force, with one very hot key."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions import ordered, quantiles
from lakegauge.operators import lineage, spend

KEYS = ["hot", "hot", "hot", "a", "b", None]


def frame(spark, n=600, seed=1):
    rng = random.Random(seed)
    base = datetime(2026, 1, 1)
    rows = [
        (i, rng.choice(KEYS), base + timedelta(seconds=rng.randrange(400_000), microseconds=i), rng.choice([None, -50, 0, 3, 7, rng.randrange(100_000)]), rng.random() < 0.2)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id int, k string, at timestamp_ntz, v bigint, mark boolean"), pd.DataFrame(rows, columns=["id", "k", "at", "v", "mark"])


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles(spark, seed):
    df, local = frame(spark, seed=seed)
    got = {r.k: (r.p0, r.p50, r.p95, r.p100, r.n) for r in quantiles.exact_percentiles(df, ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}, count_as="n").collect()}
    for key, part in local.groupby("k", dropna=False):
        values = part.v.dropna().astype(float)
        key = None if pd.isna(key) else key
        expected = [np.quantile(values, q) for q in (0, 0.5, 0.95, 1)]
        assert got[key][:4] == pytest.approx(expected) and got[key][4] == len(values)
    assert len(got) == 4


def test_percentiles_without_keys_or_values(spark):
    df, _ = frame(spark)
    empty = df.filter("v > 1000000")
    assert quantiles.add_percentiles(empty.agg(F.count("*").alias("n")), empty, [], "v", {"p": 0.5}).first().asDict() == {"n": 0, "p": None}


def test_running_total(spark):
    df, local = frame(spark)
    sums = df.filter("v IS NOT NULL AND v >= 0").select(F.col("id").cast("string").alias("label"), F.col("v").alias("total_cost"))
    got = spend.cumulative_share(sums).orderBy(F.desc("total_cost"), "label").collect()
    values = sorted(((-v, str(i)) for i, v in zip(local.id, local.v) if pd.notna(v) and v >= 0))
    total, run = sum(-v for v, _ in values), 0
    for row, (v, label) in zip(got, values, strict=True):
        run -= v
        assert (row.label, row.cum_share) == (label, pytest.approx(run / total))


def test_previous_row(spark):
    df, local = frame(spark)
    got = {r.id: r.prev_id for r in ordered.with_previous(df, ["k"], ["at", "id"], ["id"]).collect()}
    for _, part in local.sort_values(["at", "id"]).groupby("k", dropna=False):
        before = [None, *part.id[:-1]]
        assert [got[i] for i in part.id] == before
    assert len(got) == len(local)


@pytest.mark.parametrize("after", [False, True])
def test_nearest_mark(spark, after):
    df, local = frame(spark)
    got = {r.id: r.near for r in ordered.with_nearest(df, ["k"], "at", "mark", "near", after=after).collect()}
    for _, part in local.groupby("k", dropna=False):
        marks = sorted(part["at"][part["mark"]])
        for i, at in zip(part.id, part["at"]):
            side = [m for m in marks if (m >= at if after else m <= at)]
            expected = (side[0] if after else side[-1]) if side else None
            assert got[i] == (expected.to_pydatetime() if expected is not None else None)


def test_running_sum(spark):
    df, local = frame(spark)
    rows = df.withColumn("v", F.coalesce("v", F.lit(0)))
    got = {r.id: r.run for r in ordered.running_sum(rows, ["k"], ["at", "id"], "v", "run").collect()}
    for _, part in local.fillna({"v": 0}).sort_values(["at", "id"]).groupby("k", dropna=False):
        assert [got[i] for i in part.id] == list(part.v.cumsum())


@pytest.mark.parametrize("grain", ["hour", "day"])
def test_window_over_previous_rows(spark, grain):
    df, local = frame(spark)
    spread = ordered.with_history(df, ["k"], ["at", "id"], 5, grain)
    window = Window.partitionBy("_k", "_bucket").orderBy("at", "id").rowsBetween(-5, -1)
    rows = spread.withColumn("ids", F.collect_list("id").over(window)).filter(~F.col("_copy")).collect()
    got = {r.id: r.ids for r in rows}
    assert len(rows) == len(local)
    for _, part in local.sort_values(["at", "id"]).groupby("k", dropna=False):
        ids = list(part.id)
        assert all(got[x] == ids[max(i - 5, 0) : i] for i, x in enumerate(ids))


def test_closure_and_cycles(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    pairs = spark.createDataFrame([(f"t{a}", f"t{b}") for a, b in edges], "source string, target string")
    starts = spark.createDataFrame([("t0",), ("t1",), ("nowhere",)], "root string")

    def walk(start, step):
        depth, seen, level = 0, {}, {start}
        while level:
            depth += 1
            level = {b for a, b in step if a in level} - set(seen)
            seen.update({x: depth for x in level})
        return seen

    for direction, step in (("downstream", edges), ("upstream", {(b, a) for a, b in edges})):
        got = {(r.root, r.full_name): r.depth for r in lineage.lineage_closure(pairs, starts, direction).collect()}
        expected = {(f"t{s}", f"t{x}"): d for s in (0, 1) for x, d in walk(s, step).items()}
        assert got == expected
    loops = {r.full_name: r.length for r in lineage.cycles(pairs).collect()}
    assert loops == {f"t{s}": walk(s, edges)[s] for s in range(25) if s in walk(s, edges)}


def test_percentiles_scan_and_shuffle_their_input_once(spark, tmp_path):
    rows = spark.range(5000).selectExpr("CAST(id % 7 AS STRING) AS g", "CASE WHEN id % 11 > 0 THEN id * 13 % 977 END AS v")
    rows.write.parquet(str(tmp_path / "rows"))
    found = quantiles.exact_percentiles(spark.read.parquet(str(tmp_path / "rows")), ["g"], "v", {"p50": 0.5, "p95": 0.95})
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and final.count("ReusedExchange") == 1


def test_long_chain_and_long_cycle(spark):
    chain = spark.createDataFrame([(f"c{k:02}", f"c{k + 1:02}") for k in range(50)], "source string, target string")
    start = spark.createDataFrame([("c00",)], "root string")
    found = {r.full_name: r.depth for r in lineage.lineage_closure(chain, start).collect()}
    assert found == {f"c{k:02}": k for k in range(1, 51)}
    assert len(lineage.lineage_closure(chain, start, max_depth=3).collect()) == 3
    ring = [(f"r{k:02}", f"r{(k + 1) % 30:02}") for k in range(30)] + [("r00", "z"), ("x", "r05"), ("s", "s")]
    pairs = spark.createDataFrame(ring, "source string, target string")
    assert {r.full_name: r.length for r in lineage.cycles(pairs).collect()} == {**{f"r{k:02}": 30 for k in range(30)}, "s": 1}


def test_closure_of_nothing(spark):
    pairs = spark.createDataFrame([], "source string, target string")
    starts = spark.createDataFrame([("a",)], "root string")
    assert lineage.lineage_closure(pairs, starts).count() == 0


def test_allocation_shares_out_exactly_what_was_billed(spark):
    at = datetime(2026, 1, 1, 10, 30)
    bill = spark.createDataFrame([("w", at, at + timedelta(hours=1), 60.0), ("idle", at, at + timedelta(hours=1), 5.0)], "compute_id string, usage_start_time timestamp_ntz, usage_end_time timestamp_ntz, cost double")
    ran = spark.createDataFrame(
        [("long", "w", at, at + timedelta(minutes=60)), ("short", "w", at, at + timedelta(minutes=10)), ("none", "x", at, at), ("nowhere", None, at, at)],
        "statement_id string, compute_id string, start_time timestamp_ntz, end_time timestamp_ntz",
    )
    got = {r.statement_id: r.cost for r in spend.query_cost_allocation(bill, ran).collect()}
    assert got == {"long": pytest.approx(30 * 0.75 + 30), "short": pytest.approx(30 * 0.25), None: pytest.approx(5.0)}
