"""Reach of all names, carried marks and the kept closure against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lakegauge.operators import lineage, reach

PAIR = "source string, target string"


def distances(edges, start):
    out, todo = {}, deque([(start, 0)])
    following = {}
    for a, b in edges:
        following.setdefault(a, set()).add(b)
    while todo:
        at, d = todo.popleft()
        for b in following.get(at, ()):
            if b not in out:
                out[b] = d + 1
                todo.append((b, d + 1))
    return out


def closure_brute(edges):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    return {(r, x): d for r in {a for a, _ in edges} for x, d in distances(edges, r).items()}


def reach_brute(edges):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    names = {x for e in edges for x in e}
    to = {n: set(distances(edges, n)) for n in names}
    part = {n: min({n} | {m for m in to[n] if n in to[m]}) for n in names}
    after = {}
    for a, b in edges:
        if part[a] != part[b]:
            after.setdefault(part[a], set()).add(part[b])
    depth = {}
    for p in sorted(set(part.values()), key=lambda p: len(to[p] | {m for m in names if part[m] == p})):
        depth[p] = max((depth[q] + 1 for q in after.get(p, ())), default=0)
    return {n: (sum(part[m] == part[n] for m in names), len(to[n]), depth[part[n]]) for n in names}


def graph(seed, n, m, down=0.7):
    rng = random.Random(seed)
    edges = []
    for _ in range(m):
        a, b = rng.randrange(n), rng.randrange(n)
        edges.append((f"n{min(a, b)}", f"n{max(a, b)}") if rng.random() < down else (f"n{a}", f"n{b}"))
    return edges


def told(df):
    return {r.full_name: (r.part_size, r.reached, r.depth) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_reach_of_all(spark, seed):
    edges = [*graph(seed, 150, 190, 0.95), ("s", "s"), ("s", "n1"), (None, "n2"), ("n2", None), ("n3", "n4"), ("n3", "n4")]
    pairs = spark.createDataFrame(edges, PAIR)
    assert told(reach.reach(pairs)) == reach_brute(edges)
    assert told(reach.reach(pairs, "upstream")) == reach_brute([(b, a) for a, b in edges])


def test_reach_of_a_chain_and_a_large_part(spark):
    """A chain longer than any batch of steps, hanging on a part of many names: rows are words, not pairs."""
    chain = [(f"c{k:03}", f"c{k + 1:03}") for k in range(40)]
    part = [(f"p{k:04}", f"p{(k * 7 + j) % 2000:04}") for k in range(2000) for j in (1, 3)] + [("c040", "p0000"), ("p0005", "z")]
    found = told(reach.reach(spark.createDataFrame(chain + part, PAIR)))
    assert found["c000"] == (1, 40 + 2000 + 1, 42) and found["z"] == (1, 0, 0)
    assert found["p0000"] == (2000, 2001, 1) and len(found) == 41 + 2000 + 1


def test_reach_of_nothing(spark):
    none = spark.createDataFrame([], PAIR)
    assert reach.reach(none).collect() == []
    assert reach.carry_marks(none, spark.createDataFrame([("a", "email")], "full_name string, mark string")).collect() == [("a", "email", 0)]


def test_marks(spark):
    edges = [*graph(5, 60, 80), (None, "n1")]
    marks = [("n3", "email"), ("n3", "email"), ("n7", "email"), ("n9", "phone"), ("elsewhere", "phone"), (None, "phone"), ("n1", None)]
    found = reach.carry_marks(spark.createDataFrame(edges, PAIR), spark.createDataFrame(marks, "full_name string, mark string"))
    want = {}
    for name, mark in marks:
        if name and mark:
            for x, d in {**distances([e for e in edges if None not in e], name), name: 0}.items():
                want[x, mark] = min(d, want.get((x, mark), d))
    assert {(r.full_name, r["mark"]): r.steps for r in found.collect()} == want


def test_kept_closure(spark):
    """Batches of added and removed edges: the kept rows equal a fresh closure after each of them."""
    rng = random.Random(3)
    edges = set(graph(9, 30, 45)) | {("s", "s")}
    pairs = spark.createDataFrame(sorted(edges), PAIR)
    closure = lineage.lineage_closure(pairs, pairs.select(F.col("source").alias("root")).distinct())
    for batch in range(4):
        removed = set(rng.sample(sorted(edges), 6)) | {("no", "such")}
        added = set(graph(100 + batch, 30, 5)) | {(f"n{batch}", f"new{batch}"), (f"new{batch}", "n29")} | ({("s", "s")} if batch == 1 else set())
        closure = reach.update_closure(closure, spark.createDataFrame(sorted(edges), PAIR), spark.createDataFrame(sorted(added), PAIR), spark.createDataFrame(sorted(removed), PAIR))
        edges = edges - (removed - added) | added
        rows = closure.collect()
        assert len(rows) == len({(r.root, r.full_name) for r in rows})
        assert {(r.root, r.full_name): r.depth for r in rows} == closure_brute(edges)


def test_closure_kept_from_nothing_to_nothing(spark):
    none, some = spark.createDataFrame([], PAIR), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), (None, "a")], PAIR)
    empty = spark.createDataFrame([], "root string, full_name string, depth int")
    full = reach.update_closure(empty, none, some, none)
    assert {(r.root, r.full_name): r.depth for r in full.collect()} == closure_brute([("a", "b"), ("b", "c"), ("c", "a")])
    assert reach.update_closure(full, some, none, some).collect() == []
