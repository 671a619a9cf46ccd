"""Licence scans, packing, decontamination, the pipeline and the registered queries."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from lakegauge.llm import decontamination, license_scan, packing
from lakegauge.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF
from verification import compare

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def bigrams(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    return [tuple(p) for p in zip(w, w[1:])]


def scan_brute(text, templates, t):
    own, found = bigrams(text), []
    for name, body in templates:
        want = Counter(bigrams(body))
        n = sum(want.values())
        for a in range(len(own)):
            for b in range(a + 1, min(len(own), a + 2 * n + 2) + 1):
                if own[a] in want and own[b - 1] in want:
                    dice = 2 * sum((Counter(own[a:b]) & want).values()) / (b - a + n) if n else 0
                    if dice >= t - 1e-12:
                        found.append((-dice, -(b - a + 1), a, name))
    taken, out = set(), []
    for dice, size, a, name in sorted(found):
        place = set(range(a, a - size))
        if not place & taken:
            taken |= place
            out.append((name, round(-dice, 9), a, -size))
    return sorted(out, key=lambda m: m[2])


def test_licenses_against_brute_force(corpus):
    rng = random.Random(4)
    templates = (("MIT", MIT), ("Apache", APACHE), ("Long", " ".join(f"l{k % 17}" for k in range(40))), ("None", "word"))
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            w = rng.choice([b for _, b in templates]).split()
            for k in range(rng.randrange(3)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(("the", "License", f"z{k}")))
            words += w[rng.randrange(2) :] + ["filler"] * rng.randrange(3)
        rows.append((i, "\n".join([" ".join(words).upper() if i % 3 else " ".join(words), "é"])))
    got = {}
    for r in license_scan.scan(corpus(rows), templates, 0.8).collect():
        got.setdefault(r.doc_id, []).append((r.license, round(r.dice, 9), r.start_word, r.n_words))
    want = {i: m for i, t in rows if (m := scan_brute(t, templates, 0.8))}
    assert {i: sorted(m, key=lambda x: x[2]) for i, m in got.items()} == want


def test_licenses_near_pairs(corpus):
    """Each of the near licences is found by its own name, also with a word changed."""
    near = ("GPL-2.0", "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "MPL-2.0")
    known = [(name, text) for name, text in license_scan.TEMPLATES if name in near]
    assert {name for name, _ in known} == set(near)
    rows = [(k, "Some words before. " + text + " And after.") for k, (_, text) in enumerate(known)]
    rows += [(100 + k, text.replace("SOFTWARE", "PROGRAM", 1)) for k, (_, text) in enumerate(known)]
    found = license_scan.scan(corpus(rows)).collect()
    assert sorted((r.doc_id, r.license) for r in found) == sorted((i, known[i % 100][0]) for i, _ in rows)


def test_licenses_awkward_rows(corpus, mixed):
    rows = [*mixed, (50, "x. " + MIT + "\n" + APACHE), (50, MIT), (None, MIT), (51, MIT.split()[0])]
    found = license_scan.scan(corpus(rows)).collect()
    assert sorted(((r.doc_id, r.license, r.matched) for r in found), key=str) == sorted(
        [(50, "MIT", MIT[:-1]), (50, "Apache-2.0", APACHE[:-1]), (50, "MIT", MIT[:-1]), (None, "MIT", MIT[:-1])], key=str
    )
    assert license_scan.scan(corpus([])).collect() == []




@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    items = [(rng.randrange(0, 50), 1 << rng.choice((0, 0, 0, 1, 2, 3)), 1 << rng.randrange(30) if rng.random() < 0.7 else 0) for _ in range(300)]
    rooms, bins = {}, packing.best_fit(items, 60)
    held = {}
    for (size, source, cluster), own in zip(items, bins):
        fits = [left - size for k, left in rooms.items() if left >= size and not held[k][0] & source and not held[k][1] & cluster]
        if own in rooms:
            assert not held[own][0] & source and not held[own][1] & cluster
            assert rooms[own] - size == min(fits)
        else:
            assert not fits
        rooms[own] = rooms.get(own, 60) - size
        s, c = held.get(own, (0, 0))
        held[own] = (s | source, c | cluster)
    assert min(rooms.values()) >= 0


def test_packing_awkward_rows(corpus, mixed):
    rows = packing.pack(corpus(mixed), capacity=100).collect()
    of_doc = Counter()
    for r in rows:
        of_doc[r.doc_id] += r.n_words
    want = Counter()
    for i, t, *_ in mixed:
        want[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert of_doc == want
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for own in bins.values():
        assert sum(r.n_words for r in own) <= 100
        for kind in ("conflict_source", "cluster"):
            named = [r[kind] for r in own if r[kind] is not None]
            assert len(named) == len(set(named))
        assert sorted(r.place for r in own) == list(range(len(own)))
    assert packing.pack(corpus([])).collect() == []


def test_packing_in_blocks_keeps_every_word(corpus, prose):
    rows = [(i, prose(i % 40, 1 + i % 70), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    found = packing.pack(corpus(rows), capacity=64, block_rows=50).toPandas()
    assert found.groupby("doc_id")["n_words"].sum().to_dict() == {i: 1 + i % 70 for i in range(300)}
    assert found.groupby("bin")["n_words"].sum().max() <= 64
    assert not found.duplicated(["bin", "conflict_source"]).any() and not found.duplicated(["bin", "cluster"]).any()


def leaks_brute(rows, items, threshold=0.8):
    def shingles(text):
        w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
        return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]

    found = {}
    for i, t, *_ in rows:
        own = shingles(t)
        for item, body in items:
            want = shingles(body)
            for start in range(len(own) - len(want) + 1 if want else 0):
                part = own[start : start + len(want)]
                common = sum((Counter(part) & Counter(want)).values())
                score = common / (2 * len(want) - common)
                if score >= threshold and (score, -start) > found.get((i, item), (0, 0)):
                    found[i, item] = (score, -start)
    return {k: (-start, score) for k, (score, start) in found.items()}


def test_leaks_against_brute_force(spark, corpus, prose):
    rng = random.Random(8)
    items = [(k, prose(100 + k, rng.choice((6, 9, 14, 15, 30, 30, 60)), vocabulary=300)) for k in range(25)] + [(90, "too short"), (91, None), (92, "")]
    rows = []
    for i in range(80):
        w = rng.choice(items[:25])[1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, f"Some {prose(i, 20)}, {' '.join(w).upper() if i % 2 else '. '.join(w)}\n{prose(i + 500, 10)}"))
    rows += [(7, rows[7][1]), (None, items[3][1]), (200, None), (201, "")]
    got = decontamination.contaminated_windows(corpus(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert {(r.doc_id, r.item_id): (r.start, r.similarity) for r in got} == leaks_brute(rows, items)
    clean = decontamination.clean_documents(corpus(rows), spark.createDataFrame(items, "item_id long, text string"))
    bad = {i for i, _ in leaks_brute(rows, items)}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, *_ in rows if i not in bad), key=str)


def test_leaks_clipped_and_reordered(spark, corpus, prose):
    """Items that lose words at an end of a document, and items whose parts are swapped or moved apart."""
    items = [(1, " ".join(f"a{k}" for k in range(30))), (2, " ".join(f"b{k}" for k in range(60))), (3, " ".join(f"c{k % 9}" for k in range(40)))]
    a, b, c = (body.split() for _, body in items)
    more = prose(1, 30).split()
    bodies = [
        a[1:] + more, more + a[:-1], a[2:] + more, more + a[:-2], a[5:] + more, a[1:], b[30:] + b[:30], more + b[30:] + b[:30] + more, b[20:40] + b[:20] + b[40:] + more,
        b[3:] + more, more + b[:-3], more + c[4:] + more, c[3:] + more, b[:30] + ["x"] * 3 + b[30:], more + a[:-1] + more, more + b[2:] + more,
    ]
    rows = [(i, " ".join(x)) for i, x in enumerate(bodies)]
    got = decontamination.contaminated_windows(corpus(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = leaks_brute(rows, items)
    assert {(0, 1), (1, 1), (6, 2), (7, 2), (9, 2), (10, 2)} <= set(want)
    assert {(r.doc_id, r.item_id): (r.start, r.similarity) for r in got} == want


def test_leaks_empty_tables(spark, corpus, mixed):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = corpus(mixed)
    assert decontamination.contaminated_windows(docs, none).collect() == []
    assert decontamination.clean_documents(docs, none).count() == len(mixed)
    assert decontamination.contaminated_windows(corpus([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


def test_every_block_pair_within_the_radius_meets(spark):
    """Two fingerprints within the radius share a block."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 21):
            b ^= 1 << bit
        pairs.append(tuple(x - 2**64 if x >= 2**63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    met = F.arrays_overlap(decontamination.blocks_of(F.col("a"), 22), decontamination.blocks_of(F.col("b"), 22))
    assert df.filter(met).count() == 200


def test_simhash_is_the_majority_of_bits(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [([rng.getrandbits(64) - 2**63 for _ in range(n)],) for n in (1, 2, 5, 8)]
    got = [r[0] for r in spark.createDataFrame(rows, "h array<long>").select(decontamination.simhash(F.col("h"))).collect()]
    for (h,), value in zip(rows, got):
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert value % 2**64 == want


def test_pipeline_stages(spark, corpus, mixed, tmp_path):
    leak = " ".join(f"q{k}" for k in range(20))
    rows = [*mixed, (60, leak, "en", "a"), (61, "before " + leak + " after", "de", "b")]
    docs = corpus(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "sequences"]
    ids = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
        if name != "sequences":
            assert now.columns == docs.columns
    assert ids["language"] == {7, 3, 9, 20, 21, 31, None, 40, 41, 42, 60, 61}
    assert 7 not in ids["lines"] and 3 in ids["lines"]
    assert not {60, 61} & ids["benchmark"] and {3, 20, 31, 40, 41} <= ids["benchmark"]
    assert ids["sequences"] == ids["benchmark"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == ids["sequences"]


def test_registered_queries():
    found = __spark_entry__.queries()
    assert [min(k for k in found if k.startswith(f"op{n}_")) for n in range(1, 14)] == list(QUERIES)
    assert "pipeline" in found and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows_as_sql(spark, name):
    left = QUERIES[name](spark, SF).toPandas()
    assert compare.compare(left, compare.connect(SF).execute(ORACLE_SQL[name]).df()) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])  # all over documents
def test_queries_return_every_document(spark, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    found = QUERIES[name](spark, SF).toPandas()
    assert set(found["doc_id"]) <= docs if name.startswith("op1_") else set(found["doc_id"]) == docs
