"""Language and quality models, fingerprints, shards."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegauge.llm import fingerprint, language_id, quality, sharding
from tests.conftest import SF


def phrases_brute(text, sample):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        at += n
        count += 1
    return count


@pytest.mark.parametrize("seed", range(4))
def test_cross_parsing(seed):
    rng = random.Random(seed)
    sample = "".join(rng.choice("abc ") for _ in range(400))
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) for _ in range(40)]
    code = {c: k for k, c in enumerate("abc ")}
    automaton = language_id.Automaton(np.array([code[c] for c in sample]), 4)
    texts.sort(key=len, reverse=True)
    flat = np.array([code.get(c, -1) for c in "".join(texts)], np.int16)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    assert automaton.phrases(flat, start, size).tolist() == [phrases_brute(t, sample) for t in texts]


def test_symbols():
    code, cut, letters = language_id.symbols_of(["Ab, c", "", "12 !", " É1é "], language_id.symbol_map())
    assert ["".join(map(chr, code[a:b])) for a, b in zip(cut, cut[1:])] == ["ab c", "", "", "é é "]
    assert letters.tolist() == [3, 0, 0, 2]


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.predict(docs, language_id.learn(docs)).toPandas().merge(docs.toPandas(), on="doc_id")
    assert len(found) == docs.count()
    held = found[found["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95
    assert found["score"].between(0, 1).all()
    want = [zlib.crc32(str(i).encode()) % 4 == 2 for i in found["doc_id"]]
    assert found["held_out"].tolist() == want


def test_language_awkward_rows(corpus, mixed):
    docs = corpus(mixed)
    model = language_id.learn(docs)
    assert set(model.labels) <= {"de", "en"}
    rows = language_id.predict(docs, model).collect()
    assert len(rows) == len(mixed)
    blank = {(r.lang_pred, r.score) for r in rows if r.doc_id in (12, 4, 5, 30)}
    assert blank == {("und", 0.0)}
    assert all(r.lang_pred in model.labels for r in rows if r.doc_id in (31, 20, 41))
    left = language_id.recognised(docs, model)
    assert left.schema == docs.schema
    assert {12, 4, 5, 30}.isdisjoint(r.doc_id for r in left.collect()) and left.count() == len(mixed) - 5
    assert language_id.learn(corpus([])) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(corpus([]), None).collect() == []


def test_labels_are_not_inputs(corpus, prose):
    rows = [(i, prose(i, 40), "en" if i % 2 else "de", "a") for i in range(40)]
    docs = corpus(rows)
    model = language_id.learn(docs)
    one = language_id.predict(docs, model).collect()
    two = language_id.predict(docs.withColumn("lang", F.lit("fr")).withColumn("source", F.lit(None)), model).collect()
    assert one == two


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.learn(docs, labels)
    found = quality.predict(docs, ranking).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found["held_out"]]
    assert (held["quality"] == held["predicted"]).mean() >= 0.9
    assert ((found["score"] >= 0.7).astype(int) == found["predicted"]).all()


def test_quality_awkward_rows(spark, corpus, mixed):
    docs = corpus(mixed)
    labels = spark.createDataFrame([(7, 1), (3, 0), (9, None), (None, 1), (20, 1), (21, 0), (40, 1), (999, 0)], "doc_id long, quality int")
    ranking = quality.learn(docs, labels)
    rows = quality.predict(docs, ranking).collect()
    assert len(rows) == len(mixed) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (12, 4)}) == 1
    assert {r.score for r in quality.predict(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}
    ones = labels.filter("quality = 1")
    assert {r.score for r in quality.predict(docs, quality.learn(docs, ones)).collect()} == {1.0}
    assert quality.predict(corpus([]), ranking).collect() == []


def test_bradley_terry_ranks_by_the_feature_that_matters():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    label = (x[:, 2] + 0.1 * rng.normal(size=400) > -0.8).astype(int)
    ranking = quality.fit(x, label)
    score = ranking.score(x)
    assert abs(ranking.weights).argmax() == 2 and ranking.weights[2] > 0
    assert ((score >= 0.7) == label).mean() > 0.93
    assert abs((score < 0.7).mean() - (label == 0).mean()) < 0.01


def test_quality_learns_from_every_labelled_row(spark):
    """The few rows of label 0 come after 20,000 others in the order of hashed ids."""
    ids = spark.range(28_000).filter(~language_id.held_out(F.col("id"))).orderBy(F.xxhash64("id").desc())
    few = [r.id for r in ids.limit(6).collect()]
    bad = F.col("doc_id").isin(few)
    docs = spark.range(28_000).withColumnRenamed("id", "doc_id").select("doc_id", bad.alias("bad"))
    docs = docs.select("doc_id", F.when(bad, "!!! ## $$ !!!").otherwise(F.concat(F.lit("some words of text "), "doc_id")).alias("text"), (~F.col("bad")).cast("int").alias("quality"))
    ranking = quality.learn(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    assert ranking.flat is None
    score = {r.text: r.score for r in quality.predict(docs, ranking).join(docs, "doc_id").filter(F.col("doc_id").isin(few[0], 1)).collect()}
    assert len(score) == 2 and score["!!! ## $$ !!!"] < 0.7 <= score["some words of text 1"]


@pytest.mark.parametrize("good, bad", [(3, 2), (9, 200), (700, 5), (40, 40)])
def test_quality_cells_hold_every_row_and_enough_rivals(spark, good, bad):
    label = [1] * good + [0] * bad
    nth = [*range(good), *range(bad)]
    rows = spark.createDataFrame([(k % 3, n // 3, v, [float(n)]) for v, size in ((1, good), (0, bad)) for n in range(size) for k in [n % 3]], "task int, nth long, label int, x array<double>")
    per = {(t, v): len(range(t, size, 3)) for v, size in ((1, good), (0, bad)) for t in range(3)}
    before = {(t, v): sum(per[u, v] for u in range(t)) for t, v in per}
    held = quality.dealt(rows, before, good, bad, 2).collect()
    met = {(v, x) for h in held for v, x in zip(h.label, h.x)}
    assert met == {(v, float(n)) for v, n in zip(label, nth)}
    assert all(h.label.count(v) >= min(2, good, bad) for h in held for v in (0, 1))
    few = int(good < bad)
    assert sum(h.label.count(1 - few) for h in held) == max(good, bad) and max(len(h.label) for h in held) <= 24


def test_quality_pairs_are_those_of_the_cells():
    rng = np.random.default_rng(3)
    z, w = rng.normal(size=(60, 3)), rng.normal(size=3)
    label, cell = rng.integers(0, 2, 60), np.sort(rng.integers(0, 7, 60))
    d = np.array([z[i] - z[j] for i in range(60) for j in range(60) if label[i] == 1 and label[j] == 0 and cell[i] == cell[j]])
    p = 1 / (1 + np.exp(-d @ w))
    gradient, hessian = quality.pair_sums(z, label, cell, w)
    assert np.allclose(gradient, d.T @ (p - 1)) and np.allclose(hessian, (d * (p * (1 - p))[:, None]).T @ d)


def test_features_of_a_text_do_not_depend_on_its_neighbours(prose):
    texts = [prose(k, 30 + k, lines=3) for k in range(6)] + ["", "A!!", "x | y |\nz"]

    def of(some):
        raw = np.frombuffer("".join(some).encode(), np.uint8)
        return quality.features(raw, np.append(0, np.cumsum([len(t.encode()) for t in some])))

    together = of(texts)
    assert np.allclose(together, np.vstack([of([t]) for t in texts]))
    assert (together[6] == 0).all()


def edited(rows):
    """(doc_id, edited text) in descending doc_id."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        yield i, t, t[: len(t) - len(t) // 2] + following[: len(t) // 2], following


def test_fingerprints_follow_the_next_document(corpus, prose):
    rng = random.Random(1)
    rows = [(i, prose(i % 9, 5 + i % 50, lines=1 + i % 4) if i % 11 else None) for i in rng.sample(range(500), 60)] + [(None, "ä ö")]
    docs = corpus(rows)
    got = fingerprint.fingerprints(docs, bucket_bytes=500).collect()
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in edited(rows)}
    assert len(got) == len(rows) and {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    prints = {}
    for r in got:
        prints.setdefault(dict((a, b or "") for a, b in rows)[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_awkward_rows(corpus, mixed):
    got = fingerprint.fingerprints(corpus(mixed), bucket_bytes=300).collect()
    assert len(got) == len(mixed)
    alone = fingerprint.fingerprints(corpus([(1, "a b\nc")])).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(1, 1.0)]
    assert fingerprint.fingerprints(corpus([])).collect() == []


def digest_sets(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    key, cut = fingerprint.digests(raw, np.append(0, np.cumsum([len(t.encode()) for t in texts])), 4)
    return key, cut


def test_likeness_is_exact_at_any_size(prose):
    a = [prose(k, 40 + 30 * k, lines=4) for k in range(8)] + ["", "", "x", "a a a a a a a a a"]
    b = [t.replace("w1", "v1") for t in a[:5]] + a[5:8] + ["", "y", "x", "a a a a a"]
    (ka, ca), (kb, cb) = digest_sets(a), digest_sets(b)
    want = []
    for i in range(len(a)):
        x, y = set(ka[ca[i] : ca[i + 1]].tolist()), set(kb[cb[i] : cb[i + 1]].tolist())
        assert len(x) == ca[i + 1] - ca[i]
        want.append(len(x & y) / len(x | y) if x | y else 1.0)
    for cells in (3, 24, 3000):
        assert fingerprint.likeness(ka, ca, kb, cb, cells).tolist() == want


def test_peeling_gives_back_the_digests():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 2**64, 40, dtype=np.uint64)
    sketch = fingerprint.Sketches(np.array([40, 1]))
    sketch.add(key, np.zeros(40, np.int64), 1)
    sketch.add(key[:20], np.ones(20, np.int64), 1)
    text = sketch.text(0)
    assert len(zlib.decompress(base64.b64decode(text))) == 120 * 14
    found, done = sketch.peel()
    assert found[0] == 40 and done.tolist() == [True, False]


def test_shards_awkward_rows(corpus, mixed):
    rows = sharding.assign_shards(corpus(mixed), shards=5, per_rack=2, racks=2).collect()
    assert len(rows) == len(mixed)
    texts = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in mixed), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == texts
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign_shards(corpus([])).collect() == []


def draw_brute(key, nodes):
    def total(node):
        return sum(map(total, node.values())) if isinstance(node, dict) else node

    for level in ("region", "rack", "shard"):
        def draw(child):
            u = (int(hashlib.md5(f"{key}/{level}/{child}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return np.log(u) / total(nodes[child])

        child = max(nodes, key=lambda c: (draw(c), -c))
        nodes = nodes[child]
    return child


def test_shards_descend_the_tree_and_grow_into_the_new_one(spark):
    keys = spark.range(3000).withColumn("key", F.col("id").cast("string"))
    rows = keys.select("id", sharding.descend(F.col("key"), sharding.tree(24)).alias("a"), sharding.descend(F.col("key"), sharding.tree(25)).alias("b")).collect()
    for r in rows[:300]:
        assert r.a == draw_brute(str(r.id), sharding.tree(24)) and r.b == draw_brute(str(r.id), sharding.tree(25))
    assert {r.b for r in rows if r.a != r.b} == {24}
    sizes = np.bincount([r.a for r in rows], minlength=24)
    assert sizes.min() > 80 and sizes.max() < 175
    assert 70 < sum(r.b == 24 for r in rows) < 175


def test_a_changed_weight_moves_rows_only_through_its_subtree(spark):
    before, after = sharding.tree(24), sharding.tree(24)
    after[1][3][12] = 3.0
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    rows = keys.select(sharding.descend(F.col("key"), before).alias("a"), sharding.descend(F.col("key"), after).alias("b")).collect()
    region = {s: r for r, racks in before.items() for leaves in racks.values() for s in leaves}
    rack = {s: k for racks in before.values() for k, leaves in racks.items() for s in leaves}
    for r in rows:
        if r.a != r.b:
            if region[r.a] == region[r.b] == 1 and rack[r.a] == rack[r.b]:
                assert r.b == 12
            else:
                assert rack[r.b] == 3 or region[r.a] != region[r.b] == 1


def test_texts_of_another_language_go(spark, corpus):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    model = language_id.learn(docs)
    other = [(-1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "en"), (-2, "zqx vkjw xqzz wvkq jjxq zzvw kqxj wwzq vxkj " * 5, "de"), (-3, None, "en"), (-4, "12 !", "en"), (-5, "A.", "en")]
    rows = docs.unionByName(spark.createDataFrame([(i, t, lang, "a", None) for i, t, lang in other], docs.schema))
    kept = language_id.recognised(rows, model)
    assert kept.columns == docs.columns
    found = {r.doc_id: r.lang for r in kept.select("doc_id", "lang").collect()}
    assert not {-1, -2, -3, -4} & set(found) and -5 in found
    all_ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(all_ids - set(found)) <= len(all_ids) / 100
    said = {r.doc_id: r.lang_pred for r in language_id.predict(rows, model).collect()}
    assert all(said[i] == lang for i, lang in found.items())
    german = language_id.recognised(rows, model, wanted=["de"]).select("doc_id").collect()
    assert {r.doc_id for r in german} == {i for i, lang in found.items() if lang == "de"}
    # The automata decide: without them, everything with letters stays.
    assert {r.doc_id for r in language_id.recognised(rows, None).collect()} >= {-1, -2}
    assert language_id.recognised(docs.limit(0), model).collect() == []


def test_shared_sample():
    parts = [np.zeros(n) for n in (5, 100, 40, 3)]
    assert [len(p) for p in language_id._shared(parts, 60)] == [5, 26, 26, 3]
    assert [len(p) for p in language_id._shared(parts, 1000)] == [5, 100, 40, 3]


def test_few_long_documents_fill_the_sample(spark):
    long = " ".join(f"wort{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(20_000))
    docs = spark.createDataFrame([(k, "1 " * 900 + long, "de") for k in range(8)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, sample_symbols=6000)
    assert len(model.labels) == 1 and model.bits[0] > np.log2(5900)
