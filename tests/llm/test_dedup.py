"""Line, substring and near dedup against brute force."""

import hashlib
import random
import re

import pytest

from lakegauge.llm import line_dedup, near_dedup, staging, substring_dedup
from lakegauge.llm.components import connected_components

LAST = 2**63 - 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ordered(rows):
    return [(LAST if i is None else i, t) for i, t, *_ in rows]


def substring_brute(rows, window):
    first = {}
    for i, t in sorted(ordered(rows), key=lambda r: r[0]):
        w = words(t)
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    out = []
    for i, t in ordered(rows):
        w = words(t)
        gone = {j for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < i for j in range(a, a + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((None if i == LAST else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def substring_rows(docs, **more):
    found = substring_dedup.remove_repeats(docs, **more)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in found.collect()), key=str)


def test_substring_awkward_rows(corpus, mixed):
    assert substring_rows(corpus(mixed)) == substring_brute(mixed, 13)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_random_passages(corpus, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(rng.choice((12, 13, 14, 60)))] for k in range(6)]
    rows = []
    for i in rng.sample(range(1000), 60):
        body = []
        for _ in range(rng.randrange(5)):
            body += rng.choice(passages) + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))]
        rows.append((i, rng.choice((" ", "\n", "  \t")).join(body)))
    assert substring_rows(corpus(rows)) == substring_brute(rows, 13)


def test_substring_sketch_only_overestimates(corpus, prose):
    """A sketch that is far too small changes nothing but the work."""
    rows = [(i, prose(i % 7, 80, vocabulary=50)) for i in range(30)]
    docs = corpus(rows)
    sketch, bits = substring_dedup.repeat_sketch(docs, 13, 1 << 24)
    assert bits == 24 and all(len(row) == 1 << 21 for row in sketch)
    assert substring_rows(docs) == substring_brute(rows, 13)


def test_substring_rows_without_id_whose_texts_share_a_32_bit_hash(corpus):
    """Rows without doc_id, and rows of one repeated doc_id, are told apart by all 64 bits of their text's hash."""
    passage = " ".join(f"p{k}" for k in range(20))
    a, b = "a6827", "b24415"  # in these two texts F.hash is the same
    rows = [(1, passage), (None, f"{a} {passage}"), (None, f"{b} " + " ".join(f"u{k}" for k in range(30)))]
    assert substring_rows(corpus(rows)) == substring_brute(rows, 13)


def test_substring_empty_table(corpus):
    assert substring_dedup.remove_repeats(corpus([])).collect() == []


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def line_brute(rows, min_chars, exact_chars=None):
    """``exact_chars``: length from which on exact repeats go; near ones go from ``min_chars`` on."""
    exact_chars = min_chars if exact_chars is None else exact_chars

    def normal(line):
        return line.strip(" \t\r").lower()

    rows = ordered(rows)
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            if len(normal(line)) >= exact_chars:
                first.setdefault(normal(line), (i, k))
    long = [x for x in first if len(x) >= min_chars]
    gone = {x for x in long for y in long if first[y] < first[x] and one_edit(x, y)}
    out = []
    for i, t in rows:
        if t is None:
            out.append((None if i == LAST else i, None, 0, 0))
            continue
        keep = [x for k, x in enumerate(t.split("\n")) if len(normal(x)) < exact_chars or (first[normal(x)] == (i, k) and normal(x) not in gone)]
        out.append((None if i == LAST else i, "\n".join(keep), t.count("\n") + 1, t.count("\n") + 1 - len(keep)))
    return sorted(out, key=str)


def line_rows(docs, min_chars, exact_chars=None):
    found = line_dedup.remove_lines(docs, min_chars, exact_chars=exact_chars).select("row.doc_id", "text", "n_lines", "n_removed")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_lines_awkward_rows(corpus, mixed):
    assert line_rows(corpus(mixed), 20) == line_brute(mixed, 20)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_random_edits(corpus, seed):
    """Short lines over three letters: chains of edits, runs of one letter, equal lines, hot keys."""
    rng = random.Random(seed)

    def edit(x):
        k = rng.randrange(len(x))
        return rng.choice((x[:k] + rng.choice("abü") + x[k + 1 :], x[:k] + x[k + 1 :], x[:k] + rng.choice("abü") + x[k:]))

    pool = ["".join(rng.choice("abü") for _ in range(rng.randrange(4, 9))) for _ in range(25)]
    pool += [edit(rng.choice(pool)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(("", " ", "A", "")) + rng.choice(pool) for _ in range(rng.randrange(8)))) for i in rng.sample(range(99), 40)]
    assert line_rows(corpus(rows), 4) == line_brute(rows, 4)


def test_lines_awkward_rows_short_ones_too(corpus, mixed):
    assert line_rows(corpus(mixed), 20, 1) == line_brute(mixed, 20, 1)


def test_lines_with_one_common_half(corpus):
    """A half that every line has: its lines still meet, by the other stretches, and only near ones go."""
    half = "the same beginning of every line in the table, "
    rows = [(i, f"{half}{i * 7919:08d}{'x' * (i % 3)}\nok") for i in range(300)]
    rows += [(1000 + i, f"{half}{i * 7919:08d}{'x' * (i % 3)}!") for i in range(0, 300, 50)]
    assert line_rows(corpus(rows), 20, 1) == line_brute(rows, 20, 1)


def test_lines_with_outer_blanks_and_case(corpus):
    """Outer blanks and case do not count, inner ones do; letters that lower case makes longer or that depend on their place."""
    line = "One line of More than twenty Characters"
    rows = [
        (1, f"{line}\n\t \r\n\tshort\r\nΟΔΟΣ İSTANBUL, a line of some length"), (2, f" \t{line.upper()}\r\nshort \nsh\tort"),
        (3, f"{line.replace(' ', chr(9))}\n\nοδος i̇stanbul, A LINE of some length\t"), (4, f"{line[:-1]}\u00a0\n \u00a0"), (None, f"\r{line} \t"),
    ]
    for shortest in (1, 3, None):
        assert line_rows(corpus(rows), 20, shortest) == line_brute(rows, 20, shortest)


def test_lines_stage_keeps_columns_and_drops_copies(corpus, mixed):
    docs = corpus(mixed)
    left = line_dedup.without_repeated_lines(docs)
    assert left.columns == docs.columns
    assert left.schema.simpleString() == docs.schema.simpleString()
    ids = [r.doc_id for r in left.collect()]
    assert 3 in ids and 7 not in ids and 12 in ids and 4 in ids
    assert line_dedup.without_repeated_lines(corpus([])).collect() == []


def test_lines_stage_drops_exact_repeats_of_short_lines(corpus):
    """Short lines go as exact repeats only; blank ones stay."""
    rows = [(1, "Home\nthe first page\n\nroses"), (2, " home\r\nthe other page\n\nrose\nROSES"), (3, "Home"), (4, "hone\n\nend")]
    left = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(corpus(rows)).collect()}
    assert left == {1: rows[0][1], 2: "the other page\n\nrose", 4: rows[3][1]}


def test_lines_stage_keeps_short_lines_of_their_own(corpus):
    """One repeated long line does not cost a document its other lines."""
    header = "a header that every page has"
    rows = [(1, f"{header}\nroses are red"), (2, f"{header}\nviolets are blue\n\nend"), (3, f"{header}\n \n\t"), (4, " \n")]
    left = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_repeated_lines(corpus(rows)).collect()}
    assert left == {1: (rows[0][1], len(rows[0][1])), 2: ("violets are blue\n\nend", 21), 4: (" \n", 2)}


def near_brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    named = sorted(i for i in sets if i is not None)
    up = {i: i for i in named}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in named:
        for b in named:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted(((i, len(sets[i]), None if i is None else root(i), i is None or root(i) == i) for i, *_ in rows), key=str)


def near_rows(docs, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_copies(docs, **more).collect()), key=str)


def test_near_awkward_rows(corpus, mixed):
    got = near_rows(corpus(mixed))
    rows = [r for r in mixed if r[0] is not None]
    assert [r for r in got if r[0] is not None] == near_brute(rows, 4, 80)
    assert [r[2:] for r in got if r[0] is None] == [(None, True)] * 2


def test_near_edited_group(corpus, prose):
    """One text under more and more edits: links around the threshold, chains, documents that just miss it."""
    rng = random.Random(5)
    base = prose(11, 90, vocabulary=10**6).split()
    rows = []
    for i in rng.sample(range(10**4), 90):
        w = list(base)
        for k in rng.sample(range(90), rng.randrange(9)):
            w[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i + 10**5, t) for i, t in rows[:20]]
    assert near_rows(corpus(rows)) == near_brute(rows, 4, 80)


def test_near_stage_keeps_one_of_each(corpus, mixed):
    docs = corpus(mixed)
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in left.collect())
    assert ids.count("3") == 1 and "7" not in ids and "9" not in ids and "21" not in ids and ids.count("None") == 2 and "12" in ids
    assert near_dedup.one_of_each(corpus([])).collect() == []


def test_circulant_coordinates_estimate_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[1000:]
    sig = near_dedup.signatures(np.concatenate([a, b]), np.array([0, 2000]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.06
    places = near_dedup.pi(near_dedup.sigma(np.arange(1 << 16, dtype=np.uint32)))
    assert len(np.unique(places)) == 1 << 16


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (35, 30), (None, 1)]
    edges += [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {5: 3, 4: 3, 3: 3, 9: 3, 20: 20, 21: 20, **{k: 30 for k in range(30, 36)}, **{k: 100 for k in range(100, 161)}, **{k: 200 for k in range(200, 260)}}
    assert found == want


@pytest.mark.parametrize("size", (150, 600))
def test_a_group_of_near_copies_takes_a_few_pairs_a_member(monkeypatch, corpus, size):
    """Variants of one text, all near each other: the pairs looked at grow with the members."""
    body = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join("x" if k in {(i * 7) % 300, (i * 13 + 5) % 300} else w for k, w in enumerate(body)) + f" tail{i}") for i in range(size)]
    pairs = []

    def counted(df, name):
        out = staging.staged(df, name)
        if name == "tested":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "staged", counted)
    found = near_dedup.near_copies(corpus([(*r, None, None) for r in rows])).collect()
    assert {r.component_id for r in found} == {0}
    assert sum(pairs) <= 10 * size


@pytest.mark.parametrize("once, probe", [(False, False), (True, False), (False, True)])
def test_lists_of_members_meet_lists_of_leaders(once, probe):
    """A row is a block of pairs; what comes out is what single pairs give."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    wide = near_dedup._SKETCH + near_dedup._CELLS

    def docs(first, n):
        sketch = np.zeros((n, wide), np.uint8)
        sketch[:, : near_dedup._SKETCH] = rng.random((n, near_dedup._SKETCH)) < 0.3
        sketch[:, near_dedup._SKETCH :] = rng.random((n, near_dedup._CELLS)) < 0.9
        bands = [[int(x) for x in rng.integers(0, 3, 3)] + [9] for _ in range(n)]  # all share the last
        return [{"rep": first + k, "component": (first + k) % 5, "n": int(rng.integers(190, 260)), "sketch": sketch[k].tobytes(), "bands": bands[k]} for k in range(n)]

    rows = [{"bucket": k % 3, "members": docs(100 * k, size), "leaders": docs(10**4 + 100 * k, size2)} for k, (size, size2) in enumerate([(90, 32), (1, 1), (64, 3), (2, 32)])]
    one = pa.struct([("rep", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int64()), ("members", pa.list_(one)), ("leaders", pa.list_(one))]))
    least = 60
    want = []
    for r in rows:
        for m in r["members"]:
            met = []
            for x in r["leaders"]:
                a, b = (np.frombuffer(y["sketch"], np.uint8).astype(int) for y in (m, x))
                alike, most = int((a[:128] == b[:128]).sum()), int(np.minimum(a[128:], b[128:]).sum())
                shared = [p for p, q in zip(m["bands"], x["bands"]) if p == q]
                if m["component"] == x["component"] or 100 * min(m["n"], x["n"]) < 80 * max(m["n"], x["n"]) or once and shared[:1] != [r["bucket"]]:
                    continue
                if alike >= least and 180 * most >= 80 * (m["n"] + x["n"]):
                    met.append((m["rep"], alike, min(m["rep"], x["rep"]), max(m["rep"], x["rep"])))
            want += sorted(met, key=lambda t: -t[1])[:1] if probe else met
    found = [tuple(r.values()) for part in near_dedup._possible_task(80, least, once, probe)([batch.slice(0, 2), batch.slice(2)]) for r in part.to_pylist()]
    assert len(want) > 50
    assert sorted(found) == sorted(want) if not probe else sorted(t[:2] for t in found) == sorted(t[:2] for t in want)


def test_batches_for_python_are_bounded_in_bytes(spark):
    """Rows of 10 kB: not ten thousand of them in a batch, nor 64 MB."""
    import pyarrow as pa
    from lakegauge.session import prepare
    from pyspark.sql import functions as F

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    rows = prepare(spark).range(0, 3000, 1, 1).select(F.repeat(F.col("id").cast("string"), 4000).alias("text"))
    assert rows.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0] < 12 << 20


def test_the_bitmap_of_lines_follows_the_lines(spark):
    from pyspark.sql import functions as F

    assert line_dedup._bits(0) == line_dedup._bits(1) == 1 << 15 and line_dedup._bits(28_000) == 1 << 21 and line_dedup._bits(10**9) == 1 << 26
    lines = spark.range(20_000).select(F.xxhash64("id").alias("h1"), "id")
    wanted = lines.filter("id % 100 = 0").select("h1")
    found = [r.id for r in line_dedup._picked(lines, wanted).select("id").collect()]
    assert set(range(0, 20_000, 100)) <= set(found) and len(found) == len(set(found)) < 1000
    assert line_dedup._picked(lines, wanted.limit(0)).count() == 0
