"""Source mixing, tokenizer alignment and hard negatives against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakegauge.llm import alignment, mixing, negatives
from lakegauge.llm.queries import TOKENIZERS

FILES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


# ---- mixing ----
def targets_brute(sizes, weights, share, cap):
    """sizes: source -> words. Deals out, stops, deals the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + level * weight[s] >= cap * sizes[s]}
        for s in open_ - full:
            target[s] += level * weight[s]
        left = 0.0
        for s in full:
            left += target[s] + level * weight[s] - cap * sizes[s]
            target[s] = cap * sizes[s]
        open_ -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": int(10 ** rng.uniform(0, 5)) for k in range(30)} | {None: 500, "empty": 0, "ü": 70}
    rows = spark.createDataFrame([(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()], "source string, size long")
    for share in (0.0, 0.4, 1.5, 2.5):
        found = {r.source: r.target for r in mixing.source_targets(rows, (3, 1, 2), share, 2.0).collect()}
        assert found == pytest.approx(targets_brute(sizes, (3, 1, 2), share, 2.0), rel=1e-9, abs=1e-6)


def test_mixing_awkward_rows(corpus, mixed):
    docs = corpus(mixed)
    found = mixing.repetitions(docs).collect()
    assert len(found) == len(mixed)
    sizes = Counter()
    for _, text, _, source in mixed:
        sizes[source] += words(text)
    want = targets_brute(sizes, (3, 1, 2), 1.5, 2.0)
    for r in found:
        assert r.size == words(r.row.text) and r.source_size == sizes[r.row.source]
        assert r.target == pytest.approx(want[r.row.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert math.floor(rate) <= r.copies <= math.floor(rate) + 1 and r.copies <= 2
    emitted = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(docs).collect())
    taken = Counter()
    for r in found:
        taken[(r.row.doc_id, r.row.text, r.row.source)] += r.copies
    assert emitted == +taken and mixing.mix(docs).columns == docs.columns
    again = mixing.repetitions(docs.repartition(3)).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))


def test_mixing_gaps_and_empty(corpus):
    texts = ["\x0b a\x1c b c \r\n", "   ", "", None, "x", "x" * 200_000 + " " * 200_000 + "y"]
    found = mixing.repetitions(corpus([(k, t, None, "s") for k, t in enumerate(texts)])).collect()
    assert {r.row.doc_id: r.size for r in found} == {k: words(t) for k, t in enumerate(texts)}
    assert mixing.repetitions(corpus([]).limit(0)).collect() == []
    assert [r.copies for r in mixing.repetitions(corpus([(1, "", None, None)])).collect()] == [0]


def test_mixing_hot_source_comes_near_its_target(corpus):
    rows = [(k, "w " * (k % 50 + 1), None, "hot" if k % 3 else f"s{k % 20}") for k in range(6000)]
    found = mixing.repetitions(corpus(rows)).withColumn("taken", F.col("copies") * F.col("size")).withColumn("square", F.col("size") * F.col("size"))
    for r in found.groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("square").alias("square")).collect():
        assert abs(r.taken - r.target) <= 5 * math.sqrt(r.square / 4) + 1


# ---- alignment ----
def ranges(parts):
    out, at = [], 0
    for x in parts:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def align_brute(rows):
    a, b, symbols = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1]), alignment.byte_of_symbol()
    a.encode_special_tokens = True
    counts, found = Counter(), []
    for doc_id, text in rows:
        found.append([doc_id, 0, 0, 0, [], ""])
        if not text:
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            continue
        at_a, at_b = ranges(bytes_a), ranges(bytes_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, at_a) for y, (t, f) in zip(ids_b, at_b) if s < f and t < e]
        groups, begin = [], 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, at) if begin <= s and e <= end) for ids, at in ((ids_a, at_a), (ids_b, at_b))))
            begin = end
        counts.update(links)
        found[-1] = [doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()]
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        ((i, na, nb, ng, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for i, na, nb, ng, links, sha in found), key=str
    )


AWKWARD = [
    None, "", " ", "a", " a", "a ", "two  blanks", "tab\there\n\nlines \r\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "a ▁ b", "日本語のテキスト 🙂🙂 ﬁ Ⅷ é",
    "\x00\x01 ﻿​", "naïve café don't I'll 12345 3.14", "x" * 300, "the the the the", "hello world", "hello world", " nbsp　wide",
]


def aligned(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def texts(mixed):
    rows = [(i, t) for i, t, *_ in mixed if t is None or len(t) < 2000] + [(100 + k, t) for k, t in enumerate(AWKWARD)]
    return rows + [(None, "hello world"), (100, "hello world")]


def test_alignment(corpus, texts):
    docs, want = corpus([(*r, None, None) for r in texts]), align_brute(texts)
    assert sum(r[1] > 0 for r in want) > len(texts) / 2 and sum(r[1] == 0 for r in want) >= 4
    assert aligned(alignment.align(docs, *FILES)) == want
    assert aligned(alignment.align(docs.repartition(3), *FILES, block_bytes=100, part_bytes=7)) == want


def test_units_are_encoded_without_their_places():
    sides = alignment.Sides(*alignment.read_vocabularies(*FILES))
    whole = sides.a

    class IdsOnly:
        def encode_batch(self, *args, **options):
            raise AssertionError("places in the text were worked out")

        def encode_batch_fast(self, *args, **options):
            return whole.encode_batch_fast(*args, **options)

    sides.a = IdsOnly()
    units = ["plain", "Ünï 日本 🙂", "<|endoftext|>", "a  b\n\tc", "\u0301x", "1234567"]
    a, _, _ = sides.encode(units, [1] * len(units))
    right = [whole.encode(" " + x, add_special_tokens=False).ids for x in units]
    assert [x or y for x, y in zip(a, right)] == right and a[0] == right[0]


def test_neighbouring_units_are_encoded_as_one_text():
    sides = alignment.Sides(*alignment.read_vocabularies(*FILES))
    whole, sent = sides.a, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    rng = random.Random(7)
    units = list(dict.fromkeys(rng.choice(["", "É", "日本", "<|endoftext|>", "a\nb", "don't", "x\u0301"]) + f"{rng.randrange(10**6)}z" for _ in range(2000)))
    odd = ["  two", "end ", "\n", "\u00a0y", " "]  # their blanks would not be lone
    sides.a = Counting()
    for some in (units, units[:300] + odd + units[300:]):
        sent.clear()
        a, b, right = sides._encode(some)
        alone = [whole.encode(" " + x, add_special_tokens=False).ids for x in some]
        assert [x for x, ok in zip(a, right) if ok] == [x for x, ok in zip(alone, right) if ok]
        assert right[: len(units[:300])].all() and len(sent) < len(some) / 4


def test_alignment_of_long_texts(corpus, prose):
    rng = random.Random(5)
    long = "".join(rng.choice([" ", "  ", "\n", " ", " ", ""]) + rng.choice(["word", "É", "don't", "42", "🙂", ",", "xyz"]) for _ in range(1500)).strip()
    rows = [(1, long), (2, "y" * 5000), (3, prose(3, 300))]
    assert aligned(alignment.align(corpus([(*r, None, None) for r in rows]), *FILES, part_bytes=16)) == align_brute(rows)


def test_alignment_of_nothing_and_of_no_text(spark, corpus):
    assert alignment.align(corpus([]).limit(0), *FILES).collect() == []
    docs = spark.createDataFrame([(1, bytearray(b"\xff\xfe broken")), (2, None)], "doc_id long, text binary")
    docs = docs.select("doc_id", F.expr("cast(text as string)").alias("text"))
    assert aligned(alignment.align(docs, *FILES)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_link_of_every_document_is_a_row_of_a_block(corpus):
    docs = corpus([(k, "the same words", None, None) for k in range(500)]).coalesce(2)
    encoded = alignment.blocks(docs, alignment.read_vocabularies(*FILES), block_bytes=2000)
    counts = alignment.link_counts(encoded).collect()
    assert all(r["count"] % 500 == 0 for r in counts)
    assert encoded.select(F.sum(F.size("links"))).first()[0] == encoded.count() * len(counts)


# ---- hard negatives ----
def mined_brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [max(-(1 << 24), min(1 << 24, math.floor(scale * x))) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for i, (label, v) in kept.items():
        if i % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, (other, w) in kept.items() if j != i and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scores if x[2] == label)[:positives]:
            fit = sorted(x for x in scores if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit[:negatives])]
    return sorted(out)


def mined(spark, rows, **blocks):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit("x")).withColumn("slot", F.lit(1))
    df = negatives.quantised(df, "vec_id", F.col("label"), "embedding")
    found = negatives.hard_negatives(df, df.filter("id % 50 = 0"), **blocks)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


def vectors(seed, n, size=4, labels=4, spread=0.2):
    rng = random.Random(seed)
    return [(k, 0 if rng.random() < 0.4 else rng.randrange(labels), [rng.choice([0.0, 0.25, 0.5, 1.0]) if k % 3 else rng.gauss(0.3, spread) for _ in range(size)]) for k in range(n)]


def test_hard_negatives(spark):
    rows = [(i, label, np.array(v, "f4").tolist()) for i, label, v in vectors(1, 900)]
    want = mined_brute(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, row_block=100, anchor_block=5) == want


def test_hard_negatives_awkward_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(k, k % 3, [0.5, 0.25, 1.0]) for k in range(0, 120)]  # ties everywhere
    rows += [(200, None, [1.0, 1.0, 1.0]), (201, 1, None), (202, 1, [1.0, None, 1.0]), (250, 1, [nan, 1.0, 1.0]), (300, 1, [inf, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0])]
    rows += [(350, 1, [0.0, 0.0, 0.0]), (400, 2, [-1.0, -1.0, -1.0]), (450, 1, []), (451, 2, []), (500, 1, [1.0]), (501, 1, [2.0]), (502, 2, [1.5])]
    rows += [(600, 1, [1e9, 1.0, 1.0]), (601, 1, [1e9, 1.0, 0.0]), (602, 2, [6e4, 0.5, 0.5]), (50, 1, [0.75, 0.25, 1.0]), (51, 2, [0.5, 0.25, 0.5]), (51, 2, [0.5, 0.25, 0.5])]
    assert mined(spark, rows) == mined_brute(rows) != []
    assert mined(spark, rows[:0]) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(50, 1, [1.0])]) == []


def test_what_leaves_the_tasks_does_not_grow_with_the_windows(spark):
    """A thousand rows in every window, and three rows a slot leave a cell."""
    rows = [(k, 1, [1.0, 0.0]) for k in range(0, 300, 50)] + [(k + 1000, 2, [0.75, 0.0]) for k in range(1000)]
    cell = negatives._slots_cell(3)
    anchors = pa.table({"id": [0, 50], "label": [1, 1], "v": pa.array([[256, 0]] * 2, pa.list_(pa.int32())), "limits": [[62259, 32767]] * 2})
    others = pa.table({"id": [r[0] for r in rows[6:]], "label": [2] * 1000, "v": pa.array([[192, 0]] * 1000, pa.list_(pa.int32()))})
    assert cell(anchors, others).num_rows == 6
    assert mined(spark, rows) == mined_brute(rows)
