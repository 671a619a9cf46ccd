import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names the operators use inside.
CLASHING = ("row", "key", "rep", "bucket", "block", "cluster", "score", "words", "h1", "place", "id", "lines", "first", "shard")


@pytest.fixture(scope="session")
def corpus(spark):
    """rows -> documents with columns that clash; rows: (doc_id, text[, lang, source])."""

    def make(rows):
        full = [(*r, *(None, None)[len(r) - 2 :])[:4] for r in rows]
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in full]
        df = spark.createDataFrame(full, SCHEMA)
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts from a small vocabulary, from a seed."""

    def make(seed, words, vocabulary=400, lines=1):
        rng = random.Random(seed)
        body = [f"w{rng.randrange(vocabulary)}x" for _ in range(words)]
        cuts = sorted(rng.sample(range(1, words), lines - 1)) if lines > 1 else []
        return "\n".join(" ".join(body[a:b]) for a, b in zip([0, *cuts], [*cuts, words]))

    return make


@pytest.fixture(scope="session")
def mixed(prose):
    """A few documents with every awkward case: null, empty and long texts, copies, near copies, repeated rows, ids out of order, no id."""
    base = prose(1, 120, lines=6)
    long = prose(2, 6000, vocabulary=3000, lines=40)
    near = base.replace("w1", "v1", 1)
    return [
        (7, base, "en", "a"), (3, base, "en", "a"), (9, near, "de", "a"), (9, near, "de", "a"), (12, None, "en", "a"), (4, "", "de", None),
        (5, "   \n\t ", None, "b"), (20, long, "de", "a"), (21, long + " tail", "de", "b"), (30, "12 34 !!", "en", "a"), (31, "Ünï çödé 日本", "de", "b"),
        (None, base, "en", "a"), (None, None, None, None), (40, prose(3, 60, lines=3), "en", "a"), (41, "one two", "en", "a"), (42, "ONE two", "en", "c"),
    ]
