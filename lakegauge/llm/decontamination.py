"""Benchmark items in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact verification. DataFrame functions only.

Words are lower-cased runs of letters and digits; shingles are ``width`` of them. A window has as many words as an item. Its
similarity to the item is the weighted Jaccard of their shingles, weighted by how often they occur:
sum of the smaller weights / sum of the larger ones.

* Windows. Only a window that shares shingles with an item can be similar to it. So shingles at every ``stride``-th word of the
  documents are looked up among the items' shingles, which picks the documents. The stride is computed from the items: a window at the
  threshold has so few foreign shingles that some run of shared ones is at least that long, whatever was replaced or moved. In the picked
  documents all places of an item's shingles are found. A window counts if it has as many of them as the threshold needs, in any
  order, and ends with one or lies at the beginning: of all windows of the document, the earliest of the best is among these, since
  one that ends with a foreign shingle can move back without loss.
* SimHash. Each of 64 bits of a window is the majority of that bit among its shingles' hashes. Equal windows are one from here on.
* Multi-index. Fingerprints are cut into ``radius`` + 1 blocks; two of them that differ in at most ``radius`` bits agree in a whole block.
  Windows and items of equal size that agree in a block are compared in full, and none within the radius is missed.
* What is left is verified exactly.

Null and empty texts have no windows. Items with fewer than ``width`` words have no shingles and are not looked for. Rows without doc_id are
found like others (their doc_id is null in the result). Repeated rows give the same answer once. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.llm.staging import staged

#: Rows of the benchmark's tables up to which they are sent to every executor; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def shingles_of(words: Column, width: int, stride: int = 1) -> Column:
    """Hashes of the shingles that begin at every stride-th word; none if there are fewer words than ``width``."""
    starts = F.sequence(F.lit(0), F.size(words) - width, F.lit(stride))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64 bits; each is set if more than half of the hashes have it."""
    def bit(b: Column) -> Column:
        ones = F.aggregate(shingles, F.lit(0), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)).cast("int"))
        return F.when(ones * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles, each weighted by how often it occurs."""
    def times(x: Column, v: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == v))

    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(times(a, v), times(b, v)))
    return common / (F.size(a) + F.size(b) - common)


def blocks_of(fingerprint: Column, blocks: int) -> Column:
    """The fingerprint's stretches of bits, numbered; as even as 64 bits allow."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return F.array(
        *[
            F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def safe_stride(size: Column, width: int, threshold: float) -> Column:
    """Length of the run of shared shingles that a window of so many words must have to be similar."""
    m = size - width + 1
    shared = needed_shingles(size, width, threshold)
    return F.greatest(F.lit(1), F.ceil(shared / (m - shared + 1))).cast("int")


def needed_shingles(size: Column, width: int, threshold: float) -> Column:
    """Shingles that a window of so many words must share with an item of as many to be similar."""
    return F.ceil((size - width + 1) * (2 * threshold / (1 + threshold)) - 1e-9).cast("int")


def window_starts(places: Column, shingles: Column, needed: Column) -> Column:
    """Starts of the windows of so many shingles that have ``needed`` of the places (sorted) and end with one or lie at the beginning."""
    def start(i: Column) -> Column:
        first = F.get(places, i) - shingles + 1
        return F.when(F.get(places, i - needed + 1) >= first, F.greatest(first, F.lit(0)))

    ends = F.when(F.size(places) >= needed, F.sequence(needed - 1, F.size(places) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.array_compact(F.transform(ends, start)))


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 21) -> DataFrame:
    """doc_key, doc_id, item_id, start, n_words, similarity: the best window of each document for each item it has.

    ``doc_key`` is a hash of doc_id and text. ``start`` counts words; of equally good windows the earliest is given.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text").cast("string")).alias("words"))
    items = items.withColumn("n", F.size("words")).filter(F.col("n") >= width)
    items = staged(items.select("item_id", "n", shingles_of(F.col("words"), width).alias("item_shingles")), "items")
    stride, rows = items.agg(F.min(safe_stride(F.col("n"), width, threshold)), F.sum(F.size("item_shingles"))).first()
    small = (rows or 0) <= BROADCAST_ROWS

    def sent(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small else table

    base = keyed(docs)
    known = items.select("item_id", "n", F.explode("item_shingles").alias("shingle")).distinct()
    some = base.withColumn("words", words_of(F.col("text"))).select("doc_key", F.explode(shingles_of(F.col("words"), width, stride or 1)).alias("shingle"))
    hits = some.join(sent(known.select("shingle").distinct()), "shingle").select("doc_key").distinct()
    picked = staged(base.join(hits, "doc_key").dropDuplicates(["doc_key"]), "picked").withColumn("words", words_of(F.col("text")))
    each = picked.select("doc_key", F.size("words").alias("total"), F.posexplode(shingles_of(F.col("words"), width)).alias("place", "shingle"))
    met = each.join(sent(known), "shingle").filter("n <= total").groupBy("doc_key", "item_id", "n").agg(F.sort_array(F.collect_list("place")).alias("places"))
    starts = window_starts(F.col("places"), F.col("n") - width + 1, needed_shingles(F.col("n"), width, threshold))
    placed = met.select("doc_key", "n", F.explode(starts).alias("start")).groupBy("doc_key").agg(F.collect_set(F.struct("start", "n")).alias("windows"))

    texts = picked.join(placed, "doc_key")
    cut = F.transform("windows", lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), F.slice(F.col("words"), w["start"] + 1, w["n"]).alias("own")))
    windows = texts.select("doc_key", "doc_id", F.explode(cut).alias("w")).select("doc_key", "doc_id", "w.*")
    windows = windows.withColumn("content", F.xxhash64("own"))
    windows = staged(windows.withColumn("shingles", shingles_of(F.col("own"), width)).drop("own"), "windows")

    unique = windows.select("n", "content", "shingles").dropDuplicates(["n", "content"]).withColumn("print", simhash(F.col("shingles")))
    unique = staged(unique, "prints")
    of_items = items.withColumn("item_print", simhash(F.col("item_shingles")))
    left = unique.select("n", "content", "print", F.inline(blocks_of(F.col("print"), radius + 1)))
    right = of_items.select("n", "item_id", "item_print", F.inline(blocks_of(F.col("item_print"), radius + 1)))
    near = left.join(sent(right), ["n", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    near = near.select("n", "content", "item_id").distinct()
    near = near.join(unique, ["n", "content"]).join(sent(items.drop("n")), "item_id")
    near = near.select("n", "content", "item_id", similarity(F.col("shingles"), F.col("item_shingles")).alias("similarity")).filter(F.col("similarity") >= threshold)
    found = windows.drop("shingles").join(near, ["n", "content"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best")
    return found.groupBy("doc_key", "doc_id", "item_id").agg(best).select(
        "doc_key", "doc_id", "item_id", (-F.col("best.back")).cast("long").alias("start"), F.col("best.n").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity")
    )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_key, doc_id, text."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc_id, text).alias("doc_key"), doc_id.alias("doc_id"), text.alias("text"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    found = contaminated_windows(docs, benchmark).select("doc_key").distinct()
    row = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("doc_key"))
    return row.join(found, "doc_key", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
