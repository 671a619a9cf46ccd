"""Mixing sources to target weights: token totals a source, repetition rates, whole copies plus one drawn copy.

A document's size is its number of words (runs of characters other than space and 0x09-0x0D). Sources are put in order of code point, null
last, and take ``weights`` in turn. ``share`` times all words are dealt out by weight; a source's target stops at ``cap`` times its words, and
what is over is dealt again among the others until no target is above its stop. Each round of that is one aggregation over the
table of sources, and every round but the last stops at least one more source. With ``share`` beyond ``cap`` all sources stop.

Rate = target / words of the source. A document is emitted floor(rate) times, and once more if its draw is below the fraction of the rate.
The draw is 52 bits of the md5 of seed and doc_id, so it needs no shuffle, is the same in every run and does not depend on how rows lie;
a source's words come out at its target in expectation.

The texts are scanned twice, once for the totals, once to emit; only totals are shuffled. A hot source is summed in the tasks first, and the rows
meet the table of sources in a join whose form Spark picks by that table's size.

Null and empty texts have size 0. A null source is a source. Rows without doc_id draw by their text; repeated rows of a doc_id (or
equal texts without one) share a draw and so come and go together. A source without words has target and rate 0, its documents go. Very long
texts are counted by replacement in place, without a list of words. An empty table gives an empty result. Other columns pass through as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.quantiles import running_total
from lakegauge.llm.staging import staged

_GAP = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words of a text, null: none. Gaps at the ends go first, so that each match is a word with the gap behind it."""
    inner = F.btrim(text, F.lit(_GAP))
    return F.coalesce(F.length(F.regexp_replace(inner, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1 (excluded) from the hash of seed and id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text.cast("binary"))), F.lit("none"))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed} "), name).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) of the rows (source, size)."""
    if not weights or min(weights) <= 0 or share < 0 or cap < 0:
        raise ValueError("weights are positive, share and cap are not negative")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
    ranked = running_total(totals, "one", [F.col("source").asc_nulls_last()], "rank")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    sources = staged(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("stop")), "sources")

    every = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget = share * (every["words"] or 0)
    level, stopped = budget / (every["weight"] or 1.0), 0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("stop")
        found = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("stop"))), F.lit(0.0)).alias("given"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n"),
        ).first()
        if found["n"] == stopped or not found["open"]:
            break
        level, stopped = (budget - found["given"]) / found["open"], found["n"]
    return sources.select("source", "source_size", "weight", F.least(F.col("weight") * F.lit(level), F.col("stop")).alias("target"))


def repetitions(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """``row`` (the input row), ``size``, ``source_size``, ``target`` (both of its source) and ``copies`` of each row of docs (doc_id, text, source, ...)."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    targets = source_targets(docs.select(source.alias("source"), word_count(text).alias("size")), weights, share, cap)
    targets = targets.select(F.col("source").alias("of_source"), "source_size", "target")
    sized = docs.select(F.struct("*").alias("row"), source.alias("in_source"), word_count(text).alias("size"), draw(seed, F.col("doc_id"), text).alias("drawn"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("drawn") < rate - F.floor(rate), 1).otherwise(0)
    met = sized.join(targets, F.col("in_source").eqNullSafe(F.col("of_source")))
    return met.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11) -> DataFrame:
    """The mixed corpus: every row of docs as often as it is taken."""
    taken = repetitions(docs, weights, share, cap, seed).filter("copies > 0")
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), "copies")))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
