"""Shards from a weighted hash tree.

Shards are the leaves of a tree of regions, racks and shards. A document descends it: at every node each child draws
``ln(u) / weight`` with u from a hash of the document's id, the child and the level, and the largest draw wins. A child's weight
is the number of shards below it (times their weights). Draws of other children do not change when one child's weight does,
so rows only move into or out of subtrees whose weights changed. A shard that opens a region of its own takes rows
only into itself; one that joins a rack takes rows into its rack.

Law ``key``: doc_id and the tree decide. Rows without doc_id share the draw of the text "null". Repeated rows share the shard
and get slots of their own. A null text has no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of one numbering block; blocks grow in number, not in size.
BLOCK_ROWS = 1 << 16


def tree(shards: int, per_rack: int = 4, racks: int = 3) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight of an even tree; shard numbers fill racks, then regions."""
    out: dict[int, dict[int, dict[int, float]]] = {}
    for shard in range(shards):
        rack = shard // per_rack
        out.setdefault(rack // racks, {}).setdefault(rack, {})[shard] = 1.0
    return out


def _draw(key: Column, level: str, child: int, weight: float) -> Column:
    """ln(u) / weight, u from the first 52 bits of an MD5 digest; never 0."""
    digest = F.md5(F.concat_ws("/", key, F.lit(level), F.lit(str(child))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.log(u) / weight


def _winner(key: Column, level: str, children: dict[int, float]) -> Column:
    draws = [F.struct(_draw(key, level, child, weight).alias("draw"), F.lit(-child).alias("child")) for child, weight in children.items()]
    return -(F.greatest(*draws) if len(draws) > 1 else draws[0])["child"]


def descend(key: Column, nodes: dict[int, dict[int, dict[int, float]]]) -> Column:
    """The shard of a key (a string column)."""
    def total(node):
        return float(sum(map(total, node.values()))) if isinstance(node, dict) else float(node)

    def choose(level: str, node: dict, below):
        best = _winner(key, level, {child: total(sub) for child, sub in node.items()})
        if below is None:
            return best
        out = None
        for child, sub in node.items():
            value = below(sub)
            out = F.when(best == child, value) if out is None else out.when(best == child, value)
        return out

    return choose("region", nodes, lambda racks: choose("rack", racks, lambda leaves: choose("shard", leaves, None))).cast("int")


def assign_shards(docs: DataFrame, shards: int = 24, per_rack: int = 4, racks: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        descend(key, tree(shards, per_rack, racks)).alias("shard"),
        descend(key, tree(shards + 1, per_rack, racks)).alias("grown_shard"),
    )
    blocks = 1 + docs.count() // (BLOCK_ROWS * shards)
    return number_slots(placed, blocks).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def number_slots(placed: DataFrame, blocks: int) -> DataFrame:
    """Adds ``slot``, gapless from 0 within a shard: rows are ordered inside (shard, block) only, block sizes give the offsets."""
    split = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")
    return (
        split.withColumn("place", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "block"])
        .withColumn("slot", (F.col("offset") + F.col("place")).cast("long")).drop("place", "offset", "block")
    )


def write_shards(docs: DataFrame, path: str, **tree_shape: int) -> None:
    """Writes the documents below ``path``, one folder a shard, by the shard of their doc_id."""
    shape = {"shards": 24, "per_rack": 4, "racks": 3} | tree_shape
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    docs.withColumn("shard", descend(key, tree(**shape))).write.partitionBy("shard").parquet(path)
