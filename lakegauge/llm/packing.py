"""Best-fit packing of documents into sequences of fixed length, without two documents of a source or of a duplicate cluster.

Lengths are words. A document longer than a sequence is cut: its full pieces fill sequences alone, the rest is packed like a short
document, so no word is lost. The rest pieces are taken longest first (ties: smaller doc_id). Open bins are held in order of
what is left in them, each with a bitmap of its sources and one of its duplicate clusters. The search starts at the first bin
with enough room and goes on to the next larger ones until one has neither the document's source nor its cluster: the tightest
compatible bin. Without one, a new bin opens.

Rows are dealt by a hash of doc_id into blocks of about ``block_rows``; each block is packed by itself and reads no texts. Bins are
local to a block, so conflicts are, too, and neither a large source nor a large cluster is ever gathered.

A null source or cluster conflicts with nothing. A text without words takes up no room but a place in a bin. Repeated rows
are packed each; they share a cluster, so never a bin. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OUT = "doc_id long, piece int, start long, n_words long, bin string, place int, conflict_source string, cluster long"
_ARROW = pa.schema(
    {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "n_words": pa.int64(), "bin": pa.string(), "place": pa.int32(),
     "conflict_source": pa.string(), "cluster": pa.int64()}
)


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """Bin of each item (size, source bitmap, cluster bitmap), in the order given; no size exceeds the capacity."""
    room: list[int] = []  # what is left in the bins, ascending
    bins: list[int] = []  # the bins in that order
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        at = bisect_left(room, size)
        while at < len(bins) and (sources[bins[at]] & source or clusters[bins[at]] & cluster):
            at += 1
        if at < len(bins):
            own, left = bins.pop(at), room.pop(at) - size
            sources[own] |= source
            clusters[own] |= cluster
        else:
            own, left = len(sources), capacity - size
            sources.append(source)
            clusters.append(cluster)
        at = bisect_left(room, left)
        room.insert(at, left)
        bins.insert(at, own)
        out.append(own)
    return out


def _bitmaps(values: list) -> list[int]:
    """A bit for each value that occurs twice or more; no bit for the others and for nulls."""
    often = sorted(v for v, n in Counter(values).items() if n > 1 and v is not None)
    bit = {v: 1 << k for k, v in enumerate(often)}
    return [bit.get(v, 0) for v in values]


def _pack_block(capacity: int):
    def pack_table(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        docs, source, cluster, size = (table[c].to_pylist() for c in ("doc_id", "source", "cluster", "size"))
        rest = [n % capacity or min(n, capacity) for n in size]
        order = sorted(range(len(docs)), key=lambda i: (-rest[i], docs[i] is None, docs[i] or 0, size[i], cluster[i] or 0, source[i] or ""))
        of_source, of_cluster = _bitmaps(source), _bitmaps(cluster)
        bins = best_fit([(rest[i], of_source[i], of_cluster[i]) for i in order], capacity)
        following = max(bins, default=-1) + 1
        filled: Counter = Counter()
        out: list[tuple] = []
        for i, own in zip(order, bins):
            full = (size[i] - rest[i]) // capacity
            out += [(docs[i], k, k * capacity, capacity, f"{key[0]}-{following + k}", 0, source[i], cluster[i]) for k in range(full)]
            following += full
            out.append((docs[i], full, full * capacity, rest[i], f"{key[0]}-{own}", filled[own], source[i], cluster[i]))
            filled[own] += 1
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return pack_table


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0))


def same_text(text: Column) -> Column:
    """Cluster of copies: a hash of the lower-cased text with runs of blanks made one."""
    return F.when(text.isNotNull(), F.xxhash64(F.regexp_replace(F.lower(F.trim(text)), "[\\x20\\x09-\\x0D]+", " ")))


def pack(docs: DataFrame, capacity: int = 2048, block_rows: int = 8192, cluster: Column | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text, source): doc_id, piece, start, n_words, bin, place, conflict_source, cluster.

    ``cluster`` is a long column of docs that names duplicate clusters; by default equal texts are one.
    """
    text = F.col("text").cast("string")
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (same_text(text) if cluster is None else cluster.cast("long")).alias("cluster"), word_count(text).cast("long").alias("size"),
    )
    blocks = 1 + docs.count() // block_rows
    light = light.withColumn("block", F.pmod(F.xxhash64("doc_id", "cluster", "size"), F.lit(blocks)))
    return light.groupBy("block").applyInArrow(_pack_block(capacity), _OUT)
