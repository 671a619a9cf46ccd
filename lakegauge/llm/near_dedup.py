"""Near copies: circulant MinHash, banding, exact Jaccard on whole shingle sets, connected components.

A text is lower-cased (A-Z) and cut into words; its set has the distinct ``width``-word shingles, or the whole sequence as one
if there are fewer words. Two permutations give all signature coordinates: shingles are permuted once (sigma), then
coordinate k is the smallest place under the second permutation (pi) with its domain shifted circularly by k. ``rows``
coordinates make a band; documents that share a band are candidates. At a similarity of 0.8, 40 bands of 5 rows leave a pair
without a shared band once in ten million; raise ``bands`` for less.

Equal sets are one class, so copies never form pairs. Within a band's bucket not all pairs are made either: a few leaders meet the
members of other components, links merge components, used leaders leave the bucket, and the next round takes more leaders, until
every bucket holds one component or its cross pairs are all looked at. Every other round is a probe: leaders stay, and of each member only the
likeliest link of all its lists is looked at, which is one pair a member and merges a group of near copies before its pairs are looked at.
From the second round on, leaders and members meet as lists of bounded length, so a row is a block of pairs, and no leader is sent once a member; a pair leaves the task only in the first band that its two documents share (it is met there, too, as
long as they are in different components), and only if it can be a link: two bounds are held against the threshold there. One counts shingles in 256 cells
(what two sets share is at most the sum of the smaller counts, so nothing is lost); the other drops a pair if 128 one-byte
coordinates agree in so few places that a pair at the threshold would do so less than once in 10^8. Links are confirmed on the
whole sets.

Empty or null texts have an empty set and no links. Rows without doc_id stay alone, with a null component. Repeated rows of a
doc_id share their component. An empty table gives an empty result.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakegauge.llm.components import connected_components
from lakegauge.llm.staging import staged
from lakegauge.llm.words import find_words, mix64, pieces, text_buffer

_BLOCK = 1 << 18
_SKETCH = 128
_CELLS = 256
#: Leaders in a list; and of a bucket in the second round and later ones.
_LIST, _LEADERS = 32, 1024
#: Members in a list, about; and pairs that are looked at together, which scratch memory follows.
_MEMBERS, _PAIRS = 64, 1 << 12


def permute32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def sigma(x: np.ndarray) -> np.ndarray:
    return permute32(x, 0x85EBCA6B, 0xC2B2AE35)


def pi(x: np.ndarray) -> np.ndarray:
    return permute32(x, 0x7FEB352D, 0x846CA68B)


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a buffer, sorted by text, and the n + 1 offsets."""
    words = find_words(raw, bounds, 1, lower=True)
    keep = words.inside(width)
    value, doc = [words.sequences(width)[keep]], [words.doc[: len(keep)][keep]]
    count = words.count()
    for n in range(1, width):
        few = np.flatnonzero(count == n)
        if len(few):
            value.append(words.sequences(n)[words.first[few]])
            doc.append(few)
    value, doc = np.concatenate(value), np.concatenate(doc)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
        value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(bounds)))


def signatures(value: np.ndarray, start: np.ndarray, coordinates: int) -> np.ndarray:
    """(sets, coordinates) of the non-empty sets that begin at ``start``."""
    out = np.empty((len(start), coordinates), np.uint32)
    place = sigma((value >> np.uint64(32)).astype(np.uint32))
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(pi(place + np.uint32(k)), start)
    return out


def _classes_task(width: int, bands: int, rows: int):
    def task(batches):
        for batch in batches:
            raw, bounds = text_buffer(batch["text"])
            for a, b in pieces(bounds, _BLOCK):
                value, cut = shingle_sets(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                size = np.diff(cut)
                full = np.flatnonzero(size)
                key = np.zeros((2, b - a), np.uint64)
                lists, sketch = [None] * (b - a), [None] * (b - a)
                cells = np.zeros((b - a, _CELLS), np.uint8)
                if len(full):
                    start = cut[:-1][full]
                    for k in range(2):
                        key[k, full] = np.add.reduceat(mix64(value ^ np.uint64(0xA5A5F00D12345678 + k)), start)
                    sig = signatures(value, start, max(bands * rows, _SKETCH))
                    low = (sig[:, :_SKETCH] & np.uint32(0xFF)).astype(np.uint8)
                    at_cell = np.repeat(np.arange(b - a), size) * _CELLS + (value & np.uint64(_CELLS - 1)).astype(np.int64)
                    cells = np.minimum(255, np.bincount(at_cell, minlength=(b - a) * _CELLS)).astype(np.uint8).reshape(-1, _CELLS)
                    band = np.zeros((len(full), bands), np.uint64)
                    for j in range(rows):
                        band = mix64(band ^ sig[:, j : bands * rows : rows].astype(np.uint64))
                    band = mix64(band + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    for i, at in enumerate(full):
                        lists[at], sketch[at] = band[i], low[i].tobytes() + cells[at].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)),
                     pa.array(lists, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "set1", "set2", "bands", "sketch"],
                )

    return task


def _sets_task(width: int):
    def task(batches):
        for batch in batches:
            raw, bounds = text_buffer(batch["text"])
            for a, b in pieces(bounds, _BLOCK):
                value, cut = shingle_sets(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), lists], ["rep", "members"])

    return task


def _columns(rows: pa.StructArray) -> tuple[np.ndarray, ...]:
    """rep, component and n, the bands (rows, bands) and the sketch (rows, bytes) of members or leaders."""
    rep, part, n = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "n"))
    bands = rows.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(-1, _SKETCH + _CELLS)
    return rep, part, n, bands, sketch


def _possible_task(percent: int, least: int, once: bool, probe: bool):
    """Pairs of a member and a leader of another component that can be a link, from lists of both: with ``once`` in the first bucket that the
    two share, in a probe the likeliest of a member and a list."""

    def task(batches):
        for batch in batches:
            met = np.diff(batch["members"].offsets.to_numpy()).astype(np.int64) * np.diff(batch["leaders"].offsets.to_numpy())
            for at, to in pieces(np.append(0, np.cumsum(met)), _PAIRS):
                rows = batch.slice(at, to - at)
                size, size2 = (np.diff(rows[c].offsets.to_numpy()).astype(np.int64) for c in ("members", "leaders"))
                rep, part, n, bands, one = _columns(rows["members"].flatten())
                rep2, part2, n2, bands2, two = _columns(rows["leaders"].flatten())
                # Every member of a row with every leader of it.
                row = np.repeat(np.arange(len(rows)), size * size2)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(size * size2) - size * size2, size * size2)
                me, lead = (np.cumsum(size) - size)[row] + nth // size2[row], (np.cumsum(size2) - size2)[row] + nth % size2[row]
                may = (part[me] != part2[lead]) & (100 * np.minimum(n[me], n2[lead]) >= percent * np.maximum(n[me], n2[lead]))
                row, me, lead = row[may], me[may], lead[may]
                if once:
                    first = (bands[me] == bands2[lead]).argmax(axis=1)
                    here = bands2[lead, first] == rows["bucket"].to_numpy(zero_copy_only=False)[row]
                    me, lead = me[here], lead[here]
                x, y = one[me], two[lead]
                alike = (x[:, :_SKETCH] == y[:, :_SKETCH]).sum(axis=1)
                fewer = np.minimum(x[:, _SKETCH:], y[:, _SKETCH:])
                most = np.where((fewer == 255).any(axis=1), np.minimum(n[me], n2[lead]), fewer.sum(axis=1, dtype=np.int64))
                near = (alike >= least) & ((100 + percent) * most >= percent * (n[me] + n2[lead]))
                me, lead, alike = me[near], lead[near], alike[near]
                if probe and len(me):
                    order = np.lexsort((-alike, me))
                    order = order[np.append(True, np.diff(me[order]) > 0)]
                    me, lead, alike = me[order], lead[order], alike[order]
                a, b = np.minimum(rep[me], rep2[lead]), np.maximum(rep[me], rep2[lead])
                columns = [pa.array(x, pa.int64()) for x in (rep[me], alike, a, b)]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "alike", "a", "b"])

    return task


def near_copies(docs: DataFrame, width: int = 4, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = staged(
        base.mapInArrow(_classes_task(width, bands, rows), "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sketch binary"), "sets"
    )
    named = each.filter("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("set1", "set2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = staged(classes, "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("bucket")
    members = staged(banded.join(shared, "bucket"), "buckets")
    wanted = members.select("rep").distinct()
    texts = base.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi").withColumnRenamed("rep", "doc_id")
    sets = staged(texts.mapInArrow(_sets_task(width), "rep long, members array<long>").dropDuplicates(["rep"]), "members")

    share = percent / 100 + (1 - percent / 100) / 256
    least = int(_SKETCH * share - 6 * sqrt(_SKETCH * share * (1 - share)))
    component = _link_rounds(members, classes.select("rep", "n", "sketch", "bands"), sets, percent, least)
    found = each.drop("bands", "sketch").join(classes.select("set1", "set2", "rep"), ["set1", "set2"], "left")
    found = found.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    name = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    name = F.when(F.col("doc_id").isNotNull(), name)
    return found.select("doc_id", "n_shingles", name.alias("component_id"), F.coalesce(F.col("doc_id") == name, F.lit(True)).alias("kept"))


def _link_rounds(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Components over the confirmed links of all buckets (bucket, rep)."""
    spark = members.sparkSession
    tested = spark.createDataFrame([], "a long, b long")
    component = spark.createDataFrame([], "node long, component long")
    leaders, probe = 1, False
    while True:
        now = members.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        sizes = now.groupBy("bucket", "component").count()
        main = (
            sizes.groupBy("bucket")
            .agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("main"), F.count("*").alias("parts"), F.sum("count").alias("crowd"))
            .filter("parts > 1").drop("parts")
        )
        now = staged(now.join(main, "bucket"), "round")
        if now.isEmpty():
            return component
        once = leaders > 1 and not probe
        # Only the search for the first bucket that two share reads the bands, nearly half of a row.
        known = now.join(classes if once else classes.withColumn("bands", F.array().cast("array<bigint>")), "rep")
        order = Window.partitionBy("bucket").orderBy("rep")
        lead = known.filter("component <> main").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= leaders)
        one = F.struct("rep", "component", "n", "sketch", "bands")
        lists = lead.groupBy("bucket", F.floor(F.col("place") / _LIST).alias("list")).agg(F.collect_list(one).alias("leaders"))
        if leaders == 1:
            met = known.select("bucket", F.array(one).alias("members"))
        else:  # members meet many leaders: lists meet lists, so rows and bytes do not multiply
            part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("crowd") / _MEMBERS)).alias("part")
            met = known.groupBy("bucket", part).agg(F.collect_list(one).alias("members"))
        met = met.join(lists, "bucket").select("bucket", "members", "leaders")
        pairs = met.mapInArrow(_possible_task(percent, least, once, probe), "rep long, alike long, a long, b long")
        if probe:
            pairs = pairs.groupBy("rep").agg(F.max(F.struct("alike", "a", "b")).alias("best")).select("best.a", "best.b")
        pairs = pairs.select("a", "b").distinct()
        near = pairs.join(tested, ["a", "b"], "left_anti")
        near = near.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b")), "b")
        near = near.join(sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), "a")
        common = F.size(F.array_intersect("set_a", "set_b"))
        new = near.withColumn("common", common).select(
            "a", "b", (100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).alias("linked")
        )
        new = staged(new, "tested")
        tested = tested.union(new.select("a", "b"))
        linked = new.filter("linked").select("a", "b")
        if not linked.isEmpty():
            component = staged(connected_components(component.toDF("a", "b").union(linked)), "components")
        if not probe:
            members = now.join(lead.select("bucket", "rep"), ["bucket", "rep"], "left_anti").select("bucket", "rep")
        leaders, probe = _LEADERS, not probe


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, once. Rows without doc_id stay."""
    kept = near_copies(docs, width, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"))
    best = Window.partitionBy("id").orderBy("tie")
    rows = rows.join(kept, "id", "left_semi").withColumn("place", F.row_number().over(best)).filter("place = 1")
    named = rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
