"""Hard negatives for contrastive training: rows of another label whose score lies in a window below a positive's.

Components become floor(``scale`` * x); a score is the integer inner product with the anchor. An anchor's positives are its first
``positives`` other rows of its label; a positive with score s takes the first ``negatives`` rows of other labels with a score from
ceil(low * s / 100) to floor(high * s / 100) (``low``, ``high`` in percent). First means higher scores, then smaller ids.

Windows of one anchor overlap, so they are not searched one by one. The distinct upper limits of its positives, in descending order, cut the
scores into disjoint slots: slot j holds scores up to limit j and above limit j + 1, the last one down to the lowest lower limit. A row
falls into one slot. The first rows of each slot are kept by combiners: in the task, then in a window whose group limit prunes before the
shuffle. A window's answer is then the first rows of its slot and all slots below, merged in descending order, above its lower limit. What leaves
the tasks for an anchor depends on slots and ``negatives``, not on how many rows lie in its windows.

All anchors meet all rows in a grid of cells: rows are dealt into blocks by a hash of their id, anchors too, and a cell is one block of either. A
row travels once for each anchor block (``anchor_block`` anchors) and an anchor once for each row block (``row_block`` rows), so
a cell's memory is bounded and nothing passes through the driver but counts. Labels play no part in the dealing, so a hot label is spread.

Rows with a null id, label or vector, or any null or non-finite component, take no part. Rows are told apart by their id: of repeated rows the
one with the smallest label, then vector, counts. Vectors of different length do not meet. An empty vector scores 0. Components are cut to +-2^24 after scaling, so that scores
fit into long at any realistic length; sums beyond 2^53 are taken in integers. Windows of negative scores are empty. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegauge.llm.staging import staged

_MOST = 1 << 24
#: Scores of a step of a cell, so that scratch matrices stay small.
_STEP = 1 << 20
_LEAST = np.iinfo(np.int64).min


def quantised(rows: DataFrame, id: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """(id, label, v) of the rows that take part, one for each id."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = rows.filter(F.col(id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & ~odd)
    most = float(_MOST)
    component = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(float(scale)) * x.cast("double")))).cast("int"))
    kept = part.select(F.col(id).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), component.alias("v")).alias("kept"))
    return kept.groupBy("id").agg(F.min("kept").alias("kept")).select("id", "kept.label", "kept.v")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _first(scores: np.ndarray, allowed: np.ndarray, count: int):
    """The ``count`` highest allowed scores of each line, the leftmost of equal ones first: (line, column) pairs."""
    left = np.where(allowed, scores, _LEAST)
    line = np.arange(len(left))
    found = []
    for _ in range(min(count, left.shape[1])):
        best = left.argmax(axis=1)
        there = left[line, best] != _LEAST
        if not there.any():
            break
        found.append((line[there], best[there]))
        left[line, best] = _LEAST
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _by_length(anchors: pa.Table, rows: pa.Table, order: list):
    """Anchors and rows of a cell with vectors of one length, rows in the given order, and the two matrices."""
    length = [np.diff(t["v"].combine_chunks().offsets.to_numpy()) for t in (anchors, rows)]
    for n in np.intersect1d(*length):
        some, others = (t.filter(pa.array(size == n)).sort_by(order) for t, size in zip((anchors, rows), length))
        yield some, others, *(_matrix(t["v"]) if n else np.zeros((len(t), 1), np.int32) for t in (some, others))


def _steps(anchors: int, rows: int):
    step = max(1, _STEP // max(1, rows))
    return ((at, min(anchors, at + step)) for at in range(0, anchors, step))


def _positives_cell(count: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        for some, others, a, b in _by_length(anchors, rows, [("label", "ascending"), ("id", "ascending")]):
            me, id, mine, theirs = (t[c].to_numpy() for c in ("id", "label") for t in (some, others))
            for label in np.intersect1d(mine, theirs):
                (i, j), (k, n) = (np.searchsorted(x, [label, label + 1]) for x in (mine, theirs))
                for at, to in _steps(j - i, n - k):
                    at, to = i + at, i + to
                    scores = _products(a[at:to], b[k:n])
                    line, column = _first(scores, me[at:to, None] != id[k:n], count)
                    out.append((me[at + line], id[k + column], scores[line, column]))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["anchor_id", "positive_id", "positive_score"])

    return cell


def _slots_cell(count: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        for some, others, a, b in _by_length(anchors, rows, [("id", "ascending")]):
            me, id, mine, theirs = (t[c].to_numpy() for c in ("id", "label") for t in (some, others))
            limits = some["limits"].to_pylist()  # upper limits in descending order, then the score below the last slot
            width = max(map(len, limits))
            limits = np.array([x + x[-1:] * (width - len(x)) for x in limits], np.int64)
            for at, to in _steps(len(me), len(id)):
                scores = _products(a[at:to], b)
                other = mine[at:to, None] != theirs
                for slot in range(width - 1):
                    upper, lower = limits[at:to, slot, None], limits[at:to, slot + 1, None]
                    line, column = _first(scores, other & (scores <= upper) & (scores > lower), count)
                    out.append((me[at + line], np.full(len(line), slot), id[column], scores[line, column]))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["anchor_id", "slot", "negative_id", "negative_score"])

    return cell


def _grid(anchors: DataFrame, rows: DataFrame, across: int, down: int, cell, schema: str) -> DataFrame:
    """``cell`` of every block of anchors (of ``across``) with every block of rows (of ``down``)."""

    def dealt(df: DataFrame, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition(across * down, "block", "row_block")

    left = dealt(anchors, "block", across, "row_block", down)
    right = dealt(rows, "row_block", down, "block", across)
    return left.groupBy("block", "row_block").cogroup(right.groupBy("block", "row_block")).applyInArrow(cell, schema)


def _head(df: DataFrame, keys: list[str], score: str, id: str, count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(id))
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count).drop("place")


def _percent(score: str, percent: int, up: bool) -> Column:
    """percent of a score that is not negative, in whole numbers, without a product that could leave long."""
    whole, rest = F.floor(F.col(score) / F.lit(100).cast("decimal(3,0)")).cast("long"), F.col(score) % 100
    return whole * percent + F.floor((rest * percent + (99 if up else 0)) / 100).cast("long")


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    row_block: int = 1 << 16, anchor_block: int = 1 << 14,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, for rows (id, label, v) as ``quantised`` gives them and
    the anchors among them. ``low`` and ``high`` are whole percents, 0 <= low <= high."""
    if not 0 <= low <= high:
        raise ValueError("0 <= low <= high")
    rows, anchors = staged(rows, "vectors"), staged(anchors, "anchors")
    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism
    n, m = rows.count(), anchors.count()
    down = max(1, ceil(n / row_block), min(spread, ceil(n / 1024)))
    across = max(1, ceil(m / anchor_block))

    near = _grid(anchors, rows, across, down, _positives_cell(positives), "anchor_id long, positive_id long, positive_score long")
    near = _head(near, ["anchor_id"], "positive_score", "positive_id", positives).filter("positive_score >= 0")
    near = near.withColumns({"lowest": _percent("positive_score", low, True), "highest": _percent("positive_score", high, False)})
    near = staged(near.filter("lowest <= highest"), "positives")
    limits = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.concat(F.sort_array(F.collect_set("highest"), asc=False), F.array(F.min("lowest") - 1)).alias("limits")
    )
    found = _grid(
        anchors.join(limits, "id"), rows, across, down, _slots_cell(negatives), "anchor_id long, slot long, negative_id long, negative_score long"
    )
    found = _head(found, ["anchor_id", "slot"], "negative_score", "negative_id", negatives)
    descending = F.sort_array(F.collect_list(F.struct((-F.col("negative_score")).alias("below"), "negative_id", "slot")))
    found = found.groupBy("anchor_id").agg(descending.alias("found"))
    named = near.join(found, "anchor_id").join(limits.withColumnRenamed("id", "anchor_id"), "anchor_id")
    slot = F.array_position("limits", F.col("highest")) - 1
    suffix = F.slice(F.filter("found", lambda x: x["slot"] >= slot), 1, negatives)
    answer = F.filter(suffix, lambda x: -x["below"] >= F.col("lowest"))
    each = named.select("anchor_id", "positive_id", "positive_score", F.posexplode(answer).alias("at", "one"))
    return each.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.negative_id").alias("negative_id"),
        "positive_score", (-F.col("one.below")).alias("negative_score"),
    )
