"""Quality scores from preferences: a Bradley-Terry model over text features.

Features describe form only: shares of kinds of bytes and words, repetition, line shape, length. Texts of label 1 are set against texts
of label 0; the chance that one is preferred is the logistic function of the difference of their scores, a score being a weighted sum
of features. Weights minimise the logistic loss over the feature differences (ridge, Newton steps). The score quantile at the share of
label 0 becomes the threshold: scores are shifted so that it comes out as ``cut``, and the logistic function brings them to 0 .. 1.

Learned from all rows with a label whose id is not held out. Rows are numbered within their label in the order of a hash of their ids and
dealt by number into cells, each with at least ``rivals`` rows of the rarer label (all, if fewer) and an equal part of the other. All rows of
label 1 in a cell meet all of label 0, so every row takes part. Cells with a long part of the commoner label are cut into stretches of it. Cells are
written once; a Newton step is a scan of them that brings one gradient and one Hessian a task to the driver. Means, deviations and the threshold
(an exact quantile) are of all rows, too. Sums are rounded to ten digits before use, so that the order of tasks does not show in the scores.

Null labels are ignored. A null or empty text has the features 0. With one kind of label only, all scores are that label; without any, 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.quantiles import exact_percentiles
from lakegauge.llm.language_id import held_out
from lakegauge.llm.staging import staged
from lakegauge.llm.words import find_words, pieces, text_buffer

_BLOCK = 1 << 19
#: Pairs of texts compared at once.
_PAIRS = 1 << 16
#: Kinds of bytes; bytes of longer code points are letters of their own kind.
_KINDS = ("lower", "upper", "wide", "digit", "blank", "newline", "stop", "bang", "bar", "sign")
_KIND = np.full(256, _KINDS.index("sign"), np.int64)
for _kind, _bytes in (
    ("lower", range(0x61, 0x7B)), ("upper", range(0x41, 0x5B)), ("wide", range(0x80, 0x100)), ("digit", range(0x30, 0x3A)),
    ("blank", (0x20, 0x09, 0x0B, 0x0C, 0x0D)), ("newline", (0x0A,)), ("stop", b".,;:?'\"()-"), ("bang", b"!"), ("bar", b"|"),
):
    _KIND[list(_bytes)] = _KINDS.index(_kind)

FEATURES = tuple(f"bytes_{k}" for k in _KINDS) + (
    "log_words", "word_length", "distinct_words", "same_as_before", "same_as_two_before", "words_ending_in_sign",
    "words_starting_upper", "words_ending_upper", "log_words_a_line", "stops_a_word", "top_word",
)


def features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, features) of the texts of a buffer."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    kind = _KIND[raw]
    counts = np.bincount(owner * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1)
    share = counts / np.maximum(1, size)[:, None]
    words = find_words(raw, bounds)
    count = words.count()
    per = np.maximum(1, count)
    doc, h = words.doc, words.hash[0]

    def mean(of_word) -> np.ndarray:
        return np.bincount(doc, of_word, minlength=n) / per

    order = np.lexsort((h, doc))
    sorted_h, sorted_doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, sorted_doc[new], runs)
    again = [np.zeros(len(h), bool) for _ in range(2)]
    for k in (1, 2):
        if len(h) > k:
            again[k - 1][k:] = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
    first, last = kind[words.start] if len(h) else kind[:0], kind[words.end - 1] if len(h) else kind[:0]
    odd = np.isin(last, [_KINDS.index(k) for k in ("sign", "bang", "bar")])
    upper = _KINDS.index("upper")
    lines = 1 + counts[:, _KINDS.index("newline")]
    rest = [
        np.log1p(count), mean(words.end - words.start), np.bincount(sorted_doc[new], minlength=n) / per, mean(again[0]), mean(again[1]),
        mean(odd), mean(first == upper), mean((last == upper) | (odd & (first == upper))), np.log1p(count / lines),
        counts[:, _KINDS.index("stop")] / per, top / per,
    ]
    out = np.column_stack([share, *rest])
    out[size == 0] = 0
    return out


@dataclass
class Ranking:
    """score = logistic((features - mean) / scale @ weights + shift); ``flat`` replaces it where nothing could be learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float
    flat: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _steady(values: np.ndarray) -> np.ndarray:
    """Rounded to ten significant digits."""
    return np.array([float(f"{v:.10g}") for v in np.ravel(values)]).reshape(np.shape(values))


def cells(good: int, bad: int, rivals: int) -> tuple[int, int]:
    """Into how many cells rows are dealt, and into how many stretches the rows of the commoner label in a cell are cut."""
    few, many = sorted((good, bad))
    count = max(1, few // rivals)
    return count, -(-many // (count * 8 * rivals))


def pair_sums(z: np.ndarray, label: np.ndarray, cell: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss over all pairs of a text of label 1 and one of label 0 in the same cell; ``cell`` ascends."""
    gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    first, last = (np.searchsorted(cell[bad], cell[good], side=side) for side in ("left", "right"))
    done = np.append(0, np.cumsum(last - first))
    for a, b in pieces(done, _PAIRS):
        n = (last - first)[a:b]
        high = np.repeat(good[a:b], n)
        low = bad[np.arange(n.sum()) + np.repeat(first[a:b] - (done[a:b] - done[a]), n)]
        d = z[high] - z[low]
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient += d.T @ (p - 1)
        hessian += (d * (p * (1 - p))[:, None]).T @ d
    return gradient, hessian


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int, ridge: float, steps: int) -> np.ndarray:
    """Weights at the least loss, from its gradient and Hessian at any weights."""
    w = np.zeros(width)
    for _ in range(steps):
        gradient, hessian = map(_steady, sums(w))
        step = np.linalg.solve(hessian + ridge * np.eye(width), gradient + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return _steady(w)


def _flat(label: float | None) -> Ranking:
    nothing = np.zeros(0)
    return Ranking(nothing, nothing, nothing, 0.0, 0.5 if label is None else float(label))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _shift(threshold: float, cut: float) -> float:
    return float(np.log(cut / (1 - cut))) - threshold


def fit(x: np.ndarray, label: np.ndarray, cut: float = 0.7, rivals: int = 8, ridge: float = 1.0, steps: int = 30) -> Ranking:
    """Bradley-Terry weights from features and labels held in memory, in the same cells as ``learn``."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return _flat(float(label[0]) if len(label) else None)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = _scaled(x, mean, scale)
    count, _ = cells(len(good), len(bad), rivals)
    cell = np.empty(len(label), np.int64)
    for rows in (good, bad):
        cell[rows] = np.arange(len(rows)) % count
    order = np.argsort(cell, kind="stable")
    w = newton(lambda w: pair_sums(z[order], label[order], cell[order], w), x.shape[1], ridge, steps)
    return Ranking(mean, scale, w, _shift(float(np.quantile(z @ w, len(bad) / len(label))), cut))


def _features_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, bounds = text_buffer(batch["text"])
        for a, b in pieces(bounds, _BLOCK):
            x = features(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def _matrix(lists) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _numbered_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers rows within their label, in a task."""
    from pyspark import TaskContext

    task, seen = TaskContext.get().partitionId(), np.zeros(2, np.int64)
    for batch in batches:
        label = batch["label"].to_numpy()
        nth = np.where(label == 1, seen[1] + np.cumsum(label) - 1, seen[0] + np.cumsum(1 - label) - 1)
        seen += np.bincount(label, minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), task, np.int32)), pa.array(nth), batch["label"], batch["x"]], ["task", "nth", "label", "x"])


def labelled_features(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Features of all rows to learn from, numbered within task and label in the order of a hash of their ids; written once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Features are short, so they travel to the labels instead of the texts.
    found = texts.mapInArrow(_features_task, "doc_id long, x array<double>").join(known, "doc_id")
    ordered = found.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x")
    return staged(ordered.select("label", "x").mapInArrow(_numbered_task, "task int, nth long, label int, x array<double>"), "quality-rows")


def dealt(rows: DataFrame, before: Mapping[tuple[int, int], int], good: int, bad: int, rivals: int) -> DataFrame:
    """Cells of the numbered rows, one a row, each with its labels and features; written once. ``before`` has the rows of a label before those of a task."""
    count, stretches = cells(good, bad, rivals)
    starts = rows.sparkSession.createDataFrame([(t, k, n) for (t, k), n in before.items()], "task int, label int, before long")
    placed = rows.join(F.broadcast(starts), ["task", "label"]).withColumn("rank", F.col("nth") + F.col("before"))
    rarer = F.col("label") == F.lit(int(good < bad))
    own = F.array(F.floor(F.col("rank") / F.lit(count)) % F.lit(stretches))
    every = F.sequence(F.lit(0).cast("long"), F.lit(stretches - 1).cast("long"))
    placed = placed.select((F.col("rank") % F.lit(count)).alias("cell"), F.explode(F.when(rarer, every).otherwise(own)).alias("stretch"), "label", "rank", "x")
    held = F.sort_array(F.collect_list(F.struct("label", "rank", "x")))
    grouped = placed.groupBy("cell", "stretch").agg(held.alias("held"))
    return staged(grouped.select(F.col("held.label").alias("label"), F.flatten("held.x").alias("x")), "quality-cells")


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.7, rivals: int = 8, ridge: float = 1.0, steps: int = 30) -> Ranking:
    """A ranking from docs (doc_id, text) and labels (doc_id, ``label`` 0 or 1)."""
    rows = labelled_features(docs, labels, label)
    counts = sorted(tuple(r) for r in rows.groupBy("task", "label").count().collect())
    total, before = [0, 0], {}
    for task, kind, n in counts:
        before[task, kind] = total[kind]
        total[kind] += n
    bad, good = total
    if not good or not bad:
        return _flat(float(good > 0) if counts else None)
    width = len(FEATURES)
    both = rows.select(*[F.get("x", F.lit(k)).alias(f"f{k}") for k in range(width)])
    found = both.agg(*[f(f"f{k}") for f in (F.avg, F.stddev_pop) for k in range(width)]).first()
    mean, scale = _steady(np.array(found[:width])), _steady(np.array(found[width:]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    held = dealt(rows, before, good, bad, rivals)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def task(batches):
            gradient, hessian = np.zeros(width), np.zeros((width, width))
            for batch in batches:
                cell = np.repeat(np.arange(len(batch)), batch["label"].value_lengths().to_numpy())
                some = pair_sums(_scaled(_matrix(batch["x"]), mean, scale), batch["label"].flatten().to_numpy(), cell, w)
                gradient, hessian = gradient + some[0], hessian + some[1]
            yield pa.RecordBatch.from_arrays([pa.array([gradient.tolist()]), pa.array([hessian.ravel().tolist()])], ["gradient", "hessian"])

        parts = held.mapInArrow(task, "gradient array<double>, hessian array<double>").collect()
        return np.sum([p.gradient for p in parts], axis=0), np.sum([p.hessian for p in parts], axis=0).reshape(width, width)

    w = newton(sums, width, ridge, steps)

    def score_task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_scaled(_matrix(batch["x"]), mean, scale) @ w)], ["score"])

    scores = rows.select("x").mapInArrow(score_task, "score double")
    threshold = exact_percentiles(scores, [], "score", {"threshold": bad / (good + bad)}).first().threshold
    return Ranking(mean, scale, w, _shift(threshold, cut))


def predict(docs: DataFrame, ranking: Ranking, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def task(batches):
        for batch in batches:
            raw, bounds = text_buffer(batch["text"])
            for a, b in pieces(bounds, _BLOCK):
                score = shared.value.score(features(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")
