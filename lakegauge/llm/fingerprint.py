"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut into pieces of at most ``piece`` words; its digest is a 64-bit hash of its words and of how many equal
pieces came before it in the text. A sketch has cells of (count, xor of digests, xor of check hashes); each digest goes into
three cells, one in each third. Sketches of two versions are subtracted cell by cell; peeling cells that hold one digest gives
back the digests that only one of them has. When that fails the pair is tried again with twice as many cells, up to a size
that always suffices. Likeness is the share of common digests: common / (common + differing).

The fingerprint is the sketch of ``cells`` cells, written as base64 of its cells (count as int16, digest xor, 32 bits of the check xor) after
compression. Texts without words have empty sketches; two of them are alike (1.0). A null text counts as empty.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegauge.llm.words import find_words, mix64, pieces, powers, text_buffer

_HASHES = 3
_SALT = np.uint64(0x1F83D9ABFB41BD6B)
_BLOCK = 1 << 19
_NEWLINE = 0x0A


def digests(raw: np.ndarray, bounds: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of the texts of a buffer and the n + 1 offsets by text."""
    words = find_words(raw, bounds)
    n = len(words.start)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    lines = np.searchsorted(np.flatnonzero(raw == _NEWLINE), words.start)
    new = np.append(True, (lines[1:] != lines[:-1]) | (words.doc[1:] != words.doc[:-1]))
    since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    begin = np.flatnonzero(since % piece == 0)
    key = mix64(np.add.reduceat(words.hash[0] * powers(0x9E3779B97F4A7C15, piece)[since % piece], begin))
    doc = words.doc[begin]
    order = np.lexsort((key, doc))
    same = np.append(False, (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]))
    at = np.arange(len(key))
    before = np.empty(len(key), np.uint64)
    before[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return mix64(key + before * np.uint64(0xD1B54A32D192ED03)), np.searchsorted(doc, np.arange(len(bounds)))


def _places(key: np.ndarray, third: np.ndarray) -> np.ndarray:
    """(3, keys): the cell of each key in each third; ``third`` is the number of cells of a third, by key."""
    return np.stack([(mix64(key + _SALT * np.uint64(k + 1)) % third.astype(np.uint64)).astype(np.int64) + k * third for k in range(_HASHES)])


def _check(key: np.ndarray) -> np.ndarray:
    return (mix64(key ^ _SALT) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Sketches of many sets side by side; set i has the cells from offset[i] to offset[i + 1]."""

    def __init__(self, third: np.ndarray):
        self.third = third
        self.offset = np.append(0, np.cumsum(third * _HASHES))
        self.count = np.zeros(self.offset[-1], np.int32)
        self.key = np.zeros(self.offset[-1], np.uint64)
        self.check = np.zeros(self.offset[-1], np.uint32)

    def add(self, key: np.ndarray, owner: np.ndarray, sign: np.ndarray | int) -> None:
        """Adds (sign 1) or subtracts (-1) digests; the xors are their own inverses."""
        check = _check(key)
        for place in _places(key, self.third[owner]):
            at = place + self.offset[owner]
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray]:
        """Takes digests out until nothing is pure: how many came out by set, and whether the set's cells are empty now."""
        sets = len(self.third)
        owner_of = np.repeat(np.arange(sets), self.third * _HASHES)
        out = np.zeros(sets, np.int64)
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            live = live[(np.abs(self.count[live]) == 1) & (_check(self.key[live]) == self.check[live])]
            if not len(live):
                break
            both = np.rec.fromarrays([owner_of[live], self.key[live]])
            _, first = np.unique(both, return_index=True)
            owner, key, sign = owner_of[live[first]], self.key[live[first]], self.count[live[first]]
            np.add.at(out, owner, 1)
            self.add(key, owner, -sign)
            live = np.unique(_places(key, self.third[owner]) + self.offset[owner])
        bad = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = np.ones(sets, bool)
        done[owner_of[bad]] = False
        return out, done

    def text(self, i: int) -> str:
        a, b = self.offset[i], self.offset[i + 1]
        raw = self.count[a:b].astype("<i2").tobytes() + self.key[a:b].astype("<u8").tobytes() + self.check[a:b].astype("<u4").tobytes()
        return base64.b64encode(zlib.compress(raw, 1)).decode()


def _spread(cut: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the digests of the chosen texts, and the place of their text in ``chosen``."""
    size = cut[chosen + 1] - cut[chosen]
    owner = np.repeat(np.arange(len(chosen)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(cut[chosen], size), owner


def likeness(key_a, cut_a, key_b, cut_b, cells: int) -> np.ndarray:
    """By pair (text i of a, text i of b): common / (common + differing) digests, by subtracting and peeling."""
    n = len(cut_a) - 1
    total = np.diff(cut_a) + np.diff(cut_b)
    differ = np.zeros(n, np.int64)
    todo, third = np.arange(n), np.full(n, max(1, cells // _HASHES))
    while len(todo):
        sketch = Sketches(third[todo])
        for key, cut, sign in ((key_a, cut_a, 1), (key_b, cut_b, -1)):
            at, owner = _spread(cut, todo)
            sketch.add(key[at], owner, sign)
        found, done = sketch.peel()
        differ[todo[done]] = found[done]
        todo = todo[~done]
        third[todo] *= 2
    common = (total - differ) // 2
    return np.where(total == 0, 1.0, common / np.maximum(1, common + differ))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs_task(cells: int, piece: int):
    """Rows come sorted; a row whose ``tail`` is set only serves as the next document of the one before it."""

    def block(ids: list, tails: list, texts: list) -> pa.RecordBatch:
        own = [i for i in range(len(texts)) if not tails[i]]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        raw, bounds = text_buffer(pa.array(texts, pa.large_string()))
        key, cut = digests(raw, bounds, piece)
        raw, bounds = text_buffer(pa.array(changed, pa.large_string()))
        key_e, cut_e = digests(raw, bounds, piece)
        own = np.array(own, np.int64)
        at, owner = _spread(cut, own)
        key_o, cut_o = key[at], np.append(0, np.cumsum(cut[own + 1] - cut[own]))
        at, _ = _spread(cut, own + 1)
        key_n, cut_n = key[at], np.append(0, np.cumsum(cut[own + 2] - cut[own + 1]))
        prints = []
        for k, c in ((key_o, cut_o), (key_e, cut_e)):
            sketch = Sketches(np.full(len(own), max(1, cells // _HASHES)))
            sketch.add(k, np.repeat(np.arange(len(own)), np.diff(c)), 1)
            prints.append([sketch.text(i) for i in range(len(own))])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array(prints[0], pa.string()), pa.array(prints[1], pa.string()),
             pa.array(likeness(key_o, cut_o, key_e, cut_e, cells)), pa.array(likeness(key_o, cut_o, key_n, cut_n, cells))], _OUT)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tails, texts, size = [], [], [], 0
        for batch in batches:
            for i, tail, text in zip(batch["doc_id"].to_pylist(), batch["tail"].to_pylist(), batch["text"].to_pylist()):
                ids.append(i), tails.append(tail), texts.append(text)
                size += len(text)
                if size >= _BLOCK and len(texts) > 1:
                    tails[-1] = True
                    yield block(ids, tails, texts)
                    ids, tails, texts, size = [i], [tail], [text], len(text)
        if len(texts) > 1 or texts and not tails[0]:
            yield block(ids, tails, texts)

    return task


_OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIRST = -(2**63)  # the order of a row without doc_id: after all others


def _bucket_task(tops: np.ndarray):
    """Sends each row to its bucket, texts compressed; the first row of a bucket also ends the bucket before it (the last one, for the first)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rank = batch["rank"].to_numpy()
            bucket = len(tops) - 1 - np.searchsorted(tops[::-1], rank)
            top = np.flatnonzero(tops[bucket] == rank)
            take = np.append(np.arange(len(rank)), top)
            packed = pa.array([press.compress(t.encode()) for t in batch["text"].to_pylist()], pa.binary())
            tail = np.arange(len(take)) >= len(rank)
            to = np.append(bucket, (bucket[top] - 1) % len(tops))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(tail), batch["rank"].take(take), batch["tie"].take(take), batch["doc_id"].take(take), packed.take(take)],
                ["bucket", "tail", "rank", "tie", "doc_id", "packed"],
            )

    return task


def _unpacked(task):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor()

        def texts():
            for batch in batches:
                text = pa.array([plain.decompress(b).decode() for b in batch["packed"].to_pylist()], pa.large_string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tail"], text], ["doc_id", "tail", "text"])

        yield from task(texts())

    return run


def fingerprints(docs: DataFrame, cells: int = 24, piece: int = 16, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row of docs (doc_id, text).

    The next document is the following one in descending doc_id, after the last one the first; rows of one doc_id follow
    each other in the order of a hash of their texts, rows without doc_id come last. One document alone follows itself.
    Ranges of doc_id are sorted in tasks of their own; only the texts are shuffled, once, compressed.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("rank"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if rows == 0:
        return base.mapInArrow(_pairs_task(cells, piece), _SCHEMA)
    buckets = int(min(rows, 1 + (size or 0) // bucket_bytes))
    ranged = base.select("rank").repartitionByRange(buckets, F.desc("rank"))
    tops = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.max("rank").alias("top")).collect()
    tops = np.sort(np.array([r["top"] for r in tops], np.int64))[::-1].copy()
    sent = base.mapInArrow(_bucket_task(tops), "bucket long, tail boolean, rank long, tie long, doc_id long, packed binary")
    ordered = sent.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("rank"), "tie")
    return ordered.select("doc_id", "tail", "packed").mapInArrow(_unpacked(_pairs_task(cells, piece)), _SCHEMA)
