"""Repeated passages: words of a document that lie in a window an earlier document has, too.

A window is ``window`` consecutive words of one document. Three passes over the texts:

1. *Sketch.* Every window has an anchor, the least hash among its runs of ``window // 2 + 1`` words. Equal windows have equal
   anchors, so the number of documents with an anchor is at least the number of documents with the window. Tasks count
   anchors (once a document) in a sparse count-min sketch of two rows; partial sketches are merged page by page. Cells
   saturate at two, which is all the question needs.
2. *Exact grouping.* Only windows whose anchor is counted at least twice in both rows are grouped, by 96-bit hashes. A task
   first settles what it can (of equal windows only those of the smallest document go on), so a window that a third of all
   rows hold reaches the shuffle once a block, not once a row.
3. *Removal.* Positions meet their document again, whose text is shuffled compressed; words under a removed window go.

The merged sketch is broadcast. Its bits follow the size of the text up to ``max_cells``; beyond that it lets more windows
through to the exact pass (which is linear in the text) and loses none.

Empty or null texts have no words. Rows without doc_id count as later than all others. Repeated rows of one doc_id remove
nothing from each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakegauge.llm.words import Words, find_words, mix64, pieces, text_buffer

_PAGE = 16  # bits of a cell within its page
_SHARD = 24  # bits of a cell within the group that one reducer merges
_ROWS = 2
_SEED = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
_BLOCK = 1 << 19  # bytes of text hashed at once
_FLUSH = 1 << 21  # windows that a task keeps at most before it settles them


def _anchors(words: Words, window: int) -> np.ndarray:
    """By window of the batch (crossing ones included): the least hash of its shorter runs."""
    short = window // 2 + 1
    runs = words.sequences(short)
    size = max(0, len(words.doc) - window + 1)
    out = runs[:size].copy()
    for j in range(1, window - short + 1):
        np.minimum(out, runs[j : j + size], out=out)
    return out


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix64(anchor ^ _SEED[row]) >> np.uint64(64 - bits)


def _batches(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[tuple[pa.RecordBatch, int, Words]]:
    """Words of ranges of texts, with the index of the range's first row."""
    for batch in batches:
        raw, bounds = text_buffer(batch["text"])
        for a, b in pieces(bounds, _BLOCK):
            yield batch, a, find_words(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], hashes)


def _sketch_task(window: int, bits: int):
    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors = np.concatenate(held)
        for row in range(_ROWS):
            cell, count = np.unique(_cells(anchors, row, bits), return_counts=True)
            shard = (cell >> np.uint64(_SHARD)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            ids, once, twice = [], [], []
            for c, n in zip(np.split(cell, cuts), np.split(count, cuts)):
                ids.append(row << 32 | int(c[0] >> np.uint64(_SHARD)))
                once.append(_pack(c))
                twice.append(_pack(c[n > 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["shard", "once", "twice"])

    def task(batches):
        held, size = [], 0
        for _, _, words in _batches(batches, 1):
            keep = words.inside(window)
            anchor, doc = _anchors(words, window)[keep], words.doc[: len(keep)][keep]
            if len(anchor):
                order = np.lexsort((anchor, doc))
                anchor, doc = anchor[order], doc[order]
                new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
                held.append(anchor[new])
                size += int(new.sum())
            if size >= _FLUSH:
                yield from emit(held)
                held, size = [], 0
        if size:
            yield from emit(held)

    return task


def _pack(cell: np.ndarray) -> bytes:
    """Sorted cells of a shard: cells by page, then their place within the page, two bytes each."""
    page = (cell >> np.uint64(_PAGE)).astype(np.int64) & ((1 << (_SHARD - _PAGE)) - 1)
    return np.bincount(page, minlength=1 << (_SHARD - _PAGE)).astype(np.uint32).tobytes() + (cell & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    pages = 1 << (_SHARD - _PAGE)
    counts = np.frombuffer(data, np.uint32, pages)
    return (np.repeat(np.arange(pages, dtype=np.int64), counts) << _PAGE) + np.frombuffer(data, np.uint16, offset=4 * pages)


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the partial sketches of a shard, one after another; what comes out has a bit for each cell counted twice or more."""
    once, twice = np.zeros(1 << _SHARD, bool), np.zeros(1 << _SHARD, bool)
    for batch in batches:
        for a, b in zip(batch["once"], batch["twice"]):
            cell = _unpack(a.as_py())
            twice[cell[once[cell]]] = True
            once[cell] = True
            twice[_unpack(b.as_py())] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["shard", "bits"])


def repeat_sketch(docs: DataFrame, window: int, max_cells: int) -> tuple[list[np.ndarray], int]:
    """The merged sketch: a bitmap of the cells with two counts or more by row, and the bits of a cell.

    A row has four cells for each expected anchor (a word of six bytes, one anchor in four words), a power of two between
    one shard and ``max_cells``.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(_SHARD, min(int(max_cells).bit_length() - 1, int(np.ceil(np.log2(max(1, size / 6))))))
    partial = docs.select("text").mapInArrow(_sketch_task(window, bits), "shard long, once binary, twice binary")
    shards = partial.groupBy("shard").applyInArrow(_merge, "shard long, bits binary")
    rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(_ROWS)]
    for shard, data in shards.toLocalIterator():
        at = (shard & 0xFFFFFFFF) << (_SHARD - 3)
        rows[shard >> 32][at : at + len(data)] = np.frombuffer(data, np.uint8)
    return rows, bits


def _candidate_task(window: int, bits: int, sketch):
    def emit(held) -> Iterator[pa.RecordBatch]:
        """Settles the windows held: those of a larger document are removed, those of the smallest go on."""
        h1, h2, doc, pos, row, ids, keys = held
        order = np.lexsort((pos, ids[row], h2, h1))
        h1, h2, row, pos = h1[order], h2[order], row[order], pos[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        least = ids[row][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = ids[row] > least
        one = np.arange(int((~later).sum()) + 1)
        yield rows_of(False, h1[~later], h2[~later], ids[row[~later]], keys[row[~later]], pos[~later], one)
        gone, place = row[later], pos[later]
        order = np.lexsort((place, gone))
        gone, place = gone[order], place[order]
        cuts = np.flatnonzero(np.append(True, gone[1:] != gone[:-1])) if len(gone) else np.zeros(0, np.int64)
        first = gone[cuts]
        yield rows_of(True, ids[first].view(np.uint64), keys[first].view(np.uint64).astype(np.uint32), ids[first], keys[first], place, np.append(cuts, len(gone)))

    def rows_of(settled, h1, h2, ids, keys, pos, cut) -> pa.RecordBatch:
        """Rows with the positions pos[cut[i] : cut[i + 1]], four bytes each."""
        offsets = pa.py_buffer((cut * 4).astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(h1), [None, offsets, pa.py_buffer(pos.astype("<i4"))])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(h1), settled)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int32)), pa.array(ids), pa.array(keys), packed], _NAMES
        )

    def task(batches):
        rows = sketch.value
        held, size = [], 0
        for batch, base, words in _batches(batches, 2):
            if not len(words.doc):
                continue
            keep = words.inside(window)
            anchor = _anchors(words, window)
            for row in range(_ROWS):
                cell = _cells(anchor[keep], row, bits)
                keep[keep] = (rows[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            ids, keys = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_order", "text_key"))
            doc = words.doc[at]
            low = (words.sequences(window, 1)[at] >> np.uint64(32)).astype(np.uint32)
            held.append([words.sequences(window, 0)[at], low, doc, at - words.first[doc], doc + base, ids, keys])
            size += len(at)
            if size >= _FLUSH:
                yield from emit(_joined(held))
                held, size = [], 0
        if size:
            yield from emit(_joined(held))

    return task


_NAMES = ["settled", "h1", "h2", "doc_order", "text_key", "pos"]


def _joined(held):
    """Blocks of windows as one; rows are renumbered over the rows that occur."""
    ids = np.concatenate([h[5][h[4]] for h in held])
    keys = np.concatenate([h[6][h[4]] for h in held])
    h1, h2, doc, pos = (np.concatenate([h[k] for h in held]) for k in range(4))
    both = np.rec.fromarrays([ids, keys])
    unique, row = np.unique(both, return_inverse=True)
    return h1, h2, doc, pos, row, np.ascontiguousarray(unique["f0"]), np.ascontiguousarray(unique["f1"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress((t or "").encode()) for t in batch["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["doc_order"], batch["text_key"], packed], ["doc_id", "doc_order", "text_key", "packed"])


def _removal_task(window: int):
    def task(batches):
        import hashlib

        import zstandard

        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = batch["packed"].to_pylist()
            lists = batch["removed"].to_pylist()
            total, gone, sha, kept_text = [], [], [], []
            for i in range(len(batch)):
                own = plain.decompress(texts[i]).split()
                keep = own
                if lists[i]:
                    cover = np.zeros(len(own) + 1, np.int64)
                    at = np.unique(np.frombuffer(b"".join(lists[i]), "<i4"))
                    np.add.at(cover, at, 1)
                    np.add.at(cover, np.minimum(at + window, len(own)), -1)
                    under = np.cumsum(cover)[:-1] > 0
                    keep = [w for w, u in zip(own, under) if not u]
                text = b" ".join(keep)
                total.append(len(own))
                gone.append(len(own) - len(keep))
                sha.append(hashlib.sha256(text).hexdigest())
                kept_text.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(kept_text, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "kept_text", "n_words", "n_removed", "kept_sha256"],
            )

    return task


def remove_repeats(docs: DataFrame, window: int = 13, max_cells: int = 1 << 30, keep_text: bool = True) -> DataFrame:
    """doc_id, kept_text (words joined by a space), n_words, n_removed, kept_sha256 of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_order"),
        F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"),
    )
    rows, bits = repeat_sketch(base, window, max_cells)
    sketch = spark.sparkContext.broadcast(rows)
    found = base.select("doc_order", "text_key", "text").mapInArrow(
        _candidate_task(window, bits, sketch), "settled boolean, h1 long, h2 int, doc_order long, text_key long, pos binary"
    )
    same = Window.partitionBy("settled", "h1", "h2")
    removed = (
        found.withColumn("least", F.min("doc_order").over(same))
        .filter(F.col("settled") | (F.col("doc_order") > F.col("least")))
        .groupBy("doc_order", "text_key")
        .agg(F.collect_list("pos").alias("removed"))
    )
    packed = base.select("doc_id", "doc_order", "text_key", "text").mapInArrow(_packed, "doc_id long, doc_order long, text_key long, packed binary")
    joined = packed.join(removed, ["doc_order", "text_key"], "left").select("doc_id", "packed", "removed")
    out = joined.mapInArrow(_removal_task(window), "doc_id long, kept_text string, n_words long, n_removed long, kept_sha256 string")
    return out if keep_text else out.drop("kept_text")


__all__ = ["remove_repeats", "repeat_sketch"]
