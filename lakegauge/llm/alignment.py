"""Alignment of two tokenizers: where their tokens end together, which tokens overlap, and how often any two do.

Side A is a byte-level vocabulary of ``tokenizers`` that gets a blank and the text, side B a piece vocabulary of ``sentencepiece`` that
adds the blank itself; special tokens are neither added nor recognised. A token stands for bytes: A's entry decoded byte by byte, B's piece in UTF-8 with
U+2581 as a blank and <0xHH> as that byte. A text has tokens if the bytes of either side joined are a blank and the text.

Texts are cut into units before each blank that stands alone between two other characters: there neither side has a token across (checked on both vocabularies
when they are read; otherwise a text is one unit), so units give the same ids as the whole text, and a unit that
many texts share is encoded once in a block; a worker keeps a bounded number of short ones for its next blocks. Side A gets neighbouring units as one
text, for the same reason, and its ids are cut where a unit's bytes end.

Either side's cumulative ends go into a dictionary from end to index. Ends in both dictionaries (an intersection of their keys as hash sets, sorted) slice the two
lists of ids into groups; units end with a slice. Links are expanded a slice: in it, each stretch between two neighbouring ends of either side lies
in one token of A and one of B, and two tokens overlap in exactly one such stretch. Nothing crosses from one slice to another.

How often two ids are linked is counted over the whole corpus. Texts are handled in blocks of about ``block_bytes``; a block keeps each of its
different links once, in a list, and each document names its links by place in that list. The lists of all blocks are summed by link, which gives counts and the
highest count of each id of B; they meet the lists again by link and come back to their block in order of place. What is shuffled is a block's different
links, not a document's, and a link that every document has is as many rows as there are blocks. Blocks are written once, so texts are encoded once.

Longer texts than ``part_bytes`` are cut into units a part at a time, so scratch memory follows a part and the different units; a text without a lone blank is
one unit. Vocabularies are read by the driver and sent along as bytes (some megabytes, as large as the files).

Null and empty texts, texts that are not UTF-8, and texts whose bytes differ on either side have no tokens: zeros, an empty digest, and no links in the counts.
Rows without doc_id and repeated rows are rows of their own, each counted. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import defaultdict
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakegauge.llm.staging import staged

#: A link's number is id of A * 2^31 + id of B.
_SIDE = 1 << 31
_BLANK = "▁"
#: A blank that stands alone between two other characters.
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: A blank beside another ASCII character that is white space.
_BESIDE = ["  ", *(x for c in "\t\n\v\f\r\x1c\x1d\x1e\x1f" for x in (f"{c} ", f" {c}"))]
#: Units encoded in one call.
_CALL = 1 << 13
#: Units that side A encodes as one text.
_RUN = 1 << 7
#: Units of up to so many characters are kept encoded by a worker, about so many.
_SHORT, _KEPT = 32, 1 << 17


def _split(text: str) -> list[str]:
    """The stretches between lone blanks; where every blank is one, the search for a plain blank finds them faster."""
    plain = text.isascii() and text[:1] != " " and text[-1:] != " " and not any(pair in text for pair in _BESIDE)
    return text.split(" ") if plain else _LONE.split(text)


def byte_of_symbol() -> dict[str, int]:
    """Bytes by their symbol in byte-level vocabularies: printable Latin-1 stands for itself, the rest, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Sides:
    """The two encoders, made from the contents of their files, with the bytes of every id."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        symbols = byte_of_symbol()
        entry = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [self._of_entry(entry.get(i, ""), symbols) for i in range(max(entry) + 1)]
        self.known: dict[str, tuple[list, list, bool]] = {}
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_BLANK, " ").encode())
        self.length_a, self.length_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # A blank begins a token of either side, so that a cut before a lone blank leaves the ids as they are.
        kind = json.loads(byte_level).get("pre_tokenizer") or {}
        self.cuts = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and all(b" " not in x.lstrip(b" ") for x in self.bytes_b)
        # What the digest shows: an id and the sign behind it, which is a comma within a group, and the other one at its end.
        self.shown = np.array(
            [f"{i}{c}" for c in ",|" for i in range(len(self.bytes_a))] + [f"{i}{c}" for c in ",;" for i in range(len(self.bytes_b))], object
        )

    @staticmethod
    def _of_entry(entry: str, symbols: dict[str, int]) -> bytes:
        return bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else entry.encode()

    def units(self, text: str, part: int):
        """Lists of the stretches between lone blanks, for about ``part`` characters each."""
        if not self.cuts:
            yield [text]
            return
        at = 0
        while at < len(text):
            cut = _LONE.search(text, at + part)
            to = cut.start() if cut else len(text)
            yield _split(text[at:to])
            at = to + 1

    def encode(self, units: list[str], often: list[int]) -> tuple[list, list, np.ndarray]:
        """Ids of both sides of each unit, empty where a side's bytes are not a blank and the unit; and whether they are."""
        new = [x for x in units if x not in self.known]
        a, b, right = self._encode(new)
        found = dict(zip(new, zip(a, b, right.tolist())))
        told = [found.get(x) or self.known[x] for x in units]
        # Short units that the block repeats are kept for the blocks that follow.
        if len(self.known) > _KEPT:
            self.known.clear()
        self.known.update((x, found[x]) for x, n in zip(units, often) if n > 1 and len(x) <= _SHORT and x in found)
        return [x[0] for x in told], [x[1] for x in told], np.array([x[2] for x in told], bool)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of side A, without places in the text, which nobody reads; the ids are the same."""
        return [x.ids for x in self.a.encode_batch_fast([" " + x for x in texts], add_special_tokens=False)]

    def _ids_a(self, units: list[str], length: np.ndarray) -> list[list[int]]:
        """Ids of side A of each unit of so many bytes, its blank included. Neighbours with a lone blank between them are encoded as one text and cut there."""
        runs = [units[at : at + _RUN] for at in range(0, len(units), _RUN)]
        joined = [" ".join(run) for run in runs]
        lone = [self.cuts and _split(text) == run for text, run in zip(joined, runs)]
        told = iter(self._ids([text for text, one in zip(joined, lone) if one]))
        out = []
        for k, run in enumerate(runs):
            ids = next(told) if lone[k] else []
            end = np.cumsum(self.length_a[ids])
            to = np.cumsum(length[k * _RUN : k * _RUN + len(run)])
            last = np.searchsorted(end, to)
            # Bytes that differ may hide where a unit ends.
            if len(end) and end[-1] == to[-1] and (end[last] == to).all():
                last = (last + 1).tolist()
                out += [ids[i:j] for i, j in zip([0, *last], last)]
            else:
                out += self._ids(run)
        return out

    def _encode(self, units: list[str]) -> tuple[list, list, np.ndarray]:
        whole = [b" " + x.encode() for x in units]
        right = np.ones(len(units), bool)
        length = np.fromiter(map(len, whole), np.int64, len(whole))
        a, b = [], []
        for at in range(0, len(units), _CALL):
            a += self._ids_a(units[at : at + _CALL], length[at : at + _CALL])
            b += self.b.encode(units[at : at + _CALL], num_threads=1)
        for ids, known, of_id in ((a, self.bytes_a, self.length_a), (b, self.bytes_b, self.length_b)):
            # All at once; one by one only if something differs.
            same = b"".join(map(known.__getitem__, chain.from_iterable(ids))) == b"".join(whole)
            end = np.append(0, np.cumsum(of_id[np.fromiter(chain.from_iterable(ids), np.int64)]))
            if not same or (np.diff(end[np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))], prepend=0) != length).any():
                right &= [b"".join(map(known.__getitem__, x)) == w for x, w in zip(ids, whole)]
        for k in np.flatnonzero(~right):
            a[k], b[k] = [], []
        return a, b, right


@cache
def _sides(byte_level: bytes, pieces: bytes) -> Sides:
    return Sides(byte_level, pieces)


def common_ends(end_a: np.ndarray, end_b: np.ndarray) -> list[np.ndarray]:
    """Number of tokens of A, and of B, up to each end that both have."""
    index_a, index_b = (dict(zip(end.tolist(), range(1, len(end) + 1))) for end in (end_a, end_b))
    both = sorted(index_a.keys() & index_b.keys())
    return [np.fromiter(map(index.__getitem__, both), np.int64, len(both)) for index in (index_a, index_b)]


class Aligned:
    """Units laid end to end: of each its numbers, links and what the digest shows of it."""

    def __init__(self, sides: Sides, units: list[str], often: list[int]):
        ids_a, ids_b, self.right = sides.encode(units, often)
        (a, size_a), (b, size_b) = (
            (np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))) for ids in (ids_a, ids_b)
        )
        last_a, last_b = np.cumsum(size_a), np.cumsum(size_b)
        end_a, end_b = np.cumsum(sides.length_a[a]), np.cumsum(sides.length_b[b])
        cut_a, cut_b = common_ends(end_a, end_b)
        # In a slice, every end of either side closes the stretch of one link.
        mark = np.zeros(max(end_a.max(initial=-1), end_b.max(initial=-1)) + 1, bool)
        mark[end_a], mark[end_b] = True, True
        ends = np.flatnonzero(mark)
        self.links = a[np.searchsorted(end_a, ends)] * _SIDE + b[np.searchsorted(end_b, ends)]
        unit_end = np.append(0, end_a)[last_a]
        self.link_at = np.append(0, np.searchsorted(ends, unit_end, side="right"))
        groups = np.diff(np.searchsorted(cut_a, last_a, side="right"), prepend=0)
        self.numbers = np.stack([size_a, size_b, groups, np.diff(self.link_at)])
        # Ids in the order of the digest: A's of a group before B's.
        slice_a, slice_b = (np.repeat(np.arange(len(cut)), np.diff(cut, prepend=0)) for cut in (cut_a, cut_b))
        what = np.empty(len(a) + len(b), np.int64)
        end_of_a, end_of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_of_a[cut_a - 1], end_of_b[cut_b - 1] = 1, 1
        what[np.arange(len(a)) + np.append(0, cut_b)[slice_a]] = a + end_of_a * len(sides.bytes_a)
        what[np.arange(len(b)) + cut_a[slice_b]] = 2 * len(sides.bytes_a) + b + end_of_b * len(sides.bytes_b)
        body, last = sides.shown[what].tolist(), (last_a + last_b).tolist()
        self.shown = ["".join(body[i:j])[:-1] for i, j in zip([0, *last], last)]


BLOCKS = (
    "docs array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,different:int>>,"
    " places binary, times binary, links array<bigint>, counts array<bigint>"
)


def _texts(values: list) -> list[str | None]:
    """UTF-8 texts; null where a value is null, empty or not UTF-8."""
    out = []
    for value in values:
        try:
            out.append(bytes(value).decode() or None if value is not None else None)
        except UnicodeDecodeError:
            out.append(None)
    return out


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    return pa.compress(values.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<i4").astype(np.int64) if n else np.zeros(0, np.int64)


def _block(sides: Sides, ids: list, values: list, part: int, schema: pa.Schema) -> pa.RecordBatch:
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__  # a unit's number is its place among the different ones
    found = []  # of each text: the units of its parts, by number
    for text in _texts(values):
        parts = sides.units(text, part) if text else ()
        found.append([np.fromiter(map(index.__getitem__, some), np.int64, len(some)) for some in parts])
    unit = np.concatenate([np.zeros(0, np.int64), *(some for parts in found for some in parts)])
    owner = np.repeat(np.arange(len(found)), [sum(map(len, parts)) for parts in found])
    aligned = Aligned(sides, list(index), np.bincount(unit, minlength=len(index)).tolist())
    links, place = np.unique(aligned.links, return_inverse=True)
    whole = np.bincount(owner, ~aligned.right[unit], minlength=len(found)) == 0
    unit, owner = unit[whole[owner]], owner[whole[owner]]
    numbers = np.stack([np.bincount(owner, x[unit], minlength=len(found)).astype(np.int64) for x in aligned.numbers], axis=1).tolist()
    # The different units of each text, then its different links, with how often it has them.
    pair, often = np.unique(owner * len(index) + unit, return_counts=True)
    owner, unit = np.divmod(pair, max(1, len(index)))
    many = aligned.numbers[3][unit]
    at = np.arange(many.sum()) + np.repeat(aligned.link_at[unit] - np.cumsum(many) + many, many)
    pair = np.repeat(owner, many) * len(links) + place[at]
    order = np.argsort(pair)
    pair, often = pair[order], np.repeat(often, many)[order]
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    times = np.add.reduceat(often, new) if len(new) else often
    owner, mine = np.divmod(pair[new], max(1, len(links)))
    counts = np.bincount(mine, times, minlength=len(links)).astype(np.int64)
    different = np.bincount(owner, minlength=len(found)).tolist()
    begins = np.diff(owner, prepend=-1) > 0
    places = np.where(begins, mine, np.diff(mine, prepend=0))
    docs = []
    for k, (i, parts) in enumerate(zip(ids, found)):
        digest = ""
        if parts and whole[k]:
            sha = hashlib.sha256()
            for nth, some in enumerate(parts):
                sha.update((";" * (nth > 0) + ";".join(map(aligned.shown.__getitem__, some.tolist()))).encode())
            digest = sha.hexdigest()
        docs.append(dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "different"), (i, *numbers[k], digest, different[k]))))
    lists = ([docs], [_pack(places)], [_pack(times)], [links], [counts])
    return pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(lists, schema)], schema=schema)


def _made(*block) -> pa.RecordBatch:
    """A block. Its many lists of ids are in no cycles, so Python does not search them for any meanwhile."""
    gc.disable()
    try:
        return _block(*block)
    finally:
        gc.enable()


def _blocks_task(files, block_bytes: int, part_bytes: int, schema: pa.Schema):
    def task(batches):
        sides = _sides(*files.value)
        ids, values, size = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 64):
                piece = batch.slice(at, 64)
                for i, value in zip(piece["doc_id"].to_pylist(), piece["text"]):
                    value = value.as_py()
                    ids.append(i)
                    values.append(value)
                    size += len(value or b"") + 64
                    if size >= block_bytes:
                        yield _made(sides, ids, values, part_bytes, schema)
                        ids, values, size = [], [], 0
        if ids:
            yield _made(sides, ids, values, part_bytes, schema)

    return task


def _sums_task(schema: pa.Schema):
    """Sums over a document's links, from the counts of its block's list."""

    def task(batches):
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                docs = one["docs"][0].as_py()
                count, best = (one[c].flatten().to_numpy(zero_copy_only=False) for c in ("count", "best"))
                n = sum(d["different"] for d in docs)
                steps, times = (_unpack(one[c][0].as_py(), n) for c in ("places", "times"))
                out, at = [], 0
                for d in docs:
                    to = at + d.pop("different")
                    mine, often = np.cumsum(steps[at:to]), times[at:to]
                    out.append(d | {"n_best": int(often[best[mine] == 1].sum()), "count_sum": int((often * count[mine]).sum())})
                    at = to
                yield pa.RecordBatch.from_pylist(out, schema)

    return task


def read_vocabularies(byte_level: str, pieces: str) -> tuple[bytes, bytes]:
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        return a.read(), b.read()


def blocks(docs: DataFrame, files: tuple[bytes, bytes], block_bytes: int = 4 << 20, part_bytes: int = 1 << 20) -> DataFrame:
    """Encoded blocks of docs (doc_id, text), with a number each, written once."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))
    made = base.mapInArrow(_blocks_task(docs.sparkSession.sparkContext.broadcast(files), block_bytes, part_bytes, schema), BLOCKS)
    return staged(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def link_counts(encoded: DataFrame) -> DataFrame:
    """link, a, b, count and best (whether no other link of b has more) of all links of the blocks."""
    listed = encoded.select(F.inline(F.arrays_zip("links", "counts")))
    sums = staged(listed.groupBy(F.col("links").alias("link")).agg(F.sum("counts").alias("count")).filter("count > 0"), "links")
    sums = sums.withColumns({"a": F.shiftright("link", 31).cast("int"), "b": F.col("link").bitwiseAND(_SIDE - 1).cast("int")})
    most = sums.groupBy("b").agg(F.max("count").alias("most"))
    return sums.join(most, "b").select("link", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_level: str, pieces: str, block_bytes: int = 4 << 20, part_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs (doc_id, text).

    ``byte_level`` and ``pieces`` are the paths of the two vocabularies on the driver.
    """
    encoded = blocks(docs, read_vocabularies(byte_level, pieces), block_bytes, part_bytes)
    counts = link_counts(encoded).select("link", "count", F.col("best").cast("int").alias("best"))
    places = encoded.select("block", F.posexplode("links").alias("place", "link")).join(counts, "link", "left")
    found = F.sort_array(F.collect_list(F.struct("place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(0)).alias("best"))))
    known = places.groupBy("block").agg(found.alias("found")).select("block", F.col("found.count").alias("count"), F.col("found.best").alias("best"))
    met = encoded.drop("links", "counts").join(known, "block", "left")
    none = F.array().cast("array<bigint>"), F.array().cast("array<int>")
    met = met.withColumns({"count": F.coalesce("count", none[0]), "best": F.coalesce("best", none[1])}).drop("block")
    schema = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
    return met.mapInArrow(_sums_task(to_arrow_schema(StructType.fromDDL(schema))), schema)
