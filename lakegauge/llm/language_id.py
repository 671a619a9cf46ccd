"""Language by cross parsing: how few phrases of a language's own text does a text fall into?

For each label a suffix automaton holds a sample of labelled text. A text is parsed greedily: the longest prefix that occurs
in the sample is a phrase, then the next one begins. Few phrases mean a close source; the rate is phrases a symbol, times
the logarithm of the sample's length (bits a symbol), which makes samples of different length comparable. The label with the
lowest rate wins, ties go to the smaller label.

Symbols are lower-cased letters and one blank for any run of other characters. Texts are parsed in stretches of at most
``stretch`` symbols, none left out, so many stretches go through an automaton side by side.

Learned from rows with a label only, whose id is not held out; those without text add nothing. The sample is bounded: ``sample_docs`` documents a
label, in the order of a hash of their ids, and of these ``sample_symbols`` symbols, shared out: each document gives one stretch, begun at a
place drawn from its id, and no document more symbols than needed. No label in the rows means no language, and every text is
``und``. So is a null text or one without letters, with score 0. The score is the winner's share of the
inverse rates to the power ``sharpness``.

A text is rejected if it is ``und``, if its label is not wanted, or if even the winner needs more than ``max_bits`` a symbol for all
phrases but the last: by default one bit more than equally likely symbols of the alphabet would. Texts in a script or spelling that no sample has are like that.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakegauge.llm.words import text_buffer

UND = "und"
_BLOCK = 1 << 19


class Automaton:
    """Suffix automaton of a symbol sequence as one table: state * symbols + symbol -> state, -1 where no such text occurs."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.symbols = symbols
        most = 2 * len(text) + 2
        table = np.full((most, symbols), -1, np.int32)
        link, length = [-1] * most, [0] * most
        size, last = 1, 0
        for c in text.tolist():
            now, size = size, size + 1
            length[now] = length[last] + 1
            p = last
            while p != -1 and table[p, c] < 0:
                table[p, c] = now
                p = link[p]
            if p == -1:
                link[now] = 0
            else:
                q = int(table[p, c])
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy, size = size, size + 1
                    length[copy], link[copy] = length[p] + 1, link[q]
                    table[copy] = table[q]
                    while p != -1 and table[p, c] == q:
                        table[p, c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        self.table = np.ascontiguousarray(table[:size]).ravel()

    def phrases(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases of each stretch text[start : start + size]; stretches must come longest first. Unknown symbols are -1."""
        count = np.zeros(len(start), np.int64)
        state = np.zeros(len(start), np.int32)
        # How many stretches are longer than t, by t.
        longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for t, live in enumerate(longer):
            c = text[start[:live] + t]
            now = state[:live]
            known = c >= 0
            step = self.table[now * self.symbols + np.where(known, c, 0)]
            step[~known] = -1
            broke = step < 0
            at = np.flatnonzero(broke)
            count[at] += now[at] > 0  # the phrase so far ends before this symbol
            again = np.where(known[at], self.table[np.where(known[at], c[at], 0)], -1)
            alone = again < 0  # a symbol the sample lacks is a phrase of its own
            count[at[alone]] += 1
            step[at] = np.where(alone, 0, again)
            state[:live] = step
        return count + (state > 0)


def symbol_map() -> np.ndarray:
    """Code point -> lower-cased code point for letters, blank for all others."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols_of(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of all texts one after another, the n + 1 offsets, and the number of letters by text."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    code = letters[raw]
    letter = code != 0x20
    seen = np.append(0, np.cumsum(letter))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of blanks
    begins = bounds[:-1][bounds[:-1] < len(code)]
    keep[begins] = letter[begins]
    kept = np.append(0, np.cumsum(keep))
    return code[keep], kept[bounds], np.diff(seen[bounds])


class Languages:
    """Automata of several labels over one alphabet."""

    def __init__(self, samples: dict[str, np.ndarray]):
        self.labels = sorted(samples)
        alphabet = np.unique(np.concatenate([*samples.values(), np.array([0x20], np.uint32)]))
        self.code = np.full(0x110000, -1, np.int16)
        self.code[alphabet] = np.arange(len(alphabet))
        self.automata = [Automaton(self.code[samples[x]], len(alphabet)) for x in self.labels]
        self.max_bits = np.log2(len(alphabet)) + 1
        self.bits = np.array([np.log2(max(2, len(samples[x]))) for x in self.labels])

    def rates(self, code: np.ndarray, bounds: np.ndarray, stretch: int) -> np.ndarray:
        """(texts, labels): bits a symbol."""
        size = np.diff(bounds)
        parts = -(-size // stretch)
        owner = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = bounds[owner] + nth * stretch
        length = np.minimum(stretch, bounds[owner + 1] - start)
        order = np.argsort(-length, kind="stable")
        text = self.code[code]
        out = np.zeros((len(size), len(self.labels)))
        for k, automaton in enumerate(self.automata):
            found = automaton.phrases(text, start[order], length[order])
            out[:, k] = np.bincount(owner[order], found, minlength=len(size))
        return out * self.bits / np.maximum(1, size)[:, None]


def held_out(doc_id) -> F.Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4. A null id counts as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 4 == 2


def _shared(parts: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The parts cut to one length, the greatest with which they have ``most`` symbols together."""
    size = np.sort([len(p) for p in parts])
    before = np.cumsum(size) - size
    share = (most - before) // np.arange(len(size), 0, -1)  # for all from here on, if those before are whole
    fits = np.flatnonzero(share < size)
    return parts if not len(fits) else [p[: max(1, share[fits[0]])] for p in parts]


def learn(docs: DataFrame, sample_docs: int = 200, sample_symbols: int = 40_000) -> Languages | None:
    """Automata of the labels of docs (doc_id, text, lang); see the module about the sample."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.select("lang", "doc_id").withColumn("place", F.row_number().over(first)).filter(F.col("place") <= sample_docs)
    ids = ids.withColumn("drawn", F.count("*").over(Window.partitionBy("lang")))
    # A stretch has room for documents shorter than their share, and the driver gets a bounded amount.
    each = F.ceil(F.lit(4 * sample_symbols) / F.col("drawn")).cast("int")
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - each + 1)).cast("int") + 1
    few = labelled.select("lang", "doc_id", "text").join(F.broadcast(ids), ["lang", "doc_id"]).withColumn("text", F.substring("text", begin, each))
    letters = symbol_map()
    samples: dict[str, list[np.ndarray]] = {}
    for row in few.orderBy("lang", "place", "text").toLocalIterator():
        samples.setdefault(row["lang"], []).append(symbols_of([(row["text"] or "") + " "], letters)[0])
    cut = {lang: np.concatenate(_shared(parts, sample_symbols)) for lang, parts in samples.items()}
    cut = {lang: s for lang, s in cut.items() if (s != 0x20).any()}
    return Languages(cut) if cut else None


def _labelled(batches: Iterator[pa.RecordBatch], model: Languages | None, stretch: int, sharpness: float):
    """(batch, first row, rows, labels, scores, bits a symbol without the last phrase) of ranges of rows."""
    letters = symbol_map()
    for batch in batches:
        _, bounds = text_buffer(batch["text"])
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _BLOCK, side="right")) - 1)
            to = min(to, len(batch))
            texts = [t or "" for t in batch["text"].slice(at, to - at).to_pylist()]
            code, cut, letter = symbols_of(texts, letters)
            label, score, bits = [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if model is not None:
                rate = model.rates(code, cut, stretch)
                share = (1 / np.maximum(rate, 1e-9)) ** sharpness
                best = rate.argmin(axis=1)
                score = np.where(letter > 0, share[np.arange(len(best)), best] / share.sum(axis=1), 0.0)
                label = [model.labels[b] if n else UND for b, n in zip(best, letter)]
                bits = rate.min(axis=1) - model.bits[best] / np.maximum(1, np.diff(cut))
            yield batch, at, to - at, label, score, bits
            at = to


def predict(docs: DataFrame, model: Languages | None, stretch: int = 1000, sharpness: float = 4.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text). Repeated rows get equal answers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, n, label, score, _ in _labelled(batches, shared.value, stretch, sharpness):
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(at, n), batch["held_out"].slice(at, n), pa.array(label, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(
    docs: DataFrame, model: Languages | None, stretch: int = 1000, wanted: Collection[str] | None = None, max_bits: float | None = None
) -> DataFrame:
    """docs without the rejected rows; a column ``lang`` gets the language found. ``wanted`` null: all that were learned.

    If nothing could be learned, nothing is rejected but texts without a letter, and ``lang`` stays.
    """
    if model is None:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = set(model.labels if wanted is None else wanted) - {UND}
    most = model.max_bits if max_bits is None else max_bits
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, n, label, _, bits in _labelled(batches, shared.value, stretch, 1.0):
            rows = batch.slice(at, n)
            if lang is not None:
                rows = rows.set_column(lang, "lang", pa.array(label, rows.schema.field(lang).type))
            yield rows.filter(pa.array([x in keep and b <= most for x, b in zip(label, bits)], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
