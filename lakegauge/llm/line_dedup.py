"""Repeated lines over the whole corpus, up to one edit, by deletion neighbourhoods. DataFrame functions only.

A line is compared lower-cased and without outer blanks. Lines with fewer than ``min_chars`` characters are never near others, since
short lines are one edit apart by chance; ``exact_chars`` says from which length on their exact repeats go all the same. The query and
the pipeline's stage compare every line that is not blank. Lines are ordered by doc_id, then by their place in the text. A line goes if an earlier one equals it or is one inserted, deleted or replaced
character away; all lines are judged on the input, and the earliest of a kind stays.

* Equal lines: the earliest by two 64-bit hashes. From here on each distinct line counts once, so a line that a third of all
  documents hold is one row.
* Near lines: every distinct line emits itself and all variants with one character deleted, as hashed keys. Two lines that
  differ by a replaced character share the variant without it, at the same place: there all lines are near each other, so
  each only meets the earliest. A line that is another one's variant differs by an inserted character: it meets the earliest of those, and
  they meet it. So a key never makes all pairs. Pairs are verified by edit distance on the texts.
* Only lines that can have a neighbour emit variants. One edit lies in one of ``parts`` stretches of a line and leaves what is before
  and behind it alone, so neighbours share the hash of the rest for some stretch; lines that share none emit nothing. This
  loses no neighbour. Whether a key has company is told by its least and greatest line, so a stretch that a third of all lines share
  is reduced before the shuffle. Texts of the lines that are left are picked from a second scan through a bitmap of fixed size, so other lines'
  texts are not shuffled. The driver sends the bitmap out; it has 64 bits a line that is wanted, up to that size.

Null texts stay null, empty ones empty. Rows without doc_id come last. Repeated rows of one document are treated alike. An
empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakegauge.llm.staging import staged

#: Bits of the bitmap that picks lines in the second scan: 64 a line that is wanted, so that it stays small with few, and 8 MB at most, whatever
#: the table. It is spread over buckets of 32768 bits.
_A_LINE, _BITS = 64, 1 << 26
_BUCKET = 1 << 15


def _trimmed(line: Column) -> Column:
    """The line without outer blanks; most have none, and btrim() with characters of its own walks the whole line."""
    outer = reduce(or_, (end(c) for c in " \t\r" for end in (line.startswith, line.endswith)))
    return F.when(outer, F.btrim(line, F.lit(" \t\r"))).otherwise(line)


def _rest_keys(line: Column, size: Column, parts: int) -> Column:
    """Hashes of the line without one of its stretches, cut as a line of its own length and as one that is a character shorter."""
    keys = []
    for shorter in (0, 1):
        n = size - shorter
        for g in range(parts):
            a, b = F.floor(n * g / parts).cast("int"), F.floor(n * (g + 1) / parts).cast("int")
            keys.append(F.xxhash64(n, F.lit(g), F.substring(line, F.lit(1), a), F.substring(line, size - (n - b) + 1, n - b)))
    return F.array(*keys)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_order, doc_key, pos, line, h1 of every line that counts."""
    # lower() sees the whole text, and no case rule crosses a line end. Blanks go after the explosion, which generated code can follow.
    each = docs.select("doc_order", "doc_key", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    each = each.withColumn("line", _trimmed(F.col("line"))).filter(F.length("line") >= min_chars)
    return each.withColumn("h1", F.xxhash64("line"))


def _second_hash(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _with_company(lines: DataFrame, parts_keys: str) -> DataFrame:
    """h1 of the lines that share one of their keys with another line."""
    keyed = lines.select("h1", F.explode(parts_keys).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).filter("least < most").select("key")
    return keyed.join(shared, "key", "left_semi").select("h1").distinct()


def _bits(wanted: int) -> int:
    """Bits for so many lines: a power of two from a bucket's to the most."""
    return min(_BITS, max(_BUCKET, 1 << (_A_LINE * wanted - 1).bit_length()))


def _picked(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines whose h1 is among the wanted ones or shares its bit with one of them."""
    bits = _bits(wanted.count())

    def bit(h: Column) -> Column:
        return F.pmod(h, F.lit(bits))

    bitmap = (
        wanted.select(bit(F.col("h1")).alias("bit")).groupBy(F.floor(F.col("bit") / _BUCKET).alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(bit % {_BUCKET})").alias("bits"))
    )
    # Words of 64 bits, read once a bucket and not once a line; the first byte of eight is the word's highest.
    words = F.transform(F.sequence(F.lit(0), F.lit(_BUCKET // 64 - 1)), lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    bitmap = bitmap.select("bucket", words.alias("words"))
    at = (F.col("bit") % _BUCKET).cast("int")
    word = F.get("words", F.shiftright(at, 6))
    return (
        lines.withColumn("bit", bit(F.col("h1"))).withColumn("bucket", F.floor(F.col("bit") / _BUCKET))
        .join(F.broadcast(bitmap), "bucket")
        .filter(F.getbit(word, (7 - F.shiftright(at, 3) % 8) * 8 + at % 8) == 1)
        .drop("bit", "bucket", "words")
    )


def near_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, first, line; all distinct) that have an earlier line one edit away."""
    size = F.length("line")
    whole = lines.select("h1", "h2", "first", F.lit(-1).alias("cut"), F.xxhash64(size, "line").alias("key"))
    cuts = lines.select("h1", "h2", "first", "line", F.explode(F.sequence(F.lit(1), size)).alias("cut"))
    less = F.concat(F.substring("line", F.lit(1), F.col("cut") - 1), F.substring("line", F.col("cut") + 1, size))
    cuts = cuts.select("h1", "h2", "first", "cut", F.xxhash64(size - 1, less).alias("key"))
    variants = whole.union(cuts).withColumn("me", F.struct("first", "h1", "h2"))
    by_key, by_place = Window.partitionBy("key"), Window.partitionBy("key", "cut")
    met = variants.select(
        "me", "cut",
        F.min("me").over(by_place).alias("same_place"),
        F.min(F.when(F.col("cut") < 0, F.col("me"))).over(by_key).alias("whole"),
        F.min(F.when(F.col("cut") > 0, F.col("me"))).over(by_key).alias("cut_one"),
    )
    partners = F.when(F.col("cut") < 0, F.array("cut_one")).otherwise(F.array("same_place", "whole"))
    pairs = met.select("me", F.explode(partners).alias("other")).filter("other.first < me.first").distinct()
    texts = lines.select("h1", "h2", "line")
    mine = texts.toDF("m1", "m2", "mine")
    theirs = texts.toDF("o1", "o2", "theirs")
    pairs = pairs.select(F.col("me.h1").alias("m1"), F.col("me.h2").alias("m2"), F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"))
    near = pairs.join(mine, ["m1", "m2"]).join(theirs, ["o1", "o2"]).filter(F.levenshtein("mine", "theirs", 1) == 1)
    return near.select(F.col("m1").alias("h1"), F.col("m2").alias("h2")).distinct()


def remove_lines(docs: DataFrame, min_chars: int = 20, parts: int = 16, exact_chars: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) without repeated lines, as ``row`` (the input row), ``text`` (what is left), ``n_lines``, ``n_counted``
    (lines that are long enough), ``n_removed`` and ``n_kept`` (of those that are long enough). Exact repeats go from ``exact_chars`` characters on (``min_chars`` if null)."""
    shortest = min_chars if exact_chars is None else min(exact_chars, min_chars)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct("*").alias("row"), order.alias("doc_order"), F.xxhash64(text).alias("doc_key"), text.alias("text"))
    texts = keyed.select("doc_order", "doc_key", "text")
    lines = _second_hash(_lines(texts, shortest))
    long_enough = F.length("line") >= min_chars

    first = F.min(F.struct("doc_order", "doc_key", "pos")).alias("first")
    halves = _rest_keys(F.col("line"), F.length("line"), 2)
    distinct = lines.withColumn("keys", F.when(long_enough, halves)).groupBy("h1", "h2").agg(first, F.first("keys").alias("keys"))
    distinct = staged(distinct, "lines")
    wanted = staged(_with_company(distinct, "keys"), "wanted")
    few = _picked(_lines(texts, min_chars), wanted).join(wanted, "h1", "left_semi")
    few = staged(_second_hash(few).groupBy("h1", "h2").agg(first, F.first("line").alias("line")), "few")
    few = few.join(_with_company(few.withColumn("keys", _rest_keys(F.col("line"), F.length("line"), parts)), "keys"), "h1", "left_semi")
    near = near_lines(staged(few, "near"))

    kept = distinct.join(near, ["h1", "h2"], "left_anti")
    kept = kept.groupBy("first.doc_order", "first.doc_key").agg(F.sort_array(F.collect_list("first.pos")).alias("kept"))
    joined = keyed.join(kept, ["doc_order", "doc_key"], "left").select("row", "text", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    # Lower case can change a length, but not whether a line is blank.
    joined = joined.withColumn("lines", F.split("text", "\n")).withColumn("cased", F.split(F.lower("text"), "\n") if shortest > 1 else F.col("lines"))
    short = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.length(_trimmed(F.col("cased")[i])) < shortest)
    joined = joined.withColumn("short", F.when(F.col("text").isNotNull(), short)).withColumn("stay", F.sort_array(F.concat("short", "kept")))
    some = F.array_join(F.transform("stay", lambda i: F.col("lines")[i]), "\n")
    left = F.when(F.size("stay") == F.size("lines"), F.col("text")).otherwise(some)
    count = F.coalesce(F.size("lines"), F.lit(0))
    counted = F.when(F.col("text").isNotNull(), count - F.size("short")).otherwise(0)
    return joined.select(
        "row", F.when(F.col("text").isNotNull(), left).alias("text"), F.when(F.col("text").isNotNull(), count).otherwise(0).alias("n_lines"),
        counted.alias("n_counted"), F.when(F.col("text").isNotNull(), counted - F.size("kept")).otherwise(0).alias("n_removed"),
        F.size("kept").alias("n_kept"),
    )


def without_repeated_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """docs with the lines that stay, n_chars counted anew; a document that lost lines and has nothing but blank text left goes."""
    # Lines that count are those that are not blank. The condition looks at what the join gave and the input text: one on the new text would
    # be pushed below, where the text is cut anew for each of its lines.
    before = F.coalesce(F.col("row").getField("text").cast("string"), F.lit(""))
    found = remove_lines(docs, min_chars, exact_chars=1).filter((F.col("n_kept") > 0) | (F.btrim(before, F.lit(" \t\r\n")) == ""))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
