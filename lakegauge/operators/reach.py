"""Reach of every name of a lineage graph at once, marks carried along it, and a closure kept up to date.

``lineage_closure`` walks from chosen starts and makes a row for each pair. Here all starts go together: names that reach each
other are condensed to one part, every part holds the set of names it reaches as 64-bit words, and words are merged (``bit_or``) along
the edges between parts. Rows are parts times words that are not empty, not pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegauge.functions.checkpoints import cut
from lakegauge.functions.quantiles import running_total
from lakegauge.operators.lineage import _strong_parts

#: Most steps between two writes. Each is one join and one aggregation of a plan that reads the last write once.
_STEPS = 8


def _stepwise(rows: DataFrame, edges: DataFrame, keys: list[str], step: Column, merged: dict, moved: Column) -> DataFrame:
    """Rows (node, ``keys``, values) pushed along edges (here, there) until none of them changes.

    ``step`` is a struct of the values a row has after an edge, ``merged`` merges the values of rows that meet, and ``moved`` says whether the
    merged values differ from those (``was_*``) of the last write. Only rows that changed since the last write are pushed.
    """
    values = list(merged)
    edges = cut(edges.select("here", "there").distinct())
    known = cut(rows.groupBy("node", *keys).agg(*[m.alias(c) for c, m in merged.items()]).withColumn("_new", F.lit(True)))
    steps = 2
    while True:
        pushed = known.filter("_new").select("node", *keys, *values)
        for _ in range(steps):
            # A row meets its own node, unchanged, and the nodes across its edges, in one pass.
            there = F.concat(F.array(F.struct(F.col("node"), *values)), F.when(F.col("there").isNotNull(), F.array(F.struct(F.col("there").alias("node"), *[step[c].alias(c) for c in values]))).otherwise(F.array()))
            met = pushed.join(edges.withColumnRenamed("here", "node"), "node", "left")
            met = met.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(there).alias("_to"))
            met = met.select("_to.node", *[F.col(f"_{k}").alias(k) for k in keys], *[F.col(f"_to.{c}").alias(c) for c in values])
            pushed = met.groupBy("node", *keys).agg(*[m.alias(c) for c, m in merged.items()])
        both = known.select("node", *keys, *values, *[F.col(c).alias(f"was_{c}") for c in values]).unionByName(pushed, allowMissingColumns=True)
        after = both.groupBy("node", *keys).agg(*[m.alias(c) for c, m in merged.items()], *[F.max(f"was_{c}").alias(f"was_{c}") for c in values])
        known = cut(after.withColumn("_new", F.coalesce(moved, F.lit(True))).select("node", *keys, *values, "_new"))
        if known.filter("_new").isEmpty():
            return known.drop("_new")
        steps = min(_STEPS, 2 * steps)


def reach(pairs: DataFrame, direction: str = "downstream") -> DataFrame:
    """(full_name, part_size, reached, depth) of every name of the pairs (source, target).

    ``reached`` is the number of names reached by at least one edge (a name counts itself only on a cycle), ``part_size`` how many names are in its
    strong part, ``depth`` the edges between parts on the longest way from it. Null ends are ignored; repeated pairs change nothing.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError("direction is upstream or downstream")
    here, there = ("source", "target") if direction == "downstream" else ("target", "source")
    pairs = cut(pairs.filter("source IS NOT NULL AND target IS NOT NULL").select(F.col(here).alias("source"), F.col(there).alias("target")).distinct())
    loops = pairs.filter("source = target").select(F.col("source").alias("full_name"), F.lit(True).alias("loop"))
    names = pairs.select(F.col("source").alias("full_name")).union(pairs.select("target")).distinct()
    strong = cut(_strong_parts(pairs.filter("source <> target")))
    of = names.join(strong, "full_name", "left").select("full_name", F.coalesce("part", "full_name").alias("part"))
    # Names of a part get neighbouring numbers, so a part fills few words.
    numbered = running_total(of.withColumn("one", F.lit(1)), "one", [F.col("part"), F.col("full_name")], "number").drop("one")
    numbered = cut(numbered.withColumn("number", F.col("number") - 1))
    bit = F.expr("shiftleft(1L, cast(pmod(number, 64) AS int))")
    rows = numbered.select(F.col("part").alias("node"), F.floor(F.col("number") / 64).cast("long").alias("word"), bit.alias("bits"), F.lit(0).alias("level"))
    part_of = {c: numbered.select(F.col("full_name").alias(c), F.col("part").alias(f"{c}_part")) for c in ("source", "target")}
    between = pairs.join(part_of["source"], "source").join(part_of["target"], "target").filter("source_part <> target_part")
    # What a part reaches goes to the parts that have an edge into it.
    found = _stepwise(
        rows, between.select(F.col("target_part").alias("here"), F.col("source_part").alias("there")), ["word"],
        F.struct(F.col("bits").alias("bits"), (F.col("level") + 1).alias("level")), {"bits": F.bit_or("bits"), "level": F.max("level")},
        F.col("was_bits").isNull() | (F.col("bits") != F.col("was_bits")) | (F.col("level") > F.col("was_level")),
    )
    sums = found.groupBy(F.col("node").alias("part")).agg(F.sum(F.bit_count("bits")).alias("n"), F.max("level").alias("depth"))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("part_size"))
    told = numbered.join(sizes, "part").join(sums, "part").join(loops, "full_name", "left")
    itself = F.when((F.col("part_size") == 1) & F.col("loop").isNull(), 1).otherwise(0)
    return told.select("full_name", "part_size", (F.col("n") - itself).alias("reached"), "depth")


def carry_marks(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(full_name, mark, steps): every mark of ``marks`` (full_name, mark) on its name, with 0 steps, and on all that is derived from it, with
    the steps of the shortest way. Rows are names times different marks. Rows with a null are ignored."""
    rows = marks.filter("full_name IS NOT NULL AND mark IS NOT NULL").select(F.col("full_name").alias("node"), "mark", F.lit(0).alias("steps"))
    edges = pairs.filter("source IS NOT NULL AND target IS NOT NULL").select(F.col("source").alias("here"), F.col("target").alias("there"))
    found = _stepwise(
        rows, edges, ["mark"], F.struct((F.col("steps") + 1).alias("steps")), {"steps": F.min("steps")},
        F.col("was_steps").isNull() | (F.col("steps") < F.col("was_steps")),
    )
    return found.select(F.col("node").alias("full_name"), "mark", "steps")


def _with_itself(closure: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The rows of a closure whose ``column`` is among names (name), and those names with themselves at depth 0."""
    some = closure.join(names.withColumnRenamed("name", column), column, "left_semi").select("root", "full_name", "depth")
    return some.unionByName(names.select(F.col("name").alias("root"), F.col("name").alias("full_name"), F.lit(0).alias("depth")))


def _through(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, full_name, depth) of the shortest ways that go to the start of one of the edges, over it, and on from its end."""
    before = _with_itself(closure, edges.select(F.col("source").alias("name")).distinct(), "full_name")
    after = _with_itself(closure, edges.select(F.col("target").alias("name")).distinct(), "root")
    up = before.select("root", F.col("full_name").alias("source"), F.col("depth").alias("_up"))
    down = after.select(F.col("root").alias("target"), "full_name", F.col("depth").alias("_down"))
    ways = up.join(edges.select("source", "target"), "source").join(down, "target")
    return ways.groupBy("root", "full_name").agg(F.min(F.col("_up") + 1 + F.col("_down")).alias("depth"))


def _without_edges(closure: DataFrame, left: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure after ``removed`` went and the pairs ``left`` stayed: rows whose shortest way used a removed edge are deleted and found anew."""
    over = _through(closure, removed)
    doubtful = cut(closure.join(over, ["root", "full_name", "depth"], "left_semi").select("root", "full_name"))
    if doubtful.isEmpty():
        return closure
    sure = cut(closure.join(doubtful, ["root", "full_name"], "left_anti").select("root", "full_name", "depth"))
    step = left.select(F.col("source").alias("_by"), F.col("target").alias("full_name"))
    into = cut(doubtful.join(step, "full_name"))  # the edges left into doubtful rows
    direct = into.filter("root = _by").select("root", "full_name", F.lit(1).alias("depth"))
    known = sure.withColumnRenamed("full_name", "_by")
    near = into.join(known, ["root", "_by"]).select("root", "full_name", (F.col("depth") + 1).alias("depth"))
    found = cut(direct.unionByName(near).groupBy("root", "full_name").agg(F.min("depth").alias("depth")).withColumn("_new", F.lit(True)))
    while not found.filter("_new").isEmpty():
        ways = into.join(found.filter("_new").select("root", F.col("full_name").alias("_by"), "depth"), ["root", "_by"])
        better = ways.select("root", "full_name", (F.col("depth") + 1).alias("depth"), F.lit(None).cast("int").alias("_was"))
        both = found.select("root", "full_name", "depth", F.col("depth").alias("_was")).unionByName(better)
        after = both.groupBy("root", "full_name").agg(F.min("depth").alias("depth"), F.min("_was").alias("_was"))
        found = cut(after.select("root", "full_name", "depth", F.coalesce(F.col("depth") < F.col("_was"), F.lit(True)).alias("_new")))
    return sure.unionByName(found.drop("_new"))


def _with_edges(closure: DataFrame, added: DataFrame) -> DataFrame:
    """The closure after ``added`` came: ways over one new edge, then over one more, as long as a row is new or shorter."""
    closure = cut(closure.select("root", "full_name", "depth"))
    while True:
        ways = _through(closure, added).withColumnRenamed("depth", "_way")
        better = ways.join(closure, ["root", "full_name"], "left").filter("depth IS NULL OR _way < depth")
        better = cut(better.select("root", "full_name", F.col("_way").alias("depth")))
        if better.isEmpty():
            return closure
        closure = cut(closure.join(better, ["root", "full_name"], "left_anti").unionByName(better))


def update_closure(closure: DataFrame, pairs: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The closure (root, full_name, depth) of all names after a change of the pairs (source, target) that it belongs to.

    Removed edges first: a row none of whose shortest ways used one keeps its depth, so only rows with such a way are deleted and
    derived again from the rest. Then added edges: rows get new ways over them, round by round, and nothing that did not get shorter is touched
    again. Work follows the rows that change and the rows next to the changed edges; the stored rows are read, not derived. Edges removed
    that are not there, or added that are, change nothing; an edge in both lists stays.
    """
    pairs, added, removed = (df.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct() for df in (pairs, added, removed))
    gone = cut(removed.join(added, ["source", "target"], "left_anti").join(pairs, ["source", "target"], "left_semi"))
    left = cut(pairs.join(gone, ["source", "target"], "left_anti"))
    new = cut(added.join(left, ["source", "target"], "left_anti"))
    closure = closure.select("root", "full_name", F.col("depth").cast("int").alias("depth"))
    return _with_edges(_without_edges(closure, left, gone), new)
