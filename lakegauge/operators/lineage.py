"""Table and column lineage: statistics, neighbours, rollups and transitive closure.

Edges are event rows; the same pair of tables occurs many times. Operators that only need pairs reduce to distinct
pairs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakegauge.functions.checkpoints import cut
from lakegauge.functions.common import contains_text, count_if, top

SRC, TGT = "source_table_full_name", "target_table_full_name"


def _text(*parts: Column | str) -> Column:
    """Concatenation that reads NULL as empty text."""
    return F.concat(*[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def _n() -> Column:
    return F.count(F.lit(1))


def event_class(edges: DataFrame) -> DataFrame:
    """Label each edge by which ends it has."""
    source, target = F.col(SRC).isNotNull(), F.col(TGT).isNotNull()
    label = (
        F.when(source & target, "read-write").when(source, "read-only").when(target, "write-only").otherwise("path-only")
    )
    return edges.withColumn("event_class", label)


def lineage_stats(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Headline counters, one aggregation per edge table. Only an explicit FALSE counts as indirect."""
    source, target = F.col(SRC).isNotNull(), F.col(TGT).isNotNull()
    either = F.coalesce(SRC, TGT)
    t = tables.agg(
        _n().alias("table_edges"),
        F.countDistinct(either).alias("distinct_tables"),
        F.countDistinct("entity_id").alias("distinct_entities"),
        F.max("event_time").alias("last_event"),
        count_if(F.col("direct_access")).alias("direct_edges"),
        count_if(~F.col("direct_access")).alias("indirect_edges"),
        count_if(source & ~target).alias("read_only_events"),
        count_if(~source & target).alias("write_only_events"),
        count_if(source & target).alias("read_write_events"),
    )
    column = _text(either, F.lit(":"), F.coalesce("source_column_name", "target_column_name"))
    c = columns.agg(
        _n().alias("column_edges"),
        F.countDistinct(column).alias("distinct_columns"),
        F.countDistinct(either).alias("column_distinct_tables"),
        F.countDistinct("entity_id").alias("column_distinct_entities"),
        F.max("event_time").alias("column_last_event"),
    )
    row = c.select(F.struct(*c.columns)).scalar()
    return t.withColumn("_c", row).select(*t.columns, "_c.*")


def _ranked_labels(pairs: DataFrame, limit: int) -> DataFrame:
    """Most frequent labels of each kind. The window runs over counted labels."""
    sums = pairs.groupBy("kind", "label").agg(_n().alias("count"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("count").desc(), F.col("label")))
    return sums.withColumn("_rn", rank).filter(F.col("_rn") <= limit).drop("_rn")


def lineage_breakdowns(tables: DataFrame, limit: int = 20) -> DataFrame:
    """Counts by entity, source and target type from one scan; a missing entity type is ``(none)``."""
    kinds = F.array(
        F.struct(F.lit("entity_type").alias("kind"), F.coalesce("entity_type", F.lit("(none)")).alias("label")),
        F.struct(F.lit("source_type").alias("kind"), F.col("source_type").alias("label")),
        F.struct(F.lit("target_type").alias("kind"), F.col("target_type").alias("label")),
    )
    return _ranked_labels(tables.select(F.inline(kinds)).filter(F.col("label").isNotNull()), limit)


def _ends(tables: DataFrame) -> DataFrame:
    """Both ends of every edge as rows (name, is_source)."""
    ends = F.array(
        F.struct(F.col(SRC).alias("full_name"), F.lit(True).alias("is_source")),
        F.struct(F.col(TGT).alias("full_name"), F.lit(False).alias("is_source")),
    )
    return tables.select(F.inline(ends)).filter(F.col("full_name").isNotNull())


def lineage_search(tables: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Tables whose name contains the text, by the number of edges touching them."""
    hits = _ends(tables).filter(contains_text("full_name", text))
    sums = hits.groupBy("full_name").agg(
        count_if(~F.col("is_source")).alias("table_edges_in"), count_if(F.col("is_source")).alias("table_edges_out")
    )
    order = [(F.col("table_edges_in") + F.col("table_edges_out")).desc(), F.col("full_name")]
    return top(sums, order, limit)


def _neighbour_edges(tables: DataFrame, full_name: str, direct_only: bool) -> DataFrame:
    """Edges of one table as rows (side, neighbour, type, entity)."""
    if direct_only:
        tables = tables.filter(F.col("direct_access"))
    touching = tables.filter((F.col(SRC) == full_name) | (F.col(TGT) == full_name))
    sides = F.array(
        F.when(
            F.col(TGT) == full_name,
            F.struct(F.lit("upstream").alias("side"), F.col(SRC).alias("full_name"), F.col("source_type").alias("type")),
        ),
        F.when(
            F.col(SRC) == full_name,
            F.struct(F.lit("downstream").alias("side"), F.col(TGT).alias("full_name"), F.col("target_type").alias("type")),
        ),
    )
    rows = touching.select(F.explode(sides).alias("_n"), "entity_type", "entity_id").filter(F.col("_n").isNotNull())
    return rows.select("_n.*", "entity_type", "entity_id").filter(F.col("full_name").isNotNull())


def table_neighbours(tables: DataFrame, full_name: str, limit: int = 25, direct_only: bool = False) -> DataFrame:
    """Direct upstream and downstream tables with their edge counts, the ``limit`` busiest of each side."""
    edges = _neighbour_edges(tables, full_name, direct_only)
    sums = edges.groupBy("side", "full_name").agg(F.max("type").alias("type"), _n().alias("edge_count"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.col("edge_count").desc(), F.col("full_name")))
    return sums.withColumn("_rn", rank).filter(F.col("_rn") <= limit).drop("_rn")


def neighbour_entities(tables: DataFrame, full_name: str, keep: int = 3) -> DataFrame:
    """The busiest ``type: id`` labels behind each neighbour, for all neighbours in one job."""
    edges = _neighbour_edges(tables, full_name, False)
    label = F.concat(F.coalesce("entity_type", F.lit("?")), F.lit(": "), F.coalesce("entity_id", F.lit("?")))
    sums = edges.groupBy("side", "full_name", label.alias("label")).agg(_n().alias("_c"))
    rank = F.row_number().over(Window.partitionBy("side", "full_name").orderBy(F.col("_c").desc(), F.col("label")))
    best = sums.withColumn("_rn", rank).filter(F.col("_rn") <= keep)
    packed = best.groupBy("side", "full_name").agg(F.array_sort(F.collect_list(F.struct("_rn", "label"))).alias("_l"))
    return packed.select("side", "full_name", F.transform("_l", lambda x: x["label"]).alias("sample_entities"))


def column_neighbours(columns: DataFrame, full_name: str, column_name: str, limit: int = 25) -> DataFrame:
    """Direct upstream and downstream columns of one column."""

    def side(name: str, here: str, there: str) -> DataFrame:
        found = columns.filter(
            (F.col(f"{here}_table_full_name") == full_name)
            & (F.col(f"{here}_column_name") == column_name)
            & F.col(f"{there}_table_full_name").isNotNull()
        )
        sums = found.groupBy(
            F.col(f"{there}_table_full_name").alias("full_name"), F.col(f"{there}_column_name").alias("column_name")
        ).agg(_n().alias("edge_count"))
        order = [F.col("edge_count").desc(), F.col("full_name"), F.col("column_name").asc_nulls_last()]
        return top(sums, order, limit).select(F.lit(name).alias("side"), "full_name", "column_name", "edge_count")

    return side("upstream", "target", "source").unionByName(side("downstream", "source", "target"))


def _entity_label() -> Column:
    return F.concat(F.coalesce("entity_type", F.lit("?")), F.lit(": "), F.col("entity_id"))


def _column_label() -> Column:
    return _text(
        F.coalesce(TGT, SRC), F.lit("::"), F.coalesce("target_column_name", "source_column_name")
    )


def lineage_tops(tables: DataFrame, columns: DataFrame, limit: int = 15) -> DataFrame:
    """Busiest sources, targets, entities and columns as (kind, label, count); one scan per edge table."""
    kinds = F.array(
        F.struct(F.lit("source").alias("kind"), F.col(SRC).alias("label")),
        F.struct(F.lit("target").alias("kind"), F.col(TGT).alias("label")),
        F.struct(F.lit("entity").alias("kind"), _entity_label().alias("label")),
    )
    labels = tables.select(F.inline(kinds)).filter(F.col("label").isNotNull())
    named = columns.select(F.lit("column").alias("kind"), _column_label().alias("label"))
    return _ranked_labels(labels.unionByName(named), limit)


def terminal_tables(tables: DataFrame, limit: int | None = 15) -> DataFrame:
    """Targets that are never a source, by name."""
    roles = _ends(tables).groupBy("full_name").agg(F.bool_or("is_source").alias("_s"), F.bool_or(~F.col("is_source")).alias("_t"))
    return top(roles.filter(~F.col("_s") & F.col("_t")).select("full_name"), [F.col("full_name")], limit)


def catalog_names(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        _text("catalog", F.lit("."), "database", F.lit("."), "table_name").alias("full_name")
    ).distinct()


def orphan_tables(tables: DataFrame, catalog: DataFrame, limit: int | None = 15) -> DataFrame:
    """Catalog tables that no edge touches, by name."""
    seen = _ends(tables).select("full_name").distinct()
    return top(catalog_names(catalog).join(seen, "full_name", "left_anti"), [F.col("full_name")], limit)


def lineage_rollups(tables: DataFrame) -> DataFrame:
    """One row per table with its edge counts. Anything not explicitly direct counts as indirect here."""
    out = (
        tables.filter(F.col(SRC).isNotNull())
        .groupBy(F.col(SRC).alias("full_name"))
        .agg(
            _n().alias("edges_out"),
            F.countDistinct(TGT).alias("distinct_downstream"),
            F.countDistinct("entity_id").alias("_eo"),
            count_if(F.col("direct_access")).alias("direct_edges"),
            F.max("event_time").alias("_lo"),
        )
    )
    into = (
        tables.filter(F.col(TGT).isNotNull())
        .groupBy(F.col(TGT).alias("full_name"))
        .agg(
            _n().alias("edges_in"),
            F.countDistinct(SRC).alias("distinct_upstream"),
            F.countDistinct("entity_id").alias("_ei"),
            F.max("event_time").alias("_li"),
        )
    )
    zero = F.lit(0).cast("bigint")

    def n(column: str) -> Column:
        return F.coalesce(F.col(column), zero)

    return out.join(into, "full_name", "full").select(
        "full_name",
        n("edges_in").alias("edges_in"),
        n("edges_out").alias("edges_out"),
        n("distinct_upstream").alias("distinct_upstream"),
        n("distinct_downstream").alias("distinct_downstream"),
        F.greatest(n("_eo"), n("_ei")).alias("distinct_entities"),
        n("direct_edges").alias("direct_edges"),
        (n("edges_out") - n("direct_edges")).alias("indirect_edges"),
        F.greatest("_lo", "_li").alias("last_event"),
    )


def column_tops(columns: DataFrame, limit: int = 15) -> DataFrame:
    """Most fanned-out and most depended-on columns, tables and entities by column edges, as (kind, label, count)."""
    source = _text(SRC, F.lit("::"), "source_column_name")
    target = _text(TGT, F.lit("::"), "target_column_name")
    whole = columns.filter(
        F.col(SRC).isNotNull()
        & F.col("source_column_name").isNotNull()
        & F.col(TGT).isNotNull()
        & F.col("target_column_name").isNotNull()
    )
    # A distinct pair counts once for either of its ends.
    pairs = whole.select(source.alias("s"), target.alias("t")).distinct()
    ends = pairs.select(
        F.inline(
            F.array(
                F.struct(F.lit("most_fanned_out").alias("kind"), F.col("s").alias("label")),
                F.struct(F.lit("most_depended_on").alias("kind"), F.col("t").alias("label")),
            )
        )
    )
    busy = columns.select(
        F.inline(
            F.array(
                F.struct(F.lit("tables_by_column_edges").alias("kind"), F.col(SRC).alias("label")),
                F.struct(F.lit("entities").alias("kind"), _entity_label().alias("label")),
            )
        )
    ).filter(F.col("label").isNotNull())
    return _ranked_labels(ends.unionByName(busy), limit)


def table_pairs(tables: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs; what graph operators work on."""
    both = tables.filter(F.col(SRC).isNotNull() & F.col(TGT).isNotNull())
    return both.select(F.col(SRC).alias("source"), F.col(TGT).alias("target")).distinct()


def column_pairs(columns: DataFrame) -> DataFrame:
    """Distinct (source, target) pairs of columns, named ``table::column``; for column-level closure and cycles."""
    source = _text(SRC, F.lit("::"), "source_column_name")
    target = _text(TGT, F.lit("::"), "target_column_name")
    known = [F.col(c).isNotNull() for c in (SRC, "source_column_name", TGT, "target_column_name")]
    whole = columns.filter(known[0] & known[1] & known[2] & known[3])
    return whole.select(source.alias("source"), target.alias("target")).distinct()


#: Rounds after which the tables reached so far are written as one frame, so that plans stay short on long chains.
_COMPACT = 16


def lineage_closure(
    pairs: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int | None = None
) -> DataFrame:
    """Tables reachable from each start with the length of the shortest path: (root, full_name, depth).

    ``starts`` has a column ``root``. Breadth first: each round joins the newest tables to the pairs and drops what the
    same root has already reached, so cycles end. Rounds go on until nothing new is found, or for ``max_depth`` steps if
    that is given. The start itself appears only if a cycle leads back to it. Every round is written to the checkpoint
    folder, which keeps plans short and lets the job survive lost executors. The driver only learns whether a round
    found anything.
    """
    if direction not in ("upstream", "downstream"):
        raise ValueError("direction is upstream or downstream")
    here, there = ("source", "target") if direction == "downstream" else ("target", "source")
    steps = cut(pairs.select(F.col(here).alias("_from"), F.col(there).alias("full_name")).distinct())
    frontier = starts.select("root", F.col("root").alias("full_name"))
    reached: DataFrame | None = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nearby = (
            frontier.withColumnRenamed("full_name", "_from")
            .join(steps, "_from")
            .select("root", "full_name")
            .distinct()
        )
        if reached is not None:
            nearby = nearby.join(reached.select("root", "full_name"), ["root", "full_name"], "left_anti")
        found = cut(nearby.withColumn("depth", F.lit(depth)))
        if found.isEmpty():
            break
        reached = found if reached is None else reached.unionByName(found)
        if depth % _COMPACT == 0:
            reached = cut(reached)
        frontier = found.select("root", "full_name")
    if reached is None:
        return starts.select("root", F.lit("").alias("full_name"), F.lit(0).alias("depth")).limit(0)
    return reached


def _on_both_sides(pairs: DataFrame) -> DataFrame:
    """Pairs left when tables without an incoming or without an outgoing edge are peeled off until none is found."""
    size = pairs.count()
    while size:
        entered, left = pairs.select(F.col("target").alias("source")).distinct(), pairs.select(F.col("source").alias("target")).distinct()
        pairs = cut(pairs.join(entered, "source", "left_semi").join(left, "target", "left_semi").select("source", "target"))
        before, size = size, pairs.count()
        if size == before:
            break
    return pairs


def _strong_parts(pairs: DataFrame) -> DataFrame:
    """(full_name, part): tables that reach each other, for every such part of two tables or more.

    Each round gives every table the smallest name that reaches it. Within one such colour the part of the naming table
    is what reaches it back; parts found leave the pairs, what is left is peeled again.
    """
    parts: DataFrame | None = None
    pairs = _on_both_sides(cut(pairs))
    while not pairs.isEmpty():
        names = pairs.select(F.col("source").alias("full_name")).union(pairs.select("target")).distinct()
        colours = cut(names.withColumn("colour", F.col("full_name")))
        while True:
            reaching = pairs.join(colours.withColumnRenamed("full_name", "source"), "source").groupBy(F.col("target").alias("full_name")).agg(F.min("colour").alias("_via"))
            after = colours.join(reaching, "full_name", "left").select("full_name", F.least("colour", "_via").alias("colour"), (F.col("_via") < F.col("colour")).alias("_new"))
            after = cut(after)
            colours = after.drop("_new")
            if after.filter("_new").isEmpty():
                break
        of_source, of_target = (colours.select(F.col("full_name").alias(c), F.col("colour").alias(f"_{c}")) for c in ("source", "target"))
        inside = pairs.join(of_source, "source").join(of_target, "target").filter("_source = _target").select("source", "target")
        roots = colours.select(F.col("colour").alias("root")).distinct()
        back = lineage_closure(inside, roots, "upstream").select("full_name", F.col("root").alias("part"))
        found = cut(back.unionByName(roots.join(back, F.col("root") == F.col("part"), "left_semi").select(F.col("root").alias("full_name"), F.col("root").alias("part"))).distinct())
        parts = found if parts is None else parts.unionByName(found)
        gone = found.select("full_name").union(roots).distinct()
        rest = pairs.join(gone.withColumnRenamed("full_name", "source"), "source", "left_anti")
        pairs = _on_both_sides(cut(rest.join(gone.withColumnRenamed("full_name", "target"), "target", "left_anti").select("source", "target")))
    if parts is None:
        return pairs.select(F.col("source").alias("full_name"), F.col("target").alias("part")).limit(0)
    return parts


def cycles(pairs: DataFrame) -> DataFrame:
    """Tables on a cycle with the length of their shortest one.

    A cycle lies within tables that all reach each other. Such parts are found first; the walk starts only from
    their tables and never leaves a part.
    """
    proper = pairs.filter(F.col("source") != F.col("target"))
    self_loops = pairs.filter(F.col("source") == F.col("target")).select(F.col("source").alias("full_name"), F.lit(1).alias("length"))
    parts = cut(_strong_parts(proper))
    of_source, of_target = (parts.select(F.col("full_name").alias(c), F.col("part").alias(f"_{c}")) for c in ("source", "target"))
    inside = proper.join(of_source, "source").join(of_target, "target").filter("_source = _target").select("source", "target")
    walked = lineage_closure(inside, parts.select(F.col("full_name").alias("root")), "downstream")
    loops = walked.filter(F.col("root") == F.col("full_name")).select("full_name", F.col("depth").alias("length"))
    return loops.unionByName(self_loops).groupBy("full_name").agg(F.min("length").alias("length"))
