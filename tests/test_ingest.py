"""Loading, replacing and streaming into tables."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lakegauge.functions.checkpoints import ensure_checkpoint_dir
from lakegauge.plans import qi_build
from lakegauge.sources import files, ingest
from lakegauge.streaming import jobs


def test_replace_keeps_the_other_origin_and_can_empty(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    files.replace_partition(df, root, "real")
    files.replace_partition(df, root, "demo")
    loaded = files.read_table(spark, root)
    files.replace_partition(loaded.filter("data_origin = 'real' AND x = 2"), root, "real")
    assert sorted((r.data_origin, r.x) for r in files.read_table(spark, root).collect()) == [("demo", 1), ("demo", 2), ("real", 2)]
    files.replace_partition(df.limit(0), root, "demo")
    assert [r.x for r in files.read_table(spark, root).collect()] == [2]
    files.drop_partition(spark, root, "demo")
    assert files.has_rows_for(spark, root, "real") and not files.has_rows_for(spark, root, "demo")


def test_a_swap_that_fails_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    old, new = (spark.createDataFrame([(x,)], "x int") for x in (1, 2))
    tables = [f"{root}/{t}" for t in ("a", "b", "c")]
    for t in tables:
        files.replace_partition(old, t, "real")
    real, calls = files._moved, []

    def failing(fs, source, target):
        calls.append(source)
        if len(calls) == 4:
            raise OSError("lost")
        real(fs, source, target)

    moves = {files.partition_path(t, "real"): files.staged_partition(new, t) for t in tables}
    monkeypatch.setattr(files, "_moved", failing)
    with pytest.raises(OSError):
        files.publish(spark, root, moves)
    assert [r.x for t in tables for r in files.read_table(spark, t).collect()] == [1, 1, 1]

    files.publish(spark, root, {files.partition_path(t, "real"): files.staged_partition(new, t) for t in tables})
    assert [r.x for t in tables for r in files.read_table(spark, t).collect()] == [2, 2, 2]


def test_readers_see_all_old_or_all_new_rows_and_undo_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables = [f"{root}/{t}" for t in ("a", "b", "c")]

    def seen():
        return [r.x for t in tables for r in files.read_table(spark, t).collect()]

    def publish(x):
        df = spark.createDataFrame([(x,)], "x int")
        files.publish(spark, root, {files.partition_path(t, "real"): files.staged_partition(df, t) for t in tables})

    publish(1)
    early = files.read_table(spark, tables[0])
    real, between = files._moved, []

    def watched(fs, source, target):
        between.append(seen())
        real(fs, source, target)
        between.append(seen())

    monkeypatch.setattr(files, "_moved", watched)
    publish(2)
    monkeypatch.undo()
    assert between == [[1, 1, 1]] * 7 + [[2, 2, 2]] and seen() == [2, 2, 2]
    assert [r.x for r in early.collect()] == [1]  # a reader that began before
    # A job that dies before the commit leaves versions that nobody reads, and the next writer goes on.
    monkeypatch.setattr(files, "_moved", lambda fs, source, target: None if "_live-" in target.getName() else real(fs, source, target))
    publish(3)
    monkeypatch.undo()
    assert seen() == [2, 2, 2]
    for x in (4, 5, 6):
        publish(x)
    assert seen() == [6, 6, 6]
    assert len(list((tmp_path / "a" / "data_origin=real").glob("_v-*"))) == 2
    files.append_partition(spark.createDataFrame([(7,)], "x int"), tables[0], "real")
    assert sorted(seen()) == [6, 6, 6, 7]
    files.replace_partition(spark.createDataFrame([(8,)], "x int"), tables[1], "real")
    assert sorted(seen()) == [6, 6, 7, 8]


def test_append_skips_loaded_keys_but_keeps_repeats(spark, tmp_path):
    root = str(tmp_path)
    schema = "record_id string, usage_end_time timestamp_ntz, usage_quantity double"
    at = datetime(2026, 1, 1)
    ingest.load_table(spark.createDataFrame([("a", at, 1.0)], schema), root, "billing_usage", "real", replace=False)
    ingest.load_table(spark.createDataFrame([("a", at, 9.0), ("b", at, 2.0), ("b", at, 2.0)], schema), root, "billing_usage", "real", replace=False)
    ingest.load_table(spark.createDataFrame([("a", at, 7.0)], schema), root, "billing_usage", "demo", replace=False)
    rows = files.read_table(spark, f"{root}/billing_usage").collect()
    assert sorted((r.data_origin, r.record_id, float(r.usage_quantity)) for r in rows) == [("demo", "a", 7.0), ("real", "a", 1.0), ("real", "b", 2.0), ("real", "b", 2.0)]


def test_workspace_upsert_keeps_names(spark, tmp_path):
    root = str(tmp_path)
    schema = "workspace_id string, workspace_name string, status string"
    ingest.load_table(spark.createDataFrame([("1", "one", "RUNNING")], schema), root, "workspaces", "real")
    ingest.load_table(spark.createDataFrame([("1", None, "CANCELLED"), ("2", "two", None)], schema), root, "workspaces", "real")
    rows = {r.workspace_id: (r.workspace_name, r.status) for r in files.read_table(spark, f"{root}/workspaces").collect()}
    assert rows == {"1": ("one", "CANCELLED"), "2": ("two", None)}


def test_incremental_load_is_strictly_after_the_cursor(spark, tmp_path):
    root = str(tmp_path)
    schema = "job_id string, name string, change_time timestamp_ntz"
    first = spark.createDataFrame([("j1", "a", datetime(2026, 1, 1)), ("j2", "b", datetime(2026, 1, 2))], schema)
    ingest.incremental_load(spark, {"jobs": first}, root)
    more = first.unionByName(spark.createDataFrame([("j3", "c", datetime(2026, 1, 2)), ("j4", "d", datetime(2026, 1, 3))], schema))
    run = ingest.incremental_load(spark, {"jobs": more}, root).first()
    assert (run.rows_ingested, run.max_record_id) == (1, "j4")
    assert ingest.incremental_load(spark, {"jobs": more}, root).count() == 0
    cursor = ingest.read_cursors(spark, root).first()
    assert (cursor.max_update_time, cursor.rows_ingested) == (datetime(2026, 1, 3), 3)
    assert files.read_table(spark, f"{root}/jobs").count() == 3


def test_incremental_load_after_a_crash_and_without_times(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("j1", "a", datetime(2026, 1, 1)), ("j2", "b", None), ("j3", None, None)], "job_id string, name string, change_time timestamp_ntz")
    ingest.load_table(rows, root, "jobs", "real", replace=False)  # the cursor was never written
    assert ingest.incremental_load(spark, {"jobs": rows}, root).count() == 0
    more = rows.unionByName(spark.createDataFrame([("j4", "d", None), ("j5", "e", datetime(2026, 1, 5))], rows.schema))
    ingest.incremental_load(spark, {"jobs": more}, root)
    ingest.incremental_load(spark, {"jobs": more}, root)
    assert sorted(r.job_id for r in files.read_table(spark, f"{root}/jobs").collect()) == ["j1", "j2", "j3", "j4", "j5"]


def test_incremental_load_compares_only_what_can_be_equal(spark, tmp_path, monkeypatch):
    root, compared = str(tmp_path), []
    plain = ingest.rows_not_in
    monkeypatch.setattr(ingest, "rows_not_in", lambda new, existing: compared.append(existing.count()) or plain(new, existing))
    schema = "record_id string, usage_end_time timestamp_ntz, usage_quantity double"
    kept = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(kept.rglob("rdd-*"))

    def day(n, *ids):
        return [(i, datetime(2026, 1, n), 1.0) for i in ids]

    def load(rows):
        run = ingest.incremental_load(spark, {"billing_usage": spark.createDataFrame(rows, schema)}, root).collect()
        return [r.rows_ingested for r in run]

    def loaded():
        return sorted(str(r.record_id) for r in files.read_table(spark, f"{root}/billing_usage").collect())

    first = day(1, "a", "b", None)
    assert load(first) == [3]
    later = [*first, *day(2, "a", "c", "c", None), ("d", None, 1.0)]
    # No row is after the cursor, so none is compared; the known key is not loaded again, unlike keys that repeat among the new or are null.
    assert load(later) == [5] and compared == []
    assert loaded() == ["None", "None", "a", "b", "c", "c", "d"]
    # Only the row without a time is compared with.
    assert load([*later, *day(3, "e")]) == [1] and compared == [1]
    assert loaded() == ["None", "None", "a", "b", "c", "c", "d", "e"]
    assert set(kept.rglob("rdd-*")) == before and not list(tmp_path.rglob("_staged-*"))


def test_csv_export(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([(1, "ä,b"), (2, None), (3, "c")], "n int, t string"), path, max_rows=2)
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().decode() == '﻿n,t\r\n1,"ä,b"\r\n2,\r\n'


def test_build_replaces_one_origin_and_counts_bad_rows(spark, tmp_path):
    root = str(tmp_path)
    h = spark.createDataFrame([("1", "SELECT * FROM a.b.c", 5), (None, "SELECT 1", 6), ("2", "x", None)], "statement_id string, statement_text string, total_duration_ms bigint")
    run = qi_build.qi_build(spark, h, root).first()
    assert (run.status, run.statements, run.bad_rows) == ("success", 2, 1)
    qi_build.qi_build(spark, h.limit(1), root, origin="demo")
    qi_build.qi_build(spark, h.limit(1), root)
    counts = {r.data_origin: r["count"] for r in qi_build.read_qi(spark, root, "qi_statements", None).groupBy("data_origin").count().collect()}
    assert counts == {"real": 1, "demo": 1}
    assert qi_build.read_qi(spark, root, "qi_statement_tables").first().fully_qualified == "a.b.c"
    assert spark.read.parquet(f"{root}/qi_extract_runs").count() == 3


def test_build_deals_few_input_splits_to_all_cores(spark, tmp_path):
    root = str(tmp_path)
    rows = [(str(n) if n % 10 else None, f"SELECT a FROM m.s.t{n}", n) for n in range(300)]
    history = spark.createDataFrame(rows, "statement_id string, statement_text string, total_duration_ms bigint").coalesce(1)
    assert qi_build.spread(history).select(F.spark_partition_id()).distinct().count() >= 4 * spark.sparkContext.defaultParallelism // 2
    run = qi_build.qi_build(spark, history, root).first()
    assert (run.statements, run.bad_rows) == (270, 30)
    assert len(list((tmp_path / "qi_statements").rglob("part-*.parquet"))) > 1
    # Without these columns, rows are dealt as they come.
    assert qi_build.spread(spark.range(5).coalesce(1)).count() == 5


def test_stream_load_resumes_and_drops_repeats(spark, tmp_path):
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    schema = "id string, at timestamp"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    def load():
        stream = jobs.file_stream(spark, source, spark.createDataFrame([], schema).schema)
        jobs.stream_incremental(stream, "at", "id", table, mark, delay="10 days").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(files.partition_path(table, "real")).collect())

    arrive(("a", datetime(2026, 1, 1)), ("a", datetime(2026, 1, 1)), ("b", datetime(2026, 1, 2)))
    assert load() == ["a", "b"]
    assert load() == ["a", "b"]
    arrive(("b", datetime(2026, 1, 2)), ("c", datetime(2026, 1, 3)))
    assert load() == ["a", "b", "c"]


def test_state_survives_between_batches_and_late_rows_are_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "warehouse_id string, event_time timestamp, event_type string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.stream_wh_gap(jobs.file_stream(spark, source, spark.createDataFrame([], schema).schema))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.warehouse_id, r.seconds) for r in spark.read.schema(jobs.GAP_SCHEMA).parquet(out).collect())

    try:
        assert arrive(("w", datetime(2026, 1, 1, 10), "STARTING"), ("v", datetime(2026, 1, 1, 15), "STARTING")) == []
        late = ("w", datetime(2026, 1, 1, 9), "STARTING")
        assert arrive(("w", datetime(2026, 1, 1, 15, 0, 30), "RUNNING"), late) == [("w", 18030.0)]
        assert arrive(("v", datetime(2026, 1, 1, 15, 1), "RUNNING")) == [("v", 60.0), ("w", 18030.0)]
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_soft_delete_and_restore(spark):
    at = datetime(2026, 1, 1)
    df = spark.createDataFrame([("real", None), ("real", datetime(2020, 1, 1)), ("demo", None)], "data_origin string, deleted_at timestamp_ntz")
    gone = ingest.soft_delete(df, "real", at)
    assert [r.deleted_at for r in gone.collect()] == [at, datetime(2020, 1, 1), None]
    assert gone.transform(lambda d: ingest.restore(d, "real")).filter(F.col("deleted_at").isNotNull()).count() == 0
    assert ingest.hard_delete(df, "real").count() == 1


def test_snapshot_prefix_never_mixes(spark, tmp_path):
    root = str(tmp_path)
    files.write_snapshot(spark.createDataFrame([("demo",)], "y string"), root, "t", date(2027, 1, 1), files.DEMO_PREFIX)
    assert files.latest_snapshot(spark, root, "t") is None
    assert files.latest_snapshot(spark, root, "t", files.DEMO_PREFIX).first().y == "demo"
