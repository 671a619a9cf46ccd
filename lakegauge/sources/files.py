"""Snapshots, exports and partition folders on any file system Hadoop knows."""

from __future__ import annotations

import logging
import re
import time
import uuid
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation

from lakegauge.operators.scope import clamp_origin

DEMO_PREFIX = "demo_"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def list_snapshots(spark: SparkSession, root: str, table: str, prefix: str = "") -> list[str]:
    """Names of the dated snapshots of a table, oldest first. A missing folder gives an empty list."""
    fs, folder = _fs(spark, root)
    if not fs.exists(folder):
        return []
    pattern = re.compile(rf"{re.escape(prefix + table)}_[^/]*\.parquet")
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n for n in names if pattern.fullmatch(n))


def latest_snapshot(
    spark: SparkSession,
    root: str,
    table: str,
    prefix: str = "",
    fallback_to_real: bool = False,
    schema: T.StructType | None = None,
) -> DataFrame | None:
    """The newest ``<prefix><table>_*.parquet`` by name, or None. Demo reads may fall back to the real snapshot.

    The prefix is part of the match, so a read without one never picks up a ``demo_`` file.
    """
    names = list_snapshots(spark, root, table, prefix)
    if not names and prefix and fallback_to_real:
        names = list_snapshots(spark, root, table)
    if not names:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root}/{names[-1]}")


def write_snapshot(df: DataFrame, root: str, table: str, day: date, prefix: str = "") -> str:
    """Write a dated snapshot and return its path."""
    path = f"{root}/{prefix}{table}_{day.isoformat()}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def snapshot_history(spark: SparkSession, root: str, table: str, prefix: str = "") -> DataFrame:
    """All snapshots of a table together, each row with the date in its snapshot's name."""
    paths = [f"{root}/{n}" for n in list_snapshots(spark, root, table, prefix)]
    day = F.regexp_extract(F.input_file_name(), rf"{re.escape(prefix + table)}_(\d{{4}}-\d{{2}}-\d{{2}})\.parquet", 1)
    return spark.read.parquet(*paths).withColumn("snapshot_date", F.to_date(day))


def safe_stem(text: str | None, default: str = "chatbot-result", longest: int | None = None) -> str:
    """File-name stem of lower-case words joined by dashes, cut to ``longest`` characters if that is given."""
    stem = re.sub(r"[^a-z0-9]+", "-", (text or default).lower()).strip("-")[:longest]
    return stem or default


def write_csv(df: DataFrame, path: str, max_rows: int | None = None) -> None:
    """Result export as CSV with byte order mark, header and CRLF line ends.

    With ``max_rows`` the first rows go into one file (the limit already brings them into one partition); without it
    all rows are written, one file for each partition. The mark is written as part of the first header name.
    """
    marked = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    if max_rows is not None:
        marked = marked.limit(max_rows).coalesce(1)
    marked.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option(
        "emptyValue", ""
    ).csv(path)


def partition_path(root: str, origin: str) -> str:
    return f"{root}/data_origin={origin}"


def _moved(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"could not move {source} to {target}")


#: A pointer file below a root names the live version of every folder published through that root; the highest number counts.
_POINTER = "_live-"
_VERSION = "_v-"


def _names(fs, folder) -> list[str]:
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _read_pointer(spark: SparkSession, root: str, name: str) -> dict[str, str]:
    """Folder -> version, both below ``root``."""
    fs, path = _fs(spark, f"{root}/{name}")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return dict(line.split("\t") for line in text.splitlines())


def _pointers(spark: SparkSession, root: str) -> list[str]:
    fs, folder = _fs(spark, root)
    return sorted(n for n in _names(fs, folder) if n.startswith(_POINTER))


def _live(spark: SparkSession, root: str) -> dict[str, str]:
    """The versions that the newest pointer below ``root`` names. A pointer that is cleaned away while it is read has a newer one."""
    while names := _pointers(spark, root):
        try:
            return _read_pointer(spark, root, names[-1])
        except Exception:  # the file system's own error, by way of the JVM
            if names[-1] in _pointers(spark, root):
                raise
    return {}


def _live_folder(spark: SparkSession, table: str, name: str) -> str:
    """Where the rows of the folder ``name`` of a table are: its newest published version, or the folder itself."""
    above, _, own = table.rstrip("/").rpartition("/")
    found = [f"{root}/{live[key]}" for root, key in ((table, name), (above, f"{own}/{name}")) if key in (live := _live(spark, root))]
    found = [v for v in found if (where := _fs(spark, v))[0].exists(where[1])]
    return max(found, key=lambda v: v.rpartition("/")[2], default=f"{table}/{name}")


def recover(spark: SparkSession, root: str) -> None:
    """Delete what publications through ``root`` left behind: versions that none of the last two pointers names, older pointers, cut-off ones.

    For a writer that holds the tables; readers never need it, since rows that no pointer names are not read.
    """
    fs, folder = _fs(spark, root)
    *older, before, last = ["", "", *_pointers(spark, root)]
    kept = [_read_pointer(spark, root, n) for n in (before, last) if n]
    used = {v.rpartition("/")[2] for pointer in kept for v in pointer.values()}
    for target in {t for pointer in kept for t in pointer}:
        fs_target, path = _fs(spark, f"{root}/{target}")
        newest = max((v for pointer in kept if (v := pointer.get(target, "").rpartition("/")[2])), default="")
        for name in _names(fs_target, path):
            # A newer version was published through the root above or below.
            if name.startswith(_VERSION) and name not in used and name < newest:
                fs_target.delete(_fs(spark, f"{root}/{target}/{name}")[1], True)
    for name in [n for n in older if n]:
        fs.delete(_fs(spark, f"{root}/{name}")[1], False)


def publish(spark: SparkSession, root: str, moves: Mapping[str, str]) -> None:
    """Make written folders (values) the rows of live ones (keys, below ``root``), all or none.

    Each becomes a version inside its live folder, under a name that readers skip. Then one small pointer file names the live versions; giving it
    its name is the commit. Readers take the newest pointer and so see all old or all new rows at any time, and write nothing. The versions before
    stay for readers that have begun; those before them are deleted. A job that dies leaves versions that nobody reads. Of two writers at once, the
    later one finds the pointer's number taken and fails.
    """
    last = (_pointers(spark, root) or [f"{_POINTER}{0:010}"])[-1]
    live = _live(spark, root)
    fs, _ = _fs(spark, root)
    made = []
    try:
        for target, staged in moves.items():
            version = f"{target}/{_VERSION}{time.time_ns():020}-{uuid.uuid4().hex}"
            _, path = _fs(spark, version)
            fs.mkdirs(path.getParent())
            _moved(fs, _fs(spark, staged)[1], path)
            made.append(path)
            live[target.removeprefix(f"{root}/")] = version.removeprefix(f"{root}/")
        _, draft = _fs(spark, f"{root}/_publishing-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write("".join(f"{t}\t{v}\n" for t, v in live.items()).encode())
        finally:
            out.close()
        made.append(draft)
        _, pointer = _fs(spark, f"{root}/{_POINTER}{int(last.removeprefix(_POINTER)) + 1:010}")
        if fs.exists(pointer):
            raise OSError(f"{pointer} was published by another writer")
        _moved(fs, draft, pointer)
    except BaseException:
        for path in made:
            fs.delete(path, True)
        raise
    # Rows from before the first publication lie in the folder itself.
    recover(spark, root)


def staged_folder(df: DataFrame, root: str) -> str:
    """Write rows below a table's folder, under a name that readers skip, and return where."""
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    return staged


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def staged_partition(df: DataFrame, root: str) -> str:
    """Write the rows of one origin next to their table and return where."""
    return staged_folder(df.drop("data_origin") if "data_origin" in df.columns else df, root)


def replace_partition(df: DataFrame, root: str, origin: str) -> None:
    """Replace the rows of one origin and leave the other origin alone.

    The new rows are written next to the table first and then published, so the frame may read the partition it
    replaces, a failed write or swap leaves the old rows in place, and an empty frame empties the partition.
    """
    spark = df.sparkSession
    publish(spark, root, {partition_path(root, origin): staged_partition(df, root)})
    spark.catalog.refreshByPath(root)


def append_partition(df: DataFrame, root: str, origin: str) -> None:
    spark = df.sparkSession
    rows = df.drop("data_origin") if "data_origin" in df.columns else df
    rows.write.mode("append").parquet(_live_folder(spark, root, partition_path("", origin)[1:]))
    spark.catalog.refreshByPath(root)


def drop_partition(spark: SparkSession, root: str, origin: str) -> None:
    fs, target = _fs(spark, partition_path(root, origin))
    if fs.exists(target):
        fs.delete(target, True)
    spark.catalog.refreshByPath(root)


def has_rows_for(spark: SparkSession, root: str, origin: str) -> bool:
    fs, target = _fs(spark, partition_path(root, origin))
    return bool(fs.exists(target))


def read_table(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """A table written partition by partition; ``data_origin`` comes from the folder names. Of published folders, the live versions are read."""
    reader = spark.read.option("basePath", root)
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("data_origin", T.StringType())]))
    fs, folder = _fs(spark, root)
    parts = [n for n in _names(fs, folder) if n.startswith("data_origin=")]
    return reader.parquet(*[_live_folder(spark, root, n) for n in sorted(parts)] or [root])


def materialise_tables(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> DataFrame:
    """Copy tables into managed-by-path tables of the same name and count each as it is written; -1 where a copy failed (the error is logged)."""
    counts = []
    for name, df in tables.items():
        seen = Observation()
        try:
            watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            watched.write.mode("overwrite").format(fmt).option("path", f"{root}/{name}").saveAsTable(name)
            counts.append((name, seen.get["rows"]))
        except Exception:  # one unreadable table must not stop the others
            logging.getLogger(__name__).exception("copying %s failed", name)
            counts.append((name, -1))
    return spark.createDataFrame(counts, "table_name string, rows bigint")


def jdbc_source(
    spark: SparkSession,
    url: str,
    table: str,
    origin: str | None = "real",
    has_tombstone: bool = True,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """A scoped table of a database. Predicates, limits and aggregates are pushed into the subquery.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read a large table in parallel.
    """
    where = [] if origin is None else [f"data_origin = '{clamp_origin(origin)}'"]
    if origin is not None and has_tombstone:
        where.append("deleted_at IS NULL")
    condition = f" WHERE {' AND '.join(where)}" if where else ""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"(SELECT * FROM {table}{condition}) q")
    for key in ("pushDownPredicate", "pushDownLimit", "pushDownOffset", "pushDownAggregate"):
        reader = reader.option(key, "true")
    return reader.option("fetchsize", str(fetch_size)).options(**options).load()
