"""The query-history build: raw history to the six ``qi_*`` tables of one origin, plus a run row.

The wide frame is computed once and written to a staging folder next to the tables. The six tables are then read from
it with column pruning, so texts are analysed once and not six times, nothing has to fit in memory, and a lost executor
only costs its own tasks. All six are written before any is published, and they are published together.

Reading a statement's text takes far longer than reading its row, and millions of statements fit into one or two input splits. So rows are first dealt
to all cores by their values.
"""

from __future__ import annotations

import logging
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from lakegauge.operators import query_etl
from lakegauge.sources import files

CHILDREN = {
    "qi_statement_tables": query_etl.qi_tables,
    "qi_statement_columns": query_etl.qi_columns,
    "qi_statement_tags": query_etl.qi_tags,
    "qi_statement_parameters": query_etl.qi_parameters,
    "qi_statement_errors": query_etl.qi_errors,
}

RUN_SCHEMA = (
    "run_id string, data_origin string, source string, started_at timestamp_ntz, ended_at timestamp_ntz, "
    "status string, statements bigint, bad_rows bigint, error string"
)


def spread(history: DataFrame) -> DataFrame:
    """The rows dealt by id, text and start, as far as there are such columns, to several tasks a core."""
    spark = history.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return history.repartition(tasks, *[c for c in ("statement_id", "statement_text", "start_time") if c in history.columns])


def build_tables(staged: DataFrame) -> dict[str, DataFrame]:
    """The six tables as frames over the staged wide rows."""
    statements = query_etl.qi_expensive(query_etl.qi_statements(staged))
    return {"qi_statements": statements, **{name: make(staged) for name, make in CHILDREN.items()}}


def qi_build(spark: SparkSession, history: DataFrame, root: str, origin: str = "real", source: str = "") -> DataFrame:
    """Rebuild the partition of one origin in all six tables and log the run; returns the run row.

    A row without a statement id cannot be keyed: it is counted as bad and left out instead of failing the run.
    """
    run_id = uuid.uuid4().hex
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    seen = Observation(f"history-{run_id}")
    status, problem, statements, bad = "success", None, 0, 0
    stage = f"{root}/_stage-{run_id}"
    try:
        flat = query_etl.analyse(spread(history.drop("data_origin")))
        keyed = F.col("statement_id").isNotNull()
        watched = flat.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.sum(F.when(keyed, 0).otherwise(1)).alias("bad")
        ).filter(keyed)
        watched.write.parquet(stage)
        bad = seen.get["bad"] or 0
        statements = seen.get["rows"] - bad
        staged = spark.read.schema(watched.schema).parquet(stage).withColumn("data_origin", F.lit(origin))
        moves = {files.partition_path(f"{root}/{name}", origin): files.staged_partition(table, f"{root}/{name}") for name, table in build_tables(staged).items()}
        files.publish(spark, root, moves)
        spark.catalog.refreshByPath(root)
    except Exception as error:
        status, problem = "failed", str(error)
        raise
    finally:
        fs, path = files._fs(spark, stage)
        fs.delete(path, True)
        ended = datetime.now(timezone.utc).replace(tzinfo=None)
        row = (run_id, origin, source, started, ended, status, statements, bad, problem)
        run = spark.createDataFrame([row], RUN_SCHEMA)
        try:
            run.write.mode("append").parquet(f"{root}/qi_extract_runs")
        except Exception:
            if status == "success":
                raise
            logging.getLogger(__name__).exception("the run row of a failed build could not be written")
    return run


def read_qi(spark: SparkSession, root: str, name: str, origin: str | None = "real") -> DataFrame:
    """One built table, scoped to an origin by partition."""
    df = files.read_table(spark, f"{root}/{name}")
    return df if origin is None else df.filter(F.col("data_origin") == origin)
