"""Session settings every job in this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; safe to set on a running session.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Settings that change plans only. Sizes come from the cluster, not from here.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # A batch for Python is held several times (Arrow on either side, and a copy); rows with lists would fill the 64 MB of the default.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the package settings to a session somebody else created."""
    for key, value in {**RESULT_CONF, **PLAN_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "lakegauge", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())
