"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lakegauge.functions.checkpoints import ensure_checkpoint_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the frame below ``spark.checkpoint.dir`` and read it back: the plan above starts from files that survive executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
