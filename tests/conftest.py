import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lakegauge.session import local_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = local_session(
        4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": warehouse,
                       "spark.sql.maxMetadataStringLength": "100000", "spark.sql.debug.maxToStringFields": "1000",
                       "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from verification.registry import tables as make

    return make(spark, SF)
