"""Registry of checked queries: a Spark callable and, where SQL can say it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegauge.session import prepare
from verification.fixtures import Tables, with_ctes


@dataclass
class Check:
    key: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    num: tuple[str, ...]
    digits: int

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        """The Spark side; fractional columns are shown as rounded doubles so that both engines print alike."""
        df = self.build(tables(prepare(spark), path))
        shown = [
            F.round(F.col(f"`{c}`").cast("double"), self.digits).alias(c) if c in self.num else F.col(f"`{c}`")
            for c in df.columns
        ]
        return df.select(*shown)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = with_ctes(self.sql)
        if not self.num:
            return body
        shown = ", ".join(f'round(CAST("{c}" AS DOUBLE), {self.digits}) AS "{c}"' for c in self.num)
        return f"SELECT * REPLACE ({shown}) FROM (\n{body}\n) AS shown"


CHECKS: dict[str, Check] = {}
_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, path: str) -> Tables:
    """The lazy fixture frames of a session and folder; only plans are kept, never data."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, path)
    return _TABLES[key]


def check(key: str, sql: str | None = None, num: Sequence[str] = (), digits: int = 4):
    def register(build: Callable[[Tables], DataFrame]):
        if key in CHECKS:
            raise ValueError(f"duplicate query {key}")
        CHECKS[key] = Check(key, build, sql, tuple(num), digits)
        return build

    return register


def load_all() -> dict[str, Check]:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    import verification

    for module in pkgutil.iter_modules(verification.__path__):
        if module.name.startswith("checks_"):
            importlib.import_module(f"verification.{module.name}")
    return CHECKS
