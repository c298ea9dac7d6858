"""Registry of queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gradeframe.sources.tables import read_table

class Tables:
    """Attribute access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)


@dataclass(frozen=True)
class Check:
    name: str
    covers: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists blueprint ids."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"{name} registered twice")
        CHECKS[name] = Check(name, covers, build, sql)
        return build

    return add
