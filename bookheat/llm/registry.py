"""Registry of the queries of this subpackage, apart from the rest of the library."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from bookheat.llm.common import bound_batches
from bookheat.session import ship_package

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register ``job`` under ``name``; ``sql`` is the equivalent DuckDB SQL, if there is one."""

    def add(job: Job) -> Job:
        @wraps(job)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            bound_batches(spark)
            return job(spark, sf)

        JOBS[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return job

    return add
