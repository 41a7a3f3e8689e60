"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import detect_queries, ledger_queries, match_queries, plane_queries, render_queries, rule_queries, storage_queries, time_queries, track_queries
from trackloom.plans.adapters import table

FLAGSHIP = "j04_excluded_detections"
MODULES = (time_queries, track_queries, match_queries, ledger_queries, plane_queries, render_queries, detect_queries, rule_queries, storage_queries)


class Tables:
    """The tables of a folder by name, and the session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def _run(make: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
    return make(Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, make) for m in MODULES for name, (make, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items() if sql}
