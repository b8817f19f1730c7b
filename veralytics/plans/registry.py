"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veralytics.sources.fixtures import Tables, with_fixtures

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``; ``oracle`` may use fixtures as ``{fx_name}``."""

    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def oracle(name: str) -> str:
    """The runnable oracle text; built late, when every module has added its parts."""
    return with_fixtures(ORACLES[name])


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return QUERIES[name](Tables(spark, sf_dir))

    run.__name__ = name
    return run
