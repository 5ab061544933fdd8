"""Named queries over the test tables and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn

def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


from tidewright.plans import answers, audit, collecting, items, payloads, ranking, reader, scalars, stories, timestamps, views  # noqa: E402, F401
