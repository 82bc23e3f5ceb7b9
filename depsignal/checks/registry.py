"""Registered queries and the SQL that must give the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depsignal.checks.prelude import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the common table expressions of the prelude."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            head = f"{PRELUDE},\n" if sql.lstrip().startswith("+") else f"{PRELUDE}\n"
            ORACLES[name] = head + sql.lstrip().removeprefix("+")
        return fn

    return register
