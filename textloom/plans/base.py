"""Where queries register themselves, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_FOLD = "replace(replace(replace(lower(translate(coalesce({0}, ''), '" + T.FOLD_FROM.replace("'", "''") + "', '" + T.FOLD_TO + "')), 'sh', 's'), 'ri', 'r'), 'ee', 'i')"
NOW = "2024-01-15 12:00:00"


def sql_fold(x: str) -> str:
    return _FOLD.format(x)


def query(sql: str | None = None):
    """Register a function of (tables) as the query of its name; ``t('x')`` reads table x."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
