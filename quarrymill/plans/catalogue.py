"""Every query of the library with its SQL, by driver key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, **types: str):
    """Registers a query under its function's name, with the SQL that gives the same rows where SQL can.

    types: columns of the SQL to cast, where its types are wider than the query's.
    """
    if types:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql})"

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from quarrymill.plans import queries_answer, queries_ingest, queries_search, queries_structure  # noqa: E402, F401
