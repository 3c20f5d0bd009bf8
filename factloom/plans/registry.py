"""Named queries over the given tables, each with its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.fixtures import oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None, repeats: bool = False):
    """Registers a function of the named tables (after the session, if it asks for `spark` first). repeats: it tells their rows apart itself, so that needn't be done before."""

    def put(f):
        wants = f.__code__.co_varnames[: f.__code__.co_argcount][:1] == ("spark",)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            own = [table(spark, sf_dir, t, repeats) for t in tables]
            return f(spark, *own) if wants else f(*own)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return put
