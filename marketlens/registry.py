"""Registry that pairs each Spark query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.fixtures import Tables, with_projections

PLACES = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round every double so that summation order cannot change the compared value."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = (F.round(column.cast("double"), PLACES) + F.lit(0.0)).alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint").alias(field.name)
        columns.append(column)
    return df.select(*columns)


def _rounded_sql(sql: str, dbl: str, big: str) -> str:
    swaps = [f"round(CAST({c} AS DOUBLE), {PLACES}) + 0.0 AS {c}" for c in dbl.split()]
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in big.split()]
    head = f"SELECT * REPLACE ({', '.join(swaps)})" if swaps else "SELECT *"
    return f"{head} FROM (\n{sql.strip()}\n) answer"


def query(name: str, sql: str | None = None, dbl: str = "", big: str = ""):
    """Register ``build(tables)`` under ``name``; ``sql`` may use any ``fx_*`` projection."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        oracle = None if sql is None else with_projections(_rounded_sql(sql, dbl, big))
        QUERIES[name] = Query(name, build, oracle)
        return build

    return register


def load_plans() -> None:
    import importlib
    import pkgutil

    import marketlens.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"marketlens.plans.{module.name}")


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_plans()

    def runner(entry: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(entry.build(Tables(spark, sf_dir)))

        return run

    return {name: runner(entry) for name, entry in QUERIES.items()}


def oracle_queries() -> dict[str, str]:
    load_plans()
    return {name: entry.sql for name, entry in QUERIES.items() if entry.sql is not None}
