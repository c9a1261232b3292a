"""Queries over the driver's tables, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Names, functions and SQL of a module's queries."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero made positive, NaN made null, as the SQL does."""
    made: dict[str, Column] = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            made[name] = F.when(~F.isnan(name), F.round(F.col(name).cast("double"), digits) + F.lit(0.0))
    return df.withColumns(made)
