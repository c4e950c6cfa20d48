"""User-defined functions: SQL-bodied scalars, aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession


def create_function(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """A SQL-bodied scalar function; the optimizer inlines its body."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


def create_table_function(spark: SparkSession, name: str, params: str, columns: str, body: str) -> None:
    """A SQL-bodied table function (RETURNS TABLE)."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({columns}) RETURN {body}")


def user_aggregate(df: DataFrame, keys: list[str], state: dict[str, tuple[str, Column]], final: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """An aggregate given by its state (name -> (type, built-in partial aggregate)) and a
    final step; partial aggregation before the shuffle comes from the built-in parts."""
    return final(df.groupBy(*keys).agg(*[c.cast(t).alias(n) for n, (t, c) in state.items()]))
