"""Registration of queries and access to tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """Run ``text`` with the tables it names as views; a plan keeps the files it was made with."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args) if args else spark.sql(text)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL it must agree with."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def statement(name: str, text: str, oracle: str | None = None, args: dict | None = None) -> None:
    """Register a Spark SQL statement; the oracle is the same text unless given."""
    QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text, args)
    ORACLES[name] = oracle or text
