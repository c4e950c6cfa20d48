"""Loading, storing and fetching rows."""

from __future__ import annotations

import atexit
import dataclasses
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


class RowCountError(ValueError):
    """A fetch found fewer or more rows than it may return."""


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """parquet, orc, csv, json, text or jdbc; text formats want a schema, which spares a pass to infer one."""
    reader = spark.read.format(fmt).options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if fmt != "jdbc" else reader.load()


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def copy_in(spark: SparkSession, rows: Iterable[tuple], schema: str, batch: int = 50_000) -> DataFrame:
    """Typed rows checked against the target's columns, then stored in batches of ``batch``.

    The driver holds one batch; rows of a later batch that do not fit leave no table behind.
    """
    path = scratch(spark, "copy")
    rows = iter(rows)
    try:
        while True:
            some = list(itertools.islice(rows, batch))
            spark.createDataFrame(some, schema, verifySchema=True).write.mode("append").parquet(path)
            if len(some) < batch:
                break
    except BaseException:
        remove(spark, path)
        raise
    return spark.read.schema(spark.createDataFrame([], schema).schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session shares."""
    return f"{_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, partition_by: list[str] = ()) -> DataFrame:
    """Evaluate once: write to the shared folder and read what was written."""
    path = scratch(df.sparkSession, name)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    reader = df.sparkSession.read
    return (reader if partition_by else reader.schema(df.schema)).parquet(path)


class MaterializedView:
    """A stored result that ``refresh`` replaces; readers of an earlier image keep it until ``drop_old``."""

    def __init__(self, spark: SparkSession, name: str, build: Callable[[], DataFrame], with_data: bool = True):
        self.spark, self.name, self.build, self.path, self.old = spark, name, build, None, []
        if with_data:
            self.refresh()

    def refresh(self) -> DataFrame:
        made, path = self.build(), scratch(self.spark, f"view-{self.name}")
        made.write.parquet(path)
        if self.path:
            self.old.append(self.path)
        self.path, self.schema = path, made.schema
        return self.read()

    def read(self) -> DataFrame:
        if self.path is None:
            raise ValueError(f"materialized view {self.name} has not been populated")
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop_old(self) -> None:
        while self.old:
            remove(self.spark, self.old.pop())


def explain(df: DataFrame, mode: str = "formatted") -> DataFrame:
    """``EXPLAIN``: the plan as rows (line, plan); nothing is run."""
    kind = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    lines = df._jdf.queryExecution().explainString(kind).split("\n")
    return df.sparkSession.createDataFrame(list(enumerate(lines, 1)), "line int, plan string")


def explain_json(df: DataFrame) -> str:
    """``EXPLAIN (FORMAT JSON)``: the optimised plan's nodes in preorder."""
    return df._jdf.queryExecution().optimizedPlan().toJSON()


def tablesample(df: DataFrame, method: str, amount: float, seed: int | None = None) -> DataFrame:
    """``TABLESAMPLE``: bernoulli and system by percent, system_rows by a count.

    ``bernoulli`` draws rows, ``system`` whole splits of files, so it reads only those; both repeat under
    a seed.  ``system_rows`` takes rows from as few partitions as hold them.  A time bound is no sample that can be repeated, and is refused.
    """
    if method == "bernoulli":
        return df.sample(fraction=amount / 100, seed=seed)
    if method == "system":
        block = F.xxhash64(F.lit(seed if seed is not None else uuid.uuid4().int % (1 << 31)), F.input_file_name(), F.input_file_block_start())
        return df.where(F.pmod(block, F.lit(1_000_000)) < F.lit(int(amount * 10_000)))
    if method == "system_rows":
        return df.limit(int(amount))
    raise ValueError(f"sampling method {method}")


def create_table_as(df: DataFrame, name: str) -> DataFrame:
    """Store a result in the shared folder and return the stored table; refreshing is calling it again."""
    return stored(df, f"table-{name}")


def fetch_all(df: DataFrame) -> list:
    return df.collect()


def fetch_optional(df: DataFrame):
    """None or the single row; reads two rows at most."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise RowCountError("more than one row")
    return rows[0] if rows else None


def fetch_one(df: DataFrame):
    row = fetch_optional(df)
    if row is None:
        raise RowCountError("no row")
    return row


def fetch_value(df: DataFrame) -> Any:
    if len(df.columns) != 1:
        raise ValueError(f"one column is wanted, there are {len(df.columns)}")
    return fetch_one(df)[0]


def execute(df: DataFrame) -> int:
    """Number of rows of the statement's result."""
    return df.count()


def fetch_as(df: DataFrame, kind: type[T]) -> list[T]:
    """Rows as dataclass instances, by column name; missing and surplus columns are errors."""
    want = {f.name for f in dataclasses.fields(kind)}
    if want != set(df.columns):
        raise ValueError(f"columns differ: {sorted(want ^ set(df.columns))}")
    return [kind(**r.asDict()) for r in df.collect()]
