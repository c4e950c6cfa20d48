"""Helpers shared by the corpus operators: the shared folder, lineage cuts, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where the setting is absent a folder of this process serves, on a local master only:
    the machines of a cluster would not see it.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = path = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def inline_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A bounded driver-side list as a JVM-side relation (no Python on executors)."""
    import json

    empty = spark.range(1).select(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>").alias("r"))
    return empty.select(F.inline("r"))


def text_batches(batches: Iterator[pa.RecordBatch], name: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of at most ``rows`` rows with one column as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(part.schema.get_field_index(name)).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = 0x9E3779B97F4A7C15 | 1
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, and of its inverse, modulo 2^64; more than ``n`` of each."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _power:
        _power.clear()
        up = np.full(size, _ODD, np.uint64)
        down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _power[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _power[size]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of ``raw``, without a Python word."""
    buf = np.frombuffer(raw, np.uint8)
    edge = np.diff(np.concatenate([[False], ~_BLANK[buf], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return starts, ends, mix64((total[ends] - total[starts]) * down[starts])
