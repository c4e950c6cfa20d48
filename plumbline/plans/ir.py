"""A small query form that compiles to DataFrame calls; rewrites work on it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns are named alias.column in every part of a query.


@dataclass(frozen=True)
class Join:
    table: str
    alias: str
    on: tuple[tuple[str, str], ...]  # (earlier alias.column, own column)
    kind: str = "inner"


@dataclass(frozen=True)
class Sub:
    """SELECT column FROM table WHERE where [AND outer = own]."""

    table: str
    alias: str
    column: str | None = None
    where: str | None = None
    outer: tuple[tuple[str, str], ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class NotIn:
    column: str
    sub: Sub


@dataclass(frozen=True)
class CountTest:
    """(SELECT count(*) ...) > 0, or = 0."""

    sub: Sub
    some: bool


@dataclass(frozen=True)
class Exists:
    sub: Sub
    positive: bool
    on: tuple[tuple[str, str], ...] = ()  # what correlates it besides sub.outer


@dataclass(frozen=True)
class Select:
    table: str
    alias: str
    columns: tuple[tuple[str, str], ...]  # (alias.column or literal 'text', output name)
    joins: tuple[Join, ...] = ()
    where: str | None = None
    equal: tuple[tuple[str, object], ...] = ()  # alias.column = constant
    tests: tuple = ()
    group: tuple[str, ...] | None = None  # () is one group
    distinct: bool = False
    limit: int | None = None


@dataclass(frozen=True)
class Union:
    arms: tuple[Select, ...]
    all: bool = False


@dataclass
class Frames:
    tables: dict[str, DataFrame]
    used: set[str] = field(default_factory=set)

    def scan(self, name: str, alias: str) -> DataFrame:
        self.used.add(name)
        return self.tables[name].select(*[F.col(c).alias(f"{alias}.{c}") for c in self.tables[name].columns])


def col(name: str):
    return F.col(f"`{name}`")


_PART = re.compile(r"`[^`]*`|'(?:[^'\\]|\\.)*'|\w+\.\w+")


def _expr(text: str, df: DataFrame):
    names = set(df.columns)
    return F.expr(_PART.sub(lambda m: f"`{m[0]}`" if m[0] in names else m[0], text))


def _sub(s: Sub, frames: Frames) -> DataFrame:
    df = frames.scan(s.table, s.alias)
    df = df.where(_expr(s.where, df)) if s.where else df
    return df.limit(s.limit) if s.limit is not None else df


def build(q: Select | Union, frames: Frames) -> DataFrame:
    if isinstance(q, Union):
        out = build(q.arms[0], frames)
        for arm in q.arms[1:]:
            out = out.unionAll(build(arm, frames))
        return out if q.all else out.distinct()
    df = frames.scan(q.table, q.alias)
    for j in q.joins:
        right = frames.scan(j.table, j.alias)
        cond = F.lit(True)
        for a, b in j.on:
            cond = cond & (col(a) == col(f"{j.alias}.{b}"))
        df = df.join(right, cond, j.kind)
    if q.where:
        df = df.where(_expr(q.where, df))
    for c, v in q.equal:
        df = df.where(col(c) == F.lit(v))
    for t in q.tests:
        df = _apply(t, df, frames)
    outs = [(F.lit(c[1:-1]) if c.startswith("'") else col(c)).alias(n) for c, n in q.columns]
    if q.group is not None:
        df = df.groupBy(*[col(g) for g in q.group]).agg(F.count("*").alias("count"))
        df = df.select(*[col(g).alias(n) for g, n in q.columns if g in q.group], *[F.col("count").alias(n) for c, n in q.columns if c == "count(*)"])
    else:
        df = df.select(*outs)
    df = df.distinct() if q.distinct else df
    return df.limit(q.limit) if q.limit is not None else df


def _apply(t, df: DataFrame, frames: Frames) -> DataFrame:
    sub = _sub(t.sub, frames)
    if isinstance(t, NotIn):
        y = col(f"{t.sub.alias}.{t.sub.column}")
        if t.sub.outer:
            raise ValueError("a correlated NOT IN has no form here")
        cond = (col(t.column) == y) | (col(t.column) == y).isNull()
        return df.join(sub, cond, "left_anti")
    if isinstance(t, CountTest):
        keys = [f"{t.sub.alias}.{b}" for _, b in t.sub.outer]
        counted = sub.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("_n"))
        cond = F.lit(True)
        for (a, _), k in zip(t.sub.outer, keys):
            cond = cond & (col(a) == col(k))
        out = df.join(counted, cond, "left")
        n = F.coalesce(F.col("_n"), F.lit(0))
        return out.where(n > 0 if t.some else n == 0).drop("_n", *keys)
    cond = F.lit(True)
    for a, b in t.sub.outer + t.on:
        cond = cond & (col(a) == col(f"{t.sub.alias}.{b}"))
    return df.join(sub, cond, "left_semi" if t.positive else "left_anti")
