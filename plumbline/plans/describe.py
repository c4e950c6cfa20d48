"""Describing a statement without running it: columns, types, nullability, parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.plans.catalog import Catalog

_STRING = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", re.S)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool


@dataclass(frozen=True)
class Description:
    columns: tuple[Column, ...]
    params: tuple[str, ...]


def parameters(text: str) -> tuple[str, ...]:
    """Named markers in order of first use, outside literals and comments."""
    bare = _STRING.sub(" ", text)
    return tuple(dict.fromkeys(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare)))


def empty(spark: SparkSession, catalog: Catalog, table: str) -> DataFrame:
    """No rows, but the declared types and NOT NULLs, from which the analyzer's own
    nullability rules (joins, expressions, aggregates) start."""
    t = catalog[table]
    fields = [T.StructField(c, T._parse_datatype_string(k), c not in t.not_null) for c, k in t.columns.items()]
    return spark.createDataFrame([], T.StructType(fields))


def describe(spark: SparkSession, text: str, catalog: Catalog, args: dict | None = None) -> Description:
    """Columns and parameters of a statement over the catalog's tables; no file is read.

    A parameter without a value is typed as NULL of no type.
    """
    for name in catalog.tables:
        if re.search(rf"\b{name}\b", text):
            empty(spark, catalog, name).createOrReplaceTempView(name)
    params = parameters(text)
    values = {p: (args or {}).get(p) for p in params}
    df = spark.sql(text, args=values) if params else spark.sql(text)
    narrowed = never_null(df)
    columns = tuple(Column(f.name, f.dataType.simpleString(), f.nullable and i not in narrowed) for i, f in enumerate(df.schema))
    return Description(columns, params)


def never_null(df: DataFrame) -> set[int]:
    """Places of output columns that the analysed plan's constraints prove not null.

    Constraints are the analyzer's own: what filters and joins let through, carried
    through projections under the attribute's identity, never by name.
    """
    plan = df._jdf.queryExecution().analyzed()
    found = set()
    each = plan.constraints().toList().iterator()
    while each.hasNext():
        held = each.next()
        if held.getClass().getSimpleName() == "IsNotNull" and held.child().getClass().getSimpleName() == "AttributeReference":
            found.add(held.child().exprId().id())
    output = plan.output()
    return {i for i in range(output.size()) if output.apply(i).exprId().id() in found}


def annotated(df: DataFrame) -> DataFrame:
    """Output names with ``!`` (never null) or ``?`` (may be null) lose the mark; the mark
    decides the described nullability."""
    marks = {c: c[-1] for c in df.columns if c[-1] in "!?"}
    out = df
    for c in marks:
        out = out.withColumnRenamed(c, c[:-1])
    out.nullability = {c[:-1]: m == "?" for c, m in marks.items()}
    return out


def diff(a: Description, b: Description) -> list[str]:
    """What differs between two descriptions, as for two roles."""
    ours, theirs = {c.name: c for c in a.columns}, {c.name: c for c in b.columns}
    out = [f"- {n}" for n in ours if n not in theirs] + [f"+ {n}" for n in theirs if n not in ours]
    return out + [f"~ {n}: {ours[n].type}{'?' * ours[n].nullable} -> {theirs[n].type}{'?' * theirs[n].nullable}" for n in ours if n in theirs and ours[n] != theirs[n]]
