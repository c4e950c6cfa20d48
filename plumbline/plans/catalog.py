"""Declared facts about tables: NOT NULL, keys, foreign keys and checks.

Files carry none of these, and a proof may rest only on what holds, so ``verify`` tests
every declaration against the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass
class Table:
    name: str
    columns: dict[str, str]
    not_null: frozenset[str] = frozenset()
    keys: list[tuple[str, ...]] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    checks: dict[str, Callable[[], Column]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    identity: frozenset[str] = frozenset()


class Catalog:
    def __init__(self, *tables: Table):
        self.tables = {t.name: t for t in tables}

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    def not_null(self, table: str, column: str) -> bool:
        return column in self.tables[table].not_null

    def is_key(self, table: str, columns: set[str]) -> bool:
        return any(set(k) <= columns for k in self.tables[table].keys)

    def foreign_key(self, table: str, columns: tuple[str, ...], parent: str, parent_columns: tuple[str, ...]) -> ForeignKey | None:
        want = dict(zip(columns, parent_columns))
        return next((f for f in self.tables[table].foreign if f.parent == parent and dict(zip(f.columns, f.parent_columns)) == want), None)

    def verify(self, frames: dict[str, DataFrame]) -> list[str]:
        """What the data contradict; one pass per NOT NULL set and check, one shuffle per key and foreign key."""
        wrong: list[str] = []
        for t in self.tables.values():
            df = frames[t.name]
            nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in sorted(t.not_null)]).first() if t.not_null else {}
            wrong += [f"{t.name}.{c} has nulls" for c in t.not_null if nulls[c]]
            for key in t.keys:
                if not df.groupBy(*key).count().where("count > 1").isEmpty():
                    wrong.append(f"{t.name}{key} repeats")
            for f in t.foreign:
                parent = frames[f.parent].select(*[F.col(p).alias(c) for c, p in zip(f.columns, f.parent_columns)])
                child = df.select(*f.columns).dropna()
                if not child.join(parent, list(f.columns), "left_anti").isEmpty():
                    wrong.append(f"{t.name}{f.columns} has orphans")
            for name, check in t.checks.items():
                if not df.where(~check()).isEmpty():
                    wrong.append(f"{t.name} fails {name}")
        return wrong


def _t(name: str, cols: str, keys=(), foreign=(), checks=None) -> Table:
    columns = dict(c.split(":") for c in cols.split())
    return Table(name, columns, frozenset(columns), [tuple(k.split(",")) for k in keys], [ForeignKey((a,), p, (b,)) for a, p, b in foreign], checks or {})


STAR = Catalog(
    _t("region", "r_regionkey:int r_name:string", ["r_regionkey"]),
    _t("nation", "n_nationkey:int n_name:string n_regionkey:int", ["n_nationkey"], [("n_regionkey", "region", "r_regionkey")]),
    _t("customer", "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string", ["c_custkey"], [("c_nationkey", "nation", "n_nationkey")]),
    _t("supplier", "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double", ["s_suppkey"], [("s_nationkey", "nation", "n_nationkey")]),
    _t("part", "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double", ["p_partkey"], checks={"p_size > 0": lambda: F.col("p_size") > 0}),
    _t("orders", "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string", ["o_orderkey"], [("o_custkey", "customer", "c_custkey")]),
    _t("lineitem", "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double", [], [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")]),
    _t("events", "event_id:bigint ts:timestamp_ntz user_id:bigint event_type:string value:double props:string", ["event_id"], [("user_id", "customer", "c_custkey")]),
)
