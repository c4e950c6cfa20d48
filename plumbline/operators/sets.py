"""Set operations, common table expressions and recursion."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.base import query, statement, table
from plumbline.sources.tables import stored

_ARMS = "SELECT c_nationkey AS k FROM customer {op} SELECT s_nationkey FROM supplier"
for _name, _op in {"u1_union": "UNION", "u1_union_all": "UNION ALL", "u2_intersect": "INTERSECT", "u2_intersect_all": "INTERSECT ALL", "u3_except": "EXCEPT", "u3_except_all": "EXCEPT ALL"}.items():
    statement(_name, _ARMS.format(op=_op))
statement("u4_reconcile_types", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(1.5 AS DOUBLE) AS v FROM nation UNION ALL SELECT r_regionkey, CAST(2 AS DOUBLE) FROM region")
statement("u5_cte_aliases", "WITH big(k, total) AS (SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE total > 250000) SELECT c_name FROM customer JOIN top ON c_custkey = k")
statement("u7_recursive_union_all", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """``AS MATERIALIZED``: evaluate once, by writing to the shared folder."""
    return stored(df, f"cte-{name}")


@query("WITH t AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, b.n FROM t a JOIN t b ON a.o_custkey = b.o_custkey WHERE a.n > 12")
def u6_materialized(spark, sf_dir):
    t = materialized(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "t")
    return t.where("n > 12").select("o_custkey").join(t, "o_custkey")


#: Tables of a recursion that are read together before they are written as one.
PARTS = 16


def closure(start: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``WITH RECURSIVE ... UNION`` over (node) along edges (src, dst): each round joins only
    what is new, drops what was seen and writes what is left; it ends when a round finds nothing, and fails where ``max_rounds`` is given and reached."""
    parts = [materialized(start.distinct(), "seen")]
    for turn in itertools.count(1):
        fresh = parts[-1]
        step = fresh.join(edges, fresh["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        fresh = materialized(step.join(_together(parts), "node", "left_anti"), "fresh")
        if fresh.isEmpty():
            return _together(parts)
        if turn == max_rounds:
            raise RuntimeError(f"closure is not complete after {max_rounds} rounds")
        if len(parts) == PARTS:
            parts = [materialized(_together(parts), "seen")]
        parts.append(fresh)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_EDGES = "SELECT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation"


@query(f"WITH RECURSIVE e AS ({_EDGES}), t(node) AS (SELECT 2 UNION SELECT dst FROM t JOIN e ON node = src) SELECT CAST(node AS INTEGER) AS node FROM t")
def u8_recursive_union_distinct(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS src", "(n_nationkey * 3 + 1) % 25 AS dst")
    return closure(spark.range(1).select(F.lit(2).alias("node")), edges)


def paths(start: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Walks from (node) with ``depth``, ``path`` (for depth- or breadth-first order) and
    ``is_cycle``; a walk stops where it meets a node it has passed.  All walks go on to their end;
    with ``max_depth`` an error tells that some had not ended there."""
    now = materialized(start.select("node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("is_cycle")), "walks")
    out = [now]
    for depth in itertools.count(1):
        live = now.where(~F.col("is_cycle"))
        now = live.join(edges, live["node"] == edges["src"]).select(
            F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("is_cycle")
        )
        now = materialized(now, "walks")
        if now.isEmpty():
            return _together(out)
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"walks go on beyond depth {max_depth}")
        if len(out) == PARTS:
            out = [materialized(_together(out), "walks")]
        out.append(now)


def search_order(walks: DataFrame, depth_first: bool) -> DataFrame:
    """SEARCH DEPTH / BREADTH FIRST BY node SET: the column ``ordercol`` sorts rows in that order."""
    return walks.withColumn("ordercol", F.col("path") if depth_first else F.concat(F.array("depth"), F.array("node")))


_WALK = f"WITH RECURSIVE e AS ({_EDGES}), t(node, depth, path, cyc) AS (SELECT 2, 0, [2], false UNION ALL SELECT dst, depth + 1, list_append(path, dst), list_contains(path, dst) FROM t JOIN e ON node = src WHERE NOT cyc)"


@query(_WALK + " SELECT CAST(node AS INTEGER) AS node, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM t")
def u9_search_order(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS src", "(n_nationkey * 3 + 1) % 25 AS dst")
    return paths(spark.range(1).select(F.lit(2).alias("node")), edges).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(_WALK + " SELECT CAST(node AS INTEGER) AS node, cyc AS is_cycle FROM t")
def u10_cycle(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS src", "(n_nationkey * 3 + 1) % 25 AS dst")
    return paths(spark.range(1).select(F.lit(2).alias("node")), edges).select("node", "is_cycle")


_TREE = "SELECT n_nationkey AS src, n_nationkey * 2 + i AS dst FROM nation, (SELECT unnest([1, 2]) AS i) WHERE n_nationkey * 2 + i < 25"


@query(
    f"""WITH RECURSIVE e AS ({_TREE}), t(node, depth, path) AS (SELECT 0, 0, [0] UNION ALL SELECT dst, depth + 1, list_append(path, dst) FROM t JOIN e ON node = src)
        SELECT CAST(node AS INTEGER) AS node, row_number() OVER (ORDER BY path) AS d, row_number() OVER (ORDER BY depth, node) AS b FROM t"""
)
def u9_search_both_orders(spark, sf_dir):
    """The places that depth-first and breadth-first order give the nodes of a tree."""
    step = F.explode(F.array(F.lit(1), F.lit(2))).alias("i")
    edges = table(spark, sf_dir, "nation").select("n_nationkey", step).selectExpr("n_nationkey AS src", "n_nationkey * 2 + i AS dst").where("dst < 25")
    walks = paths(spark.range(1).select(F.lit(0).alias("node")), edges)
    place = lambda df: F.row_number().over(Window.orderBy("ordercol"))
    deep = search_order(walks, True)
    deep = deep.select("node", "depth", "path", place(deep).cast("long").alias("d"))
    wide = search_order(deep, False)
    return wide.select("node", "d", place(wide).cast("long").alias("b"))


def cte_order(uses: dict[str, set[str]]) -> list[str]:
    """Evaluation order of WITH items by what they use; a cycle raises (mutual recursion)."""
    from graphlib import TopologicalSorter

    return list(TopologicalSorter(uses).static_order())
