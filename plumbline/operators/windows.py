"""Window functions, with GROUPS frames, EXCLUDE and named-window inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.base import query, statement, table

statement("w1_partition_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
statement("w3_rows_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM orders")
statement("w4_range_numeric", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
statement("w4_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7' DAY PRECEDING AND CURRENT ROW) AS n FROM events")
statement("w7_default_frame", "SELECT p_partkey, max(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size) AS m FROM part")
statement(
    "w8_ranking",
    "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS t FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
)
statement("w9_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS prev, lead(o_orderkey, 2) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
statement(
    "w10_first_last_nth",
    "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
statement("w11_aggregate_over", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer")
statement(
    "w12_filter_over",
    "SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS f FROM orders",
    "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS f FROM orders",
)
statement(
    "w_session_gaps",
    "SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '1' DAY THEN 0 ELSE 1 END AS fresh FROM events) t",
    "SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL '1' DAY THEN 0 ELSE 1 END AS fresh FROM events) t",
)


class Named:
    """Named windows: ``w.extend(order_by=...)`` inherits the partitioning."""

    def __init__(self, partition: list[str], order: list[Column] | None = None):
        self.partition, self.order = partition, order

    def extend(self, order: list[Column]) -> Named:
        if self.order:
            raise ValueError("a window that has an order cannot be given another")
        return Named(self.partition, order)

    def spec(self):
        w = Window.partitionBy(*self.partition)
        return w.orderBy(*self.order) if self.order else w


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS a, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def w2_window_inheritance(spark, sf_dir):
    w = Named(["o_custkey"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w.extend([F.col("o_totalprice"), F.col("o_orderkey")]).spec()).alias("a"), F.count("*").over(w.spec()).alias("n"))


def groups_frame(df: DataFrame, partition: list[str], order: str, low: int, high: int, **aggs: Column) -> DataFrame:
    """``GROUPS BETWEEN low AND high``: peer groups are numbered, then a range frame counts them."""
    peers = df.withColumn("_peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    w = Window.partitionBy(*partition).orderBy("_peer").rangeBetween(low, high)
    return peers.select("*", *[c.over(w).alias(k) for k, c in aggs.items()]).drop("_peer")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part")
def w5_groups_frame(spark, sf_dir):
    return groups_frame(table(spark, sf_dir, "part"), ["p_brand"], "p_size", -1, 1, n=F.count("*")).select("p_partkey", "n")


def excluding(total: Column, own: Column) -> Column:
    """sum/count over a frame without a part of it."""
    return total - own


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS n, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS s FROM part")
def w6_exclude(spark, sf_dir):
    whole, peers = Window.partitionBy("p_brand"), Window.partitionBy("p_brand", "p_size")
    rest = F.count("*").over(whole) - F.count("*").over(peers)
    s = F.when(rest > 0, excluding(F.sum("p_size").over(whole), F.sum("p_size").over(peers)))
    return table(spark, sf_dir, "part").select("p_partkey", excluding(F.count("*").over(whole), F.lit(1)).alias("n"), s.alias("s"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM part")
def w6_exclude_ties(spark, sf_dir):
    whole, peers = Window.partitionBy("p_brand"), Window.partitionBy("p_brand", "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", (F.count("*").over(whole) - F.count("*").over(peers) + 1).alias("n"))
