"""Every join kind; the optimizer picks the physical strategy from sizes it knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plumbline.operators.base import query, sql, statement, table

statement("j1_inner_equi", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
statement("j3_left_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
statement("j4_right_outer", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 250000")
statement("j5_full_outer", "SELECT a.n_nationkey AS ak, b.n_nationkey AS bk FROM (SELECT * FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) b ON a.n_nationkey = b.n_nationkey")
statement("j6_cross", "SELECT r_name, n_name FROM region, nation")
statement("j7_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
statement("j8_using", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey < 3) b USING (k)")
statement("j9_aliased_join", "SELECT j.n_name, j.r_name FROM (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) j WHERE j.r_name LIKE 'A%'")
statement(
    "j10_lateral_top_order",
    "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t ON true",
)
statement("j11_semi_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
statement("j11_semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
statement("j12_anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
statement("j13_null_aware_anti", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM customer WHERE c_nationkey <= 3)")
statement("j15_scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
statement("j17_self_join", "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
statement("p14_row_in_subquery", "SELECT c_custkey FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT n_nationkey, 'BUILDING' FROM nation WHERE n_regionkey = 1)")


BAND = "SELECT a.p_partkey AS k1, b.p_partkey AS k2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size AND b.p_size <= a.p_size + 2"


def band_pairs(df: DataFrame, key: str, by: str, on: str, width: int, block: int = 200) -> DataFrame:
    """``k1``, ``k2``: keys of the pairs with equal ``by`` whose second ``on``, a whole number, is 1 to ``width`` larger.

    Keys are listed by value, lists are joined for each distance (no pair is made and dropped again) and dealt out
    evenly in blocks of ``block`` by ``block`` pairs, since the result and not the input says what a task has to do.
    Spark holds the rows that one block makes until all are made, so blocks are small.
    """
    spark = df.sparkSession
    at = df.where(F.col(by).isNotNull() & F.col(on).isNotNull()).groupBy(by, F.col(on).cast("long").alias("_at")).agg(F.collect_list(F.struct(F.col(key).alias("k"))).alias("_all"))
    blocks = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(block)), lambda i: F.slice("_all.k", i, block))
    lists = at.select(by, "_at", F.explode(blocks).alias("_keys"))
    low = lists.select(by, F.explode(F.array([F.col("_at") + d for d in range(1, width + 1)])).alias("_at"), F.col("_keys").alias("_low"))
    pairs = low.join(lists.withColumnRenamed("_keys", "_high").hint("merge"), [by, "_at"]).select("_low", "_high")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    out = pairs.repartition(tasks).select(F.explode("_low").alias("k1"), "_high")
    return out.select("k1", F.explode("_high").alias("k2"))


@query(BAND)
def j2_theta_band(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    if not isinstance(part.schema["p_size"].dataType, IntegralType):
        return sql(spark, sf_dir, BAND)
    return band_pairs(part, "p_partkey", "p_brand", "p_size", 2)


def quantified(left: DataFrame, x: Column, op: str, right: DataFrame, y: str, every: bool) -> DataFrame:
    """``x op ANY/ALL (SELECT y)`` as column ``verdict``, three-valued, through one aggregate row.

    Only < <= > >= are decided by the extremes; the empty set is false for ANY and true for ALL.
    """
    if op not in ("<", "<=", ">", ">="):
        raise ValueError("use IN / NOT IN or a semi join for = and <>")
    low = (op[0] == ">") != every
    bound = right.agg((F.min(y) if low else F.max(y)).alias("_bound"), F.count("*").alias("_n"), F.count(y).alias("_known"))
    compare = {"<": x < F.col("_bound"), "<=": x <= F.col("_bound"), ">": x > F.col("_bound"), ">=": x >= F.col("_bound")}[op]
    has_null = F.col("_n") > F.col("_known")
    if every:
        verdict = F.when(F.col("_n") == 0, True).when(F.col("_known") == 0, None).when(~compare, False).when(has_null, None).otherwise(compare)
    else:
        verdict = F.when(F.col("_n") == 0, False).when(F.col("_known") == 0, None).when(compare, True).when(has_null, None).otherwise(compare)
    return left.crossJoin(F.broadcast(bound)).withColumn("verdict", verdict).drop("_bound", "_n", "_known")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_brand = 'Brand#11')")
def j14_greater_all(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = quantified(part, F.col("p_retailprice"), ">", part.where("p_brand = 'Brand#11'").select(F.col("p_retailprice").alias("y")), "y", every=True)
    return out.where("verdict").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size < ANY (SELECT p_size FROM part WHERE p_brand = 'Brand#12' AND p_size < 10)")
def j14_less_any(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = quantified(part, F.col("p_size"), "<", part.where("p_brand = 'Brand#12' AND p_size < 10").select(F.col("p_size").alias("y")), "y", every=False)
    return out.where("verdict").select("p_partkey")


@query("SELECT c_custkey, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS keys FROM customer")
def j16_array_subquery(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    out = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce(F.array_join(F.col("a").cast("array<string>"), ","), F.lit("")).alias("keys"))


def asof(left: DataFrame, right: DataFrame, by: str, on: str, value: str, out: str) -> DataFrame:
    """Last ``value`` of ``right`` at or before each left row: one sort per key, no pairs."""
    from pyspark.sql import Window

    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(by, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


@query(
    """SELECT e.event_id, (SELECT p.value FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts ORDER BY p.ts DESC, p.value DESC LIMIT 1) AS last_value
       FROM events e WHERE e.event_type = 'click'"""
)
def j10_asof_lateral(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    right = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return asof(events.where("event_type = 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "value", "last_value").select("event_id", "last_value")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
def j18_fk_lookup(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
