"""Order, limit, ties and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pg
from plumbline.operators.base import query, statement, table

statement("o1_order_ordinal", "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1 LIMIT 20")
statement("o2_nulls_order", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY nullif(n_regionkey, 2) DESC NULLS FIRST, n_nationkey LIMIT 8")
statement("o4_distinct_order", "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_mktsegment LIMIT 3")
statement("o5_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
statement("o9_order_in_union", "SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) u ORDER BY k LIMIT 12")


def asc(c: str) -> Column:
    """Ascending with NULLs last, the order that is meant when none is spelled."""
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    return F.col(c).desc_nulls_first()


def order_using(c: str, op: str) -> Column:
    """``ORDER BY c USING <`` or ``>``."""
    return asc(c) if op == "<" else desc(c)


def fetch_first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """``FETCH FIRST n ROWS ONLY``: a bounded heap per task, then one merge of the heaps."""
    return df.orderBy(*order).limit(n)


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
def o3_order_using(spark, sf_dir):
    return fetch_first(table(spark, sf_dir, "customer"), 7, order_using("c_acctbal", ">"), order_using("c_custkey", "<")).select("c_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 6")
def o6_fetch_first(spark, sf_dir):
    return fetch_first(table(spark, sf_dir, "orders"), 6, desc("o_orderdate"), asc("o_orderkey")).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 10) t)")
def o7_with_ties(spark, sf_dir):
    return with_ties(table(spark, sf_dir, "part"), 10, "p_size").select("p_partkey", "p_size")


def with_ties(df: DataFrame, n: int, key: str) -> DataFrame:
    """The ``n`` largest by ``key`` and all equal to the last of them: the bound is one row, found by a top-n."""
    bound = df.select(key).orderBy(desc(key)).limit(n).agg(F.min(key).alias("_bound"), F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(bound)).where((F.col(key) >= F.col("_bound")) | F.col(key).isNull()).drop("_bound", "_n")


def nearest(df: DataFrame, vector: str, q: list[float], k: int, id_col: str, metric=pg.l2_distance) -> DataFrame:
    """Exact k nearest: a distance per row in the scan, then a bounded top-k."""
    probe = F.array(*[F.lit(float(x)) for x in q])
    return df.select(id_col, F.round(metric(F.col(vector), probe), 5).alias("d")).orderBy("d", id_col).limit(k)


_Q = [round(0.1 * ((i % 7) - 3), 1) for i in range(64)]
_SQL_Q = "[" + ",".join(map(str, _Q)) + "]"


def _knn_sql(expr: str) -> str:
    return f"SELECT vec_id, d FROM (SELECT vec_id, round({expr}, 5) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST({_SQL_Q} AS DOUBLE[]) AS q FROM embeddings)) ORDER BY d, vec_id LIMIT 10"


@query(_knn_sql("list_distance(e, q)"))
def o8_knn_l2(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", _Q, 10, "vec_id")


@query(_knn_sql("1 - list_cosine_similarity(e, q)"))
def o8_knn_cosine(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", _Q, 10, "vec_id", pg.cosine_distance)


@query(_knn_sql("-list_inner_product(e, q)"))
def o8_knn_inner_product(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", _Q, 10, "vec_id", lambda a, b: -pg.inner_product(a, b))


@query(_knn_sql("list_sum(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])))"))
def o8_knn_l1(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), "embedding", _Q, 10, "vec_id", pg.l1_distance)
