"""Projection, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pg
from plumbline.operators.base import query, sql, statement, table

statement("p1_clause_order", "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderpriority HAVING count(*) > 1 ORDER BY n DESC, p LIMIT 3")
statement("p2_star_expansion", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
statement("p5_where_bool", "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR c_nationkey < 3)")
_V = "(VALUES (1, true), (2, false), (3, CAST(NULL AS BOOLEAN))) AS t(i, b)"
statement("p6_three_valued", f"SELECT i, b AND NULL AS a, b OR NULL AS o, NOT b AS n FROM {_V}")
statement("p8_is_distinct", "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_regionkey, 2) AS d, nullif(n_regionkey, 1) IS NOT DISTINCT FROM 1 AS s FROM nation")
statement("p10_in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 24)")
statement("p12_is_tests", f"SELECT i, b IS NULL AS n, b IS TRUE AS t, b IS NOT FALSE AS nf, b IS UNKNOWN AS u FROM {_V}", f"SELECT i, b IS NULL AS n, b IS NOT DISTINCT FROM true AS t, b IS DISTINCT FROM false AS nf, b IS NULL AS u FROM {_V}")
statement("p15_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS c, CASE p_brand WHEN 'Brand#11' THEN 1 END AS b FROM part")
statement("p16_coalesce_nullif", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), nullif(n_nationkey, 5), -1) AS v FROM nation")
statement("p18_greatest_least", "SELECT n_nationkey, greatest(n_nationkey, n_regionkey * 5, NULL) AS g, least(n_nationkey, n_regionkey * 5, NULL) AS l FROM nation")
statement("p22_parameters", "SELECT c_custkey FROM customer WHERE c_nationkey = :n AND c_acctbal > :floor", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal > 100", {"n": 7, "floor": 100})
statement("p25_row_fields", "SELECT r.a AS a, r.b.c AS c FROM (SELECT named_struct('a', n_nationkey, 'b', named_struct('c', n_name)) AS r FROM nation) t", "SELECT n_nationkey AS a, n_name AS c FROM nation")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
def p9_between_symmetric(spark, sf_dir):
    return table(spark, sf_dir, "part").where(pg.between_symmetric(F.col("p_size"), F.lit(20), F.lit(10))).select("p_partkey")


@query("SELECT n_nationkey, (n_nationkey IN (1, 5, 9)) AS any_eq, (n_nationkey > 3 AND n_nationkey > 8) AS all_gt FROM nation")
def p11_any_all_array(spark, sf_dir):
    x = F.col("n_nationkey")
    eq = pg.any_of(F.array(F.lit(1), F.lit(5), F.lit(9)), lambda e: x == e)
    return table(spark, sf_dir, "nation").select("n_nationkey", eq.alias("any_eq"), pg.all_of(F.array(F.lit(3), F.lit(8)), lambda e: x > e).alias("all_gt"))


@query("SELECT n_nationkey, (n_regionkey < 2 OR (n_regionkey = 2 AND n_nationkey < 10)) AS lt, CASE WHEN n_regionkey <> 2 THEN n_regionkey < 2 END AS unknown FROM nation")
def p13_row_comparison(spark, sf_dir):
    left = [F.col("n_regionkey"), F.col("n_nationkey")]
    null = F.lit(None).cast("int")
    return table(spark, sf_dir, "nation").select("n_nationkey", pg.row_less(left, [F.lit(2), F.lit(10)]).alias("lt"), pg.row_less(left, [F.lit(2), null]).alias("unknown"))


@query("SELECT p_partkey, CAST(round(p_retailprice) AS INTEGER) AS i, CAST(p_size AS VARCHAR) AS s, CAST('12' AS BIGINT) AS b FROM part")
def p19_cast(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", pg.to_int(F.col("p_retailprice")).alias("i"), F.col("p_size").cast("string").alias("s"), F.lit("12").cast("bigint").alias("b"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = lower('building')")
def p21_collate(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'BuilDing'")


def in_values(x: Column, values: list) -> Column:
    """``IN $..values``: an empty list is false."""
    return x.isin(values) if values else F.lit(False)


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT unnest(generate_series(1, 1500, 3)))")
def p23_spread(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders"), "o_custkey", list(range(1, 1501, 3))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT unnest(generate_series(1, 4500, 3)))")
def p23_spread_semi_join(spark, sf_dir):
    return spread(table(spark, sf_dir, "orders"), "o_custkey", list(range(1, 4501, 3))).select("o_orderkey")


def spread(df: DataFrame, col: str, keys: list[int]) -> DataFrame:
    """``col IN $..keys``; a list above a thousand values becomes a relation and a semi join."""
    if len(keys) <= 1000:
        return df.where(in_values(F.col(col), keys))
    return df.join(df.sparkSession.createDataFrame([(k,) for k in keys], "_k long"), F.col(col) == F.col("_k"), "left_semi")


@query("SELECT n_nationkey, n_nationkey * 2 AS doubled, upper(n_name) || '!' AS loud FROM nation")
def p26_generated_columns(spark, sf_dir):
    return with_generated(table(spark, sf_dir, "nation"), {"doubled": F.col("n_nationkey") * 2, "loud": F.concat(F.upper("n_name"), F.lit("!"))}).select("n_nationkey", "doubled", "loud")


def with_generated(df, columns: dict[str, Column]):
    """Generated columns are their expressions over the stored ones."""
    return df.withColumns(columns)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def p27_alias_annotations(spark, sf_dir):
    from plumbline.plans.describe import annotated

    return annotated(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k!"), F.col("n_name").alias("name?")))
