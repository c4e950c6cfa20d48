"""Every registered query against DuckDB, and again inside a wrapper that must change nothing."""

import time

import pytest
from conftest import SF, assert_agrees

from plumbline.operators.joins import band_pairs
from plumbline.operators.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_agrees(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", ["j13_null_aware_anti", "g3_grouping_sets", "w5_groups_frame", "u8_recursive_union_distinct", "d5_merge"])
def test_wrapped(spark, duck, name):
    QUERIES[name](spark, SF).createOrReplaceTempView("inner_query")
    assert_agrees(spark.sql("WITH q AS (SELECT * FROM inner_query) SELECT * FROM q"), duck, ORACLES[name])


def test_table_function_takes_all_events(spark):
    got = QUERIES["s8_table_function"](spark, SF).select("event_id").distinct()
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").where("event_type IS NOT NULL").select("event_id").distinct().count() > 50


def test_spread_has_both_forms(spark):
    plans = [QUERIES[n](spark, SF)._jdf.queryExecution().optimizedPlan().toString() for n in ("p23_spread", "p23_spread_semi_join")]
    assert ["LeftSemi" in p for p in plans] == [False, True]


def test_band_makes_no_pair_that_it_drops(spark, duck, tmp_path):
    """One brand and 50,000 sizes: a join by brand alone compares 10,000,000,000 pairs for 400,000 rows."""
    spark.range(100_000).selectExpr("id AS p_partkey", "'b' AS p_brand", "CAST(id DIV 2 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    began = time.time()
    assert QUERIES["j2_theta_band"](spark, str(tmp_path)).selectExpr("count(*)", "min(k2 DIV 2 - k1 DIV 2)", "max(k2 DIV 2 - k1 DIV 2)").first()[:] == (399_988, 1, 2)
    assert time.time() - began < 20


@pytest.mark.parametrize("kind", ["INTEGER", "DOUBLE"])
def test_band_of_odd_rows(spark, duck, tmp_path, kind):
    """NULLs in each column, repeated keys, negative sizes, fractions, lists of several blocks."""
    rows = f"""SELECT CASE WHEN i % 17 > 0 THEN i // 2 END AS p_partkey, CASE WHEN i % 11 > 0 THEN 'b' || i % 3 END AS p_brand,
               CAST(CASE WHEN i % 13 > 0 THEN (i % 21 - 9) / {1 if kind == "INTEGER" else 4} END AS {kind}) AS p_size FROM range(900) t(i)"""
    duck.execute(f"COPY ({rows}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    want = ORACLES["j2_theta_band"].replace("part a", f"'{tmp_path}/part.parquet' a").replace("part b", f"'{tmp_path}/part.parquet' b")
    assert_agrees(QUERIES["j2_theta_band"](spark, str(tmp_path)), duck, want)
    if kind == "INTEGER":
        assert_agrees(band_pairs(spark.read.parquet(f"{tmp_path}/part.parquet"), "p_partkey", "p_brand", "p_size", 2, block=3), duck, want)
