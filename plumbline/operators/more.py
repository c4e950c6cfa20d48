"""Foreign files, cursors, staged data-modifying items, and further function families."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ext
from plumbline.functions import pg, text
from plumbline.operators import dml
from plumbline.operators.base import query, statement, table
from plumbline.sources import tables as src
from plumbline.streaming.rows import Cursor


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{src._folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


@query("SELECT r_regionkey, r_name FROM region")
def s15_foreign_table(spark, sf_dir):
    """A file-backed foreign table: the declared columns are read, and no pass infers them."""
    path = _scratch(spark, "foreign")
    src.write(table(spark, sf_dir, "region"), path, "csv")
    return src.read(spark, path, "csv", "r_regionkey int, r_name string")


@query("SELECT n_regionkey, n_name FROM nation WHERE n_regionkey < 2")
def s17_copy_to(spark, sf_dir):
    path = _scratch(spark, "copy")
    src.write(table(spark, sf_dir, "nation").where("n_regionkey < 2").select("n_regionkey", "n_name"), path, partition_by=["n_regionkey"])
    return src.read(spark, path).select("n_regionkey", "n_name")


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 10")
def s19_cursor(spark, sf_dir):
    cur = Cursor(table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey"))
    rows = cur.fetch(4) + cur.fetch(6)
    cur.close()
    return spark.createDataFrame(rows, "n_nationkey int")


@query("SELECT count(*) AS n, sum(k) AS s FROM (SELECT 90 + n_nationkey AS k FROM nation WHERE n_regionkey = 1)")
def u11_data_modifying_cte(spark, sf_dir):
    """WITH ins AS (INSERT ... RETURNING key) SELECT ... FROM ins: the image is staged, then read."""
    nation = table(spark, sf_dir, "nation")
    new = nation.where("n_regionkey = 1").selectExpr("90 + n_nationkey AS n_nationkey", "n_name", "n_regionkey")
    ins = dml.insert(nation, new).returning(F.col("new.n_nationkey").alias("k"))
    return ins.agg(F.count("*").alias("n"), F.sum("k").alias("s"))


@query("SELECT 0 AS n, count(*) AS before, max(n_nationkey) + 1 AS after FROM nation")
def d9_truncate(spark, sf_dir):
    """TRUNCATE gives the empty image of the same columns; the next insert starts from it."""
    nation = table(spark, sf_dir, "nation")
    empty = dml.delete(nation, F.lit(True))
    again = dml.insert(empty, nation).table()
    counts = empty.agg(F.count("*").cast("int").alias("n")).crossJoin(nation.agg(F.count("*").alias("before")))
    return counts.crossJoin(again.agg((F.count("*").cast("int")).alias("after")))


@query("SELECT s_suppkey, s_acctbal * 1.5 AS v FROM supplier")
def d8_call_procedure(spark, sf_dir):
    def raise_balance(df: DataFrame, factor: float) -> DataFrame:
        return dml.update(df, {"s_acctbal": F.col("s_acctbal") * factor})

    return raise_balance(table(spark, sf_dir, "supplier"), 1.5).select("s_suppkey", F.col("s_acctbal").alias("v"))


statement("p3_whole_row", "SELECT t.r.n_name AS name FROM (SELECT named_struct('n_name', n_name, 'n_nationkey', n_nationkey) AS r FROM nation) t", "SELECT n_name AS name FROM nation")
statement("p7_comparisons", "SELECT n_nationkey, n_nationkey = 3 AS e, n_nationkey <> 3 AS ne, n_nationkey < 3 AS l, n_nationkey <= 3 AS le, n_nationkey > 3 AS g, n_nationkey >= 3 AS ge FROM nation")
statement("p20_constants", "SELECT n_nationkey, 1 AS i, 10000000000 AS b, CAST(1.5 AS DOUBLE) AS d, 'x' AS s, NULL IS NULL AS n, CAST(DATE '2024-02-29' AS VARCHAR(10)) AS dt FROM nation")
statement("w13_over_group", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM orders GROUP BY o_custkey")


@query("SELECT n_nationkey, n_name[1:2] || '..' AS o, instr(n_name, 'A') AS p, md5(n_name) AS m, sha256(n_name) AS d FROM nation")
def f_text_more(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.left(n, F.lit(2)), F.lit("..")).alias("o"), F.instr(n, "A").cast("long").alias("p"), F.md5(n.cast("binary")).alias("m"), ext.digest(n, "sha256").alias("d"))


@query("SELECT c_custkey, unnest(string_split(c_name, '#')) AS w FROM customer")
def f_string_to_table(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(pg.string_to_array(F.col("c_name"), "#")).alias("w"))


@query("SELECT n_nationkey, i, CASE WHEN i <= 1 THEN 'a' || n_nationkey END AS x FROM nation, (SELECT unnest([1, 2]) AS i) WHERE n_regionkey = 2")
def f_lockstep_srf(spark, sf_dir):
    """Several set-returning calls in one list run side by side, the shorter padded with NULL."""
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")))
    rows = table(spark, sf_dir, "nation").where("n_regionkey = 2").select("n_nationkey", a.alias("i"), b.alias("x"))
    return rows.select("n_nationkey", F.inline(F.arrays_zip("i", "x")))


@query("SELECT n_nationkey, n_regionkey || '>' || n_nationkey AS p, 2 AS lvl, n_regionkey = 1 AS below FROM nation")
def f_label_paths(spark, sf_dir):
    path = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.replace(path, F.lit("."), F.lit(">")).alias("p"), ext.nlevel(path).alias("lvl"), ext.is_descendant(path, F.lit("1")).alias("below"))


@query("SELECT n_nationkey, n_name AS v, n_regionkey = 2 AS has, CASE WHEN n_nationkey % 3 = 0 THEN 'z' || n_nationkey ELSE 'old' END AS z, CASE WHEN n_regionkey = 2 THEN 2 ELSE 3 END - 1 AS n FROM nation")
def f_key_value_maps(spark, sf_dir):
    """hstore: concatenation (the right side wins), a key test, deletion of a key."""
    k = F.col("n_nationkey")
    right = F.when(k % 3 == 0, F.create_map(F.lit("z"), F.concat(F.lit("z"), k.cast("string")))).otherwise(F.create_map(F.lit("z"), F.lit("old")))
    left = F.map_from_arrays(F.array(F.lit("name"), F.lit("z")), F.array(F.col("n_name"), F.lit("first")))
    extra = F.when(F.col("n_regionkey") == 2, F.create_map(F.lit("r2"), F.lit("y"))).otherwise(F.create_map(F.lit("p"), F.lit("1"), F.lit("q"), F.lit("2")))
    m = ext.map_concat(ext.map_concat(left, right), extra)
    return table(spark, sf_dir, "nation").select("n_nationkey", m["name"].alias("v"), ext.map_has(m, "r2").alias("has"), m["z"].alias("z"), (F.size(ext.map_delete(m, "z")) - 1).alias("n"))


@query("SELECT n_nationkey, round(2 * 6371000 * asin(sqrt(pow(sin(radians(n_nationkey - 5) / 2), 2) + cos(radians(5)) * cos(radians(n_nationkey)) * pow(sin(radians(n_regionkey) / 2), 2))), 0) AS d FROM nation")
def f_earth_distance(spark, sf_dir):
    d = ext.earth_distance(F.lit(5), F.lit(0), F.col("n_nationkey"), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.round(d, 0).alias("d"))


@query("SELECT c_custkey, strip_accents(c_name || 'éÀü') AS u FROM customer")
def f_unaccent(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ext.unaccent(F.concat("c_name", F.lit("éÀü"))).alias("u"))


@query("SELECT n_nationkey, [n_regionkey, n_regionkey, n_nationkey][3] AS a, 4 AS n, list_has_any([n_nationkey, 7], [7]) AS o FROM nation")
def f_array_building(spark, sf_dir):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    built = F.array_append(F.array_repeat(r, 2), k)
    return table(spark, sf_dir, "nation").select("n_nationkey", pg.subscript(built, 3).alias("a"), F.size(F.concat(built, F.array(r))).alias("n"), F.arrays_overlap(F.array(k, F.lit(7)), F.array(F.lit(7))).alias("o"))


@query("SELECT p_partkey, CAST(p_size // 10 + 1 AS BIGINT) AS b FROM part")
def f_width_bucket(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.width_bucket(F.col("p_size"), 0, 50, 5).cast("long").alias("b"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS e, CAST(coalesce(json_extract_string(props, '$.none'), 'dflt') AS VARCHAR) AS v FROM events")
def f_sql_json(spark, sf_dir):
    j = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", ext.json_exists(j, "$.k").alias("e"), ext.json_value(j, "$.none", on_empty="dflt").alias("v"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey")
def n11_row_policy(spark, sf_dir):
    """A row policy is a filter on the scan; columns a role may not read are refused before the plan is made."""
    from plumbline.plans.facts import Role

    role = Role("analyst", {"customer": {"c_nationkey", "c_mktsegment"}}, {"customer": "c_mktsegment = 'BUILDING'"})
    return role.scan("customer", table(spark, sf_dir, "customer")).groupBy("c_nationkey").agg(F.count("*").alias("n"))
