"""Scans, row sources and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pg
from plumbline.sources.tables import MaterializedView, explain, stored, tablesample
from plumbline.operators.base import query, sql, statement, table

statement("s1_from_list", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
statement("s5_derived_table", "SELECT t.k, t.n FROM (SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment) AS t(k, n)")
statement("s6_lateral", "SELECT n_nationkey, t.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) t")
statement("s7_values", "SELECT v.x, v.y, n_name FROM (VALUES (1, 'a'), (2, 'b'), (7, NULL)) AS v(x, y) JOIN nation ON n_nationkey = v.x")
statement(
    "s8_table_function",
    "SELECT event_id, w FROM events LATERAL VIEW explode(split(event_type, '_')) x AS w",
    "SELECT event_id, unnest(string_split(event_type, '_')) AS w FROM events",
)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-03-01'")
def s2_table_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-03-01'").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def s3_inheritance_scan(spark, sf_dir):
    """A parent's scan returns the rows of its children; ``ONLY`` would leave them out."""
    return inherited(table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name AS name"), table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_name AS name"))


def inherited(parent: DataFrame, *children: DataFrame, only: bool = False) -> DataFrame:
    out = parent
    for child in () if only else children:
        out = out.unionByName(child.select(*parent.columns))
    return out


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 200000 GROUP BY o_orderstatus")
def s4_partitioned_scan(spark, sf_dir):
    """A table stored by a key: a filter on the key reads the folders of its values alone."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    kept = stored(orders, "partitioned", ["o_orderstatus"]).where("o_orderstatus IN ('F', 'P') AND o_totalprice > 200000")
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT conv_id, len(a) AS n, a[1] AS a1, b[1] AS b1 FROM (SELECT conv_id, list(role ORDER BY turn) AS a, list(turn ORDER BY turn) AS b FROM conversations GROUP BY conv_id)")
def s9_rows_from(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    zipped = g.select("conv_id", F.inline(pg.rows_from(F.transform("x", lambda s: s["role"]).alias("a"), F.transform("x", lambda s: s["turn"]).alias("b"))))
    names = zipped.columns
    z = zipped.toDF("conv_id", "a", "b") if len(names) == 3 else zipped
    return z.groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("a", "b").alias("a1"), F.min("b").alias("b1"))


@query("SELECT doc_id, i, w FROM (SELECT doc_id, unnest(string_split(lang || '-' || source, '-')) AS w, unnest(generate_series(1, len(string_split(lang || '-' || source, '-')))) AS i FROM documents)")
def s10_with_ordinality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat_ws("-", "lang", "source"), "-")).alias("p", "w"))
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), "w")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s11_column_definition_list(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("t")).select("event_id", "t.k")


@query()
def s12_tablesample(spark, sf_dir):
    """BERNOULLI (10) REPEATABLE (7): which rows come is the sampler's choice, so no SQL is given."""
    return tablesample(table(spark, sf_dir, "orders"), "bernoulli", 10, seed=7).select("o_orderkey")


@query("SELECT 100 AS n, true AS apart FROM (SELECT 1)")
def s12_system_rows(spark, sf_dir):
    """system_rows (100): so many rows, each once."""
    got = tablesample(table(spark, sf_dir, "orders"), "system_rows", 100)
    return got.agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct("o_orderkey")).alias("apart"))


@query("SELECT n AS id, n * 10 AS v, i AS nr FROM (SELECT unnest([3, 4, 5]) AS n, unnest([1, 2, 3]) AS i)")
def s13_json_table(spark, sf_dir):
    doc = spark.range(1).select(F.lit('{"items": [{"id": 3, "v": 30}, {"id": 4, "v": 40}, {"id": 5, "v": 50}]}').alias("j"))
    return json_table(doc, "j", "$.items", "id int, v int").select("id", "v", "nr")


def json_table(df: DataFrame, col: str, path: str, columns: str, ordinality: str = "nr", outer: bool = False) -> DataFrame:
    """``JSON_TABLE(col, path COLUMNS (...))``: array elements as rows, with FOR ORDINALITY."""
    items = F.from_json(F.get_json_object(F.col(col), path), f"array<struct<{columns}>>")
    rows = df.select("*", (F.posexplode_outer if outer else F.posexplode)(items).alias("_p", "_s"))
    return rows.select(*df.columns, (F.col("_p") + 1).alias(ordinality), "_s.*")


_LOCK = re.compile(r"\bFOR\s+(?:NO\s+KEY\s+UPDATE|KEY\s+SHARE|UPDATE|SHARE)(?:\s+OF\s+\w+(?:\s*,\s*\w+)*)?(?:\s+NOWAIT|\s+SKIP\s+LOCKED)?", re.I)
_QUOTED = re.compile(r"('(?:[^']|'')*'|--[^\n]*|/\*.*?\*/)", re.S)


def without_locks(text: str) -> str:
    """The statement without its row-locking clauses: rows of a snapshot need no locks."""
    return "".join(p if i % 2 else _LOCK.sub("", p) for i, p in enumerate(_QUOTED.split(text)))


@query("SELECT s_suppkey, s_name || ' FOR UPDATE' AS s FROM supplier WHERE s_acctbal > 0")
def s14_row_locking(spark, sf_dir):
    """FOR UPDATE OF ... SKIP LOCKED in a statement and in its subquery."""
    text = "SELECT s_suppkey, s || ' FOR UPDATE' AS s FROM (SELECT s_suppkey, s_name AS s, s_acctbal FROM supplier FOR NO KEY UPDATE) q WHERE s_acctbal > 0 FOR UPDATE OF q, r SKIP LOCKED FOR SHARE NOWAIT"
    return sql(spark, sf_dir, without_locks(text))


@query("SELECT count(*) > 0 AS scans, true AS pushed, 2 AS columns FROM orders")
def s23_explain(spark, sf_dir):
    """EXPLAIN as rows: the scan, the filter that reaches it and the columns it reads."""
    df = sql(spark, sf_dir, "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
    plan = explain(df)
    has = lambda p: F.count_if(F.col("plan").rlike(p)) > 0
    read = F.max(F.when(F.col("plan").startswith("ReadSchema"), F.size(F.split("plan", ","))))
    return plan.agg(has("Scan parquet").alias("scans"), has("PushedFilters.*GreaterThan\\(o_totalprice").alias("pushed"), read.cast("long").alias("columns"))


@query("SELECT n_regionkey, 2 * n AS n FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey)")
def s18_refresh_materialized_view(spark, sf_dir):
    """REFRESH replaces the stored image by what the source holds by then."""
    source = [table(spark, sf_dir, "nation")]
    view = MaterializedView(spark, "regions", lambda: source[0].groupBy("n_regionkey").agg(F.count("*").alias("n")))
    source[0] = source[0].unionByName(source[0])
    return view.refresh()


@query("SELECT k, sum(v) AS s FROM (VALUES (1, 2.5), (1, 3.5), (2, 1.0)) AS t(k, v) GROUP BY k")
def s16_copy_in(spark, sf_dir):
    from plumbline.sources.tables import copy_in

    return copy_in(spark, [(1, 2.5), (1, 3.5), (2, 1.0)], "k int, v double").groupBy("k").agg(F.sum("v").alias("s"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def s18_create_table_as(spark, sf_dir):
    from plumbline.sources.tables import create_table_as

    return create_table_as(sql(spark, sf_dir, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey"), "s18")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def s20_prepared(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT o_orderkey FROM orders WHERE o_orderstatus = :status AND o_totalprice > :floor", {"status": "F", "floor": 300000.0})
