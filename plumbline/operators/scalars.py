"""Scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import ext, jsonb, pg, text
from plumbline.functions.udf import create_function, create_table_function
from plumbline.operators.base import query, sql, statement, table

statement("f_text_basic", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, length(c_name) AS n, replace(c_name, '#', '-') AS r, lpad(CAST(c_custkey AS VARCHAR(20)), 8, '0') AS p, split_part(c_name, '#', 2) AS s, repeat('x', c_nationkey % 4) AS x, reverse(c_mktsegment) AS v, left(c_name, 4) AS f, right(c_name, 3) AS g, ascii(c_name) AS a, md5(c_name) AS m, translate(c_mktsegment, 'AEI', '431') AS t, trim('  y ') AS y FROM customer")
statement("f_like", "SELECT p_partkey, p_type LIKE '%BRASS' AS a, p_type ILIKE 'standard%' AS b, p_name LIKE 'a_m%' AS c FROM part")
statement("f_regexp", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS e FROM customer", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', 'N') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS e FROM customer")
statement("f_math", "SELECT p_partkey, abs(p_size - 25) AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(sqrt(p_size), 6) AS q, p_size % 7 AS m, round(ln(p_size), 8) AS l, round(exp(p_size / 50.0), 6) AS x, sign(p_size - 25) AS s, round(pi(), 8) AS pi FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_size), 6) AS q, p_size % 7 AS m, round(ln(p_size), 8) AS l, round(exp(p_size / 50.0), 6) AS x, CAST(sign(p_size - 25) AS DOUBLE) AS s, round(pi(), 8) AS pi FROM part")
statement("f_dates", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, year(o_orderdate) AS y, month(o_orderdate) AS mo, day(o_orderdate) AS d, quarter(o_orderdate) AS q, o_orderdate + INTERVAL '3' DAY AS p FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(quarter(o_orderdate) AS INTEGER) AS q, o_orderdate + INTERVAL '3' DAY AS p FROM orders")


@query("SELECT c_custkey, concat('a', NULL, c_mktsegment) AS c, substring(c_name, 1, 1) AS s1, '' AS s2, substring(c_name, 3) AS s3, coalesce('''' || replace(nullif(c_mktsegment, 'BUILDING'), '''', '''''') || '''', 'NULL') AS q FROM customer")
def f_text_semantics(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        pg.concat_any(F.lit("a"), F.lit(None), F.col("c_mktsegment")).alias("c"),
        pg.substring(name, 0, 2).alias("s1"),
        pg.substring(name, -1, 2).alias("s2"),
        pg.substring(name, 3).alias("s3"),
        pg.quote_nullable(F.nullif("c_mktsegment", F.lit("BUILDING"))).alias("q"),
    )


@query("SELECT p_partkey, regexp_full_match(p_type, '(STANDARD|PROMO).*(BRASS|TIN)') AS s, regexp_matches(p_type, 'NICKEL') AS t FROM part")
def f_similar_to(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", pg.similar_to(F.col("p_type"), "(STANDARD|PROMO)%(BRASS|TIN)").alias("s"), pg.similar_to(F.col("p_type"), "%NICKEL%").alias("t"))


@query("SELECT p_partkey, p_size // 7 AS d, CAST(round(p_size / 2.0) AS INTEGER) AS r, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, p_size * p_size AS w, CAST(trunc(p_retailprice * 10) / 10 AS DOUBLE) AS t, 1 + (CASE WHEN p_size = 5 THEN 1 ELSE 0 END) AS nn FROM part")
def f_math_semantics(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        pg.int_div(size, F.lit(7)).alias("d"),
        pg.to_int(size / 2.0).alias("r"),
        pg.gcd(F.col("p_partkey"), size).alias("g"),
        pg.lcm(F.col("p_partkey"), size).alias("l"),
        pg.power(size, F.lit(2)).cast("int").alias("w"),
        pg.trunc_num(F.col("p_retailprice"), 1).alias("t"),
        pg.num_nulls(F.nullif(size, F.lit(5)), F.lit(None), F.lit(1)).alias("nn"),
    )


@query(
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e, CAST(dayofweek(ts) AS INTEGER) AS d, CAST(isodow(ts) AS INTEGER) AS i, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01') AS b,
       strftime(ts, '%Y-%m-%d %H:%M') AS c, (ts < TIMESTAMP '2024-06-01' AND ts + INTERVAL '1' DAY > TIMESTAMP '2024-01-01') AS o FROM events"""
)
def f_date_semantics(spark, sf_dir):
    ts = F.col("ts")
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.floor(pg.epoch(ts)).alias("e"),
        pg.dow(ts).alias("d"),
        pg.isodow(ts).alias("i"),
        pg.date_bin(900, ts).cast("timestamp_ntz").alias("b"),
        pg.to_char(ts, "YYYY-MM-DD HH24:MI").alias("c"),
        pg.overlaps(ts, ts + F.expr("INTERVAL '1' DAY"), lit("2024-01-01"), lit("2024-06-01")).alias("o"),
    )


@query("SELECT o_orderkey, CAST(o_orderdate - INTERVAL '2' HOUR AS TIMESTAMP) AS t FROM orders WHERE month(o_orderdate) = 7")
def f_at_time_zone(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("month(o_orderdate) = 7").select("o_orderkey", pg.at_time_zone(F.col("o_orderdate"), "+02:00").cast("timestamp_ntz").alias("t"))


@query(
    """SELECT k, a[1] AS first, a[9] AS none, nullif(len(a), 0) AS n, nullif(coalesce(list_position(a, 'zz'), 0), 0) AS p, list_has_all(a, ['A']) AS c, array_to_string(list_filter(a, lambda x: x <> 'A'), ',') AS r, array_to_string(a[1:2], ',') AS s
       FROM (SELECT conv_id AS k, list(upper(left(role, 1)) ORDER BY turn) AS a FROM conversations GROUP BY conv_id)"""
)
def f_array_semantics(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("k")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    a = F.col("a")
    return g.select("k", F.transform("x", lambda s: F.upper(F.left(s["role"], F.lit(1)))).alias("a")).select(
        "k",
        pg.subscript(a, 1).alias("first"),
        pg.subscript(a, 9).alias("none"),
        pg.array_length(a).cast("long").alias("n"),
        pg.array_position(a, "zz").alias("p"),
        pg.array_contains_all(a, F.array(F.lit("A"))).alias("c"),
        pg.array_to_string(pg.array_remove(a, F.lit("A")), ",").alias("r"),
        pg.array_to_string(pg.array_slice(a, 1, 2), ",").alias("s"),
    )


@query("SELECT n_nationkey, unnest(generate_series(n_regionkey, 2)) AS g FROM nation WHERE n_regionkey <= 2")
def f_generate_series(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(pg.generate_series(F.col("n_regionkey"), F.lit(2))).alias("g"))
    return d


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, list_contains(json_keys(props), 'k') AS has, CASE CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'number' ELSE 'array' END AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) + 0 AS again FROM events")
def f_json(spark, sf_dir):
    j, k = F.col("props"), pg.json_get(F.col("props"), "k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        "event_id",
        pg.json_get(j, "k").alias("k"),
        pg.json_has_key(j, "k").alias("has"),
        pg.json_typeof(F.when(k % 3 == 0, j).when(k % 3 == 1, pg.json_get(j, "k")).otherwise(F.lit("[1]"))).alias("t"),
        pg.json_get(jsonb.set_path(j, ["z"], F.lit("1")), "k").cast("bigint").alias("again"),
    )


@query("SELECT event_id, u.k, u.v FROM (SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS v FROM events) u")
def f_json_each(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))


@query("SELECT p_partkey, (p_size >= 10 AND p_size < 20) AS c, (p_size < 30 AND p_size + 5 > 25) AS o FROM part")
def f_ranges(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", pg.range_contains(pg.make_range(F.lit(10), F.lit(20)), size).alias("c"), pg.range_overlaps(pg.make_range(size, size + 5), pg.make_range(F.lit(25), F.lit(30))).alias("o"))


@query("SELECT doc_id, (list_contains(w, 'the') AND list_contains(w, 'of')) AS m, len(list_distinct(w)) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)")
def f_full_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pg.matches_all(F.col("text"), "the", "of").alias("m"), F.size(pg.lexemes(F.col("text"))).cast("long").alias("n"))


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def f_fuzzy(spark, sf_dir):
    return sql(spark, sf_dir, "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")


@query()
def f_trigram_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.round(pg.similarity(F.col("n_name"), F.lit("united")), 6).alias("s"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END AS rank FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')")
def f_enum_order(spark, sf_dir):
    labels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(labels))
    return o.select("o_orderkey", pg.enum_order(F.col("o_orderpriority"), labels).cast("int").alias("rank"))


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS v FROM customer")
def f_sql_function(spark, sf_dir):
    create_function(spark, "twice_plus", "x DOUBLE, y DOUBLE DEFAULT 1", "DOUBLE", "x * 2 + y")
    return sql(spark, sf_dir, "SELECT c_custkey, twice_plus(c_acctbal) AS v FROM customer")


@query("SELECT n_nationkey, i AS k FROM nation, (SELECT unnest([1, 2]) AS i) WHERE n_regionkey = 1")
def f_table_function(spark, sf_dir):
    create_table_function(spark, "upto", "n INT", "k INT", "SELECT explode(sequence(1, n))")
    return sql(spark, sf_dir, "SELECT n_nationkey, u.k FROM nation, LATERAL upto(2) u WHERE n_regionkey = 1")


@query("SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS \"BUILDING\", count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS \"MACHINERY\" FROM customer GROUP BY c_nationkey")
def f_crosstab(spark, sf_dir):
    out = ext.crosstab(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"], F.count(F.lit(1)))
    return out.select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("BUILDING"), F.coalesce("MACHINERY", F.lit(0)).alias("MACHINERY"))


@query("SELECT n_nationkey, concat('<nation id=\"', n_nationkey, '\">', n_name, '</nation>') AS x FROM nation")
def f_xml_element(spark, sf_dir):
    body = text.xml_element("nation", {"id": F.col("n_nationkey")}, text.xml_escape(F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", body.alias("x"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS n, array_to_string(list_transform(embedding[1:8], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings")
def f_vectors(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(pg.vector_norm(e), 6).alias("n"), pg.binary_quantize(pg.subvector(e, 1, 8)).alias("b"))
