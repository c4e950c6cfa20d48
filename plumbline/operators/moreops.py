"""Queries of the further text, number, time, array, XML and full-text functions, aggregates and frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import pg, text
from plumbline.operators.base import query, statement, table

ts = lambda s: F.lit(s).cast("timestamp_ntz")


# text
@query("SELECT n_nationkey, 'Hello ' || n_name || ', 100% of ' || n_regionkey || '|' || lpad(n_name, CAST(greatest(12, length(n_name)) AS INTEGER), ' ') || '|' || rpad(CAST(n_nationkey AS VARCHAR), 4, ' ') || '|' || n_name AS s, '''' || n_name || ''' NULL' AS l FROM nation")
def f_format(spark, sf_dir):
    n, k, r = F.col("n_name"), F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", text.format_text("Hello %s, 100%% of %s|%1$12s|%3$-4s|%1$s", n, r, k).alias("s"), text.format_text("%L %L", n, F.lit(None)).alias("l"))


@query("SELECT c_custkey, (c_name LIKE 'Customer!#%' ESCAPE '!') AS a, (c_mktsegment ILIKE 'b_ild%') AS b, regexp_extract(c_name, '([a-z]+)#0*([0-9]+)', 1) || '/' || regexp_extract(c_name, '([a-z]+)#0*([0-9]+)', 2) AS m, len(regexp_extract_all(c_mktsegment, '[AEIOU]')) AS n, NOT regexp_matches(c_mktsegment, '^B') AS nb, regexp_split_to_array(c_name, '#')[2] AS p FROM customer")
def f_pattern_functions(spark, sf_dir):
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.like(n, "Customer!#%", "!").alias("a"),
        text.like(s, "b_ild%", blind=True).alias("b"),
        F.array_join(text.regexp_match(n, "([a-z]+)#0*([0-9]+)"), "/").alias("m"),
        F.size(text.regexp_matches(s, "[AEIOU]")).cast("long").alias("n"),
        (~s.rlike("^B")).alias("nb"),
        F.get(text.regexp_split(n, "#"), F.lit(1)).alias("p"),
    )


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")
def f_regexp_split_to_table(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.regexp_split(F.col("p_type"), r"\s+")).alias("w"))


@query(
    """SELECT c_custkey, strlen(c_name) AS o, substr(c_name, 1, 2) || 'XX' || substr(c_name, 5) AS v, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i, rpad(c_mktsegment, 12, '.') AS r,
       ltrim('  x') || rtrim('y  ') AS t, chr(65 + CAST(c_nationkey AS INTEGER)) AS c, lower(hex(encode(c_mktsegment))) AS h, base64(encode(c_name)) AS b, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name || '-' || c_custkey END AS w, coalesce(list_position(string_split(c_name, '#'), 'Customer'), 0) AS ps FROM customer"""
)
def f_text_editing(spark, sf_dir):
    n, s, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")
    sep = F.when(k != 3, F.lit("-"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.octet_length(n).cast("long").alias("o"),
        F.overlay(n, F.lit("XX"), 3, 2).alias("v"),
        text.initcap(s).alias("i"),
        F.rpad(s, 12, ".").alias("r"),
        F.concat(F.ltrim(F.lit("  x")), F.rtrim(F.lit("y  "))).alias("t"),
        F.chr(k + 65).alias("c"),
        F.lower(F.hex(s)).alias("h"),
        F.base64(F.encode(n, "UTF-8")).alias("b"),
        text.concat_ws(sep, n, F.lit(None), F.col("c_custkey")).alias("w"),
        F.array_position(F.split(n, "#"), "Customer").cast("long").alias("ps"),
    )


@query("SELECT n_nationkey, CAST('-1234.50' AS DECIMAL(30, 2)) AS a, CAST(n_nationkey AS DECIMAL(30, 0)) AS b FROM nation")
def f_to_number(spark, sf_dir):
    k = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select("n_nationkey", text.to_number(F.lit("-$1,234.50"), "SL9G999D99").alias("a"), text.to_number(k, "999").alias("b"))


# numbers
@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 4 ELSE (p_size - 10) // 10 + 1 END AS b, round(log10(p_size), 8) AS l, round(ln(p_size) / ln(2), 8) AS l2, p_size & 6 AS a, p_size | 6 AS o, xor(p_size, 6) AS x, -p_size - 1 AS n, p_size * 8 AS s, p_size // 4 AS r FROM part")
def f_number_functions(spark, sf_dir):
    """width_bucket with both overflow buckets, logarithms and bits."""
    x = F.col("p_size")
    bits = text.bit_ops(x, F.lit(6))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.width_bucket(x, 10, 40, 3).alias("b"), F.round(text.log10(x), 8).alias("l"), F.round(text.log_base(F.lit(2.0), x), 8).alias("l2"),
        bits["and"].alias("a"), bits["or"].alias("o"), bits["xor"].alias("x"), bits["not"].alias("n"), text.shift(x, 3).alias("s"), text.shift(x, -2).alias("r"),
    )


@query("SELECT p_partkey, 2 AS s, length(rtrim(split_part(t, '.', 2), '0')) AS m, rtrim(rtrim(t, '0'), '.') AS x FROM (SELECT p_partkey, CAST(CAST(p_size AS DECIMAL(12, 2)) / 4 AS DECIMAL(12, 2))::VARCHAR AS t FROM part)")
def f_scale(spark, sf_dir):
    d = (F.col("p_size").cast("decimal(12,2)") / 4).cast("decimal(12,2)")
    return table(spark, sf_dir, "part").select("p_partkey", text.scale_of(d).alias("s"), text.min_scale(d).cast("long").alias("m"), text.trim_scale(d).alias("x"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 100 // (p_size % 5) END AS q FROM part")
def f_division_by_zero(spark, sf_dir):
    """Division by zero raises under ANSI rules; the guarded form gives NULL."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr("try_divide(100, p_size % 5)").cast("int").alias("q"))


# time
@query(
    """SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS d, make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), 7, 8, 9.5) AS t,
       strptime(strftime(o_orderdate, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') AS p, CAST(o_orderdate AS DATE) AS c FROM orders"""
)
def f_make_and_parse_time(spark, sf_dir):
    o = F.col("o_orderdate")
    y, m, d = F.year(o), F.month(o), F.day(o)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.make_date(y, m, F.lit(1)).alias("d"),
        text.make_timestamp(y, m, d, F.lit(7), F.lit(8), F.lit(9.5)).alias("t"),
        text.to_timestamp(pg.to_char(o, "DD/MM/YYYY HH24:MI"), "DD/MM/YYYY HH24:MI").alias("p"),
        text.to_date(pg.to_char(o, "YYYY-MM-DD"), "YYYY-MM-DD").alias("c"),
    )


@query(
    """SELECT o_orderkey, CAST(m // 12 AS INTEGER) AS y, CAST(m % 12 AS INTEGER) AS mo, CAST(date_diff('day', o_orderdate + to_months(CAST(m AS INTEGER)), e) AS INTEGER) AS d
       FROM (SELECT o_orderkey, o_orderdate, e, datesub('month', o_orderdate, e) AS m FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS o_orderdate, TIMESTAMP '2030-05-17' AS e FROM orders WHERE day(o_orderdate) <= 28))"""
)
def f_age(spark, sf_dir):
    o = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    a = text.age(ts("2030-05-17"), o)
    return table(spark, sf_dir, "orders").where("day(o_orderdate) <= 28").select("o_orderkey", a["years"].alias("y"), a["months"].alias("mo"), a["days"].alias("d"))


@query("SELECT n_nationkey, CAST(unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-02-02', INTERVAL '12' HOUR)) AS TIMESTAMP) AS t FROM nation WHERE n_regionkey = 1")
def f_time_series(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", F.explode(text.series(ts("2024-01-30"), ts("2024-02-02"), "12 hours")).alias("t"))


statement("f_clocks", "SELECT now() = current_timestamp() AS a, CAST(now() AS DATE) = current_date() AS b, localtimestamp() IS NOT NULL AS c", "SELECT true AS a, true AS b, true AS c")
statement("f_random_uuid", "SELECT count(*) AS n, count(DISTINCT u) AS d, min(length(u)) AS l, bool_and(r >= 0 AND r < 1) AS r FROM (SELECT uuid() AS u, rand() AS r FROM orders)", "SELECT count(*) AS n, count(*) AS d, 36 AS l, true AS r FROM orders")


# arrays
@query(
    """SELECT n_nationkey, array_to_string(list_filter([1, 2, 3, 4], lambda i: a[i] = n_regionkey), ',') AS p, n_regionkey || ',' || n_regionkey AS f, a[1] || ',99,' || a[3] || ',' || a[4] || ',?,7' AS s, '[1:4]' AS d
       FROM (SELECT n_nationkey, n_regionkey, [n_regionkey, n_nationkey, n_regionkey, 2] AS a FROM nation)"""
)
def f_array_places(spark, sf_dir):
    """array_positions, array_fill, assignment to subscripts, dimensions."""
    r, k = F.col("n_regionkey"), F.col("n_nationkey")
    a = F.array(r, k, r, F.lit(2))
    show = lambda x, null=None: F.array_join(x.cast("array<string>"), ",", null) if null else F.array_join(x.cast("array<string>"), ",")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", show(text.positions(a, r)).alias("p"), show(text.fill(r, 2)).alias("f"), show(text.assign(text.assign(a, 2, F.lit(99)), 6, F.lit(7)), "?").alias("s"), text.dims(a).alias("d")
    )


@query("SELECT n_nationkey, i AS s, CASE i WHEN 1 THEN n_regionkey ELSE n_nationkey END AS v FROM nation, (SELECT unnest([1, 2]) AS i)")
def f_generate_subscripts(spark, sf_dir):
    a = F.array("n_regionkey", "n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", a.alias("a"), F.explode(text.subscripts(a)).alias("s"))
    return rows.select("n_nationkey", F.col("s").cast("int").alias("s"), pg.subscript(F.col("a"), F.col("s")).alias("v"))


@query("SELECT n_nationkey, 'a' AS x, CAST(NULL AS VARCHAR) AS y, 2 AS known FROM nation")
def f_string_to_array_null(spark, sf_dir):
    a = text.string_to_array_null(F.lit("a,-,c"), ",", "-")
    return table(spark, sf_dir, "nation").select("n_nationkey", pg.subscript(a, 1).alias("x"), pg.subscript(a, 2).alias("y"), F.size(F.array_compact(a)).alias("known"))


# XML
@query("SELECT n_nationkey, '<nation id=\"' || n_nationkey || '\" q=\"&lt;&quot;&gt;\">' || n_name || ' &amp; &lt;co&gt;<e/></nation>' AS x, '<k>' || n_nationkey || '</k>' AS f FROM nation")
def f_xml(spark, sf_dir):
    """xmlelement with attributes and escaping, an empty element, xmlforest without NULLs."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    x = text.xml_element("nation", {"id": k, "q": F.lit('<">'), "none": F.lit(None)}, text.xml_escape(F.concat(n, F.lit(" & <co>"))), text.xml_element("e"))
    return table(spark, sf_dir, "nation").select("n_nationkey", x.alias("x"), text.xml_forest(k=k, z=F.lit(None)).alias("f"))


@query("SELECT n_regionkey, string_agg('<n>' || n_name || '</n>', '' ORDER BY n_nationkey DESC) AS x FROM nation GROUP BY n_regionkey")
def g_xml_agg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.xml_agg(text.xml_element("n", None, text.xml_escape(F.col("n_name"))), -F.col("n_nationkey")).alias("x"))


# full text
@query(
    """SELECT doc_id, (list_contains(w, 'the') AND NOT list_contains(w, 'und')) OR list_contains(w, 'der') AS q, regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' of the ') AS ph, len(list_filter(w, lambda x: starts_with(x, 'tio'))) > 0 AS pre
       FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)"""
)
def f_text_query(spark, sf_dir):
    """to_tsquery with & | !, a phrase and a prefix."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.text_matches(t, "(the & !und) | der").alias("q"), text.text_matches(t, "of <-> the").alias("ph"), text.text_matches(t, "tio:*").alias("pre"))


# aggregates
@query("SELECT p_brand, quantile_cont(p_size, 0.25) AS a, quantile_cont(p_size, 0.5) AS b, CAST(quantile_disc(p_size, 0.5) AS INTEGER) AS c, CAST(quantile_disc(p_size, 0.9) AS INTEGER) AS d FROM part GROUP BY p_brand")
def g9_percentile_arrays(spark, sf_dir):
    """percentile_cont and percentile_disc of an array of fractions."""
    got = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.percentile("p_size", F.array(F.lit(0.25), F.lit(0.5))).alias("x"), F.array_sort(F.collect_list("p_size")).alias("s"))
    disc = lambda f: F.get("s", F.ceil(F.size("s") * f).cast("int") - 1)
    return got.select("p_brand", F.get("x", F.lit(0)).alias("a"), F.get("x", F.lit(1)).alias("b"), disc(0.5).alias("c"), disc(0.9).alias("d"))


@query(
    """SELECT c_nationkey, max(s) FILTER (WHERE n = top) AS m FROM (SELECT c_nationkey, s, n, max(n) OVER (PARTITION BY c_nationkey) AS top FROM
       (SELECT c_nationkey, c_mktsegment AS s, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)) GROUP BY c_nationkey"""
)
def g_mode_of_segment(spark, sf_dir):
    """mode() WITHIN GROUP (ORDER BY segment DESC): the commonest, the last of them by the alphabet."""
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(pg_mode(F.col("c_mktsegment"), descending=True).alias("m"))


def pg_mode(x: Column, descending: bool = False) -> Column:
    """``mode() WITHIN GROUP (ORDER BY x)``: of equally common values the first in that order."""
    counts = F.map_entries(F.aggregate(F.collect_list(x), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), _tally))
    pairs = F.transform(counts, lambda e: F.struct(e["value"].alias("n"), e["key"].alias("v")))
    if descending:
        return F.array_max(pairs)["v"]
    most = F.array_max(F.transform(pairs, lambda p: p["n"]))
    return F.array_min(F.transform(F.filter(pairs, lambda p: p["n"] == most), lambda p: p["v"]))


def _tally(m: Column, v: Column) -> Column:
    more = F.coalesce(F.try_element_at(m, v), F.lit(0)) + 1
    return F.map_concat(F.map_filter(m, lambda k, _: k != v), F.map_from_arrays(F.array(v), F.array(more)))


def fold_aggregate(x: Column, order: Column, state: Column, step: Callable[[Column, Column], Column], final: Callable[[Column], Column]) -> Column:
    """CREATE AGGREGATE with SFUNC, STYPE, INITCOND and FINALFUNC: ``step`` sees the values in order.

    A step that is no merge needs a group in one place, so a group's values travel together.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda r: r["x"])
    return F.aggregate(ordered, state, step, final)


@query("SELECT p_brand, sum(p_size * power(0.5, r - 1)) / 2 AS ema FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r FROM part) GROUP BY p_brand")
def g_fold_aggregate(spark, sf_dir):
    """An exponential average, which depends on the order: state s, step s / 2 + x, final s / 2."""
    ema = fold_aggregate(F.col("p_size"), F.col("p_partkey"), F.lit(0.0), lambda s, x: s / 2 + x, lambda s: s / 2)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(ema.alias("ema"))


def range_agg(df: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """``range_agg`` over half-open ranges: one row for each range of the multirange, by window sums; no key's ranges meet in an array."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = df.where(F.col(low) < F.col(high)).select(*keys, low, high).distinct()  # ties would be ordered anew
    opened = apart.withColumn("_new", F.when(before.isNull() | (F.col(low) > before), 1).otherwise(0))
    numbered = opened.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_g")


@query(
    """WITH r AS (SELECT DISTINCT o_custkey AS k, o_orderkey // 10 AS lo, o_orderkey // 10 + 2 AS hi FROM orders),
       s AS (SELECT k, lo, hi, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
       g AS (SELECT k, lo, hi, sum(CASE WHEN prev IS NULL OR lo > prev THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM s)
       SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, g"""
)
def g_multirange(spark, sf_dir):
    low = F.floor(F.col("o_orderkey") / 10)
    return range_agg(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), low.alias("lo"), (low + 2).alias("hi")), ["k"], "lo", "hi")


# frames
def excluded(spec, low: int, high: int, build: Callable, join: Callable[[Column, Column], Column]) -> Column:
    """An aggregate over ROWS (or, on a peer number, RANGE) ``low``..``high`` without the current one:
    the part before and the part after, joined. ``build(window)`` gives the aggregate of a part."""
    between = spec
    if low >= 0:
        return build(between(max(low, 1), high))
    if high <= 0:
        return build(between(low, min(high, -1)))
    return join(build(between(low, -1)), build(between(1, high)))


@query(
    """SELECT p_partkey, min(p_retailprice) OVER w AS mn, max(p_retailprice) OVER w AS mx, array_to_string(list(p_partkey) OVER w, ',') AS l FROM part
       WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)"""
)
def w6_exclude_min_max(spark, sf_dir):
    """EXCLUDE CURRENT ROW for aggregates that have no inverse."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        excluded(w.rowsBetween, -2, 2, lambda v: F.min(price).over(v), F.least).alias("mn"),
        excluded(w.rowsBetween, -2, 2, lambda v: F.max(price).over(v), F.greatest).alias("mx"),
        F.nullif(F.array_join(excluded(w.rowsBetween, -2, 2, lambda v: F.collect_list("p_partkey").over(v), F.concat).cast("array<string>"), ","), F.lit("")).alias("l"),
    )


@query("SELECT p_partkey, min(p_retailprice) OVER w AS mn, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP)")
def w6_exclude_group(spark, sf_dir):
    """EXCLUDE GROUP: the peers of the current row are one number, on which the frame's two parts leave a gap."""
    rows = table(spark, sf_dir, "part").withColumn("_peer", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")))
    w = Window.partitionBy("p_brand").orderBy("_peer")
    least = excluded(w.rangeBetween, -1, 1, lambda v: F.min("p_retailprice").over(v), F.least)
    many = excluded(w.rangeBetween, -1, 1, lambda v: F.count("*").over(v), lambda a, b: a + b)
    return rows.select("p_partkey", least.alias("mn"), many.alias("n"))
