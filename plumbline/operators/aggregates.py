"""Aggregation: grouping forms, ordered and hypothetical sets, NULL-keeping collections."""

from __future__ import annotations

from itertools import chain, combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.base import query, sql, statement, table

MONEY = "CAST({} AS DECIMAL(18,2))"


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
       CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS DECIMAL(24,4))) AS DOUBLE) AS sum_disc, sum(l_quantity) / count(*) AS avg_qty, count(*) AS n
       FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def g1_pricing_summary(spark, sf_dir):
    return sql(
        spark,
        sf_dir,
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_base,
       CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS DECIMAL(24,4))) AS DOUBLE) AS sum_disc, sum(l_quantity) / count(*) AS avg_qty, count(*) AS n
       FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    )


statement("g1_group_by_ordinal", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2")
statement("g2_functional_dependency", "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_ROLL = "SELECT r_name, n_name, {g} AS g, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY {s}"
statement("g3_rollup", _ROLL.format(g="grouping_id(r_name, n_name)", s="ROLLUP (r_name, n_name)"), _ROLL.format(g="GROUPING(r_name, n_name)", s="ROLLUP (r_name, n_name)"))
statement("g3_cube", _ROLL.format(g="grouping_id(r_name, n_name)", s="CUBE (r_name, n_name)"), _ROLL.format(g="GROUPING(r_name, n_name)", s="CUBE (r_name, n_name)"))
statement("g5_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND max(o_totalprice) > 100000")
statement("g6_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS o FROM orders GROUP BY o_orderpriority")
statement("g7_distinct_aggregate", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, sum(DISTINCT l_linenumber) AS l FROM lineitem GROUP BY l_returnflag")
statement(
    "g9_ordered_sets",
    "SELECT p_brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS med, percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size) AS q1 FROM part GROUP BY p_brand",
    "SELECT p_brand, quantile_cont(p_size, 0.5) AS med, quantile_disc(p_size, 0.25) AS q1 FROM part GROUP BY p_brand",
)
statement("g12_whole_query", "SELECT count(*) AS n, max(o_totalprice) AS m, min(o_orderdate) AS d FROM orders WHERE o_orderkey < 0")
statement("g13_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
statement(
    "g_bool_aggregates",
    "SELECT c_nationkey, bool_or(c_acctbal > 9000) AS any_rich, bool_and(c_acctbal > -900) AS all_over, every(c_acctbal > 0) AS all_pos FROM customer GROUP BY c_nationkey",
    "SELECT c_nationkey, bool_or(c_acctbal > 9000) AS any_rich, bool_and(c_acctbal > -900) AS all_over, bool_and(c_acctbal > 0) AS all_pos FROM customer GROUP BY c_nationkey",
)
_STATS = "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_discount), 8) AS c, round(covar_pop(l_quantity, l_discount), 8) AS cp, round(covar_samp(l_quantity, l_discount), 8) AS cs, round(regr_slope(l_quantity, l_discount), 5) AS sl, round(regr_intercept(l_quantity, l_discount), 6) AS ic, round(regr_r2(l_quantity, l_discount), 9) AS r2, regr_count(l_quantity, l_discount) AS rc, round(regr_avgx(l_quantity, l_discount), 8) AS ax, round(regr_sxx(l_quantity, l_discount), 5) AS sxx, round(regr_sxy(l_quantity, l_discount), 5) AS sxy, round(regr_syy(l_quantity, l_discount), 3) AS syy FROM lineitem GROUP BY l_returnflag"
statement("g_statistics", _STATS)
statement("g_mode", "SELECT c_nationkey, count(*) AS n, mode() WITHIN GROUP (ORDER BY c_nationkey) AS m FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, count(*) AS n, mode(c_nationkey) AS m FROM customer GROUP BY c_nationkey")


def expand_grouping(*entries: tuple[str, list]) -> list[tuple[str, ...]]:
    """Flat grouping sets of a GROUP BY list.

    An entry is ("plain", [names]), ("rollup" | "cube", [name or tuple]) or ("sets", [tuple or entry]).
    Entries multiply; duplicates stay, as in the language.
    """

    def unit(x) -> tuple[str, ...]:
        return x if isinstance(x, tuple) else (x,)

    def one(kind: str, items: list) -> list[tuple[str, ...]]:
        if kind == "plain":
            return [tuple(items)]
        if kind == "rollup":
            return [tuple(chain.from_iterable(map(unit, items[:k]))) for k in range(len(items), -1, -1)]
        if kind == "cube":
            return [tuple(chain.from_iterable(map(unit, c))) for k in range(len(items), -1, -1) for c in combinations(items, k)]
        return [s for x in items for s in (one(*x) if isinstance(x, tuple) and len(x) == 2 and x[0] in ("rollup", "cube", "sets", "plain") and isinstance(x[1], list) else [unit(x)])]

    return [tuple(dict.fromkeys(chain.from_iterable(p))) for p in product(*[one(*e) for e in entries])]


def grouping_sets(df: DataFrame, sets: list[tuple[str, ...]], *aggs: Column, distinct: bool = False) -> DataFrame:
    """Aggregate by every set in one pass (Expand); ``distinct`` drops repeated sets."""
    if distinct:
        sets = list({frozenset(s): s for s in sets}.values())
    names = list(dict.fromkeys(chain.from_iterable(sets)))
    if len({frozenset(s) for s in sets}) == len(sets):
        return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggs)
    out = None
    for s in sets:
        part = df.groupBy(*s).agg(*aggs).select(*[F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names], *[F.col(f"`{a}`") for a in df.limit(0).groupBy(*s).agg(*aggs).columns[len(s) :]])
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")
def g3_grouping_sets(spark, sf_dir):
    sets = expand_grouping(("cube", ["o_orderstatus", "o_orderpriority"]))
    return grouping_sets(table(spark, sf_dir, "orders"), sets, F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "n")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def g3b_group_by_distinct(spark, sf_dir):
    sets = expand_grouping(("rollup", ["o_orderstatus", "o_orderpriority"]), ("rollup", ["o_orderstatus"]))
    return grouping_sets(table(spark, sf_dir, "orders"), sets, F.count("*").alias("n"), distinct=True).select("o_orderstatus", "o_orderpriority", "n")


@query("SELECT n_regionkey, n_nationkey % 2 AS odd, GROUPING(n_regionkey) AS g1, GROUPING(n_nationkey % 2) AS g2, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey % 2)")
def g4_grouping_bits(spark, sf_dir):
    df = table(spark, sf_dir, "nation").withColumn("odd", F.col("n_nationkey") % 2)
    return df.rollup("n_regionkey", "odd").agg(F.grouping("n_regionkey").alias("g1"), F.grouping("odd").alias("g2"), F.count("*").alias("n"))


def ordered_array(value: Column, *order: Column, descending: bool = False) -> Column:
    """``array_agg(value ORDER BY order)``; NULL values are kept."""
    packed = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))
    packed = F.sort_array(packed, asc=not descending)
    return F.transform(packed, lambda s: s["v"])


def array_agg(value: Column) -> Column:
    """Keeps NULLs; NULL over no rows."""
    packed = F.collect_list(F.struct(value.alias("v")))
    return F.when(F.count("*") > 0, F.transform(packed, lambda s: s["v"]))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def g8_ordered_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(ordered_array(F.col("n_name"), F.col("n_name"), descending=True), "|").alias("names"))


@query("SELECT n_regionkey, len(list(nullif(n_nationkey % 3, 0))) AS size, count(nullif(n_nationkey % 3, 0)) AS known FROM nation GROUP BY n_regionkey")
def g_array_agg_keeps_nulls(spark, sf_dir):
    value = F.nullif(F.col("n_nationkey") % 3, F.lit(0))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.size(array_agg(value)).cast("long").alias("size"), F.count(value).alias("known"))


def hypothetical(value, x: Column) -> dict[str, Column]:
    """rank, dense_rank, percent_rank and cume_dist that ``value`` would have among ``x`` ascending."""
    less = F.count(F.when(x < value, 1))
    upto = F.count(F.when(x <= value, 1))
    n = F.count("*")
    return {
        "rank": (less + 1).cast("long"),
        "dense_rank": (F.count_distinct(F.when(x < value, x)) + 1).cast("long"),
        "percent_rank": F.when(n == 0, F.lit(0.0)).otherwise(less / n),
        "cume_dist": (upto + 1) / (n + 1),
    }


@query(
    """SELECT p_brand, CAST(count(*) FILTER (WHERE p_size < 25) + 1 AS BIGINT) AS rank, CAST(count(DISTINCT CASE WHEN p_size < 25 THEN p_size END) + 1 AS BIGINT) AS dense_rank,
       count(*) FILTER (WHERE p_size < 25) / count(*) AS percent_rank, (count(*) FILTER (WHERE p_size <= 25) + 1) / (count(*) + 1) AS cume_dist FROM part GROUP BY p_brand"""
)
def g10_hypothetical_set(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*[c.alias(k) for k, c in hypothetical(25, F.col("p_size")).items()])


@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > n_regionkey * 1000) AS n FROM nation")
def g11_outer_level_columns(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    hits = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("c_acctbal") > F.col("n_regionkey") * 1000).groupBy("n_nationkey").agg(F.count("*").alias("n"))
    return n.select("n_nationkey").join(hits, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"))


def require_equality(df: DataFrame, keys: list[str]) -> None:
    """Keys of DISTINCT, GROUP BY and set operations need an equality operator: maps and VARIANT have none."""
    from pyspark.sql import types as T

    def bad(kind) -> bool:
        if isinstance(kind, (T.MapType, T.VariantType)):
            return True
        if isinstance(kind, T.ArrayType):
            return bad(kind.elementType)
        return isinstance(kind, T.StructType) and any(bad(f.dataType) for f in kind.fields)

    wrong = [f.name for f in df.select(*keys).schema if bad(f.dataType)]
    if wrong:
        raise TypeError(f"no equality operator for {', '.join(wrong)}")


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the given order."""
    from pyspark.sql import Window

    require_equality(df, keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def g14_distinct_on(spark, sf_dir):
    return distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS pairs FROM nation GROUP BY n_regionkey")
def g_json_object_agg(spark, sf_dir):
    pairs = F.from_json(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))))), "map<string,string>")
    out = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(pairs.alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("v"))))
    return out.select("n_regionkey", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["k"], e["v"])), ",").alias("pairs"))


@query("SELECT c, count(*) AS n FROM (SELECT l_suppkey % 10 AS c FROM lineitem) GROUP BY c")
def g_spread_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("c")).agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT DISTINCT o_custkey AS k, o_orderkey // 10 AS lo, o_orderkey // 10 + 2 AS hi FROM orders),
       s AS (SELECT k, lo, hi, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
       g AS (SELECT k, lo, hi, sum(CASE WHEN prev IS NULL OR lo > prev THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM s)
       SELECT k, count(DISTINCT g) AS n_ranges FROM g GROUP BY k"""
)
def g_range_agg(spark, sf_dir):
    from plumbline.operators.moreops import range_agg

    low = F.floor(F.col("o_orderkey") / 10)
    merged = range_agg(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), low.alias("lo"), (low + 2).alias("hi")), ["k"], "lo", "hi")
    return merged.groupBy("k").agg(F.count("*").alias("n_ranges"))


@query("SELECT label, i, round(sum(v), 4) AS s, round(avg(v), 5) AS a FROM (SELECT label, unnest(generate_series(1, 4)) AS i, unnest(embedding[1:4]) AS v FROM embeddings) GROUP BY label, i")
def g_vector_aggregates(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 4)).alias("p", "v"))
    return each.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.sum(F.col("v").cast("double")), 4).alias("s"), F.round(F.avg(F.col("v").cast("double")), 5).alias("a"))


@query("SELECT p_brand, sum(p_size) AS total, (sum(p_size * p_size)) AS squares FROM part GROUP BY p_brand")
def g_user_aggregate(spark, sf_dir):
    """A user-defined aggregate: state (total, squares) folded by a step function, per partition first."""
    from plumbline.functions.udf import user_aggregate

    sums = user_aggregate(table(spark, sf_dir, "part"), ["p_brand"], {"total": ("long", F.sum(F.col("p_size").cast("long"))), "squares": ("long", F.sum((F.col("p_size") * F.col("p_size")).cast("long")))})
    return sums
