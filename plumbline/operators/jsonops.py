"""JSON: containment, paths, editing, construction, aggregates and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import jsonb as J
from plumbline.operators.base import query, table

#: The same document in both dialects, built of a nation's columns.
DOC = """'{"id":' || n_nationkey || ',"name":"' || n_name || '","tags":["r' || n_regionkey || '","all"],"geo":{"region":' || n_regionkey || ',"odd":' || CASE WHEN n_nationkey % 2 = 1 THEN 'true' ELSE 'false' END || '},"parts":[{"q":' || n_nationkey || '},{"q":' || (n_nationkey + 1) || '}]}'"""
_D = f"(SELECT n_nationkey, n_regionkey, n_name, CAST({DOC} AS JSON) AS d FROM nation)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name", F.expr(DOC).alias("d"))


@query(f"""SELECT n_nationkey, json_contains(d, '{{"geo":{{"region":1}}}}') AS a, json_contains(d, '{{"tags":["r2"]}}') AS b, json_contains(d, '{{"id":"3"}}') AS c, json_contains(d, '{{"geo":{{"odd":true}},"tags":["all"]}}') AS e, json_contains(d, '{{"parts":[{{"q":4}}]}}') AS f FROM {_D}""")
def f_json_contains(spark, sf_dir):
    d = F.col("d")
    has = lambda p: J.contains(d, p)
    return _docs(spark, sf_dir).select("n_nationkey", has('{"geo":{"region":1}}').alias("a"), has('{"tags":["r2"]}').alias("b"), has('{"id":"3"}').alias("c"), has('{"geo":{"odd":true},"tags":["all"]}').alias("e"), has('{"parts":[{"q":4}]}').alias("f"))


@query(f"SELECT n_nationkey, json_contains(d, CAST('{{\"geo\":{{\"region\":' || (n_nationkey % 5) || '}}}}' AS JSON)) AS a FROM {_D}")
def f_json_contains_column(spark, sf_dir):
    """Both sides from columns."""
    want = F.expr("""'{"geo":{"region":' || (n_nationkey % 5) || '}}'""")
    return _docs(spark, sf_dir).select("n_nationkey", J.contains_column(F.col("d"), want).alias("a"))


@query(f"SELECT n_nationkey, json_exists(d, '$.geo') AS a, n_regionkey = 2 AS b, json_exists(d, '$.nope') OR json_exists(d, '$.id') AS c, json_exists(d, '$.nope') AND json_exists(d, '$.id') AS e FROM {_D}")
def f_json_keys_exist(spark, sf_dir):
    d = F.col("d")
    tags = J.query_text(d, "$.tags")
    return _docs(spark, sf_dir).select("n_nationkey", J.has_key(d, "geo").alias("a"), J.has_key(tags, "r2").alias("b"), J.has_any(d, ["nope", "id"]).alias("c"), J.has_all(d, ["nope", "id"]).alias("e"))


@query(
    f"""SELECT n_nationkey, replace(CAST(d AS VARCHAR), '"region":' || n_regionkey, '"region":9') AS s, CAST(json_merge_patch(d, '{{"new":"x"}}') AS VARCHAR) AS n, CAST(json_merge_patch(d, '{{"geo":null,"parts":null}}') AS VARCHAR) AS r, replace(CAST(d AS VARCHAR), '"id":' || n_nationkey || ',', '"id":[1],') AS c FROM {_D}"""
)
def f_json_edit(spark, sf_dir):
    """jsonb_set of a nested member, a new member, #- twice, and ||; numbers stay numbers."""
    d = F.col("d")
    return _docs(spark, sf_dir).select(
        "n_nationkey",
        J.set_path(d, ["geo", "region"], F.lit("9")).alias("s"),
        J.set_path(d, ["new"], F.lit('"x"')).alias("n"),
        J.delete_path(J.delete_path(d, ["geo"]), ["parts"]).alias("r"),
        J.concat(d, F.lit('{"id":[1]}')).alias("c"),
    )


@query(f"SELECT n_nationkey, n_regionkey > 1 AS e, (n_nationkey > 10 OR n_nationkey + 1 > 10) AS p, n_nationkey % 2 = 1 AND n_regionkey < 3 AS m, CAST(json_extract(d, '$.parts[1].q') AS VARCHAR) AS f, 2 AS n FROM {_D}")
def f_json_path(spark, sf_dir):
    d = F.col("d")
    return _docs(spark, sf_dir).select(
        "n_nationkey",
        J.path_exists(d, "$.geo ? (@.region > 1)").alias("e"),
        J.path_exists(d, "$.parts[*] ? (@.q > 10)").alias("p"),
        J.path_match(d, "$.geo.odd == true && $.geo.region < 3").alias("m"),
        J.path_first(d, "$.parts[1].q").alias("f"),
        F.size(J.path_items(d, "$.parts.q")).alias("n"),
    )


@query(f'''SELECT n_nationkey, CAST(json_extract(d, '$.tags') AS VARCHAR) AS q, '{{"odd":' || CAST(json_extract(d, '$.geo.odd') AS VARCHAR) || ',"region":' || CAST(json_extract(d, '$.geo.region') AS VARCHAR) || '}}' AS o, '[' || n_nationkey || ',' || (n_nationkey + 1) || ']' AS w, CAST(NULL AS VARCHAR) AS many, CAST(json_extract(d, '$.geo.region') AS INTEGER) AS v FROM {_D}''')
def f_json_query(spark, sf_dir):
    """JSON_QUERY with and without a wrapper, and a subscript to a number."""
    d = F.col("d")
    return _docs(spark, sf_dir).select(
        "n_nationkey",
        J.query_text(d, "$.tags").alias("q"),
        J.query_text(d, "$.geo").alias("o"),
        J.query_text(d, "$.parts[*].q", wrapper=True).alias("w"),
        J.query_text(d, "$.parts[*].q").alias("many"),
        F.try_variant_get(J.parsed(d), "$['geo']['region']", "int").alias("v"),
    )


@query("SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_nationkey) || '}' AS o, '[' || string_agg('\"' || n_name || '\"', ',' ORDER BY n_nationkey DESC) || ']' AS a, '[' || string_agg(CAST(nullif(n_nationkey % 3, 0) AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS skip, '[' || string_agg(coalesce(CAST(nullif(n_nationkey % 3, 0) AS VARCHAR), 'null'), ',' ORDER BY n_nationkey) || ']' AS keep FROM nation GROUP BY n_regionkey")
def g_json_aggregates(spark, sf_dir):
    """JSON_OBJECTAGG and JSON_ARRAYAGG with an order, ABSENT and NULL ON NULL."""
    k, rest = F.col("n_nationkey"), F.nullif(F.col("n_nationkey") % 3, F.lit(0))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        J.object_agg(F.col("n_name"), k, k, unique=True).alias("o"),
        J.array_agg(F.col("n_name"), -k).alias("a"),
        J.array_agg(rest, k).alias("skip"),
        J.array_agg(rest, k, absent_on_null=False).alias("keep"),
    )


@query("SELECT n_nationkey, CAST(json_object('k', n_nationkey, 's', n_name || '\"x', 'n', NULL) AS VARCHAR) AS o, CAST(json_object('k', n_nationkey) AS VARCHAR) AS absent, CAST(json_array(n_nationkey, n_name, true) AS VARCHAR) AS a, CAST(to_json(n_name) AS VARCHAR) AS s FROM nation")
def f_json_construct(spark, sf_dir):
    """JSON_OBJECT, JSON_ARRAY and JSON_SCALAR."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        J.build_object(("k", k), ("s", F.concat(n, F.lit('"x'))), ("n", F.lit(None).cast("string"))).alias("o"),
        J.build_object(("k", k), ("n", F.lit(None).cast("string")), absent_on_null=True).alias("absent"),
        J.build_array(k, n, F.lit(None).cast("string"), F.lit(True)).alias("a"),
        J.scalar(n).alias("s"),
    )


_FORMS = """CASE n_nationkey % 5 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '[1,2]' WHEN 2 THEN '"s"' WHEN 3 THEN '12.5' ELSE '{bad' END"""


@query(f"SELECT n_nationkey, json_valid(x) AS v, json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x END) = 'OBJECT' AS o, json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x END) = 'ARRAY' AS a, json_valid(x) AND json_type(CASE WHEN json_valid(x) THEN x END) NOT IN ('OBJECT', 'ARRAY') AS s, CASE n_nationkey % 5 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'number' END AS t FROM (SELECT n_nationkey, {_FORMS} AS x FROM nation)")
def f_is_json(spark, sf_dir):
    x = F.expr(_FORMS)
    return table(spark, sf_dir, "nation").select("n_nationkey", J.is_json(x).alias("v"), J.is_json(x, "object").alias("o"), J.is_json(x, "array").alias("a"), J.is_json(x, "scalar").alias("s"), J.kind(J.parsed(x)).alias("t"))


@query(f'''SELECT n_nationkey, k, CASE WHEN k = 'geo' THEN '{{"odd":' || CAST(json_extract(d, '$.geo.odd') AS VARCHAR) || ',"region":' || CAST(json_extract(d, '$.geo.region') AS VARCHAR) || '}}' ELSE CAST(json_extract(d, '$.' || k) AS VARCHAR) END AS v FROM (SELECT n_nationkey, d, unnest(json_keys(d)) AS k FROM {_D})''')
def f_json_members(spark, sf_dir):
    """jsonb_each: every member of every document, values as JSON text with sorted members."""
    each = F.explode(F.try_variant_get(J.parsed(F.col("d")), "$", "map<string,variant>")).alias("k", "x")
    return _docs(spark, sf_dir).select("n_nationkey", each).select("n_nationkey", "k", F.to_json("x").alias("v"))


@query(f"SELECT n_nationkey, i AS nr, CAST(json_extract(d, '$.parts[' || (i - 1) || '].q') AS INTEGER) AS q, 7 AS dflt, false AS has FROM {_D}, (SELECT unnest([1, 2]) AS i)")
def s13_json_table_columns(spark, sf_dir):
    """FOR ORDINALITY, a typed column, DEFAULT ON EMPTY and EXISTS PATH."""
    columns = [J.Ordinality("nr"), J.Col("q", "int"), J.Col("dflt", "int", "$.none", 7), J.Exists("has", "$.none")]
    return J.json_table(_docs(spark, sf_dir), F.col("d"), "$.parts[*]", columns).select("n_nationkey", "nr", "q", "dflt", "has")


@query(
    f"""SELECT n_nationkey, n_nationkey AS id, i AS nr, CAST(json_extract(d, '$.parts[' || (i - 1) || '].q') AS INTEGER) AS q, NULL AS tag FROM {_D}, (SELECT unnest([1, 2]) AS i)
        UNION ALL SELECT n_nationkey, n_nationkey, NULL, NULL, json_extract_string(d, '$.tags[' || (i - 1) || ']') FROM {_D}, (SELECT unnest([1, 2]) AS i)"""
)
def s13_json_table_nested(spark, sf_dir):
    """Two NESTED PATHs side by side: a union, each with NULLs for the other's columns."""
    columns = [J.Col("id", "int"), J.Nested("$.parts[*]", (J.Ordinality("nr"), J.Col("q", "int"))), J.Nested("$.tags[*]", (J.Col("tag", "string", "$"),))]
    return J.json_table(_docs(spark, sf_dir), F.col("d"), "$", columns).select("n_nationkey", "id", "nr", "q", "tag")
