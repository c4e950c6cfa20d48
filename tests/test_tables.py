"""DML images, fetches, streams and grouping-set expansion."""

from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggregates, dml, joins, sets
from plumbline.sources import tables as src
from plumbline.streaming.rows import Cursor, fetch_stream


def test_merge_arms(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    s = spark.createDataFrame([(1, "x"), (9, "y")], "k int, v string")
    image = dml.merge(t, s, ["k"], [(F.col("s.v") == "x", None)], [(None, {"k": F.col("s.k"), "v": F.col("s.v")})], [(F.col("t.v").isNull(), {"v": F.lit("filled")})])
    assert sorted(map(tuple, image.table().collect())) == [(2, "b"), (3, "filled"), (9, "y")]
    assert sorted(r["action"] for r in image.returning("action").collect()) == ["delete", "insert", "update"]


def test_merge_refuses_repeated_source(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(dml.DuplicateKeyError):
        dml.upsert(t, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), ["k"], {"v": F.col("s.v")})


def test_null_keys_never_match(spark):
    t = spark.createDataFrame([(None, "a")], "k int, v string")
    s = spark.createDataFrame([(None, "x")], "k int, v string")
    assert dml.upsert(t, s, ["k"], {"v": F.col("s.v")}).table().count() == 2


def test_update_and_delete_with_null_condition(spark):
    t = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert sorted(map(tuple, dml.update(t, {"k": F.lit(0)}, F.col("v") > 1).collect())) == [(0, 5), (1, None)]
    assert dml.delete(t, F.col("v") > 1).count() == 1


def test_quantified(spark):
    left = spark.createDataFrame([(5,), (1,)], "x int")
    known, unknown = spark.createDataFrame([(3,)], "y int"), spark.createDataFrame([(3,), (None,)], "y int")
    verdict = lambda right, every: {r["x"]: r["verdict"] for r in joins.quantified(left, F.col("x"), ">", right, "y", every).collect()}
    assert verdict(known, True) == {5: True, 1: False}
    assert verdict(unknown, True) == {5: None, 1: False}
    assert verdict(unknown, False) == {5: True, 1: None}
    assert verdict(known.where("y > 9"), True) == {5: True, 1: True} and verdict(known.where("y > 9"), False) == {5: False, 1: False}


def test_expand_grouping():
    assert aggregates.expand_grouping(("rollup", ["a", ("b", "c")])) == [("a", "b", "c"), ("a",), ()]
    assert len(aggregates.expand_grouping(("cube", ["a", "b"]), ("plain", ["c"]))) == 4
    assert aggregates.expand_grouping(("sets", [("a",), ("rollup", ["b"])])) == [("a",), ("b",), ()]


def test_repeated_grouping_sets(spark):
    df = spark.createDataFrame([("x",), ("y",)], "a string")
    out = aggregates.grouping_sets(df, [("a",), ("a",), ()], F.count("*").alias("n"))
    assert sorted((r["a"] or "", r["n"]) for r in out.collect()) == [("", 2), ("x", 1), ("x", 1), ("y", 1), ("y", 1)]


def test_closure_is_complete_or_fails(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "node int")
    assert sets.closure(start, chain).count() == sets.closure(start, chain, max_rounds=6).count() == 6
    with pytest.raises(RuntimeError):
        sets.closure(start, chain, max_rounds=2)


def test_closure_stops_on_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src int, dst int")
    assert sorted(r["node"] for r in sets.closure(spark.createDataFrame([(1,)], "node int"), edges).collect()) == [1, 2, 3]


def test_cte_order():
    assert sets.cte_order({"c": {"b"}, "b": {"a"}, "a": set()}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        sets.cte_order({"a": {"b"}, "b": {"a"}})


def test_fetches(spark):
    df = spark.range(3)
    with pytest.raises(src.RowCountError):
        src.fetch_one(df)
    assert src.fetch_optional(df.where("id > 5")) is None
    assert src.fetch_value(df.where("id = 1")) == 1 and src.execute(df) == 3

    @dataclass
    class Item:
        id: int

    assert src.fetch_as(df.orderBy("id"), Item)[2] == Item(2)
    with pytest.raises(ValueError):
        src.fetch_as(df.withColumn("x", F.lit(1)), Item)


def test_streams(spark):
    df = spark.range(0, 100, 1, 4)
    assert sum(r["id"] for r in fetch_stream(df)) == 4950
    cur = Cursor(df)
    assert len(cur.fetch(30)) == 30 and len(cur.fetch(100)) == 70 and cur.fetch() == []
    cur.close()
    with pytest.raises(ValueError):
        cur.fetch()


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    src.write(df, str(tmp_path / fmt), fmt)
    assert sorted(map(tuple, src.read(spark, str(tmp_path / fmt), fmt, "k int, v string").collect()), key=str) == [(1, "a"), (2, None)]


def test_array_agg_over_nothing(spark):
    got = spark.range(0).agg(aggregates.array_agg(F.col("id")).alias("a")).first()["a"]
    assert got is None


def test_recursion_goes_on_or_fails(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "node int")
    assert sets.closure(start, edges).count() == 41 and sets.paths(start, edges).count() == 41
    for stopped in (lambda: sets.closure(start, edges, 3), lambda: sets.paths(start, edges, 3)):
        with pytest.raises(RuntimeError):
            stopped()
    ring = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src int, dst int")
    got = {tuple(r["path"]): r["is_cycle"] for r in sets.paths(start, ring).collect()}
    assert got == {(0,): False, (0, 1): False, (0, 1, 0): True, (0, 1, 2): False}


def test_copy_in_stores_batches_or_nothing(spark):
    pulled = []
    rows = ((pulled.append(i) or i, str(i)) for i in range(25))
    assert src.copy_in(spark, rows, "a int, b string", batch=10).count() == 25
    assert src.copy_in(spark, [], "a int").count() == 0
    with pytest.raises(Exception):
        src.copy_in(spark, [(1,), ("x",)], "a int", batch=1)


def test_partitioned_scan_prunes(spark):
    df = src.stored(spark.range(100).selectExpr("id", "id % 4 AS k"), "parts", ["k"])
    plan = "\n".join(r["plan"] for r in src.explain(df.where("k = 2")).collect())
    assert "PartitionFilters: [isnotnull(k" in plan and df.where("k = 2").count() == 25
    assert len(df.where("k = 2").inputFiles()) <= len(df.inputFiles()) and '"class"' in src.explain_json(df)


def test_samples(spark):
    df = spark.range(20_000)
    a, b = (src.tablesample(df, "bernoulli", 10, seed=5) for _ in range(2))
    assert 1700 < a.count() < 2300 and a.exceptAll(b).isEmpty()
    files = src.stored(df.repartition(40), "sample")
    kept = src.tablesample(files, "system", 50, seed=3)
    n = kept.select(F.input_file_name().alias("f")).distinct().count()
    assert 8 <= n <= 32 and kept.count() == src.tablesample(files, "system", 50, seed=3).count() and src.tablesample(files, "system", 100, seed=3).count() == 20_000
    assert src.tablesample(df, "system_rows", 7).count() == 7
    with pytest.raises(ValueError):
        src.tablesample(df, "system_time", 10)


def test_refreshed_view_keeps_the_earlier_image(spark):
    rows = [spark.range(3)]
    view = src.MaterializedView(spark, "v", lambda: rows[0])
    before = view.read()
    rows[0] = spark.range(5)
    assert view.read().count() == 3 and view.refresh().count() == 5 and before.count() == 3
    view.drop_old()
    with pytest.raises(ValueError):
        src.MaterializedView(spark, "w", lambda: rows[0], with_data=False).read()


def test_identity_and_partial_index(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(7, "c")], "k long, v string")
    always = dml.Identity("k", 100)
    with pytest.raises(ValueError):
        dml.insert(t, new, identity=always)
    assert {r["k"] for r in dml.insert(t, new, identity=always, overriding="system").table().collect()} == {1, 2, 7}
    assert min(r["k"] for r in dml.insert(t, new.drop("k"), identity=always).table().where("v = 'c'").collect()) >= 100
    s = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    got = dml.upsert(t, s, ["k"], {"v": F.lit("met")}, "k = 1").table()
    assert sorted(map(tuple, got.collect())) == [(1, "met"), (2, "b"), (2, "y")]


def test_small_source_does_not_shuffle_the_target(spark):
    t = src.stored(spark.range(1000).selectExpr("id AS k", "'a' AS v"), "target")
    s = src.stored(spark.createDataFrame([(1, "x"), (5000, "y")], "k long, v string"), "source")
    image = dml.upsert(t, s, ["k"], {"v": F.col("s.v")})
    assert image.table().count() == 1001 and sorted(r["action"] for r in image.returning("action").collect()) == ["insert", "update"]
    plan = image.rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_keys_need_equality(spark):
    df = spark.sql("SELECT map('a', 1) AS m, array(1) AS a, struct(map(1, 2) AS x) AS s")
    aggregates.require_equality(df, ["a"])
    for c in ("m", "s"):
        with pytest.raises(TypeError):
            aggregates.require_equality(df, [c])


def test_locking_clauses():
    from plumbline.operators.scans import without_locks

    assert without_locks("SELECT 'FOR UPDATE' FROM t FOR UPDATE OF t SKIP LOCKED").strip() == "SELECT 'FOR UPDATE' FROM t"
    assert without_locks("SELECT a FROM t -- FOR SHARE").strip() == "SELECT a FROM t -- FOR SHARE"
