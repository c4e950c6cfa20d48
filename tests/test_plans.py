"""Proofs, rewrites (taken and refused), description and lint."""

import json
from dataclasses import replace

import pytest
from conftest import SF

from plumbline.operators.base import table
from plumbline.plans import demo
from plumbline.plans.catalog import STAR, Catalog, ForeignKey, Table
from plumbline.plans.describe import describe, diff, parameters
from plumbline.plans.ir import CountTest, Exists, Frames, Join, NotIn, Select, Sub, Union, build
from plumbline.plans.fromsql import query, run_sql
from plumbline.plans.lint import lint_catalog, lint_query, lint_sql, lint_text, report
from plumbline.plans.proofs import at_least_one_row, at_most_one_row, distinct_rows
from plumbline.plans.rules import run, simplify
from plumbline.plans.syntax import Unknown


def test_declarations_hold(spark):
    assert STAR.verify({n: table(spark, SF, n) for n in STAR.tables}) == []


def test_false_declaration_is_found(spark):
    wrong = Catalog(Table("lineitem", {"l_orderkey": "bigint"}, frozenset(), [("l_orderkey", "l_linenumber")]))
    assert wrong.verify({"lineitem": table(spark, SF, "lineitem")})


@pytest.mark.parametrize(("name", "rule"), [("not_in", "not_in"), ("count_exists", "count_exists"), ("count_not_exists", "count_exists"), ("distinct", "distinct"), ("union_all", "union_all"), ("fk_join", "fk_join")])
def test_rewritten(spark, name, rule):
    q = demo.CASES[name][0]
    simple, used = simplify(q, STAR)
    assert rule in used and simple != q
    tables = {t: table(spark, SF, t) for t in STAR.tables}
    a, b = run(q, STAR, tables, False), run(q, STAR, tables, True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_not_in_kept_when_nullable():
    loose = Catalog(*[replace(STAR[t], not_null=frozenset() if t == "orders" else STAR[t].not_null) for t in STAR.tables])
    assert simplify(demo.NOT_IN, loose)[1] == []
    limited = replace(demo.NOT_IN, tests=(NotIn("c.c_custkey", Sub("orders", "o", "o_custkey", limit=5)),))
    assert simplify(limited, STAR)[1] == []


def test_not_in_kept_on_null_extended_side():
    q = Select("nation", "n", (("n.n_nationkey", "k"),), (Join("customer", "c", (("n.n_nationkey", "c_nationkey"),), "left"),), tests=(NotIn("c.c_custkey", Sub("orders", "o", "o_custkey")),))
    assert "not_in" not in simplify(q, STAR)[1]


def test_not_in_with_null_rejects_all(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1,), (None,)], "b int")
    q = Select("l", "l", (("l.a", "a"),), tests=(NotIn("l.a", Sub("r", "r", "b")),))
    assert build(q, Frames({"l": left, "r": right})).count() == 0


def test_fk_join_kept():
    outer = replace(demo.FK, joins=tuple(replace(j, kind="left") for j in demo.FK.joins))
    read = replace(demo.FK, columns=(("o.o_orderkey", "k"), ("n.n_name", "n")))
    assert simplify(outer, STAR)[1] == [] and simplify(read, STAR)[1] == []
    assert [j.alias for j in simplify(demo.FK, STAR)[0].joins] == []


def test_union_kept_without_tag():
    q = Union((Select("customer", "c", (("c.c_custkey", "k"),)), Select("supplier", "s", (("s.s_suppkey", "k"),))))
    assert simplify(q, STAR)[1] == []


def test_count_kept_when_uncorrelated():
    q = Select("customer", "c", (("c.c_custkey", "k"),), tests=(CountTest(Sub("orders", "o"), True),))
    assert not any(isinstance(t, Exists) for t in simplify(q, STAR)[0].tests)


def test_row_count_proofs():
    one = Select("orders", "o", (("o.o_orderkey", "k"),), (Join("customer", "c", (("o.o_custkey", "c_custkey"),)),), equal=(("o.o_orderkey", 5),))
    assert at_most_one_row(one, STAR)
    assert not at_most_one_row(replace(one, equal=(("o.o_custkey", 5),)), STAR)
    assert not at_most_one_row(replace(one, joins=(Join("customer", "c", (("o.o_custkey", "c_custkey"),), "full"),)), STAR)
    agg = Select("orders", "o", (("count(*)", "n"),), group=())
    assert at_most_one_row(agg, STAR) and at_least_one_row(agg) and not at_least_one_row(replace(agg, limit=0))
    assert distinct_rows(Select("lineitem", "l", (("l.l_orderkey", "k"),), group=("l.l_orderkey",)), STAR)
    assert not distinct_rows(Select("lineitem", "l", (("l.l_orderkey", "k"), ("l.l_linenumber", "n"))), STAR)


def test_describe(spark):
    d = describe(spark, "SELECT c.c_name, o.o_orderkey, count(*) OVER () AS n FROM customer c LEFT JOIN orders o ON c_custkey = o_custkey WHERE c.c_acctbal > :floor", STAR)
    assert [(c.name, c.type, c.nullable) for c in d.columns] == [("c_name", "string", False), ("o_orderkey", "bigint", True), ("n", "bigint", False)]
    assert d.params == ("floor",)
    assert parameters("SELECT ':x', a::int, :y -- :z\n, :y") == ("y",)
    other = describe(spark, "SELECT c_name FROM customer", STAR)
    assert diff(d, other) == ["- o_orderkey", "- n"]


def test_lint(spark):
    rules = lambda fs: [f.rule for f in fs]
    assert rules(lint_text("SELECT * FROM t WHERE x = NULL LIMIT 3")) == ["null_comparison", "limit_without_order"]
    assert rules(lint_text("DELETE FROM t")) == ["unbounded_write"]
    # clauses of other queries in the text don't silence a rule
    assert rules(lint_text("DELETE FROM t WHERE true")) == ["unbounded_write"]
    assert rules(lint_text("UPDATE t SET a = (SELECT max(b) FROM u WHERE c = 1)")) == ["unbounded_write"]
    assert rules(lint_text("SELECT a, rank() OVER (ORDER BY b) FROM t LIMIT 3")) == ["limit_without_order"]
    assert rules(lint_text("SELECT a FROM (SELECT a FROM t ORDER BY a LIMIT 9) LIMIT 3 OFFSET 1")) == ["limit_without_order"]
    assert rules(lint_text("SELECT a FROM t ORDER BY a LIMIT 3 OFFSET 2")) == [] and rules(lint_text("SELECT count(*) FROM t LIMIT 1")) == []
    assert rules(lint_text("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE NULL <> x)")) == ["null_comparison"]
    assert rules(lint_text("no statement at all")) == []
    sql = lambda text, fetch="all": rules(lint_sql(text, STAR, fetch))
    assert sql("SELECT DISTINCT o_orderkey FROM orders") == ["redundant_distinct"]
    assert sql("SELECT o_orderkey FROM orders WHERE o_orderkey = 4 LIMIT 1") == ["limit_without_order", "redundant_limit", "fetch_all_single_row"]
    assert sql("SELECT o_orderkey FROM orders WHERE coalesce(o_custkey, 0) > 3", "one") == ["redundant_null_check", "fetch_may_return_many"]
    assert sql("SELECT o_orderkey FROM orders o WHERE o.o_custkey IS NULL") == ["redundant_null_check"]
    loose = Catalog(*[replace(STAR[t], not_null=frozenset()) for t in STAR.tables])
    assert rules(lint_sql("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", loose)) == ["not_in_nullable"]
    assert rules(lint_text("SELECT 'x = NULL' FROM t WHERE a LIKE :p")) == ["like_unescaped_param"]
    assert rules(lint_text("UPDATE t SET a = 1 WHERE b = 2")) == []
    assert "redundant_distinct" in rules(lint_query(demo.DISTINCT, STAR))
    one = Select("orders", "o", (("o.o_orderkey", "k"),), equal=(("o.o_orderkey", 1),), limit=1, where="o.o_custkey IS NOT NULL")
    assert rules(lint_query(one, STAR)) == ["redundant_limit", "redundant_null_check", "fetch_all_single_row"]
    assert "fetch_may_return_many" in rules(lint_query(demo.FK, STAR, "one"))
    assert "prefer_timestamptz" in rules(lint_catalog(STAR))
    assert json.loads(report(lint_text("DELETE FROM t"), "sarif"))["runs"][0]["results"][0]["ruleId"] == "unbounded_write"


@pytest.mark.parametrize("name", list(demo.CASES))
def test_same_query_from_text(spark, name):
    """Each case's text gives a query that the same rules change, with the same rows."""
    by_hand, text = demo.CASES[name]
    parsed = query(text, STAR, spark)
    assert simplify(parsed, STAR)[1] == simplify(by_hand, STAR)[1]
    tables = {t: table(spark, SF, t) for t in STAR.tables}
    got, used = run_sql(spark, text, STAR, tables)
    assert used and sorted(map(tuple, got.collect())) == sorted(map(tuple, spark.sql(text).collect()))


def test_text_outside_the_form_is_left_alone(spark):
    tables = {t: table(spark, SF, t) for t in STAR.tables}
    for text in (
        "SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey",
        "SELECT c_custkey FROM customer WHERE c_custkey + 1 NOT IN (SELECT o_custkey FROM orders)",
        "SELECT o_orderkey FROM orders CROSS JOIN region",
        "WITH q AS (SELECT 1 AS x) SELECT x FROM q",
        "SELECT c_custkey FROM customer WHERE (SELECT count(o_custkey) FROM orders WHERE c_custkey = o_custkey) > 0",
    ):
        with pytest.raises(Unknown):
            query(text, STAR, spark)
        assert run_sql(spark, text, STAR, tables)[1] == []
    # the parent is read by the condition, so its join stays
    read = "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0"
    assert run_sql(spark, read, STAR, tables)[1] == []


def test_never_null_goes_by_identity(spark):
    null = lambda text: [c.nullable for c in describe(spark, text, LOOSE).columns]
    assert null("SELECT nullif(x, 1) AS c, c AS d FROM loose WHERE c IS NOT NULL") == [True, False]
    assert null("SELECT c FROM loose WHERE c IS NOT NULL OR x > 1") == [True]
    assert null("SELECT a.c, b.x FROM loose a JOIN loose b ON a.c = b.x") == [False, False]
    assert null("SELECT a.c, b.x FROM loose a LEFT JOIN loose b ON a.c = b.x") == [True, True]
    assert null("SELECT c FROM (SELECT c FROM loose WHERE c > 3) UNION ALL SELECT c FROM loose") == [True]


LOOSE = Catalog(Table("loose", {"x": "int", "c": "int"}))


def test_index_rules():
    t = Table("t", {"a": "bigserial", "b": "varchar(9)", "c": "bigint"}, keys=[("a",)], foreign=[ForeignKey(("c",), "t", ("a",))], indexes={"i": ("b",), "j": ("b", "a"), "k": ("a",)})
    rules = sorted(f.rule for f in lint_catalog(Catalog(t)))
    assert rules == ["fk_type_mismatch", "fk_without_index", "prefer_identity", "prefer_text", "redundant_index", "redundant_index"]


def test_refuted_scan_reads_nothing(spark):
    tables = {t: table(spark, SF, t) for t in STAR.tables}
    out, used = run_sql(spark, "SELECT p_partkey FROM part p WHERE p.p_size = -4", STAR, tables)
    assert used == ["refuted"] and "LocalTableScan" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 0
    for text in ("SELECT p_partkey FROM part WHERE p_size IS NULL", "SELECT count(*) AS n FROM part WHERE p_size < 0", "SELECT p_partkey FROM part WHERE p_retailprice < 0"):
        assert "refuted" not in run_sql(spark, text, STAR, tables)[1]
