"""Registered queries of the rewrites, as written and simplified."""

from __future__ import annotations

from plumbline.operators.base import ORACLES, QUERIES, table
from plumbline.plans.catalog import STAR
from plumbline.plans.fromsql import run_sql
from plumbline.plans.ir import CountTest, Join, NotIn, Select, Sub, Union

NOT_IN = Select("customer", "c", (("c.c_custkey", "k"),), tests=(NotIn("c.c_custkey", Sub("orders", "o", "o_custkey", "o.o_totalprice > 100000")),))
COUNT_SOME = Select("customer", "c", (("c.c_custkey", "k"),), tests=(CountTest(Sub("orders", "o", where="o.o_orderstatus = 'F'", outer=(("c.c_custkey", "o_custkey"),)), True),))
COUNT_NONE = Select("customer", "c", (("c.c_custkey", "k"),), tests=(CountTest(Sub("orders", "o", where="o.o_orderstatus = 'F'", outer=(("c.c_custkey", "o_custkey"),)), False),))
DISTINCT = Select("orders", "o", (("o.o_orderkey", "k"), ("c.c_name", "name")), (Join("customer", "c", (("o.o_custkey", "c_custkey"),)),), distinct=True)
UNION = Union((Select("customer", "c", (("c.c_custkey", "k"), ("'customer'", "kind"))), Select("supplier", "s", (("s.s_suppkey", "k"), ("'supplier'", "kind")))))
FK = Select("orders", "o", (("o.o_orderkey", "k"),), (Join("customer", "c", (("o.o_custkey", "c_custkey"),)), Join("nation", "n", (("c.c_nationkey", "n_nationkey"),))), where="o.o_totalprice > 200000")

CASES = {
    "not_in": (NOT_IN, "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "count_exists": (COUNT_SOME, "SELECT c_custkey AS k FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') > 0"),
    "count_not_exists": (COUNT_NONE, "SELECT c_custkey AS k FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') = 0"),
    "distinct": (DISTINCT, "SELECT DISTINCT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "union_all": (UNION, "SELECT c_custkey AS k, 'customer' AS kind FROM customer UNION SELECT s_suppkey, 'supplier' FROM supplier"),
    "fk_join": (FK, "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000"),
}


def _add(name: str, text: str, rewrite: bool) -> None:
    """The statement as Spark runs it, or what the rules make of its text; a rule has to apply."""

    def go(spark, sf_dir):
        out, used = run_sql(spark, text, STAR, {t: table(spark, sf_dir, t) for t in STAR.tables}, rewrite)
        if rewrite and not used:
            raise AssertionError(f"no rule applies to {name}")
        return out

    QUERIES[name], ORACLES[name] = go, text


for _name, (_, _sql) in CASES.items():
    _add(f"n_{_name}_rewritten", _sql, True)
    _add(f"n_{_name}_as_written", _sql, False)


_REFUTED = "SELECT p_partkey AS k, p_size AS n FROM part WHERE p_size < 0 OR (p_size BETWEEN -9 AND 0 AND p_brand <> 'x')"
_OPEN = "SELECT p_partkey AS k, p_size AS n FROM part WHERE p_size < 3 OR (p_size > 45 AND p_size < 0)"


def _refuted(spark, sf_dir):
    """A condition that a CHECK refutes reads nothing; one that it leaves open is run."""
    tables = {"part": table(spark, sf_dir, "part")}
    (none, proved), (some, kept) = (run_sql(spark, text, STAR, tables) for text in (_REFUTED, _OPEN))
    if proved != ["refuted"] or kept:
        raise AssertionError("one of the conditions is refuted, the other is not")
    return none.unionAll(some)


QUERIES["n5_refuted_by_check"], ORACLES["n5_refuted_by_check"] = _refuted, f"{_REFUTED} UNION ALL {_OPEN}"
