"""Insert, update, delete and merge as functions from a table to its next image.

A table is immutable here: a statement returns the new rows, ``RETURNING`` projects
from the joined image, and storing the image is a write.  Joins are on declared keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.base import query, table


class DuplicateKeyError(ValueError):
    """A statement would touch one row twice."""


@dataclass
class Image:
    """The joined old and new rows: columns ``old`` and ``new`` (structs, null where absent), ``action``."""

    rows: DataFrame

    def table(self) -> DataFrame:
        return self.rows.where("new IS NOT NULL").select("new.*")

    def returning(self, *cols: Column | str) -> DataFrame:
        return self.rows.where("action <> 'keep'").select(*cols)


@dataclass(frozen=True)
class Identity:
    """GENERATED ALWAYS or BY DEFAULT AS IDENTITY; numbers are unique from ``start`` on, with gaps between tasks."""

    column: str
    start: int
    always: bool = True


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None, identity: Identity | None = None, overriding: str | None = None) -> Image:
    """Missing columns take their default or NULL, an identity column its next number.

    Values for a column generated always are an error unless ``overriding`` is ``system``;
    with ``user`` they are ignored.
    """
    given = rows
    if identity:
        if identity.column in given.columns and identity.always and overriding is None:
            raise ValueError(f"{identity.column} is generated always")
        if identity.column not in given.columns or overriding == "user":
            given = given.withColumn(identity.column, F.lit(identity.start) + F.monotonically_increasing_id())
    for c, kind in target.dtypes:
        if c not in given.columns:
            given = given.withColumn(c, (defaults or {}).get(c, F.lit(None)).cast(kind))
    kind = target.schema.simpleString()
    old = target.select(F.struct("*").alias("old")).select("old", F.col("old").alias("new"), F.lit("keep").alias("action"))
    fresh = given.select(F.struct(*[F.col(c).cast(t).alias(c) for c, t in target.dtypes]).alias("new"))
    return Image(old.unionByName(fresh.select(F.lit(None).cast(kind).alias("old"), "new", F.lit("insert").alias("action"))))


def merge(
    target: DataFrame,
    source: DataFrame,
    on: list[str],
    matched: list[tuple[Column | None, dict[str, Column] | None]] = (),
    not_matched: list[tuple[Column | None, dict[str, Column]]] = (),
    not_matched_by_source: list[tuple[Column | None, dict[str, Column] | None]] = (),
    check: bool = True,
) -> Image:
    """MERGE; the first arm whose condition holds acts.  Arms for target rows without a source row
    take one full outer join; without them the target is joined from its side, so a source
    that the planner finds small is broadcast and the target is not shuffled.

    Expressions read ``t.col`` and ``s.col``.  An arm is (condition, assignments); assignments of None
    delete.  A target row matched twice is an error, found by an aggregate over keys.
    """
    if check and not source.groupBy(*on).count().where(F.col("count") > 1).isEmpty():
        raise DuplicateKeyError(f"source rows repeat {on}")
    t = target.select(F.struct("*").alias("t"), *[F.col(c).alias(f"_t_{c}") for c in on])
    s = source.select(F.struct("*").alias("s"), *[F.col(c).alias(f"_s_{c}") for c in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.col(f"_t_{c}") == F.col(f"_s_{c}"))
    if not_matched_by_source:
        both = t.join(s, cond, "full").select("t", "s")
    else:
        met = t.join(s, cond, "left_semi").select(*[F.col(f"_t_{c}") for c in on]).distinct()
        fresh = s.join(met, cond, "left_anti").select(F.lit(None).cast(target.schema.simpleString()).alias("t"), "s")
        both = t.join(s, cond, "left").select("t", "s").unionByName(fresh)
    kinds = dict(target.dtypes)
    row_type = target.schema.simpleString()

    def image(values: dict[str, Column] | None, base: bool) -> Column:
        if values is None:
            return F.lit(None).cast(row_type)
        return F.struct(*[values.get(c, F.col(f"t.{c}") if base else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    def arms(items, base: bool, verb: str, otherwise: Column) -> tuple[Column, Column]:
        new, action = otherwise, F.lit("keep")
        for when, values in reversed(list(items)):
            test = F.lit(True) if when is None else when
            new = F.when(test, image(values, base)).otherwise(new)
            action = F.when(test, F.lit("delete" if values is None else verb)).otherwise(action)
        return new, action

    keep = F.col("t")
    m, ma = arms(matched, True, "update", keep)
    n, na = arms(not_matched, False, "insert", F.lit(None).cast(row_type))
    b, ba = arms(not_matched_by_source, True, "update", keep)
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    new = F.when(has_t & has_s, m).when(has_s, n).otherwise(b)
    action = F.when(has_t & has_s, ma).when(has_s, na).otherwise(ba)
    return Image(both.select(F.col("t").alias("old"), new.alias("new"), action.alias("action")).where("old IS NOT NULL OR new IS NOT NULL"))


def upsert(target: DataFrame, source: DataFrame, on: list[str], update: dict[str, Column] | None, index_where: str | None = None) -> Image:
    """INSERT ... ON CONFLICT (on) [WHERE index_where] DO UPDATE / DO NOTHING.

    ``index_where``: the predicate of a partial unique index; rows outside it never conflict.
    """
    values = {c: F.col(f"s.{c}") for c in source.columns}
    arms = [(None, update)] if update is not None else [], [(None, values)]
    if index_where is None:
        return merge(target, source, on, *arms)
    inside = F.coalesce(F.expr(index_where), F.lit(False))
    met = merge(target.where(inside), source.where(inside), on, *arms)
    apart = insert(target.where(~inside), source.where(~inside))
    return Image(met.rows.unionByName(apart.rows))


def update(target: DataFrame, assign: dict[str, Column], where: Column | None = None) -> DataFrame:
    test = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return target.select(*[F.when(test, assign[c]).otherwise(F.col(c)).cast(k).alias(c) if c in assign else F.col(c) for c, k in target.dtypes])


def update_from(target: DataFrame, source: DataFrame, on: list[str], assign: dict[str, Column]) -> Image:
    return merge(target, source, on, [(None, assign)])


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    return target.join(source.select(*on).distinct(), on, "left_anti")


def violations(df: DataFrame, not_null: list[str] = (), checks: dict[str, Column] | None = None, key: list[str] | None = None) -> DataFrame:
    """Rows that a constraint refuses: column ``reason`` and the row; empty when the write may go on."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in not_null]
    reasons += [F.when(~c, F.lit(f"check {n}")) for n, c in (checks or {}).items()]
    out = df.withColumn("reason", F.concat_ws("; ", *reasons)).where("reason <> ''")
    if key:
        twice = df.groupBy(*key).count().where("count > 1").select(*key)
        out = out.unionByName(df.join(twice, key, "left_semi").withColumn("reason", F.lit(f"key {', '.join(key)} repeats")))
    return out


def _news(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey < 3").selectExpr("n_nationkey * 20 AS n_nationkey", "concat('NEW', n_nationkey) AS n_name", "0 AS n_regionkey")


_N = "(SELECT n_nationkey * 20 AS k, 'NEW' || n_nationkey AS name FROM nation WHERE n_nationkey < 3)"


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 99, 'ATLANTIS'")
def d1_insert(spark, sf_dir):
    rows = spark.range(1).selectExpr("99 AS n_nationkey", "'ATLANTIS' AS n_name")
    return insert(table(spark, sf_dir, "nation"), rows).table().select("n_nationkey", "n_name")


@query(f"SELECT coalesce(n_nationkey, k) AS n_nationkey, CASE WHEN k IS NULL THEN n_name ELSE name END AS n_name FROM nation FULL JOIN {_N} s ON n_nationkey = k")
def d2_upsert_update(spark, sf_dir):
    return upsert(table(spark, sf_dir, "nation"), _news(spark, sf_dir), ["n_nationkey"], {"n_name": F.col("s.n_name")}).table().select("n_nationkey", "n_name")


@query(f"SELECT coalesce(n_nationkey, k) AS n_nationkey, coalesce(n_name, name) AS n_name FROM nation FULL JOIN {_N} s ON n_nationkey = k")
def d2_upsert_nothing(spark, sf_dir):
    return upsert(table(spark, sf_dir, "nation"), _news(spark, sf_dir), ["n_nationkey"], None).table().select("n_nationkey", "n_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def d3_update(spark, sf_dir):
    return update(table(spark, sf_dir, "customer"), {"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, coalesce(t, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def d3_update_from(spark, sf_dir):
    src = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("t"))
    return update_from(table(spark, sf_dir, "customer"), src, ["c_custkey"], {"c_acctbal": F.col("s.t")}).table().select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def d4_delete_using(spark, sf_dir):
    return delete_using(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query(f"SELECT coalesce(n_nationkey, k) AS n_nationkey, CASE WHEN n_nationkey IS NULL THEN name WHEN k IS NULL THEN lower(n_name) ELSE n_name || '*' END AS n_name FROM nation FULL JOIN {_N} s ON n_nationkey = k WHERE NOT (k IS NULL AND n_nationkey IS NOT NULL AND n_regionkey = 4)")
def d5_merge(spark, sf_dir):
    image = merge(
        table(spark, sf_dir, "nation"),
        _news(spark, sf_dir),
        ["n_nationkey"],
        matched=[(None, {"n_name": F.concat(F.col("t.n_name"), F.lit("*"))})],
        not_matched=[(None, {"n_nationkey": F.col("s.n_nationkey"), "n_name": F.col("s.n_name")})],
        not_matched_by_source=[(F.col("t.n_regionkey") == 4, None), (None, {"n_name": F.lower("t.n_name")})],
    )
    return image.table().select("n_nationkey", "n_name")


@query(f"SELECT CASE WHEN n_nationkey IS NULL THEN 'insert' ELSE 'update' END AS action, n_name AS before, name AS after FROM {_N} s LEFT JOIN nation ON n_nationkey = k")
def d6_returning(spark, sf_dir):
    image = upsert(table(spark, sf_dir, "nation"), _news(spark, sf_dir), ["n_nationkey"], {"n_name": F.col("s.n_name")})
    return image.returning("action", F.col("old.n_name").alias("before"), F.col("new.n_name").alias("after"))


@query("SELECT n_nationkey, 'check odd' AS reason FROM nation WHERE n_nationkey % 2 <> 1")
def d10_constraint_validation(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return violations(n, ["n_name"], {"odd": F.col("n_nationkey") % 2 == 1}, ["n_nationkey"]).select("n_nationkey", "reason")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, 'AGAIN', 4 FROM nation WHERE n_regionkey = 1")
def d2_partial_index(spark, sf_dir):
    """ON CONFLICT (key) WHERE region < 3: the new rows, of region 4, are outside the index and conflict with nothing."""
    nation = table(spark, sf_dir, "nation")
    new = nation.where("n_regionkey = 1").selectExpr("n_nationkey", "'AGAIN' AS n_name", "4 AS n_regionkey")
    return upsert(nation, new, ["n_nationkey"], {"n_name": F.lit("never")}, "n_regionkey < 3").table()


@query("SELECT count(*) + 5 AS n, count(*) + 5 AS keys, sum(n_nationkey) + 0 AS old FROM nation")
def d1_insert_identity(spark, sf_dir):
    """GENERATED ALWAYS AS IDENTITY (START 1000), given values ignored by OVERRIDING USER VALUE."""
    nation = table(spark, sf_dir, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("long"))
    new = nation.where("n_regionkey = 1")
    out = insert(nation, new, identity=Identity("n_nationkey", 1000), overriding="user").table()
    return out.agg(F.count("*").alias("n"), F.count_distinct("n_nationkey").alias("keys"), F.sum(F.when(F.col("n_nationkey") < 1000, F.col("n_nationkey"))).alias("old"))
