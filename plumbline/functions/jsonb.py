"""JSON values: containment, paths, construction, tables.

Documents are text (or VARIANT).  Patterns and paths that are known when the plan is made are
compiled to expressions over VARIANT, so they run inside the scan; editing a document
member by member has no JVM form and goes through Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ITEMS = "array<variant>"


def parsed(j: Column) -> Column:
    """VARIANT of a document; text that is no JSON is NULL."""
    return F.try_parse_json(j)


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null, of a VARIANT."""
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", "null")
        .when(name.isNotNull(), "number")
    )


def _key(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _key(name), "variant")


def items(v: Column) -> Column:
    """Elements of an array; NULL of anything else."""
    return F.try_variant_get(v, "$", _ITEMS)


def equals(v: Column, value) -> Column:
    """A VARIANT scalar against a Python one, by JSON type: 1 is not "1"."""
    if value is None:
        return F.is_variant_null(v)
    if isinstance(value, bool):
        return (kind(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        return (kind(v) == "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value)))
    return (kind(v) == "string") & (F.try_variant_get(v, "$", "string") == F.lit(value))


def _contains(v: Column, want) -> Column:
    if isinstance(want, dict):
        out = kind(v) == "object"
        for name, value in want.items():
            m = member(v, name)
            out = out & m.isNotNull() & _contains(m, value)
        return out
    if isinstance(want, list):
        out = kind(v) == "array"
        for value in want:
            out = out & F.exists(items(v), _holds(value))
        return out
    return equals(v, want)


def _holds(value) -> Callable[[Column], Column]:
    return lambda e: F.coalesce(_contains(e, value), F.lit(False))


def contains(j: Column, pattern: str) -> Column:
    """``j @> pattern``: nested, by type; at the top an array holds a scalar that is one of its elements."""
    want, v = json.loads(pattern), parsed(j)
    out = F.coalesce(_contains(v, want), F.lit(False))
    if not isinstance(want, (dict, list)):
        out = out | F.coalesce(F.exists(items(v), lambda e: equals(e, want)), F.lit(False))
    return F.when(v.isNotNull(), out)


def _within(a, b) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _within(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_within(x, y) for x in a) for y in b)
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def _load(text: str | None):
    return json.loads(text)


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _rowwise(result: str, f: Callable) -> Callable:
    """An Arrow function over text columns; a NULL argument or bad JSON gives NULL."""
    made = pa.bool_() if result == "boolean" else pa.string()

    @F.arrow_udf(result)
    def run(*columns: pa.Array) -> pa.Array:
        out = []
        for row in zip(*(c.to_pylist() for c in columns)):
            try:
                out.append(None if None in row else f(*row))
            except ValueError:
                out.append(None)
        return pa.array(out, made)

    return run


def contains_column(a: Column, b: Column) -> Column:
    """``a @> b`` where both are columns."""

    def test(x: str, y: str) -> bool:
        p, q = _load(x), _load(y)
        return _within(p, q) or (isinstance(p, list) and not isinstance(q, (dict, list)) and any(_within(e, q) for e in p))

    return _rowwise("boolean", test)(a, b)


def has_key(j: Column, name: str) -> Column:
    """``j ? name``: a member of an object or a string among an array's elements."""
    v = parsed(j)
    return F.when(v.isNotNull(), F.coalesce(member(v, name).isNotNull(), F.lit(False)) | F.coalesce(F.exists(items(v), lambda e: equals(e, name)), F.lit(False)) | F.coalesce(equals(v, name), F.lit(False)))


def has_any(j: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | has_key(j, n)
    return out


def has_all(j: Column, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & has_key(j, n)
    return out


# editing
def _step(node, part: str):
    return int(part) if isinstance(node, list) else part


def _set(doc, path: list[str], value, create: bool, insert_only: bool = False, after: bool = False):
    node = doc
    for part in path[:-1]:
        try:
            node = node[_step(node, part)]
        except (KeyError, IndexError, TypeError):
            return doc
    last = path[-1]
    if isinstance(node, dict):
        if last in node and insert_only:
            raise ValueError("member exists")
        if last in node or create:
            node[last] = value
    elif isinstance(node, list):
        i = int(last)
        inside = -len(node) <= i < len(node)
        if insert_only:
            at = i + (len(node) if i < 0 else 0) + after
            node.insert(max(0, at), value)
        elif inside:
            node[i] = value
        elif create:
            node.insert(0 if i < 0 else len(node), value)
    return doc


def set_path(j: Column, path: list[str], value: Column, create: bool = True) -> Column:
    """``jsonb_set(j, path, value)``: ``value`` is JSON text; other members keep their types."""
    return _rowwise("string", lambda d, v: _dump(_set(_load(d), path, _load(v), create)))(j, value)


def insert_path(j: Column, path: list[str], value: Column, after: bool = False) -> Column:
    """``jsonb_insert``: a member that exists makes it NULL here, where an error would end the query."""
    return _rowwise("string", lambda d, v: _dump(_set(_load(d), path, _load(v), True, True, after)))(j, value)


def delete_path(j: Column, path: list[str]) -> Column:
    """``j #- path``."""

    def cut(d: str) -> str:
        doc = node = _load(d)
        for part in path[:-1]:
            try:
                node = node[_step(node, part)]
            except (KeyError, IndexError, TypeError):
                return _dump(doc)
        try:
            del node[_step(node, path[-1])]
        except (KeyError, IndexError, TypeError):
            pass
        return _dump(doc)

    return _rowwise("string", cut)(j)


def concat(a: Column, b: Column) -> Column:
    """``a || b``: objects merge, the right side's members win; anything else joins as arrays."""

    def both(x: str, y: str) -> str:
        p, q = _load(x), _load(y)
        if isinstance(p, dict) and isinstance(q, dict):
            return _dump(p | q)
        return _dump((p if isinstance(p, list) else [p]) + (q if isinstance(q, list) else [q]))

    return _rowwise("string", both)(a, b)


def strip_nulls(j: Column) -> Column:
    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if v is not None}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return _rowwise("string", lambda d: _dump(strip(_load(d))))(j)


# construction
def scalar(x: Column) -> Column:
    """``JSON_SCALAR`` / ``to_json``: a value as JSON text, NULL as null."""
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def build_object(*pairs: tuple[str, Column], absent_on_null: bool = False) -> Column:
    """``JSON_OBJECT(k: v, ...)``; members of NULL are null, or left out."""
    parts = [F.when(v.isNotNull() | F.lit(not absent_on_null), F.concat(F.lit(json.dumps(k) + ":"), scalar(v))) for k, v in pairs]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}")) if parts else F.lit("{}")


def build_array(*values: Column, absent_on_null: bool = True) -> Column:
    """``JSON_ARRAY(v, ...)``; NULLs are left out unless told otherwise."""
    parts = [F.when(v.isNotNull() | F.lit(not absent_on_null), scalar(v)) for v in values]
    return F.concat(F.lit("["), F.array_join(F.array(*parts), ","), F.lit("]")) if parts else F.lit("[]")


def object_agg(key: Column, value: Column, *order: Column, absent_on_null: bool = False, unique: bool = False) -> Column:
    """``JSON_OBJECTAGG``: repeated keys stay repeated, or raise with ``unique``; a NULL key raises."""
    text = F.when(key.isNull(), F.raise_error(F.lit("a key of a JSON object is null"))).otherwise(F.concat(scalar(key.cast("string")), F.lit(":"), scalar(value)))
    pair = F.when(value.isNotNull() | F.lit(not absent_on_null), text)
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or (key,))], pair.alias("p"))))
    made = F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda r: r["p"]), ","), F.lit("}"))
    if unique:
        made = F.when(F.count(key) == F.count_distinct(key), made).otherwise(F.raise_error(F.lit("a key of a JSON object repeats")))
    return made


def array_agg(value: Column, *order: Column, absent_on_null: bool = True) -> Column:
    """``JSON_ARRAYAGG(value ORDER BY order)``."""
    item = F.when(value.isNotNull() | F.lit(not absent_on_null), scalar(value))
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order or (value,))], item.alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ","), F.lit("]"))


def is_json(j: Column, form: str = "value") -> Column:
    """``j IS JSON [VALUE | OBJECT | ARRAY | SCALAR]``."""
    k = kind(parsed(j))
    of = {"value": k.isNotNull(), "object": k == "object", "array": k == "array", "scalar": ~k.isin("object", "array")}[form]
    return F.when(j.isNotNull(), F.coalesce(of, F.lit(False)))


# paths
_TOKEN = re.compile(r"\s*(==|!=|<>|<=|>=|&&|\|\||\.\.|[()\[\]{}.,?@$!<>*]|\"(?:[^\"\\]|\\.)*\"|-?\d+(?:\.\d+)?|[A-Za-z_]\w*)")


def _opened(v: Column) -> Column:
    """Lax mode: the elements of an array, or the value itself."""
    return F.coalesce(items(v), F.array(v))


def _members(name: str) -> Callable[[Column], Column]:
    return lambda v: F.filter(F.transform(_opened(v), lambda e: member(e, name)), lambda m: m.isNotNull())


def _element(i: int) -> Callable[[Column], Column]:
    return lambda v: F.slice(_opened(v), i + 1, 1)


def _method(name: str) -> Callable[[Column], Column]:
    if name == "type":
        return lambda v: F.parse_json(scalar(kind(v)))
    return lambda v: F.parse_json(scalar(F.coalesce(F.size(items(v)), F.lit(1))))


class _Path:
    """Compiles lax SQL/JSON paths: members, [n], [*], .*, filters with comparisons, && || ! and exists,
    and the methods type() and size()."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip().removeprefix("lax ")
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"path syntax at {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        token = self.peek()
        if token is None or (want is not None and token != want):
            raise ValueError(f"path syntax: {want or 'more'} expected, {token!r} found")
        self.at += 1
        return token

    def steps(self, current: Column) -> Column:
        """Items that the steps from here give, from an array of VARIANT."""
        empty = F.array().cast(_ITEMS)
        each = lambda f: F.flatten(F.transform(current, lambda v: F.coalesce(f(v), empty)))
        while self.peek() in (".", "[", "?"):
            token = self.take()
            if token == ".":
                name = self.take()
                if name == "*":
                    current = each(lambda v: F.map_values(F.try_variant_get(v, "$", "map<string,variant>")))
                elif self.peek() == "(" and name in ("type", "size"):
                    self.take("("), self.take(")")
                    current = F.transform(current, _method(name))
                else:
                    name = json.loads(name) if name.startswith('"') else name
                    current = F.flatten(F.transform(current, _members(name)))
            elif token == "[":
                if self.peek() == "*":
                    self.take()
                    current = each(_opened)
                else:
                    i = int(self.take())
                    current = each(_element(i))
                self.take("]")
            else:
                self.take("(")
                spot = self.at
                current = F.filter(F.flatten(F.transform(current, _opened)), lambda v: F.coalesce(self._filter(spot, v), F.lit(False)))
                self._skip(spot)
                self.take(")")
        return current

    def _skip(self, spot: int) -> None:
        depth, self.at = 0, spot
        while depth or self.peek() != ")":
            depth += {"(": 1, ")": -1}.get(self.take(), 0)

    def _filter(self, spot: int, v: Column) -> Column:
        self.at = spot
        return self.condition(v)

    def condition(self, v: Column) -> Column:
        out = self._and(v)
        while self.peek() == "||":
            self.take()
            out = out | self._and(v)
        return out

    def _and(self, v: Column) -> Column:
        out = self._not(v)
        while self.peek() == "&&":
            self.take()
            out = out & self._not(v)
        return out

    def _not(self, v: Column) -> Column:
        if self.peek() == "!":
            self.take()
            return ~F.coalesce(self._not(v), F.lit(False))
        if self.peek() == "exists":
            self.take(), self.take("(")
            out = F.size(self.operand(v)) > 0
            self.take(")")
            return out
        if self.peek() == "(":
            self.take()
            out = self.condition(v)
            self.take(")")
            return out
        left = self.operand(v)
        op = self.take()
        value = self.constant()
        return F.exists(left, lambda x: F.coalesce(_compare(x, op, value), F.lit(False)))

    def operand(self, v: Column) -> Column:
        if self.take() not in ("@", "$"):
            raise ValueError("path syntax: @ or $ expected")
        return self.steps(F.array(v))

    def constant(self):
        token = self.take()
        if token.startswith('"'):
            return json.loads(token)
        if token in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[token]
        return float(token) if "." in token else int(token)


def _compare(x: Column, op: str, value) -> Column:
    if op in ("==", "!=", "<>"):
        same = equals(x, value)
        return same if op == "==" else ~same & (kind(x) == {str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number"))
    if isinstance(value, (bool, type(None))):
        raise ValueError("an order comparison takes numbers or strings")
    text = isinstance(value, str)
    left = F.when(kind(x) == ("string" if text else "number"), F.try_variant_get(x, "$", "string" if text else "double"))
    right = F.lit(value if text else float(value))
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def path_items(j: Column, path: str) -> Column:
    """``jsonb_path_query_array``: an array of VARIANT."""
    compiler = _Path(path)
    compiler.take("$")
    start = parsed(j)
    out = compiler.steps(F.array(start))
    if compiler.peek() is not None:
        raise ValueError(f"path syntax at {compiler.peek()!r}")
    return F.when(start.isNotNull(), out)


def path_exists(j: Column, path: str) -> Column:
    """``j @? path``."""
    return F.size(path_items(j, path)) > 0


def path_match(j: Column, predicate: str) -> Column:
    """``j @@ predicate``: a comparison over ``$``."""
    compiler = _Path(predicate)
    v = parsed(j)
    out = compiler.condition(v)
    if compiler.peek() is not None:
        raise ValueError(f"path syntax at {compiler.peek()!r}")
    return F.when(v.isNotNull(), F.coalesce(out, F.lit(False)))


def path_first(j: Column, path: str) -> Column:
    """``jsonb_path_query_first``, as JSON text."""
    return F.to_json(F.get(path_items(j, path), F.lit(0)))


def query_text(j: Column, path: str, wrapper: bool = False) -> Column:
    """``JSON_QUERY(j, path [WITH WRAPPER])``: JSON text; several items without a wrapper give NULL."""
    found = path_items(j, path)
    all_of = F.concat(F.lit("["), F.array_join(F.transform(found, lambda v: F.to_json(v)), ","), F.lit("]"))
    if wrapper:
        return F.when(F.size(found) > 0, all_of)
    return F.when(F.size(found) == 1, F.to_json(F.get(found, F.lit(0))))


# tables
@dataclass(frozen=True)
class Col:
    """``name type PATH path DEFAULT on_empty ON EMPTY``; a value that does not fit is NULL, or raises."""

    name: str
    type: str = "string"
    path: str | None = None
    on_empty: object = None
    error_on_error: bool = False


@dataclass(frozen=True)
class Ordinality:
    name: str


@dataclass(frozen=True)
class Exists:
    name: str
    path: str


@dataclass(frozen=True)
class Nested:
    path: str
    columns: tuple = field(default_factory=tuple)


def _items_of(v: Column, path: str) -> Column:
    compiler = _Path(path)
    compiler.take("$")
    return compiler.steps(F.array(v))


def json_table(df: DataFrame, doc: Column, path: str, columns: list) -> DataFrame:
    """``JSON_TABLE(doc, path COLUMNS (...))`` beside the rows of ``df``; documents without items give no rows.

    NESTED PATH joins its rows to its parent's (outer); siblings are joined as a union, each with NULLs for the other.
    """
    start = df.select("*", parsed(doc).alias("_v0"))
    rows = start.select("*", F.posexplode(_items_of(F.col("_v0"), path)).alias("_p", "_v")).drop("_v0")
    return _expand(rows, df.columns, columns).select(*df.columns, *_names(columns))


def _names(columns) -> list[str]:
    return [n for c in columns for n in (_names(c.columns) if isinstance(c, Nested) else [c.name])]


def _expand(rows: DataFrame, keep: list[str], columns) -> DataFrame:
    own = []
    for c in columns:
        if isinstance(c, Ordinality):
            own.append((F.col("_p") + 1).alias(c.name))
        elif isinstance(c, Exists):
            own.append((F.size(_items_of(F.col("_v"), c.path)) > 0).alias(c.name))
        elif isinstance(c, Col):
            found = F.get(_items_of(F.col("_v"), c.path or f'$."{c.name}"'), F.lit(0))
            value = F.variant_get(found, "$", c.type) if c.error_on_error else F.try_variant_get(found, "$", c.type)
            own.append(value.alias(c.name) if c.on_empty is None else F.when(found.isNull(), F.lit(c.on_empty).cast(c.type)).otherwise(value).alias(c.name))
    nested = [c for c in columns if isinstance(c, Nested)]
    base = rows.select(*keep, *own, "_v")
    if not nested:
        return base.drop("_v")
    held = [*keep, *[c.name for c in columns if not isinstance(c, Nested)]]
    out = None
    for i, n in enumerate(nested):
        below = base.withColumn("_items", _items_of(F.col("_v"), n.path))
        # A parent without items of any sibling stays as one row, by the first of them.
        opened = below.select(*held, (F.posexplode_outer if i == 0 else F.posexplode)("_items").alias("_p", "_v"))
        if i == 0 and len(nested) > 1:
            others = F.lit(0)
            for m in nested[1:]:
                others = others + F.size(_items_of(F.col("_w"), m.path))
            opened = below.withColumn("_w", F.col("_v")).select(*held, others.alias("_n"), F.posexplode_outer("_items").alias("_p", "_v")).where(F.col("_p").isNotNull() | (F.col("_n") == 0)).drop("_n")
        part = _expand(opened, held, n.columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
