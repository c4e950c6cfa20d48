"""Column helpers for scalar semantics that Spark SQL lacks or evaluates differently.

All are built from JVM-side expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

col = lambda c: F.col(c) if isinstance(c, str) else c


# predicates
def between_symmetric(x: Column, a: Column, b: Column) -> Column:
    return x.between(F.least(a, b), F.greatest(a, b))


def any_of(array: Column, test) -> Column:
    """``x op ANY (array)``: NULL when undecided."""
    return F.exists(array, test)


def all_of(array: Column, test) -> Column:
    """``x op ALL (array)``: NULL when undecided."""
    return F.forall(array, test)


def row_equal(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & (a == b)
    return out


def row_less(left: list[Column], right: list[Column], or_equal: bool = False) -> Column:
    """Lexicographic row comparison; a NULL that is reached makes it NULL."""
    out = F.lit(or_equal)
    for a, b in reversed(list(zip(left, right))):
        out = F.when(a == b, out).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(a < b)
    return out


def num_nulls(*xs: Column) -> Column:
    return sum((x.isNull().cast("int") for x in xs), F.lit(0))


def num_nonnulls(*xs: Column) -> Column:
    return sum((x.isNotNull().cast("int") for x in xs), F.lit(0))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Period overlap; ends may come in either order, and a point overlaps a period that holds it."""
    a, b, c, d = F.least(s1, e1), F.greatest(s1, e1), F.least(s2, e2), F.greatest(s2, e2)
    return ((a < d) & (c < b)) | (a == c) | ((a == b) & (a >= c) & (a < d)) | ((c == d) & (c >= a) & (c < b))


def similar_to(x: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL regular expression, anchored at both ends."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out.append("\\" + pattern[i])
        elif c == "%":
            out.append("[\\s\\S]*")
        elif c == "_":
            out.append("[\\s\\S]")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return x.rlike("^(?:" + "".join(out) + ")$")


def ieq(a: Column, b: Column) -> Column:
    """Case-insensitive text equality."""
    return F.lower(a) == F.lower(b)


# numbers
def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; division by zero raises."""
    return _div(a, b)


def _div(a: Column, b: Column) -> Column:
    q = a.cast("decimal(38,0)") / b.cast("decimal(38,0)")
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def to_int(x: Column) -> Column:
    """Numeric to integer: rounds half away from zero, where a cast would truncate."""
    return F.round(x, 0).cast("int")


def round_half_even(x: Column, n: int = 0) -> Column:
    return F.bround(x, n)


def trunc_num(x: Column, n: int = 0) -> Column:
    scale = F.lit(float(10**n))
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def gcd(a: Column, b: Column) -> Column:
    """Euclid in a bounded fold: 92 steps reduce any pair of 64-bit numbers."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(_div(a, g) * b))


# text
def concat_any(*xs: Column) -> Column:
    """Concatenation that reads NULL as empty."""
    return F.concat_ws("", *[x.cast("string") for x in xs])


def substring(x: Column, start: int, n: int | None = None) -> Column:
    """Positions count from 1 and may start before the text; only the part inside it is returned."""
    begin = max(start, 1)
    if n is None:
        return F.substring(x, begin, 2147483647)
    end = start + n
    return F.substring(x, begin, max(0, end - begin))


def array_to_string(a: Column, sep: str, null: str | None = None) -> Column:
    return F.array_join(a, sep) if null is None else F.array_join(a, sep, null)


def string_to_array(x: Column, sep: str) -> Column:
    import re

    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, re.escape(sep), -1))


def quote_literal(x: Column) -> Column:
    body = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.concat(F.when(F.contains(x, F.lit("\\")), F.lit("E'")).otherwise(F.lit("'")), body, F.lit("'"))


def quote_nullable(x: Column) -> Column:
    return F.coalesce(quote_literal(x), F.lit("NULL"))


def quote_ident(x: Column) -> Column:
    return F.when(x.rlike("^[a-z_][a-z0-9_]*$"), x).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))


def trigrams(x: Column) -> Column:
    """Distinct trigrams of each lower-cased word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(x), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    ta, tb = trigrams(a), trigrams(b)
    shared, both = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    return F.when(both == 0, F.lit(0.0)).otherwise(shared / both)


_FORMATS = [("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("Mon", "MMM"), ("Month", "MMMM"), ("Dy", "EEE"), ("Q", "q")]


def to_char(ts: Column, fmt: str) -> Column:
    """Timestamps by template: YYYY MM DD HH24 HH12 MI SS MS Mon Dy Q; other characters stand as they are."""
    out, i = "", 0
    while i < len(fmt):
        for a, b in sorted(_FORMATS, key=lambda p: -len(p[0])):
            if fmt.startswith(a, i):
                out, i = out + b, i + len(a)
                break
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return F.date_format(ts, out)


# dates
def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def dow(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def isodow(ts: Column) -> Column:
    return F.pmod(F.dayofweek(ts) + 5, F.lit(7)) + 1


def date_bin(seconds: int, ts: Column, origin: str = "2000-01-01") -> Column:
    base = F.unix_seconds(F.lit(origin).cast("timestamp"))
    bins = F.floor((F.unix_micros(ts.cast("timestamp")) / 1e6 - base) / seconds)
    return F.timestamp_seconds(bins * seconds + base)


def at_time_zone(ts: Column, zone: str) -> Column:
    """A zone-less timestamp read in ``zone``, as UTC."""
    return F.to_utc_timestamp(ts, zone)


# arrays
def subscript(a: Column, i: Column | int) -> Column:
    """1-based; NULL out of bounds, and for an index below one."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when(i >= 1, F.try_element_at(a, F.greatest(i, F.lit(1)).cast("int")))


def array_slice(a: Column, low: int, high: int) -> Column:
    low = max(low, 1)
    return F.slice(a, low, max(0, high - low + 1))


def array_length(a: Column) -> Column:
    """NULL for an empty array."""
    return F.nullif(F.size(a), F.lit(0))


def array_position(a: Column, x) -> Column:
    """NULL when absent."""
    return F.nullif(F.array_position(a, x), F.lit(0))


def array_remove(a: Column, x: Column) -> Column:
    """Removes NULLs too when ``x`` is NULL."""
    return F.filter(a, lambda y: ~y.eqNullSafe(x))


def array_replace(a: Column, x: Column, y: Column) -> Column:
    return F.transform(a, lambda e: F.when(e.eqNullSafe(x), y).otherwise(e))


def array_contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def generate_series(low: Column, high: Column, step: int = 1) -> Column:
    """Empty when the range is; explode it for rows."""
    kind = "array<long>"
    go = low <= high if step > 0 else low >= high
    return F.when(go, F.sequence(low.cast("long"), high.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast(kind))


def rows_from(*arrays: Column) -> Column:
    """Arrays side by side, the shorter padded with NULL; inline it for rows."""
    return F.arrays_zip(*arrays)


# ranges: struct(lower, upper, lower_inc, upper_inc, empty)
def make_range(low: Column, high: Column, bounds: str = "[)") -> Column:
    li, ui = bounds[0] == "[", bounds[1] == "]"
    empty = F.coalesce((low > high) | ((low == high) & F.lit(not (li and ui))), F.lit(False))
    return F.struct(low.alias("lower"), high.alias("upper"), F.lit(li).alias("lower_inc"), F.lit(ui).alias("upper_inc"), empty.alias("empty"))


def range_contains(r: Column, x: Column) -> Column:
    low = r["lower"].isNull() | (x > r["lower"]) | (r["lower_inc"] & (x == r["lower"]))
    high = r["upper"].isNull() | (x < r["upper"]) | (r["upper_inc"] & (x == r["upper"]))
    return ~r["empty"] & low & high


def range_overlaps(a: Column, b: Column) -> Column:
    below = lambda p, q: q["lower"].isNull() | p["upper"].isNull() | (q["lower"] < p["upper"]) | ((q["lower"] == p["upper"]) & q["lower_inc"] & p["upper_inc"])
    return ~a["empty"] & ~b["empty"] & below(a, b) & below(b, a)


def range_intersect(a: Column, b: Column) -> Column:
    low = F.greatest(a["lower"], b["lower"])
    high = F.least(a["upper"], b["upper"])
    inc = lambda v, side: F.coalesce((a[side] != v) | a[f"{side}_inc"], F.lit(True)) & F.coalesce((b[side] != v) | b[f"{side}_inc"], F.lit(True))
    return F.struct(low.alias("lower"), high.alias("upper"), inc(low, "lower").alias("lower_inc"), inc(high, "upper").alias("upper_inc"), (~range_overlaps(a, b)).alias("empty"))


# JSON held as text
def json_get(j: Column, *path: str | int) -> Column:
    return F.get_json_object(j, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def json_has_key(j: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(j), key)


def json_keys(j: Column) -> Column:
    return F.json_object_keys(j)


def json_typeof(j: Column) -> Column:
    kind = F.schema_of_variant(F.try_parse_json(j))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.isNotNull(), "number")
    )


def is_json(j: Column) -> Column:
    return F.when(j.isNotNull(), F.try_parse_json(j).isNotNull())


# full text
def lexemes(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(x), "[^\\p{L}\\p{N}]+"), lambda w: w != "")))


def matches_all(x: Column, *words: str) -> Column:
    """``to_tsvector(x) @@ plainto_tsquery(words)`` without stemming."""
    lex = lexemes(x)
    out = F.lit(True)
    for w in words:
        out = out & F.array_contains(lex, w.lower())
    return out


def text_rank(x: Column, *words: str) -> Column:
    """Share of the words of ``x`` that are query words."""
    all_words = F.filter(F.split(F.lower(x), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    hit = F.size(F.filter(all_words, lambda w: w.isin([q.lower() for q in words])))
    return F.when(F.size(all_words) > 0, hit / F.size(all_words)).otherwise(F.lit(0.0))


# vectors
def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1_distance(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def vector_norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - inner_product(a, b) / (vector_norm(a) * vector_norm(b))


def l2_normalize(a: Column) -> Column:
    n = vector_norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def subvector(a: Column, start: int, n: int) -> Column:
    return F.slice(a, start, n)


def binary_quantize(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


# enums
def enum_order(x: Column, labels: list[str]) -> Column:
    """Position of a label in its declared order, for comparing and sorting."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), x), F.lit(0))
