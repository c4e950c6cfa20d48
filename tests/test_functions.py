"""Scalar semantics on NULLs, empties and edges."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import jsonb as J
from plumbline.functions import pg, text
from plumbline.operators.moreops import range_agg


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_row_comparison(spark):
    one, two, null = F.lit(1), F.lit(2), F.lit(None).cast("int")
    assert value(spark, pg.row_less([one, null], [two, one])) is True
    assert value(spark, pg.row_less([one, null], [one, two])) is None
    assert value(spark, pg.row_less([one, two], [one, two])) is False
    assert value(spark, pg.row_less([one, two], [one, two], or_equal=True)) is True
    assert value(spark, pg.row_equal([one, null], [two, one])) is False
    assert value(spark, pg.row_equal([one, null], [one, one])) is None


def test_text(spark):
    assert value(spark, pg.substring(F.lit("abc"), -1, 2)) == ""
    assert value(spark, pg.substring(F.lit("abc"), 0, 2)) == "a"
    assert value(spark, pg.substring(F.lit("abc"), 2)) == "bc"
    assert value(spark, pg.concat_any(F.lit("a"), F.lit(None), F.lit(3))) == "a3"
    assert value(spark, pg.quote_literal(F.lit("o'x\\"))) == "E'o''x\\\\'"
    assert value(spark, pg.quote_ident(F.lit('A"b'))) == '"A""b"'
    assert value(spark, pg.quote_nullable(F.lit(None).cast("string"))) == "NULL"
    assert value(spark, pg.string_to_array(F.lit(""), ",")) == []
    assert value(spark, pg.string_to_array(F.lit("a.b."), ".")) == ["a", "b", ""]
    assert value(spark, pg.similar_to(F.lit("a.c"), "a.c")) is True
    assert value(spark, pg.similar_to(F.lit("abc"), "a.c")) is False
    assert value(spark, pg.similar_to(F.lit("a%"), "a\\%")) is True
    assert round(value(spark, pg.similarity(F.lit("word"), F.lit("two words"))), 6) == round(4 / 11, 6)
    assert value(spark, pg.to_char(F.lit(dt.datetime(2024, 3, 5, 17, 8)), "DD.MM.YYYY HH24:MI")) == "05.03.2024 17:08"


def test_numbers(spark):
    assert value(spark, pg.int_div(F.lit(-7), F.lit(2))) == -3
    assert value(spark, pg.to_int(F.lit(2.5))) == 3 and value(spark, pg.to_int(F.lit(-2.5))) == -3
    assert value(spark, pg.gcd(F.lit(-48), F.lit(18))) == 6 and value(spark, pg.gcd(F.lit(0), F.lit(5))) == 5
    assert value(spark, pg.lcm(F.lit(4), F.lit(6))) == 12
    assert value(spark, pg.trunc_num(F.lit(-1.29), 1)) == -1.2
    assert value(spark, pg.round_half_even(F.lit(2.5))) == 2
    assert value(spark, pg.num_nonnulls(F.lit(None), F.lit(1), F.lit(2))) == 2


def test_dates(spark):
    ts = F.lit(dt.datetime(2020, 5, 3, 10, 7)).cast("timestamp_ntz")  # a Sunday
    assert value(spark, pg.dow(ts)) == 0 and value(spark, pg.isodow(ts)) == 7
    lit = lambda s: F.lit(s).cast("timestamp")
    point = value(spark, pg.overlaps(lit("2020-01-01"), lit("2020-01-01"), lit("2020-01-01"), lit("2020-01-02")))
    apart = value(spark, pg.overlaps(lit("2020-01-01"), lit("2020-01-02"), lit("2020-01-02"), lit("2020-01-03")))
    assert point is True and apart is False
    age = lambda a, b: tuple(value(spark, text.age(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))))
    assert age("2020-03-31", "2020-01-31") == (0, 2, 0, 0.0) and age("2001-04-10", "1957-06-13") == (43, 9, 28, 0.0)
    assert age("2020-01-31", "2020-03-31 12:00:00") == (0, -2, 0, -43200.0)


def test_arrays(spark):
    a = F.array(F.lit(1), F.lit(None).cast("int"), F.lit(3))
    assert value(spark, pg.subscript(a, 0)) is None and value(spark, pg.subscript(a, 4)) is None and value(spark, pg.subscript(a, 3)) == 3
    assert value(spark, pg.array_length(F.array().cast("array<int>"))) is None
    assert value(spark, pg.array_position(a, 9)) is None
    assert value(spark, pg.array_remove(a, F.lit(None).cast("int"))) == [1, 3]
    assert value(spark, pg.array_replace(a, F.lit(3), F.lit(4))) == [1, None, 4]
    assert value(spark, pg.any_of(a, lambda x: x == 9)) is None
    assert value(spark, pg.all_of(a, lambda x: x > 0)) is None
    assert value(spark, pg.generate_series(F.lit(3), F.lit(1))) == []
    assert value(spark, pg.generate_series(F.lit(3), F.lit(1), -1)) == [3, 2, 1]


def test_ranges(spark):
    r = lambda a, b, k="[)": pg.make_range(F.lit(a), F.lit(b), k)
    assert value(spark, pg.range_contains(r(1, 5), F.lit(5))) is False
    assert value(spark, pg.range_contains(r(1, 5, "[]"), F.lit(5))) is True
    assert value(spark, pg.range_overlaps(r(1, 5), r(5, 9))) is False
    assert value(spark, pg.range_overlaps(r(1, 5, "[]"), r(5, 9))) is True
    assert value(spark, r(3, 3))["empty"] is True
    both = value(spark, pg.range_intersect(r(1, 5), r(3, 9)))
    assert (both["lower"], both["upper"], both["empty"]) == (3, 5, False)
    rows = spark.createDataFrame([("a", 5, 8), ("a", 1, 3), ("a", 2, 4), ("a", 2, 4), ("a", 9, 9), ("b", 1, 2), ("b", 2, 3)], "k string, lo int, hi int")
    assert sorted(map(tuple, range_agg(rows, ["k"], "lo", "hi").collect())) == [("a", 1, 4), ("a", 5, 8), ("b", 1, 3)]


def test_json(spark):
    j = F.lit('{"a": 1, "b": "x"}')
    assert value(spark, pg.json_typeof(F.lit("[1]"))) == "array" and value(spark, pg.json_typeof(F.lit("1.5"))) == "number"
    assert value(spark, pg.is_json(F.lit("{"))) is False and value(spark, pg.is_json(F.lit(None).cast("string"))) is None
    assert value(spark, J.contains(j, '{"b": "x"}')) is True and value(spark, J.contains(j, '{"a": "1"}')) is False
    deep = F.lit('{"a": {"b": [1, {"c": null}]}, "n": "1"}')
    for want, is_in in (('{"a": {"b": [{"c": null}]}}', True), ('{"a": {"b": [2]}}', False), ('{"a": {"b": 1}}', False), ("{}", True), ('{"n": 1}', False)):
        assert value(spark, J.contains(deep, want)) is is_in is value(spark, J.contains_column(deep, F.lit(want))), want
    assert value(spark, J.contains(F.lit("[1, 2]"), "1")) is True and value(spark, J.contains(F.lit("[1, [2]]"), "[2]")) is False
    assert value(spark, J.contains(F.lit("{bad"), "1")) is None and value(spark, J.contains(F.lit(None).cast("string"), "1")) is None


def test_json_editing(spark):
    doc = F.lit('{"a": {"b": [1, 2]}, "n": 1.50, "t": true}')
    assert value(spark, J.set_path(doc, ["a", "b", "-1"], F.lit('{"x": null}'))) == '{"a":{"b":[1,{"x":null}]},"n":1.5,"t":true}'
    assert value(spark, J.set_path(doc, ["z"], F.lit("3"), create=False)) == '{"a":{"b":[1,2]},"n":1.5,"t":true}'
    assert value(spark, J.set_path(doc, ["n", "q"], F.lit("3"))) == '{"a":{"b":[1,2]},"n":1.5,"t":true}'
    assert value(spark, J.insert_path(doc, ["a", "b", "0"], F.lit("9"))) == '{"a":{"b":[9,1,2]},"n":1.5,"t":true}'
    assert value(spark, J.delete_path(doc, ["a", "b", "7"])) == '{"a":{"b":[1,2]},"n":1.5,"t":true}'
    assert value(spark, J.concat(F.lit("[1]"), F.lit('"x"'))) == '[1,"x"]' and value(spark, J.strip_nulls(F.lit('{"a":null,"b":[null]}'))) == '{"b":[null]}'


def test_json_paths(spark):
    doc = F.lit('{"a": [{"x": 1, "y": "p"}, {"x": 5}], "b": {"k": 2}}')
    got = lambda p: value(spark, F.transform(J.path_items(doc, p), lambda v: F.to_json(v)))
    assert got("$.a.x") == ["1", "5"] and got("$.a[1].x") == ["5"] and got("$.b.*") == ["2"] and got("$.nope") == []
    assert got('$.a[*] ? (@.x > 2 || @.y == "p").x') == ["1", "5"] and got("$.a[*] ? (!(@.x > 2)).x") == ["1"]
    assert got("$.a ? (exists(@.y)).x") == ["1"] and got("$.a.size()") == ["2"] and got("$.b.type()") == ['"object"']
    assert value(spark, J.path_match(doc, "$.b.k == 2 && $.a.x > 4")) is True
    for wrong in ("$.", "$.a[", "$.a ? (@.x > )", "$ x", "$.a ? (@.x > true)"):
        with pytest.raises(ValueError):
            J.path_items(doc, wrong)


def test_json_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ('q"', 3)], "k string, v int")
    one = lambda c: df.agg(c.alias("x")).first()["x"]
    assert one(J.object_agg(F.col("k"), F.col("v"), F.col("v"))) == '{"a":null,"a":1,"q\\"":3}'
    assert one(J.object_agg(F.col("k"), F.col("v"), F.col("v"), absent_on_null=True)) == '{"a":1,"q\\"":3}'
    with pytest.raises(Exception, match="repeats"):
        one(J.object_agg(F.col("k"), F.col("v"), unique=True))
    assert one(J.array_agg(F.col("v"))) == "[1,3]" and df.where("v > 9").agg(J.array_agg(F.col("v")).alias("x")).first()["x"] == "[]"


def test_formats(spark):
    n = F.lit("it's")
    assert value(spark, text.format_text("%s-%2$L-%%-%1$s", n, n)) == "it's-'it''s'-%-it's"
    assert value(spark, text.format_text("[%5s|%-3s|%I]", F.lit("x"), F.lit("y"), F.lit("A b"))) == '[    x|y  |"A b"]'
    with pytest.raises(ValueError):
        text.format_text("%s %s", n)
    with pytest.raises(ValueError):
        text.format_text("%d", n)
    assert value(spark, text.like(F.lit("a%b\nc"), "a!%b_c", "!")) is True and value(spark, text.like(F.lit("axb"), "a!%b", "!")) is False
    assert value(spark, text.regexp_match(F.lit("foobar"), "o(b)(a)")) == ["b", "a"] and value(spark, text.regexp_match(F.lit("x"), "y")) is None
    assert value(spark, text.concat_ws(F.lit(","), F.lit(None), F.lit("a"), F.lit(""))) == "a," and value(spark, text.concat_ws(F.lit(None).cast("string"), F.lit("a"))) is None
    assert value(spark, text.initcap(F.lit("hELLO-wORLD it's"))) == "Hello-World It'S"
    assert value(spark, text.xml_forest(a=F.lit("<&>"), b=F.lit(None))) == "<a>&lt;&amp;&gt;</a>"
    assert [value(spark, text.width_bucket(F.lit(x), 0, 10, 5)) for x in (-1.0, 0.0, 9.9, 10.0)] == [0, 1, 5, 6]
    assert value(spark, text.assign(F.array(F.lit(1)), 3, F.lit(9))) == [1, None, 9]


def test_text_queries(spark):
    doc = F.lit("The quick brown fox, the lazy dog")
    for q, want in (("quick & dog", True), ("quick & cat", False), ("cat | fox", True), ("!cat & fox", True), ("brown <-> fox", True), ("quick <-> fox", False), ("quick <2> fox", True), ("la:*", True), ("!(cat | fox)", False)):
        assert value(spark, text.text_matches(doc, q)) is want, q
    assert value(spark, text.text_matches(F.lit(None).cast("string"), "a")) is False
    for wrong in ("a &", "(a", "a b", ""):
        with pytest.raises(ValueError):
            text.text_matches(doc, wrong)


def test_text_queries_against_word_lists(spark):
    some, draw = ["of", "the", "ofx", "xof", "tion", "ti", "été", "ß", "a1", "𝔸b"], random.Random(5)
    texts = ["", None, "of_the", "of\n-- the", "THE of", *("".join(draw.choice(some) + draw.choice([" ", "-", "_", ", ", "\u0301", "\n"]) for _ in range(draw.randrange(12))) for _ in range(1000))]
    queries = {"of <-> the": ["of", "the"], "of <2> the": ["of", "", "the"], "ti:* <-> a1 <3> t:*": ["ti*", "a1", "", "", "t*"], "𝔸b <-> ß": ["𝔸b", "ß"], "of:* <-> x:*": ["of*", "x*"], "t:*": ["t*"]}
    fits = lambda w, e: w.startswith(e[:-1]) if e.endswith("*") else e in ("", w)

    def found(t, run):
        words = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
        return any(all(fits(w, e) for w, e in zip(words[i:], run)) for i in range(len(words) - len(run) + 1))

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(*[text.text_matches(F.col("t"), q).alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    want = [tuple(found(t, run) for run in queries.values()) for t in texts]
    assert [tuple(r) for r in got] == want and all(0 < sum(c) < len(texts) for c in zip(*want, strict=True))
    for q, ok in (("'of' <0> o:*", True), ("of <0> the", False), ("of_the", False), ("of_:*", False), ("'of the'", False), ("!of_the & of", True)):
        assert value(spark, text.text_matches(F.lit("of_the"), q)) is ok, q


def test_text_query_reads_a_long_text_once(spark):
    long = spark.createDataFrame([("of x the y " * 12_500,)], "t string")
    began = time.time()
    got = long.select(*[text.text_matches(F.col("t"), q).alias(n) for n, q in (("a", "of <-> the"), ("b", "of <2> the"), ("c", "of <9> y"), ("d", "z:*"))]).first()
    assert tuple(got) == (False, True, False, False)
    assert time.time() - began < 20


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert value(spark, pg.cosine_distance(a, b)) == 1.0
    assert value(spark, pg.l1_distance(a, b)) == 3.0
    assert value(spark, pg.l2_normalize(b)) == [0.0, 1.0]
    assert value(spark, pg.binary_quantize(a)) == "10"
