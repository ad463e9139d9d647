"""Rules that differ from Spark's own, on fixed cases."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import collections, datetime, geometry, maths, network, ranges, strings, text_search
from lattica.operators import predicates, sorts_sets
from lattica.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(autouse=True)
def shipped(spark):
    spark.sparkContext.environment["PYTHONPATH"] = __file__.rsplit("/", 2)[0]


@pytest.mark.parametrize("start,length,want", [(2, 3, "bcd"), (0, 3, "ab"), (-1, 3, "a"), (-5, 3, ""), (7, 2, ""), (1, 0, ""), (3, None, "cdef")])
def test_substring(spark, start, length, want):
    assert one(spark, strings.substring(F.lit("abcdef"), start, length)) == want


def test_replace_first_and_all(spark):
    s = F.lit("a1b2")
    assert one(spark, strings.regexp_replace(s, "[0-9]", "<>")) == "a<>b2"
    assert one(spark, strings.regexp_replace(s, "([a-z])([0-9])", "\\2\\1", "g")) == "1a2b"
    assert one(spark, strings.regexp_replace(F.lit("A$"), "a", "$", "i")) == "$$"


def test_quotes_and_format(spark):
    assert one(spark, strings.format_text("%s %I %L %%", F.lit(None).cast("string"), F.lit('My"T'), F.lit("it's"))) == " \"My\"\"T\" 'it''s' %"
    assert one(spark, strings.quote_nullable(F.lit(None).cast("string"))) == "NULL"


@pytest.mark.parametrize("pattern,text,want", [("a%", "abc", True), ("a_", "abc", False), ("(a|b)+", "abab", True), ("a.c", "abc", False), ("[ab]{2}c", "abc", True), ("a\\%", "a%", True)])
def test_similar_to(spark, pattern, text, want):
    assert one(spark, F.lit(text).rlike(predicates.similar_to_regex(pattern))) is want


def test_rounding(spark):
    assert [one(spark, maths.float_to_int(F.lit(x))) for x in (0.5, 1.5, 2.5, -0.5, -1.5)] == [0, 2, 2, 0, -2]
    assert [one(spark, maths.int_div(F.lit(a), F.lit(b))) for a, b in ((7, 2), (-7, 2), (7, -2))] == [3, -3, -3]
    with pytest.raises(Exception, match="square root"):
        one(spark, maths.sqrt(F.lit(-1.0)))
    assert one(spark, maths.sind(F.lit(30.0))) == 0.5 and one(spark, maths.tand(F.lit(45.0))) == 1.0


def test_intervals(spark):
    i = one(spark, datetime.justify_hours(datetime.interval(0, 1, -3_600_000_000)))
    assert (i.days, i.us) == (0, 23 * 3_600_000_000)
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    a = one(spark, datetime.age(ts("2001-04-10 00:00:00"), ts("1957-06-13 00:00:00")))
    assert (a.months, a.days) == (43 * 12 + 9, 28)
    assert str(one(spark, datetime.add(ts("2020-01-31 00:00:00"), datetime.interval(1, 1, 0)))) == "2020-03-01 00:00:00"
    assert one(spark, datetime.extract("century", ts("2000-12-31 00:00:00"))) == 20
    assert one(spark, datetime.extract("century", ts("2001-01-01 00:00:00"))) == 21
    assert one(spark, datetime.overlaps(ts("2001-01-01"), ts("2001-01-01"), ts("2001-01-01"), ts("2001-02-01"))) is True


def test_ranges(spark):
    r = lambda a, b, k="[)": ranges.make(F.lit(a), F.lit(b), k, discrete=True)
    text = lambda c: one(spark, ranges.to_text(c))
    assert text(r(1, 4, "(]")) == "[2,5)" and text(r(3, 3)) == "empty" and text(r(3, 3, "[]")) == "[3,4)"
    assert text(ranges.union(r(1, 3), r(3, 6))) == "[1,6)" and text(ranges.difference(r(1, 9), r(5, 20))) == "[1,5)"
    assert text(ranges.difference(r(1, 9), r(0, 5))) == "[5,9)" and text(ranges.difference(r(1, 9), r(0, 20))) == "empty"
    with pytest.raises(Exception, match="contiguous"):
        text(ranges.union(r(1, 3), r(4, 6)))
    with pytest.raises(Exception, match="contiguous"):
        text(ranges.difference(r(1, 9), r(3, 4)))
    n = ranges.make(F.lit(1.1), F.lit(None).cast("double"))
    assert one(spark, ranges.upper_inf(n)) and one(spark, ranges.has(n, F.lit(1e9))) and not one(spark, ranges.has(n, F.lit(1.0)))


JSON = {"a": [1, 2, {"b": "xyz"}], "c": {"d": 5, "e": None}}


@pytest.mark.parametrize(
    "path,want",
    [
        ("$.a[*]", [1, 2, {"b": "xyz"}]), ("$.a[1 to last]", [2, {"b": "xyz"}]), ("$.c.*", [5, None]), ("$.a.b", ["xyz"]), ("$.a.size()", [3]),
        ("$.a[*] ? (@ >= 2)", [2]), ('$.a[*].b ? (@ starts with "xy")', ["xyz"]), ('$.** ? (@ like_regex "y")', ["xyz"]), ("$.c.d * 2 + 1", [11]),
        ("$.c ? (exists(@.d) && !(@.d == 4)).d", [5]), ("$.c.type()", ["object"]), ("-$.c.d", [-5]), ("$.c.d == 5", [True]), ("$.missing", []),
    ],
)
def test_jsonpath(path, want):
    assert collections.JsonPath(path).find(JSON) == want


def test_json_containment(spark):
    has = lambda a, b: one(spark, collections.json_contains(F.lit(json.dumps(a)), F.lit(json.dumps(b))))
    assert has(JSON, {"c": {"d": 5}}) and has([1, [2]], [[2]]) and has(["x"], "x") and not has({"a": 1}, {"a": 2}) and not has([1], {"a": 1})


def test_text_search(spark):
    v = text_search.to_tsvector(F.lit("The fat cats sat on a mat and ate fat rats"))
    hit = lambda q: one(spark, text_search.matches(v, q))
    q = text_search.Query
    assert hit(q.parse("fat & rat")) and hit(q.parse("fat <-> cat")) and not hit(q.parse("cat <-> fat")) and hit(q.parse("ca:*"))
    assert hit(q.parse("fat <5> ate")) is False and hit(q.web('"fat cats" -dog')) and not hit(q.web("dog or -cat"))
    assert hit(q.parse("dog").rewrite("dog", q.parse("cat | wolf"))) and hit(~q.parse("dog") & q.plain("the mat"))
    assert one(spark, text_search.headline(F.lit("A cat sat"), q.parse("cat"))) == "A <b>cat</b> sat"


def test_network(spark):
    assert one(spark, network.merged(F.lit("192.168.1.5/24"), F.lit("192.168.2.5/24"))) == "192.168.0.0/22"
    assert one(spark, network.inside(F.lit("10.1.2.3"), F.lit("10.0.0.0/8"))) is True
    assert one(spark, network.lca(F.lit("1.2.3"), F.lit("1.2.3.4.5"))) == "1.2"
    hit = lambda p, q: one(spark, network.matches_lquery(F.lit(p), q))
    assert hit("a.b.c.d", "a.*.d") and hit("a.b.c", "a.*{1}.c") and not hit("a.b.x.c", "a.*{1}.c") and hit("a.b", "a.!c") and not hit("a.c", "a.!c")


def test_geometry(spark):
    p = lambda x, y: geometry.point(F.lit(x), F.lit(y))
    assert one(spark, geometry.distance(p(0, 0), p(3, 4))) == 5
    assert one(spark, geometry.segment_distance(p(0, 0), p(10, 0), p(5, 2))) == 2
    assert one(spark, geometry.circle_distance(geometry.circle(p(0, 0), F.lit(1)), geometry.circle(p(5, 0), F.lit(1)))) == 3


def test_recursion_stops_at_cycles(spark):
    df = spark.createDataFrame([(2, 1), (3, 2), (1, 3)], "k int, p int")
    with pytest.raises(Exception, match="infinite recursion"):
        sorts_sets.connect_by(df, "k", "p", 1).collect()
    base = spark.createDataFrame([(1,)], "k int")
    step = lambda r: r.join(df, r.k == df.p).select(df.k)
    assert sorted(r.k for r in sorts_sets.recursive_union(base, step).collect()) == [1, 2, 3]


def test_copy_round_trip(spark):
    rows = [(1, "a"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "i int, s string")
    for form in ("text", "csv"):
        path = io.fresh_path(spark)
        io.copy_to(df, path, form)
        got = sorted(map(tuple, io.copy_from(spark, path, "i int, s string", form).collect()))
        assert got[:2] == rows[:2]
    assert io.upsert(df, df.where("i = 2").withColumn("s", F.lit("z")), ["i"]).where("i = 2").first().s == "z"
    assert io.upsert(df, df.withColumn("s", F.lit("z")), ["i"], "nothing").where("s = 'z'").count() == 0
