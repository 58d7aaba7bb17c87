import json
import random

import pytest
from pyspark.sql import functions as F

from heliograph.functions import patterns, timestamps
from heliograph.functions.cdxj import field_text, format_line, sort_key, split_line, surt_of_line
from heliograph.functions.surt import surt_parts, url_to_surt
from heliograph.functions.cdxj import payload_is_object
from heliograph.operators.search import FieldRule, first_per_capture, match_key, search, sort_captures

LINES = [
    'com,a)/ 20200101000000 {"status":"200","mime":"text/html"}',
    'com,a)/ 20200101000000 {"status":"404"}',
    'com,a)/x 20210101000000 {"status":200,"ok":true}',
    'com,a,www)/ 20190101000000 {"status":null}',
    "com,ab)/ 20200601000000",
    'com,a)/x 20220101000000 {"status":',
    "rubbish",
]


def values(df):
    return [r.value for r in df.collect()]


@pytest.mark.parametrize("text,want", [("2020", "20200101000000"), ("202012", "20201201000000"), ("20201225", "20201225000000"), ("20201", "20201101000000"), ("202012250102031", "20201225010203")])
def test_normalize(spark, text, want):
    assert timestamps.normalize(text) == want
    assert spark.range(1).select(timestamps.normalized(F.lit(text))).first()[0] == want


@pytest.mark.parametrize("text", ["2020-01", "", "x", " 2020"])
def test_normalize_refuses(text):
    with pytest.raises(ValueError):
        timestamps.normalize(text)


@pytest.mark.parametrize(
    "key,kind,want",
    [("a)/p", "exact", ("a)/p", False)), ("a)/p", "prefix", ("a)/p", True)), ("a)/p", "domain", ("a)", True)), ("a)/p", "subdomains", ("a,", True)), ("a", "domain", ("a", True)), ("a", "other", ("a", False))],
)
def test_match_types(key, kind, want):
    assert match_key(key, kind) == want


@pytest.mark.parametrize("key", ["", "x" * 10_001, "a\0b"])
def test_key_guard(key):
    with pytest.raises(ValueError):
        match_key(key)


@pytest.mark.parametrize("expression,want", [("a=b", ("a", "=", "b")), (" a != b ", ("a", "!=", "b")), ("a~b=c", ("a", "~", "b=c")), ("a!~b", ("a", "!~", "b")), ("a=b!=c", ("a=b", "!=", "c"))])
def test_rules(expression, want):
    rule = FieldRule.parse(expression)
    assert (rule.field, rule.op, rule.value) == want


@pytest.mark.parametrize("expression", ["a", "x" * 2001, "a=\0", "a~(b+)+", "a~(b*)+", "a~(b+)*", "a~(a|b)*", "a~(a|b)+", "a~(", "a~" + "b" * 1001])
def test_rules_refused(expression):
    with pytest.raises(ValueError):
        FieldRule.parse(expression)


def test_search(captures):
    df = captures(LINES)
    assert values(search(df, "com,a)/")) == LINES[:2]
    assert values(search(df, "com,a", "prefix", limit=3)) == LINES[:3]
    assert len(values(search(df, "com,a", "prefix", limit=0))) == 6
    assert values(search(df, "com,a)/", "domain", sort=True)) == LINES[:3] + LINES[5:6]
    assert values(search(df, "com,a)/", "subdomains")) == LINES[3:4]
    assert values(search(df, "com,a", "prefix", from_ts="2020", to_ts="2021", sort=True)) == LINES[:3]
    assert values(search(df, "com,a)/", dedupe=True)) == LINES[:1]


@pytest.mark.parametrize(
    "rules,want",
    [(["status=200"], [0, 2]), (["status!=200"], [1]), (["status~^4"], [1]), (["status!~^4"], [0, 2]), (["ok=True"], [2]), (["ok=true"], []), (["status=200", "mime~html"], [0]), (["none=1"], []), (["none!=1"], [])],
)
def test_field_rules(captures, rules, want):
    assert values(search(captures(LINES), "com,", "prefix", filters=rules)) == [LINES[i] for i in want]


def test_second_line_and_one_line_file(captures):
    df = captures(["a)/ 2020", "b)/ 2020"])
    assert values(search(df, "b)/")) == ["b)/ 2020"]
    assert values(search(captures(["z)/ 2020"]), "b)/")) == []


def test_dedupe_and_sort_against_brute_force(captures):
    rng = random.Random(1)
    lines = [f"k{rng.randrange(5)} {rng.randrange(4)} {{\"n\":{i}}}" for i in range(200)] + ["one", "one", ""]
    df = captures(lines)
    first = {}
    for x in lines[:200]:
        first.setdefault(tuple(x.split(" ")[:2]), x)
    assert sorted(values(first_per_capture(df))) == sorted([*first.values(), "one", "one", ""])
    assert values(sort_captures(df))[3:] == sorted(lines[:200], key=lambda x: (x.split(" ")[:2], lines.index(x)))


def test_lines(spark):
    df = spark.createDataFrame([("a b {\"x\": 1}",), ("a b",), ("a b  ",), ("abc\t",), ("",), ("a ",)], "value string")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in split_line(F.col("value")).items()), surt_of_line(F.col("value")), sort_key(F.col("value"))).collect()]
    assert got == [("a", "b", '{"x": 1}', "a", "a b"), ("a", "b", None, "a", "a b"), ("a", "b", None, "a", "a b"), (None, None, None, "abc", "abc"), (None, None, None, "", ""), ("a", "", None, "a", "a")]
    made = spark.createDataFrame([("{}",), ("{ }",), (None,), ('{"a":1}',)], "j string").select(format_line(F.lit("s"), F.lit("t"), F.col("j")))
    assert [r[0] for r in made.collect()] == ["s t", "s t", "s t", 's t {"a":1}']


def test_field_text(spark):
    payload = json.dumps({"a.b": "dot", "it's": 1, "f": 1.50, "t": True, "s": "true", "n": None, "o": {"t": False}})
    df = spark.createDataFrame([(payload,)], "json string")
    got = df.select(*(field_text(F.col("json"), n).alias(f"c{i}") for i, n in enumerate(["a.b", "it's", "f", "t", "s", "n", "gone"]))).first()
    assert tuple(got) == ("dot", "1", "1.5", "True", "true", None, None)


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://www.Example.com/A/b?z=1&a=2#f", "com,example)/a/b?a=2&z=1"), ("https://example.com:443/", "com,example)/"), ("http://example.com:8080/x/", "com,example:8080)/x"),
        ("http://user:pw@www2.a.org", "org,a)/"), ("http://1.2.3.4/x", "1.2.3.4)/x"), ("example.com/x?", "com,example)/x"), ("https://example.com:80/", "com,example:80)/"),
        ("http://a.com/x;jsessionid=0a1b?sid=1&b=2", "com,a)/x?b=2"), ("http://example.com./", "com,example)/"), ("", None), (None, None), ("http://www.com/", "com)/"),
    ],
)
def test_surt(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(url_to_surt(F.col("u"))).first()[0] == want


def test_surt_keeps_www_if_asked(spark):
    assert spark.range(1).select(url_to_surt(F.lit("http://www.a.com/"), strip_www=False)).first()[0] == "com,a,www)/"


def test_surt_parts(spark):
    df = spark.createDataFrame([("com,a,b,c:80)/x",), ("com",), (None,)], "s string")
    assert [tuple(r) for r in df.select(*surt_parts(F.col("s")).values()).collect()] == [("com", "a", "c.b"), ("com", None, None), (None, None, None)]


def test_patterns(spark):
    assert patterns.balanced(r"^pt,a)/x(b)\)[)]") == r"^pt,a\)/x(b)\)[)]"
    assert patterns.balanced("a[]x])") == r"a[]x]\)"
    assert patterns.literal("^com,a\\)/") == (True, "com,a)/")
    assert patterns.literal("a.b") is None and patterns.literal("a\\.b") == (False, "a.b") and patterns.literal("\\d") is None
    df = spark.createDataFrame([("x٣y",), ("ab ab",)], "v string")
    assert df.where(F.col("v").rlike(patterns.to_jvm(r"x\dy"))).count() == 1
    assert df.where(F.col("v").rlike(patterns.to_jvm(r"(?P<w_x>ab) (?P=w_x)\Z"))).count() == 1
    assert df.where(F.col("v").rlike(patterns.to_jvm("[[:alpha:]]b"))).count() == 1


def test_pushdown(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("b", "2")], "surt string, ts string").write.parquet(str(tmp_path / "t"))
    plan = search(spark.read.parquet(str(tmp_path / "t")), "a", "prefix")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(surt,a)" in plan


def test_payloads_that_are_exactly_one_object(spark):
    good = ['{"a":1}', ' {"a":[1,2]} ', '{"a":1,"a":2}', "{}", '{"a":"]}"}', '{"a":{"b":[]}}']
    bad = ['{"a":1},', '{"a":1}}', '{"a":1}]', '{"a":1}]}', '{"a":1} x', '{"a":1},{"b":2}', '{"a":1},"b":2', "{'a':1}", '{"a":NaN}', "[1]", "", None, '{"a":1']
    rows = [(x, True) for x in good] + [(x, False) for x in bad]
    df = spark.createDataFrame(rows, "j string, want boolean")
    assert df.where(payload_is_object(F.col("j")) != F.col("want")).select("j").collect() == []
