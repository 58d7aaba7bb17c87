import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heliograph.functions.cdxj import with_parts
from heliograph.operators import blocklist, excess, merge, pathindex, payload, reports
from heliograph.operators.blocklist import Blocklist, apply_blocklist
from heliograph.operators.payload import _spliced, add_fields, parse_line, write_line


def lines_of(df):
    return [r.value for r in df.collect()]


# ------------------------------------------------ excess


def test_excess_boundary(captures):
    df = captures(["a 1"] * 10 + ["b 1"] * 11 + ["", "  ", "c"])
    assert [tuple(r) for r in excess.excessive_find(df, 10).collect()] == [("b", 11)]
    assert Counter(r.surt for r in excess.excessive_auto(df, 10).collect()) == {"a": 10, None: 2, "": 1}
    assert excess.excessive_auto(df, 0).count() == 3


def test_excess_realistic(captures, monkeypatch):
    df = captures(["hot 1"] * 2000 + [f"u{i} 1" for i in range(300)] + ["mid 1"] * 350)
    assert [tuple(r) for r in excess.by_count(excess.excessive_find(df)).collect()] == [("hot", 2000)]
    assert excess.excessive_auto(df).count() == 650
    monkeypatch.setattr(excess, "BROADCAST_KEYS", 0)
    assert excess.excessive_auto(df).count() == 650


def test_excess_remove_with_nulls_and_extra_columns(spark, captures):
    keys = spark.createDataFrame([("a", 5), (None, 1), ("a", 5)], "surt string, count int")
    assert lines_of(excess.excessive_remove(captures(["a 1", "b 1", "x"]), keys)) == ["b 1", "x"]


def test_sweep(captures):
    df = captures(["a 1"] * 5 + ["b 1"] * 3 + ["c 1"])
    assert sorted(map(tuple, excess.threshold_sweep(df, [0, 2, 4, 9, 2]).collect())) == [(0, 3, 9), (2, 2, 8), (4, 1, 5), (9, 0, 0)]


# ------------------------------------------------ merge


def test_merge(spark):
    rng = random.Random(1)
    files = [sorted(f"k{rng.randrange(40)} é" for _ in range(30)) for _ in range(20)]
    frames = [spark.createDataFrame([(x,) for x in f], "value string") for f in files]
    assert lines_of(merge.merge_sorted(*frames)) == sorted(x for f in files for x in f)
    assert lines_of(merge.merge_distinct(*frames)) == sorted({x for f in files for x in f})
    with pytest.raises(ValueError):
        merge.merge_sorted()


def test_order_violations(spark):
    rng = random.Random(2)
    rows, want = [], []
    for f in "ab":
        lines = [rng.choice("pqrst") * rng.randrange(3) for _ in range(60)]
        rows += [(f, i, x) for i, x in enumerate(lines)]
        want += [(a, b) for a, b in zip(lines, lines[1:]) if a > b]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "f string, i int, value string")
    assert sorted(map(tuple, merge.order_violations(df, ["f", "i"]).collect())) == sorted(want)
    assert merge.order_violations(df.limit(0), ["f", "i"]).count() == 0


def test_same_rows(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "v string")
    b = spark.createDataFrame([("x",), ("z",)], "v string")
    assert sorted(map(tuple, merge.same_rows(a, b).collect())) == [("x", "left"), ("y", "left"), ("z", "right")]
    assert merge.same_rows(a, a).count() == 0


# ------------------------------------------------ blocklist


LINES = ['com,ok)/ 1 {"status": "200"}', "com,bad)/ 1", "com,ok)/ads/x 1", 'com,ok)/ 1 {"status": "404"}', "com,x.swf 1", "com,xyswf 1"]


def test_blocklist(captures):
    patterns = ["# comment", "", "   ", "^com,bad)", "/ads/", '"status": "404"', r"\.swf ", "(broken"]
    made = Blocklist.of(patterns)
    assert len(made) == 4 and made.rejected == ["(broken"]
    df = captures(LINES)
    assert lines_of(apply_blocklist(df, made)) == [LINES[0], LINES[5]]
    assert tuple(blocklist.blocklist_report(df, made).first()) == (6, 2, 4)
    assert tuple(blocklist.blocklist_report(df.limit(0), made).first()) == (0, 0, 0)


def test_no_patterns(captures):
    assert apply_blocklist(captures(LINES), Blocklist.of(["#"])).count() == len(LINES)


def test_case_and_classes(captures):
    df = captures(["A1 b", "a1 b"])
    assert lines_of(apply_blocklist(df, Blocklist.of(["^A[[:digit:]]"]))) == ["a1 b"]
    assert lines_of(apply_blocklist(df, Blocklist.of([r"(?i)^a\d"]))) == []


@pytest.mark.parametrize("count", [50, 600])
def test_many_patterns_against_brute_force(spark, count):
    rng = random.Random(count)
    word = lambda n: "".join(rng.choice("abc)/") for _ in range(n))
    literals = [word(4) for _ in range(count)]
    prefixes = [word(3) for _ in range(20)]
    texts = [word(rng.randrange(3, 14)) for _ in range(400)]
    made = Blocklist.of([x.replace(")", r"\)") for x in literals] + ["^" + p for p in prefixes])
    df = spark.createDataFrame([(t, 1) for t in texts] + [(None, 1)], "value string, hg int")
    want = [t for t in texts if not any(x in t for x in literals) and not any(t.startswith(p) for p in prefixes)]
    assert lines_of(apply_blocklist(df, made)) == [*want, None]


# ------------------------------------------------ payload fields


def test_add_fields(captures):
    lines = ['a 1 {"x": 1, "c": "old", "f": 1.50, "é": null}', "a 1", "", "one", 'a 1 {"x":', "a 1 [1]", "a 1  "]
    got = payload.add_fields(captures(lines).drop("added"), {"c": "new", "d": "2"}).collect()
    assert [r.value for r in got] == ['a 1 {"x":1,"c":"new","f":1.5,"é":null,"d":"2"}', 'a 1 {"c":"new","d":"2"}', "", "one", 'a 1 {"x":', "a 1 [1]", 'a 1 {"c":"new","d":"2"}']
    assert [r.added for r in got] == [True, True, False, False, False, False, True]


def test_add_by_function(captures, tmp_path):
    (tmp_path / "f.py").write_text("def addfield(surt, timestamp, payload):\n    if surt == 'b':\n        raise ValueError('no')\n    payload['y'] = timestamp[:4]\n    return {} if surt == 'c' else payload\n")
    function = payload.load_function(str(tmp_path / "f.py"))
    got = payload.add_fields(captures(["a 2020 {}", "b 2020 {}", 'c 2020 {"q":1}']), function=function)
    assert [tuple(r)[0::8] for r in got.select("value", *"surt ts json src_path src_block src_pos".split(), F.lit(0), "added").collect()] == [('a 2020 {"y":"2020"}', True), ("b 2020 {}", False), ("c 2020", True)]
    (tmp_path / "g.py").write_text("x = 1\n")
    with pytest.raises(AttributeError):
        payload.load_function(str(tmp_path / "g.py"))
    with pytest.raises(OSError):
        payload.load_function(str(tmp_path / "none.py"))


@pytest.mark.parametrize("arguments", [{}, {"fields": {"a": "b"}, "function": lambda a, b, c: c}])
def test_either_or(captures, arguments):
    with pytest.raises(ValueError):
        payload.add_fields(captures(["a"]), **arguments)


def test_assignments():
    assert payload.parse_assignments(["a=b=c", "a=2", "x="]) == {"a": "2", "x": ""}
    with pytest.raises(ValueError):
        payload.parse_assignments(["a"])


TYPES = {"s": 'q"é', "i": 5, "f": 1.5, "t": True, "n": None, "l": [1, 2], "d": {"a": 1}}


@pytest.mark.parametrize(
    "field,as_json,raw",
    [("s", '"q\\"é"', 'q"é'), ("i", "5", "5"), ("f", "1.5", "1.5"), ("t", "true", "true"), ("n", "null", "null"), ("l", "[1, 2]", "[1, 2]"), ("d", '{"a": 1}', "{'a': 1}"), ("x", "dflt", "dflt")],
)
def test_extract(captures, field, as_json, raw):
    df = captures(["a 1 " + json.dumps(TYPES), "a 1", "", "bad", "a 1 {"])
    for mode, want in ((False, as_json), (True, raw)):
        got = [(r.extracted, r.outcome) for r in payload.extract_field(df, field, mode, "dflt").collect()]
        assert got == [(want, "missing" if field == "x" else "found"), ("dflt", "missing"), (None, "blank"), (None, "error"), (None, "error")]


def test_field_column(captures):
    df = captures(["a 1 " + json.dumps(TYPES), "a 1"])
    got = [tuple(r) for r in df.select(*(payload.field_column(F.col("json"), f, "?").alias(f) for f in ("s", "n", "x")), payload.field_column(F.col("json"), "i")).collect()]
    assert got == [('q"é', "null", "?", "5"), ("?", "?", "?", None)]


# ------------------------------------------------ path indexes


def test_arclist(spark):
    rows = [("http://h/d/a.warc.gz",), ("  /m/b.arc ",), ("c",), ("# x",), ("",), ("d/",), (None,)]
    got = [tuple(r) for r in pathindex.arclist_to_path_index(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [("a.warc.gz", "http://h/d/a.warc.gz"), ("b.arc", "/m/b.arc"), ("c", "c"), ("", "d/")]
    assert lines_of(pathindex.path_index_lines(spark.createDataFrame(got, "filename string, path string"), " ")) == ["a.warc.gz http://h/d/a.warc.gz", "b.arc /m/b.arc", "c c", " d/"]


def test_upsert_and_resolve(spark, captures):
    index = spark.createDataFrame([("f", "one", "i", 0, 1), ("f", "two", "i", 0, 2), ("", "x", "i", 0, 3), ("g", None, "i", 0, 4)], "filename string, path string, src_path string, src_block long, src_pos long")
    assert sorted(map(tuple, pathindex.upsert(index).collect())) == [("f", "two"), ("g", None)]
    df = captures(['a 1 {"filename":"f"}', 'b 1 {"filename":"z"}', "c 1"]).withColumn("path", F.lit("mine"))
    assert [(r.surt, r.path) for r in pathindex.resolve(df, index).orderBy("surt").collect()] == [("a", "two"), ("b", None), ("c", None)]


# ------------------------------------------------ reports


def test_reports(captures):
    df = captures(['com,a)/ 20200101000000 {"status":"200","length":"5"}', 'com,a)/ 20200101000000 {"status":"301","length":"n"}', 'com,b)/ 20210201000000 {"status":null,"url":"u","length":"70"}', "x"])
    assert [tuple(r) for r in reports.captures_per_domain(df, 2).collect()] == [("com,a", 2), ("com,b", 1)]
    assert [tuple(r) for r in reports.field_histogram(df, "status").collect()] == [(None, 2), ("200", 1), ("301", 1)]
    assert [tuple(r) for r in reports.missing_fields(df, ["status", "url"]).collect()] == [("status", 3, 1), ("url", 1, 3)]
    assert [r.length for r in reports.largest_responses(df).collect()] == [70, 5]
    assert [tuple(r) for r in reports.repeated_captures(df).collect()] == [("com,a)/", "20200101000000", 2)]
    assert sorted(r.surt for r in reports.keys_below(df, "com,").collect()) == ["com,a)/", "com,b)/"]
    assert [r.replay_url for r in reports.replay_urls(df, "http://r/").collect()] == [None, None, "http://r/20210201000000/u", None]
    assert [r[0] for r in df.select(reports.quality_label(F.get_json_object("json", "$.status"))).collect()] == ["high", "medium", "unknown", "unknown"]
    assert {tuple(r) for r in reports.per_year(df).collect()} == {("2020", 2), ("2021", 1), (None, 1)}
    assert {tuple(r) for r in reports.per_month(df).collect()} == {("2020", "01", 2), ("2021", "02", 1), (None, None, 1)}
    assert tuple(reports.validation(df).first()) == (4, 3, 3, 3)
    assert reports.percent(1, 3) == 33.3 and reports.percent(1, 0) == 0.0
    assert with_parts(df.select("value")).columns == ["value", "surt", "ts", "json"]


def test_spliced_fields_are_what_writing_anew_gives(spark):
    payloads = [
        '{"a":1}', '{ "a" : "x  y: z, {1}" , "b":[1, 2,{"c": null}]}', '{"collection":"x","a":1}', '{"a":{"collection":1}}', "{}", '{"a":1.50}', '{"a":-0}', '{"a":1e3}', '{"a":"\\u00e9\\/"}',
        '{"a":1,"a":2}', '{"a":1},', '{"a":1}]', "[1]", "x", "", '{"a":"é☃"}', '{"a": true, "b": false}', '{"t":"10:05.3"}', '{"a":12345678901234567890123}', '\xa0{"a":1}', '{"a":"1\u2003 2"}', '{"a":1 }', '{"a":"b"\u2003}',
    ]
    lines = [f"k)/ 2020 {p}" for p in payloads] + ["k)/ 2020", "k", "", None, 'k)/  {"a":1}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    for fields in ({"collection": "demo"}, {"n": 'quote " and \\', "é": "ü"}):
        def anew(line):
            try:
                surt, ts, payload = parse_line(line)
                return write_line(surt, ts, (payload or {}) | fields), True
            except ValueError:
                return line, False

        want = [anew(x) if x else (x, False) for x in lines]
        assert [(r.value, r.added) for r in add_fields(df, fields).orderBy("i").collect()] == want
        assert df.where(_spliced(F.col("value"), fields).isNotNull()).count() >= 8


def test_many_expressions_are_scanned_by_automata(spark, monkeypatch):
    rng = random.Random(21)
    patterns = [f"^[a-z]+,q{i:x}[a-z]*\\)" for i in range(300)] + [r"(a)b\1", r"x(?=y)", r"(?P<n>zz+)k", "[[:digit:]]{5}$", r"\d-\d\Z", "é[^ ]ü"]
    lines = ["com,q1f)/", "com,q1fzz)/ 1", "com,r1)/", "abaX", "xaba", "xy", "xz", "1zzzk", "12345", "12345 ", "1-2", "1-2 x", "éaü", "é ü", "", None]
    lines += ["".join(rng.choice("abcq,)0123xyzk-") for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    found = Blocklist.of(patterns)
    assert len(found.scanned()[1]) == 1 and len(found.conditions("value")) == 1  # the two that look back or ahead
    got = [r.i for r in apply_blocklist(df, found).orderBy("i").collect()]
    monkeypatch.setattr(blocklist, "SCAN_FROM", 10**6)
    assert got == [r.i for r in apply_blocklist(df, Blocklist.of(patterns)).orderBy("i").collect()]
    own = [re.compile(p.replace("[[:digit:]]", "[0-9]")) for p in found.expressions]
    assert got == [i for i, x in enumerate(lines) if x is None or not any(p.search(x) for p in own)]
