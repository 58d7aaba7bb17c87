import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliograph.operators.recover import Fault, Record, loaded, parse_lines, parse_record, parse_text, rejected

OK = 'a)/ 20200101000000 {"offset":"1"}'


def reason(line):
    found = parse_record(line)
    return found.reason if isinstance(found, Fault) else found


@pytest.mark.parametrize(
    "line,expected",
    [
        ("a", "columns"), (" a b", "columns"), ("a  b", "columns"), ("a)/ 20200101000000 - {}", "columns"), ("a\t20200101000000\t{}", "columns"),
        ("a)/ 20200101000000 [1]", "columns"), ("a)/ 2020010100000 {}", "timestamp"), ("a)/ 20200230000000", "timestamp"),
        ("a)/ 20200101240000", "timestamp"), ("a)/ 20200101000060", "timestamp"), ("a)/ ２0200101000000", "timestamp"), ("a)/ 00000101000000", "timestamp"),
        ("a)/ 20200101000000 {", "json"), ("a)/ 20200101000000 {'a':1}", "json"), ('a)/ 20200101000000 {"a":1,}', "json"),
        ('a)/ 20200101000000 {"a":01}', "json"), ('a)/ 20200101000000 {"a":NaN}', "json"), ('a)/ 20200101000000 {"a":"\t"}', "json"),
        ('a)/ 20200101000000 {"a":1} x', "json"), ('a)/ 20200101000000 {"a":"\\x"}', "json"), ('a)/ 20200101000000 {"a":1}{}', "json"),
        ('a)/ x {"a":}', "json"), ('a)/ x {"offset":"n"}', "timestamp"),
        ('a)/ 20200101000000 {"offset":"n/a"}', "offset"), ('a)/ 20200101000000 {"offset":1.0}', "offset"), ('a)/ 20200101000000 {"offset":-1}', "offset"),
        ('a)/ 20200101000000 {"offset":""}', "offset"), ('a)/ 20200101000000 {"offset":" 1"}', "offset"), ('a)/ 20200101000000 {"offset":true}', "offset"),
        ('a)/ 20200101000000 {"offset":9223372036854775808}', "offset"), ('a)/ 20200101000000 {"offset":[1]}', "offset"), ('a)/ 20200101000000 {"offset":1e3}', "offset"),
        ('a)/ 20200101000000 {"offset":"٣"}', "offset"),
    ],
)
def test_rejected(line, expected):
    assert reason(line) == expected


@pytest.mark.parametrize(
    "line",
    [
        OK, OK + "\r\n", "a)/ 20200229235959", "a)/ 20200101000000 ", 'a)/ 20200101000000   {"x":null} ', 'a)/ 20200101000000 {"offset":null}',
        'a)/ 20200101000000 {"offset":9223372036854775807}', 'a)/ 20200101000000 {"offset":"' + "0" * 5000 + '7"}', 'a)/ 20200101000000 {"offset":-0}',
        'a)/ 20200101000000 {"a":1,"a":2}', 'a)/ 20200101000000 {"o\\u0066fset":"x","offset":"1"}', 'a)/ 20200101000000 {"a":"\\ud800"}',
        'a)/ 20200101000000 {"a":\n1}', 'a)/ 20200101000000 {"x":{"offset":"n/a"}}', "a)/ 20200101000000 " + '{"a":' * 3000 + "1" + "}" * 3000,
    ],
)
def test_accepted(line):
    assert isinstance(parse_record(line), Record)


@pytest.mark.parametrize("line", ["", " ", "\n", " \t\r\n", " "])
def test_blank(line):
    assert parse_record(line) is None


def test_escaped_name_of_the_offset_counts():
    assert reason('a)/ 20200101000000 {"o\\u0066fset":"x"}') == "offset"


def test_fault_is_located():
    line = 'a)/ 20200101000000 {"a" 1}'
    assert parse_record(line).place == line.index("1}")


def test_recovery_at_anchor():
    broken = 'a)/x 20200101000000 {"u":"http b,c)/y 20210101000000 {"offset":"5"}'
    found = list(parse_text(f"{broken}\n{OK}\n\nrubbish\n"))
    assert [type(x).__name__ for x in found] == ["Fault", "Record", "Record", "Fault"]
    assert (found[1].surt, found[1].offset, found[2].surt) == ("b,c)/y", 5, "a)/")


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text().filter(lambda k: k != "offset"), VALUES, max_size=4), st.booleans())
def test_valid_json_is_accepted(payload, ascii_only):
    text = json.dumps(payload, ensure_ascii=ascii_only)
    assert isinstance(parse_record("k)/ 20200101000000 " + text), Record)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:\\ 01eE.-+truefalsn', max_size=14))
def test_agrees_with_a_strict_parser(inner):
    def bad(name):
        raise ValueError(name)

    text = "{" + inner
    try:
        valid = isinstance(json.loads(text, parse_constant=bad), dict)
    except ValueError:
        valid = False
    assert isinstance(parse_record("k)/ 20200101000000 " + text), Record) == valid


def test_frames(spark):
    rows = [(1, OK, "a"), (2, None, "b"), (3, "", "c"), (4, "x", "d"), (4, "x", "d"), (5, 'a)/x 20200101000000 {"u":"h b)/y 20210101000000', "e")]
    lines = spark.createDataFrame(rows, "line_id int, line string, reason string")
    parsed = parse_lines(lines)
    assert sorted((r.line_id, r.reason) for r in rejected(parsed).collect()) == [(4, "columns"), (4, "columns"), (5, "json")]
    assert [tuple(r) for r in loaded(parsed).collect()] == [(1, "a)/", "20200101000000", '{"offset":"1"}', 1)]
    assert parse_lines(lines.limit(0)).count() == 0


def test_src_path_is_kept(spark):
    lines = spark.createDataFrame([(1, OK, "file")], "line_id long, line string, src_path string")
    assert parse_lines(lines).first().src_path == "file"


@pytest.mark.parametrize("between", ["", " "])
def test_all_records_behind_a_broken_quote(between):
    broken = 'x)/ 20200101000000 {"a":"b'
    glued = [f'{k})/ 2020010100000{i} {{"offset":"{i}"}}' for i, k in enumerate("abc")]
    found = list(parse_text(broken + " " + between.join(glued) + "\n" + OK))
    assert [f.reason for f in found if isinstance(f, Fault)] == ["json"]
    assert [f.surt for f in found if isinstance(f, Record)] == ["a)/", "b)/", "c)/", "a)/"]
    assert [f.payload for f in found if isinstance(f, Record)][:3] == [g.split(" ", 2)[2] for g in glued]
