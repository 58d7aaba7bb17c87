import json

import pytest

from heliograph.operators import drift


def captures(spark, files, folder="/idx/C"):
    rows = []
    for number, payloads in files:
        for p in payloads:
            text = p if p is None or isinstance(p, str) else json.dumps(p)
            rows.append((f"{folder}/C-20200101-{number:05d}.warc.gz.cdxj", text, "mine", 7))
    return spark.createDataFrame(rows, "src_path string, json_data string, status string, kind int")


def changes(df):
    return sorted((r.src_path[-18:-13], r.field_name, r.change_kind, r.before, r.after) for r in drift.schema_changes(df).collect())


def test_changes(spark):
    df = captures(spark, [
        (1, [{"status": "200", "coll": "X"}, {"status": "404"}]),
        (2, [{"Status": 200, "coll": ["X"]}, {"Status": None}]),
        (3, [{"other": 1}, None]),
        (5, [{"response_code": 200, "collection": {"name": "X"}}]),
        (4, [None]),
    ])
    assert changes(df) == [
        ("00002", "collection", "retyped", "string", "array"),
        ("00002", "status", "renamed", "status", "Status"),
        ("00002", "status", "retyped", "string", "number"),
        ("00003", "collection", "removed", "coll", None),
        ("00003", "status", "removed", "Status", None),
        ("00005", "collection", "added", None, "collection"),
        ("00005", "status", "added", None, "response_code"),
    ]


def test_majority_and_no_series(spark):
    df = captures(spark, [(1, [{"status": 1}, {"status": 2}, {"sc": "3"}]), (2, [{"status": "x"}, {"status": 4}, {"status": 5}])])
    assert changes(df) == []
    odd = spark.createDataFrame([("no-number", '{"status":1}'), (None, '{"status":1}'), ("", None)], "src_path string, json_data string")
    assert drift.schema_changes(odd).count() == 0
    assert drift.schema_changes(odd.limit(0)).count() == 0


def test_broken_payloads_carry_nothing(spark):
    df = captures(spark, [(1, [{"status": 1}]), (2, ["[1]", "{", '{"status":1,"status":2}', "", '"x"'])])
    assert [c[2] for c in changes(df)] == ["removed"]


def test_consistent_table(spark):
    df = captures(spark, [(1, [{"status": 200, "coll": ["A"]}, {"Status": "404", "col_id": {"name": "B", "v": 1}}, {"crawl_name": None}, None, {"sc": 1.5, "collection": {"v": 1}}])])
    rows = [(r.kind, r.status, r.collection) for r in drift.consistent_table(df).collect()]
    assert rows == [(7, "200", "A"), (7, "404", "B"), (7, None, None), (7, None, None), (7, "1.5", '{"v":1}')]
    assert drift.consistent_table(df).columns == ["src_path", "json_data", "kind", "status", "collection"]


@pytest.mark.parametrize("a,b,want", [(None, None, None), (None, "long", "long"), ("boolean", "long", "long"), ("long", "double", "double"), ("long", "timestamp", "string"), ("string", "double", "string")])
def test_lattice(a, b, want):
    assert drift.promote(a, b) == want and drift.promote(b, a) == want


def test_lattice_is_associative():
    kinds = [None, *("boolean", "long", "double", "timestamp", "string")]
    for a in kinds:
        for b in kinds:
            for c in kinds:
                assert drift.promote(drift.promote(a, b), c) == drift.promote(a, drift.promote(b, c))


def test_parquet_files(spark, tmp_path):
    spark.sql("select 1 as id, '7' as n, true as old").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.sql("select 2L as id, 8 as n, date'2020-01-01' as d").coalesce(1).write.parquet(str(tmp_path / "b"))
    spark.sql("select 2.5D as id, 9 as number").coalesce(1).write.parquet(str(tmp_path / "c"))
    paths = [str(next((tmp_path / x).glob("*.parquet"))) for x in "abc"]
    table, log = drift.read_drifting(spark, paths, {"number": "n"})
    assert dict(table.dtypes) == {"id": "double", "n": "string", "old": "boolean", "d": "timestamp"}
    assert sorted((r.id, r.n) for r in table.collect()) == [(1.0, "7"), (2.0, "8"), (2.5, "9")]
    got = [(r.file_order, r.field_name, r.change_kind) for r in log.orderBy("file_order", "field_name", "change_kind").collect()]
    assert got == [(1, "d", "added"), (1, "n", "retyped"), (1, "old", "removed"), (2, "d", "removed"), (2, "id", "retyped"), (2, "n", "renamed")]
    empty, none = drift.read_drifting(spark, [])
    assert empty.count() == 0 and none.count() == 0


def test_names_that_are_not_known_are_told_by_their_values(spark):
    df = captures(spark, [
        (1, [{"status": "200", "collection": "A-1", "hops": "3", "length": "200"}, {"status": "404", "collection": "A-1", "hops": "4", "length": "31"}]),
        (2, [{"http_response": 200, "collection": "A-2", "hops": "3", "length": "404"}, {"http_response": 404, "collection": "A-2", "hops": "2", "length": "7"}]),
        (3, [{"http_response": "200", "Crawl Of": "A-1", "depth": "2"}, {"http_response": "301", "Crawl Of": "A-2", "depth": "200"}, {"http_response": "404", "Crawl Of": "A-3", "depth": "1"}]),
        (4, [{"depth": "1", "seed": "x'y\"z"}, None]),
    ])
    names = drift.field_names(df)
    assert names == {"status": "status", "collection": "collection", "http_response": "status", "Crawl Of": "collection"}
    assert changes(df) == [
        ("00002", "status", "renamed", "status", "http_response"),
        ("00002", "status", "retyped", "string", "number"),
        ("00003", "collection", "renamed", "collection", "Crawl Of"),
        ("00003", "status", "retyped", "number", "string"),
        ("00004", "collection", "removed", "Crawl Of", None),
        ("00004", "status", "removed", "http_response", None),
    ]
    rows = drift.consistent_table(df).select("src_path", "status", "collection").where("src_path like '%00003%'").collect()
    assert sorted((r.status, r.collection) for r in rows) == [("200", "A-1"), ("301", "A-2"), ("404", "A-3")]


def test_names_with_quotes(spark):
    df = spark.createDataFrame([(json.dumps({"a'b": 1, 'c"d': 2, "e'\"f": 3, "g.h[0]": 4, "i\\j": 5}),)], "json_data string")
    names = dict.fromkeys(("a'b", 'c"d', "e'\"f", "g.h[0]", "i\\j"), "status")
    found = drift._with_members(df, names).first().members
    assert {m.name: m.text for m in found} == {"a'b": "1", 'c"d': "2", "e'\"f": "3", "g.h[0]": "4", "i\\j": "5"}


def test_fold_in_executors_is_the_lattice(spark):
    import functools
    import itertools

    kinds = ["boolean", "long", "double", "timestamp", "string", None]
    rows = [(i, k) for i, group in enumerate(itertools.product(kinds, repeat=3)) for k in group]
    found = spark.createDataFrame(rows, "g int, k string").groupBy("g").agg(drift.folded(drift.F.col("k")).alias("kind")).collect()
    want = {i: functools.reduce(drift.promote, group, None) for i, group in enumerate(itertools.product(kinds, repeat=3))}
    assert {r.g: r.kind for r in found} == want


def test_union_schema_of_payloads(spark):
    df = captures(spark, [(1, [{"status": 1, "collection": ["a"]}]), (2, [{"sc": 2, "coll": "x"}])])
    assert {r.field_name: r.kind for r in drift.union_schema(drift.file_schemas(df)).collect()} == {"status": "double", "collection": "string"}
