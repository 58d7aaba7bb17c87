import random

import pytest

from heliograph.operators import merkle

ROWS = "warc_path string, cdxj_path string, warc_sha string"


def changes(spark, now, then):
    a, b = spark.createDataFrame(now, ROWS), spark.createDataFrame(then, ROWS)
    return sorted(tuple(r) for r in merkle.state_changes(a, b, ["warc_path", "cdxj_path"]).collect())


def test_kinds(spark):
    now = [("a", "x", "1"), ("b", "x", "2"), ("c", None, "3"), ("d", "y", "4")]
    then = [("a", "x", "1"), ("b", "x", "9"), ("c", None, "3"), ("e", "z", "5")]
    assert changes(spark, now, then) == [("b", "x", "2", "changed"), ("d", "y", "4", "added"), ("e", "z", "5", "removed")]


@pytest.mark.parametrize("now,then", [([], []), ([("a", "x", "1")], []), ([], [("a", "x", "1")])])
def test_empty(spark, now, then):
    assert len(changes(spark, now, then)) == len(now) + len(then)


def test_deep_tree_extracts_only_changed_leaves(spark):
    rng = random.Random(1)
    now = {(f"w{i}", f"c{i}"): str(rng.random()) for i in range(3000)}
    then = dict(now)
    for k in rng.sample(sorted(then), 20):
        then[k] = "old"
    for k in rng.sample(sorted(then), 15):
        del then[k]
    rows = lambda d: [(*k, v) for k, v in d.items()]
    want = sorted((*k, v, "added" if k not in then else "changed") for k, v in now.items() if then.get(k) != v)
    assert changes(spark, rows(now), rows(then)) == want
    depth = merkle.depth_for(3000)
    a, b = (merkle.with_leaf(spark.createDataFrame(rows(x), ROWS), ["warc_path", "cdxj_path"], depth) for x in (now, then))
    leaves = merkle.changed_leaves(merkle.tree(a, depth), merkle.tree(b, depth), depth).count()
    assert depth >= 1 and 0 < leaves <= 35


def test_pending(spark):
    t = lambda n: f"timestamp_ntz'2025-01-{n:02d} 00:00:00'"
    listing = spark.sql(
        f"""select * from values (1L,'a','ca','1',{t(1)}), (2L,'a','ca','2',{t(2)}), (3L,'b','cb','1',{t(1)}), (4L,'c','cc',null,{t(2)}), (5L,'c','cc','1',{t(1)}),
        (6L,'d','new','1',{t(1)}), (7L,null,'x','1',{t(1)}), (8L,'e','ce','1',{t(1)}), (8L,'e','ce','1',{t(1)}), (9L,'f','cf','1',{t(1)})
        as v(list_id, warc_path, cdxj_path, warc_sha, seen_at)"""
    )
    log = spark.sql(
        f"""select * from values (1L,1,'a','ca','1','ok',{t(3)}), (2L,1,'b','cb','1','ok',{t(3)}), (3L,1,'d','old','1','ok',{t(3)}), (4L,2,'e','ce','1','ok',{t(3)}),
        (5L,1,'f','cf','0','ok',{t(9)}), (6L,3,'f','cf','1','ok',{t(3)}), (7L,1,'e','ce','1',null,{t(3)}), (8L,99,'e','ce','1','ok',{t(3)})
        as v(log_id, run_id, warc_path, cdxj_path, warc_sha, outcome, logged_at)"""
    )
    runs = spark.sql(f"select * from values (1,'ok',{t(4)}), (2,'failed',{t(5)}), (3,'ok',{t(6)}) as v(run_id, run_state, finished_at)")
    got = sorted((r.warc_path, r.cdxj_path) for r in merkle.pending_files(listing, log, runs).collect())
    assert got == [("a", "ca"), ("d", "new"), ("e", "ce")]


def test_store_survives_a_failed_run(spark, tmp_path):
    store = merkle.StateStore(spark, str(tmp_path / "s"), ["k"])
    one = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    assert {r.change for r in store.changes(one).collect()} == {"added"}
    assert store.publish(one, one.limit(1)) == 1
    two = spark.createDataFrame([("a", 2), ("c", 1)], "k string, v int")
    want = [("a", 2, "changed"), ("b", 1, "removed"), ("c", 1, "added")]
    assert sorted(map(tuple, store.changes(two).collect())) == want
    # A run that dies after writing its output but before its commit changes nothing.
    broken = merkle.StateStore(spark, str(tmp_path / "s"), ["k"])
    broken.commits.publish = lambda *p: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.publish(two, two)
    again = merkle.StateStore(spark, str(tmp_path / "s"), ["k"])
    assert sorted(map(tuple, again.changes(two).collect())) == want
    assert again.publish(two, two) == 2
    assert again.changes(two).count() == 0 and again.output().count() == 2


def test_clashing_columns(spark):
    a = spark.createDataFrame([("a", 1)], "k string, leaf int")
    assert merkle.state_changes(a, a.limit(0), ["k"]).first().leaf == 1
    with pytest.raises(ValueError):
        merkle.state_changes(a.withColumnRenamed("leaf", "change"), a, ["k"])


def test_a_state_that_grows_gets_a_deeper_tree(spark, tmp_path):
    store = merkle.StateStore(spark, str(tmp_path / "s"), ["id"])
    rows = lambda n: spark.range(n).selectExpr("id", "id % 7 as v")
    store.publish(rows(60))
    assert store.latest()["depth"] == 1
    assert store.advance(rows(1_000_000)).count() == 999_940
    assert store.latest()["depth"] == merkle.depth_for(1_000_000) == 2
    largest = store._tree(store.latest()).where("level = 2").agg({"members": "max"}).first()[0]
    assert largest < 100
    assert store.state().count() == 1_000_000 and store.changes(rows(1_000_000)).count() == 0


def test_versions_write_what_changed(spark, tmp_path):
    store = merkle.StateStore(spark, str(tmp_path / "s"), ["k"])
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "k string, v string")
    held, when = {f"k{i}": "0" for i in range(2000)}, {f"k{i}": 1 for i in range(2000)}
    store.publish(frame(held), frame(held).limit(1))
    for n in range(2, 13):
        held[f"k{n}"] = str(n)
        held[f"new{n}"] = "x"
        when[f"k{n}"] = when[f"new{n}"] = n
        del held[f"k{n + 100}"]
        changes = store.advance(frame(held))
        assert sorted(r.change for r in changes.collect()) == ["added", "changed", "removed"]
        last = store.latest()
        if len(last["folders"]) > 1:
            assert spark.read.parquet(f"{tmp_path}/s/{last['folders'][-1][1]}/state").count() == 3
        assert {r.k: r.v for r in store.state().collect()} == held
        assert {r.k: r[merkle.VERSION] for r in store.state().collect()} == {k: when[k] for k in held}
    assert len(store.latest()["folders"]) < 8 and store.outputs().select(merkle.VERSION).distinct().count() == 12


def test_null_and_nested_columns_count(spark):
    one = spark.sql("select * from values ('a', cast(null as string), 'x', map('m', 1)), ('b', 'x', cast(null as string), map()) as t(k, p, q, m)")
    two = spark.sql("select * from values ('a', 'x', cast(null as string), map('m', 1)), ('b', 'x', cast(null as string), map()) as t(k, p, q, m)")
    leaf = lambda df: merkle.leaf_digests(merkle.with_leaf(df.where("k = 'a'"), ["k"], 1)).first()
    assert leaf(one) != leaf(two)


def test_pending_files_are_published_with_the_state(spark, tmp_path):
    listing = spark.sql("select 1L as list_id, 'a' as warc_path, 'ca' as cdxj_path, '1' as warc_sha, timestamp_ntz'2025-01-01 00:00:00' as seen_at")
    log = spark.sql("select 1L as log_id, 1 as run_id, 'b' as warc_path, 'cb' as cdxj_path, '1' as warc_sha, 'ok' as outcome, timestamp_ntz'2025-01-01 00:00:00' as logged_at")
    runs = spark.sql("select 1 as run_id, 'ok' as run_state, timestamp_ntz'2025-01-01 00:00:00' as finished_at")
    store = merkle.StateStore(spark, str(tmp_path / "s"), ["warc_path", "cdxj_path"])
    assert [r.warc_path for r in merkle.pending_files(listing, log, runs, store).collect()] == ["a"]
    again = merkle.StateStore(spark, str(tmp_path / "s"), ["warc_path", "cdxj_path"])
    assert again.latest()["version"] == 2 and [r.warc_path for r in again.state().collect()] == ["a"]
    assert [r.warc_path for r in again.output().collect()] == ["a"]
