import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heliograph.llm.page import page_key, seconds
from heliograph.llm import neighbourhood as nb

INCOMING = "rec_id long, batch_no int, k string, s long, id string"


def screen(spark, history, incoming, window=5):
    h = spark.createDataFrame(history, "k string, s long")
    i = spark.createDataFrame([(*r, "x") for r in incoming], INCOMING)
    got = nb.screen_batches(h, i, "batch_no", "rec_id", F.col("k"), F.col("s"), window).collect()
    assert len(got) == len(incoming)
    return sorted(r.id for r in got if not r.accepted)


def brute(history, incoming, window=5):
    accepted = defaultdict(set)
    for k, s in history:
        accepted[k].add(s)
    cases = []
    for rec, _, k, s in sorted(incoming, key=lambda r: (r[1] is None, r[1], r[0])):
        if k is None or s is None:
            continue
        if any(s + i in accepted[k] for i in range(-window, window + 1)):
            cases.append(rec)
        else:
            accepted[k].add(s)
    return sorted(cases)


def test_order_decides(spark):
    history = [("a", 100), ("a", 100)]
    incoming = [(1, 1, "a", 105), (2, 1, "a", 106), (3, 2, "a", 111), (4, 2, "a", 112), (5, 2, "b", 100), (6, 2, "b", 100), (7, 1, None, 100), (8, 2, "a", None)]
    assert screen(spark, history, incoming) == brute(history, incoming) == [1, 3, 6]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    day = 86400

    def row():
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}é"
        return key, rng.choice([rng.randrange(40, 400), day * rng.randrange(1, 4) + rng.randrange(-14, 14)])

    history = [row() for _ in range(500)]
    incoming = [(i, rng.choice([1, 2, 3, 4, 5, 6, 7]), *row()) for i in range(700)]
    assert screen(spark, history, incoming) == brute(history, incoming)


def test_empty_tables(spark):
    assert screen(spark, [], []) == []
    assert screen(spark, [], [(1, 1, "a", 1), (2, 1, "a", 2)]) == [2]
    assert screen(spark, [("a", 1)], []) == []


KEYED = "id long, key string, second long"


def test_runs_are_merged_and_ranges_split(spark, tmp_path):
    runs = nb.SortedRuns(spark, 5, compact_every=2, rows_per_range=50, path=str(tmp_path))
    rng = random.Random(3)
    history = [(rng.choice(["hot", f"k{rng.randrange(99)}"]), rng.randrange(10_000)) for _ in range(600)]
    runs.add(spark.createDataFrame(history, "key string, second long"))
    before = len(runs.borders["key"])
    for n in range(5):
        batch = [(1000 * n + i, rng.choice(["hot", f"k{rng.randrange(99)}"]), rng.randrange(30_000)) for i in range(300)]
        got = {r.id for r in runs.absorb(spark.createDataFrame(batch, KEYED)).collect() if not r.accepted}
        want = brute(history, [(i, 1, k, s) for i, k, s in batch])
        assert sorted(got) == want
        history += [(k, s) for i, k, s in batch if i not in got]
        files = runs.files["key"]
        assert sum(f[1] for f in files) == len(set(history)) == spark.read.parquet(*(f"{tmp_path}/{f[0]}" for f in files)).distinct().count()
    assert len(runs.borders["key"]) > before
    per_range = defaultdict(int)
    for _, _, low, _ in runs.files["key"]:
        per_range[nb.bisect_right(runs.borders["key"], low)] += 1
    assert max(per_range.values()) <= 3


def test_runs_are_reopened_and_read_in_part(spark, tmp_path):
    runs = nb.SortedRuns(spark, 5, rows_per_range=1000, path=str(tmp_path))
    runs.add(spark.range(50_000).selectExpr("concat('k', id % 5000) as key", "id as second"))
    again = nb.SortedRuns(spark, 5, rows_per_range=1000, path=str(tmp_path))
    batch = spark.createDataFrame([(1, "k7", 12), (2, "k7", 13), (3, "k8", 1), (4, "none", 7), (5, "none", 11), (6, None, 1), (7, "k7", None)], KEYED)
    assert {r.id for r in again.absorb(batch).collect() if not r.accepted} == {1, 5}
    assert 0 < again.rows_read.value < 10_000
    third = nb.SortedRuns(spark, 5, rows_per_range=1000, path=str(tmp_path))
    assert {r.id for r in third.absorb(spark.createDataFrame([(9, "none", 12), (10, "k8", 4)], KEYED)).collect() if not r.accepted} == {9, 10}
    with pytest.raises(ValueError):
        nb.SortedRuns(spark, 6, path=str(tmp_path))


def test_a_run_that_dies_leaves_the_former_state(spark, tmp_path):
    runs = nb.SortedRuns(spark, 5, path=str(tmp_path))
    runs.add(spark.createDataFrame([("a", 1)], "key string, second long"))
    runs.commits.publish = lambda *x: 1 / 0
    with pytest.raises(ZeroDivisionError):
        runs.absorb(spark.createDataFrame([(1, "b", 1)], KEYED))
    again = nb.SortedRuns(spark, 5, path=str(tmp_path))
    assert {r.id: r.accepted for r in again.absorb(spark.createDataFrame([(1, "b", 1), (2, "a", 6)], KEYED)).collect()} == {1: True, 2: False}


def test_a_batch_that_crowds_into_one_range(spark, tmp_path):
    """A page the history does not know holds most of a batch: it is compared and written by
    several tasks, and its range is cut."""
    runs = nb.SortedRuns(spark, 2, rows_per_range=500, path=str(tmp_path))
    runs.add(spark.range(4000).selectExpr("concat('k', id % 400) as key", "id as second"))
    before = len(runs.borders["key"])
    rng = random.Random(4)
    for turn in range(2):
        batch = [(10_000 * turn + i, "hot" if i % 4 else f"k{i % 400}", rng.randrange(10**6)) for i in range(6000)]
        got = {r.id for r in runs.absorb(spark.createDataFrame(batch, KEYED)).collect() if not r.accepted}
        if not turn:
            assert sorted(got) == brute([(f"k{i % 400}", i) for i in range(4000)], [(i, 1, k, s) for i, k, s in batch], 2)
    assert len(runs.borders["key"]) > before + 4 and runs.borders["key"] == sorted(runs.borders["key"])
    assert max(f[1] for f in runs.files["key"]) < 2500
    again = nb.SortedRuns(spark, 2, rows_per_range=500, path=str(tmp_path))
    probe = spark.createDataFrame([(i, k, s + 1) for i, k, s in batch], KEYED)
    assert all(not r.accepted for r in again.absorb(probe).where("id not in (%s)" % ",".join(map(str, got))).collect())


def test_several_keys(spark):
    runs = nb.SortedRuns(spark, 5, ("page", "digest"))
    runs.add(spark.createDataFrame([("a", "x", 100)], "page string, digest string, second long"))
    rows = [(1, "b", "x", 103), (2, "a", "y", 96), (3, "b", "z", 103), (4, "c", "z", 104), (5, None, "z", 108), (6, None, None, 100), (7, None, "w", 99)]
    got = runs.absorb(spark.createDataFrame(rows, "id long, page string, digest string, second long"))
    # 3 is a repeat of 1 under the page, so 4 is none of 3 under the digest.
    assert {r.id for r in got.collect() if not r.accepted} == {1, 2, 3, 5}


def test_batch_by_batch_equals_all_at_once(spark, tmp_path):
    rng = random.Random(5)
    row = lambda: (f"k{rng.randrange(20)}", rng.choice([rng.randrange(200), 86400 + rng.randrange(-30, 30)]))
    history, incoming = [row() for _ in range(50)], [(i, i // 60 + 1, *row()) for i in range(240)]
    runs = nb.SortedRuns(spark, 5, path=str(tmp_path))
    runs.add(spark.createDataFrame(history, "key string, second long"))
    cases = []
    for n in range(1, 5):
        runs = nb.SortedRuns(spark, 5, path=str(tmp_path))
        batch = [(i, k, s) for i, b, k, s in incoming if b == n]
        cases += [r.id for r in runs.absorb(spark.createDataFrame(batch, KEYED)).collect() if not r.accepted]
    assert sorted(cases) == screen(spark, history, incoming) == brute(history, incoming)


def test_chains_across_days(spark):
    """A page taken every few seconds for days, in order of time and against it."""
    rng = random.Random(7)
    seconds = sorted(rng.sample(range(86400 - 4000, 2 * 86400 + 4000), 30_000))
    for ids in (range(len(seconds)), range(len(seconds), 0, -1), rng.sample(range(len(seconds)), len(seconds))):
        incoming = [(i, 1, "hot", s) for i, s in zip(ids, seconds)]
        assert screen(spark, [], incoming) == brute([], incoming)


def test_page_keys(spark):
    same = [
        ("EXAMPLE,a)/B", "example,a)/b"), ("example,a:80)/", "example,a)/"), ("example,a,www2:443)/x/", "example,a)/x"),
        ("example,a)/%7eu%41", "example,a)/~uA"), ("example,a)/x?b=1&a=2&PHPSESSID=9&utm_x=1", "example,a)/x?a=2&b=1"), ("example,a)/x?", "example,a)/x"),
        ("example,a)/x/?sid=1", "example,a)/x"), ("example,a)/%2fx", "example,a)/%2Fx"),
    ]
    df = spark.createDataFrame(same, "a string, b string").select("a", page_key(F.col("a")).alias("x"), page_key(F.col("b")).alias("y"))
    assert [tuple(r) for r in df.collect() if r.x != r.y] == []
    different = spark.createDataFrame([("example,awww)/", "example,a)/"), ("example,a:8080)/", "example,a)/"), ("example,a)//", "example,a)"), ("example,a)/x?a=1", "example,a)/x")], "a string, b string")
    assert different.where(page_key(F.col("a")) == page_key(F.col("b"))).count() == 0


def test_seconds(spark):
    df = spark.createDataFrame([("19700101000010",), ("20200229235959",), ("20210229000000",), ("20200101000060",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(seconds(F.col("t"))).collect()] == [10, 1583020799, None, None, None, None, None]
