import datetime as dt
import random

import pytest

from heliograph.operators import orphans

REFS = "ref_table string, ref_id long, key string, at timestamp_ntz, slot int"
PARENTS = "key string, loaded_at timestamp_ntz, removed_at timestamp_ntz, part string"


def day(n):
    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def found(spark, refs, parents, **options):
    r = spark.createDataFrame([("t", i, k, day(a), 0) for i, (k, a) in enumerate(refs)], REFS)
    p = spark.createDataFrame([(k, day(a), day(b), "x") for k, a, b in parents], PARENTS)
    return sorted((x.ref_id, x.reason) for x in orphans.orphan_references(r, p, **options).collect())


def brute(refs, parents):
    out = []
    for i, (k, t) in enumerate(refs):
        mine = [(a, b) for key, a, b in parents if key == k]
        if k is None or (t is not None and any(a is not None and a <= t and (b is None or b > t) for a, b in mine)):
            continue
        loaded = t is not None and any(a is not None and a <= t for a, _ in mine)
        out.append((i, "missing" if not mine else "deleted" if loaded else "late"))
    return out


def test_reasons(spark):
    refs = [("a", 5), ("a", 0), ("b", 9), ("c", 1), (None, 1), ("a", None), ("c", None), ("a", 5), ("", 3)]
    parents = [("a", 2, None), ("a", 2, None), ("b", 1, 9), ("d", None, None), (None, 1, None)]
    assert found(spark, refs, parents) == [(1, "late"), (2, "deleted"), (3, "missing"), (5, "late"), (6, "missing"), (8, "missing")]


def test_nested_intervals_and_entries_that_never_stood(spark):
    parents = [("a", 1, 10), ("a", 2, 3), ("b", 5, 4), ("c", None, None)]
    refs = [("a", 5), ("a", 10), ("b", 6), ("c", 1)]
    assert found(spark, refs, parents) == [(1, "deleted"), (2, "deleted"), (3, "late")]


@pytest.mark.parametrize("refs,parents", [([], []), ([("a", 1)], []), ([], [("a", 1, None)])])
def test_empty(spark, refs, parents):
    assert found(spark, refs, parents) == brute(refs, parents)


def test_hot_key_is_split_and_matches_brute_force(spark):
    rng = random.Random(3)
    keys = [f"k{i}" for i in range(40)] + ["é" * 300, "x"]
    parents = [(rng.choice(keys), rng.choice([None, *range(20)]), rng.choice([None, *range(25)])) for _ in range(120)]
    refs = [("x" if rng.random() < 0.4 else rng.choice([*keys, "gone", None]), rng.choice([None, *range(30)])) for _ in range(900)]
    assert found(spark, refs, parents, rows_per_part=50, parents_per_range=7) == brute(refs, parents)


def test_layout_packs_slots():
    assert orphans._layout([(0, 10, 1), (1, 500, 1), (2, 5, 1), (3, 5, 60), (7, 0, 0)], 100, 50) == [(0, 0), (1, 1), (2, 2), (3, 3), (7, 4)]


def largest(spark, refs, parents, rows_per_part, parents_per_range):
    left, right = orphans.partitioned(refs, parents, rows_per_part, parents_per_range)
    return [x.groupBy("part").count().agg({"count": "max"}).first()[0] for x in (left, right)]


@pytest.mark.parametrize("key", ["'hot'", "concat('k', id)"])
def test_no_part_gets_too_many(spark, key):
    """A million distinct parents of one key, or of a million keys, and as many references."""
    at = "timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 900000)"
    parents = spark.range(1_000_000).selectExpr(f"{key} as key", f"{at} as loaded_at", f"{at} + interval 1 minute as removed_at")
    refs = spark.range(300_000).selectExpr("'t' as ref_table", "id as ref_id", f"{key} as key", f"{at} as at")
    rows, held = largest(spark, refs, parents, 20_000, 50_000)
    assert rows <= 1.2 * 20_000 and held <= 50_000


def test_key_with_many_parents_is_cut_by_time(spark):
    rng = random.Random(11)
    parents = [("x" if i % 3 else f"k{i}", rng.choice([None, *range(200)]), rng.choice([None, *range(250)]) if rng.random() < 0.1 else rng.randrange(200)) for i in range(400)]
    refs = [(rng.choice(["x", "x", "k3", "k6", "none"]), rng.choice([None, *range(-5, 230)])) for _ in range(900)]
    assert found(spark, refs, parents, rows_per_part=100, parents_per_range=20) == brute(refs, parents)


def test_base_name(spark):
    rows = [(" ./a/b.warc.gz ",), ("x.cdx.gz",), ("/s/x.cdx.gz",), ("a/",), (None,)]
    df = spark.createDataFrame(rows, "n string")
    assert [r[0] for r in df.select(orphans.base_name(df.n)).collect()] == ["b.warc.gz", "x.cdx.gz", "x.cdx.gz", "", None]
    assert [r[0] for r in df.select(orphans.base_name(df.n, ".cdx.gz")).collect()] == ["b.warc.gz", "x", "x", "", None]


def test_report(spark):
    r = spark.createDataFrame([("t", i, k, day(a), 0) for i, (k, a) in enumerate([("a", 1), ("a", 40), ("b", 1), ("a", None)])], REFS)
    p = spark.createDataFrame([("a", day(0), day(5), "x")], PARENTS)
    rows = {(x.ref_table, x.month): tuple(x)[2:] for x in orphans.orphan_report(r, orphans.orphan_references(r, p)).collect()}
    assert rows == {("t", "2025-01"): (2, 1, 0, 0), ("t", "2025-02"): (1, 0, 1, 0), ("t", None): (1, 0, 0, 1)}
