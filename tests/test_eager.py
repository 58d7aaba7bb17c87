import random

from pyspark.sql import functions as F

from heliograph.operators import eager


def frames(spark, n=400):
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 6 + [f"k{i}" for i in range(8)] + [None])
    left = spark.createDataFrame([(key(), rng.randrange(9), rng.choice(["a", "b"]), "x") for _ in range(n)], "k string, v int, g string, n string")
    right = spark.createDataFrame([(key(), rng.randrange(9)) for _ in range(n)], "k string, w int")
    return left, right


def test_equals_the_plain_join(spark):
    left, right = frames(spark)
    states = eager.eager_join(left, right, ["k"], {"lv": ("sum", "v"), "lo": ("min", "v")}, {"rw": ("sum", "w")})
    got = {r.k: (r.joined_rows, r.lv, r.rw, r.lo) for r in eager.joined_measures(states, ["lv"], ["rw"]).collect()}
    plain = left.join(right.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")))
    want = {r.k: tuple(r)[1:] for r in plain.groupBy("k").agg(F.count("*"), F.sum("v"), F.sum("w"), F.min("v")).collect()}
    assert got == want and None in got


def test_left_and_full(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([("b", 1)], "k string, w int")
    assert [(r.k, r.left_rows, r.right_rows) for r in eager.eager_join(left, right, ["k"], how="left").collect()] == [("a", 2, 0)]
    assert sorted((r.k, r.joined_rows) for r in eager.eager_join(left, right, ["k"], how="full").collect()) == [("a", 0), ("b", 0)]
    assert eager.eager_join(left.limit(0), right, ["k"]).count() == 0


def test_statistics(spark):
    rows = spark.createDataFrame([("a", "x", "1"), ("a", "x", "3"), ("a", None, "2"), ("b", None, None), (None, "y", "5"), ("", "z", "1")], "surt_key string, d string, ts string")
    got = {r.surt_key: tuple(r)[1:] for r in eager.key_statistics(rows, "surt_key", F.col("d"), "ts").collect()}
    assert got == {"a": (3, 1, "1", "3"), "b": (1, 0, None, None), None: (1, 1, "5", "5"), "": (1, 1, "1", "1")}
    heavy = eager.heavy_keys(eager.key_statistics(rows, "surt_key", F.col("d"), "ts"), "surt_key", 6, 0.5)
    assert [r.surt_key for r in heavy.collect()] == ["a"]


def test_roll_up_is_exact_at_the_threshold(spark):
    stats = spark.createDataFrame([("a", 7), ("b", 6)], "k string, n_rows long")
    assert [r.k for r in eager.heavy_keys(stats, "k", 700, 0.01).collect()] == ["a"]
    rolled = eager.roll_up(stats, [F.lit(1).alias("g")], {"n_rows": "sum"})
    assert rolled.first().n_rows == 13


def test_clashing_names_and_long_values(spark):
    rows = spark.createDataFrame([("a", "x" * 100_000, "1", 1, 2), ("a", "x" * 100_000, "1", 1, 2)], "k string, value string, first string, n_rows int, left_rows int")
    got = [tuple(r) for r in eager.key_statistics(rows, "k", F.col("value"), "first").collect()]
    assert got == [("a", 2, 1, "1", "1")]
    assert eager.key_statistics(rows.limit(0), "k", F.col("value"), "first").count() == 0
