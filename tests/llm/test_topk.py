import random
from collections import Counter

import pytest

from heliograph.llm.topk import most_frequent


def top(spark, values, k, **options):
    df = spark.createDataFrame([(v, 1) for v in values], "v string, n int")
    return [(r.value, r.n) for r in most_frequent(df, "v", k, **options).collect()]


def brute(values, k):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("max_groups", [1 << 20, 64])
def test_skewed(spark, max_groups):
    rng = random.Random(2)
    values = [f"v{int(rng.paretovariate(0.7))}" for _ in range(4000)] + [None] * 50 + [""] * 9
    assert top(spark, values, 10, max_groups=max_groups) == brute(values, 10)


def test_flat_and_ties(spark):
    values = [f"v{i}" for i in range(3000)] * 2
    assert top(spark, values, 5, max_groups=256) == brute(values, 5)


def test_few_values_and_none(spark):
    assert top(spark, ["a", "a", "b"], 5) == [("a", 2), ("b", 1)]
    assert top(spark, [], 5) == []
    assert top(spark, [None], 5) == []


def test_long_values(spark):
    values = ["x" * 50_000 + str(i % 3) for i in range(30)]
    assert top(spark, values, 2) == brute(values, 2)
