import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm.mixture import Mixture, quotas, split

TARGETS = "source string, target_share double, max_repeats int, note string"


def mix(spark, docs, targets, **options):
    d = spark.createDataFrame([(i, s, n, "e", 1) for i, (s, n) in enumerate(docs)], "doc_id long, source string, n_tokens int, shard string, id int")
    t = spark.createDataFrame([(*x, "n") for x in targets], TARGETS)
    return Mixture(d, t, **options)


def test_quotas():
    assert quotas({"a": 100, "b": 100}, {"a": (0.75, 2), "b": (0.25, 1)}) == {"a": 150, "b": 50}
    capped = quotas({"a": 190, "b": 10}, {"a": (0.4, 2), "b": (0.4, 3), "c": (0.2, 9)})
    assert capped == {"a": pytest.approx(170), "b": 30, "c": 0}
    assert quotas({"a": 10}, {"a": (0.5, 0)}) == {"a": 0}
    assert quotas({}, {"a": (1.0, 2)}) == {"a": 0}


def test_split_is_exact():
    parts = split(np.array([1000, 0, 7, 3]), 13, 5)
    assert parts.sum(axis=0).tolist() == [1000, 0, 7, 3] and parts.min() >= 0
    sizes = parts.sum(axis=1)
    assert sizes.max() - sizes.min() <= 3
    assert split(np.array([0, 0]), 4, 1).sum() == 0


def test_mixture(spark):
    rng = random.Random(1)
    docs = [(rng.choice(["big", " BIG ", "Mid", "tiny"] if rng.random() < 0.2 else ["big", "big", "mid"]), rng.randrange(0, 60)) for _ in range(1500)]
    docs += [(None, 10), ("other", 10), ("mid", None)]
    m = mix(spark, docs, [("Big", 0.4, 1), ("mid", 0.5, 3), ("tiny ", 0.1, 2), ("none", 0.1, 5), (None, 0.3, 1)], shards=7)
    shares = {r.source: r for r in m.shares().collect()}
    held = sum(n or 0 for s, n in docs if s and s.strip().lower() in ("big", "mid", "tiny"))
    for s, r in shares.items():
        assert abs(r.tokens - r.quota_tokens) <= 30, s
        assert r.most_uses <= r.max_repeats
    assert abs(sum(r.tokens for r in shares.values()) - held) <= 100
    assert shares["none"].tokens == 0 and abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    draws = m.draws().collect()
    assert len({(r.doc_id, r.use) for r in draws}) == len(draws)
    uses = {r.doc_id: r.n_uses for r in m.uses().collect()}
    by_source = {}
    for i, n in uses.items():
        by_source.setdefault(docs[i][0].strip().lower(), set()).add(n)
    assert all(max(x) - min(x) <= 1 for x in by_source.values())
    sizes = m.draws().groupBy("shard").agg(F.sum("tokens").alias("t")).collect()
    assert len(sizes) == 7
    assert m.shuffled().count() == len(draws)


def test_refines_into_blocks(spark, monkeypatch):
    monkeypatch.setattr("heliograph.llm.mixture.BLOCK_BITS", 2)
    monkeypatch.setattr("heliograph.llm.mixture.FEW", 3)
    docs = [("a", 1 + i % 5) for i in range(700)] + [("b", 3)] * 500
    m = mix(spark, docs, [("a", 0.3, 1), ("b", 0.7, 4)])
    for r in m.shares().collect():
        assert abs(r.tokens - r.quota_tokens) <= 3


def test_empty_and_capped(spark):
    assert mix(spark, [], [("a", 1.0, 2)]).uses().count() == 0
    assert mix(spark, [("a", 5)], []).uses().count() == 0
    m = mix(spark, [("a", 5), ("a", 6)], [("a", 0.5, 1), ("b", 0.5, 3)])
    assert {r.doc_id: r.n_uses for r in m.uses().collect()} == {0: 1, 1: 1}
    assert mix(spark, [("a'\\", 5)], [("a'\\", 1.0, 2)]).uses().count() == 1


def test_same_seed_same_mixture(spark):
    docs = [("a", 5 + i % 3) for i in range(200)] + [("b", 4)] * 100
    one, two, three = (mix(spark, docs, [("a", 0.3, 1), ("b", 0.7, 3)], seed=s) for s in (1, 1, 2))
    rows = lambda m: sorted(map(tuple, m.draws().collect()))
    assert rows(one) == rows(two) != rows(three)


def test_every_shard_is_a_sample_of_the_mixture(spark):
    docs = [("big", 10)] * 40_000 + [("mid", 20)] * 10_000 + [("tiny", 10)] * 3000
    m = mix(spark, docs, [("big", 0.5, 1), ("mid", 0.4, 3), ("tiny", 0.1, 2)], shards=20)
    shards = m.draws().groupBy("shard").pivot("source").agg(F.sum("tokens")).fillna(0).collect()
    assert len(shards) == 20
    shares = {r.source: r.tokens for r in m.shares().collect()}
    for r in shards:
        for s, whole in shares.items():
            assert 0.5 < r[s] / (whole / 20) < 1.6, (s, r)


def test_more_shards_than_documents_of_a_source(spark):
    docs = [("a", 10)] * 3000 + [("b", 10)] * 40
    m = mix(spark, docs, [("a", 0.6, 1), ("b", 0.4, 30)], shards=5000)
    draws = m.draws().collect()
    assert len(draws) == m.uses().agg(F.sum("n_uses")).first()[0] and {r.shard for r in draws} <= set(range(5000))
    assert len({r.shard for r in draws}) > 1500
    # Uses of a document are spread.
    by_doc = {}
    for r in draws:
        by_doc.setdefault(r.doc_id, []).append(r.shard)
    again = [x for x in by_doc.values() if len(x) > 5]
    assert again and sum(len(set(x)) == len(x) for x in again) > 0.8 * len(again)


def test_large_splits_are_exact_and_even():
    parts = split(np.array([64 * 100_000, 64 * 100_000, 1000]), 100_000, 3)
    assert parts.sum(axis=0).tolist() == [6_400_000, 6_400_000, 1000] and parts.min() >= 0
    assert abs(parts[:, 0].std() - np.sqrt(32)) < 1  # half of 128 draws each


def test_one_id_repeated_does_not_fill_the_driver(spark, monkeypatch):
    monkeypatch.setattr("heliograph.llm.mixture.FEW", 10)
    d = spark.range(50_000).selectExpr("7L as doc_id", "'a' as source", "1 as n_tokens").unionByName(spark.range(100).selectExpr("id + 100 as doc_id", "'b' as source", "1000 as n_tokens"))
    m = Mixture(d, spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], "source string, target_share double, max_repeats int"))
    assert m.passes["a"] == 0 and {r.n_uses for r in m.uses().where("source = 'a'").collect()} <= {50_000}
