"""Targets by repeated resharing, and what the mix takes."""

import random

import pytest
from pyspark.sql import functions as F

from shardloom.llm import mixing


def reshared(sizes, weights, most):
    """Targets by the rule as stated: share by weight, stop at the cap, share the excess again."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(most * sizes[i] for i in capped)
        share = sum(weights[i] for i in free)
        new = {i for i in free if rest * weights[i] / share > most * sizes[i]}
        if not new:
            return [most * sizes[i] if i in capped else rest * weights[i] / share for i in range(len(sizes))]
        capped |= new


@pytest.mark.parametrize("n", [1, 2, 5, 23])
def test_targets(spark, n):
    rng = random.Random(n)
    sizes = [rng.choice([0, 3, 50, 1000, rng.randrange(1, 10**6)]) for _ in range(n)] if n > 1 else [77]
    names = sorted(f"s{i:02d}" for i in range(n))
    frame = spark.createDataFrame(list(zip(names, sizes, strict=True)), "__source string, source_size long")
    got = {r["__source"]: r.target for r in mixing.targets(frame).collect()}
    want = reshared(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 3)
    assert [got[x] for x in names] == pytest.approx(want)


@pytest.mark.parametrize("buckets", [1, 16, 4096])
def test_taken_words_come_near_the_targets(spark, buckets):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), "w " * rng.randrange(0, 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sizes(docs, buckets=buckets).collect()
    assert len(out) == len(rows)
    by = {}
    source = {i: s for i, s, _ in rows}
    for r in out:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        mine = by.setdefault(source[r.doc_id], [0, r.target])
        mine[0] += r.taken
    for taken, target in by.values():
        assert abs(taken - target) <= 40
    again = {tuple(r) for r in mixing.mix_sizes(docs.repartition(7), buckets=buckets).collect()}
    assert again == {tuple(r) for r in out}
    full = mixing.mixed(docs, buckets=buckets)
    assert full.columns == docs.columns
    assert full.count() == sum(r.copies for r in out)


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "x", "a b", 2), (None, "x", "a b", 2), (2, "x", "", 3), (2, "x", " c d e\n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mixing.mix_sizes(docs).collect()
    assert sorted(r.size for r in out) == [0, 0, 2, 2, 3]
    assert {r.target for r in out} == {0.0, 7.0}
    assert sum(r.taken for r in out) == 7
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_sizes(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_inclusion_follows_the_probabilities(spark):
    """400 sources with the same sizes under different identifiers draw alike; how often each size is drawn follows its probability."""
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]
    rows = [(s * 100 + k, f"s{s:03d}", "w " * n) for s in range(400) for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sizes(docs, weights=(3, 5)).collect()
    whole = {r.doc_id // 100: int(r.target // r.source_size) for r in out}
    words = sum(sizes)
    mean = sum(n * n.bit_length() for n in sizes) / words
    for odd, p in ((0, 0.75), (1, 0.25)):
        own = [r for r in out if r.doc_id // 100 % 2 == odd]
        want = [p + p * (1 - p) * (n.bit_length() - mean) / mixing.DOUBLINGS for n in sizes]
        assert sum(w * n for w, n in zip(want, sizes, strict=True)) == pytest.approx(p * words)
        for k, w in enumerate(want[:9]):
            drawn = sum(r.copies - whole[r.doc_id // 100] for r in own if r.doc_id % 100 == k) / 200
            assert abs(drawn - w) < 0.12, (p, k, drawn, w)
        assert want[0] < want[4] < want[-1]


def test_rank_is_random_odds_over_inclusion_odds(spark):
    rows = spark.createDataFrame([(7, 0.25, 0.5, 3.0), (100, 0.9, 0.1, 2.0), (5, 0.5, 0.0, 1.0)], "size long, u double, p double, mean double")
    got = [r[0] for r in rows.select(mixing.rank(F.col("size"), F.col("u"))).collect()]
    assert got[0] == pytest.approx((0.25 / 0.75) / (0.5 / 0.5))
    chance = 0.1 + 0.1 * 0.9 * (7 - 2) / 20
    assert got[1] == pytest.approx((0.9 / 0.1) / (chance / (1 - chance)))
    assert got[2] is None
