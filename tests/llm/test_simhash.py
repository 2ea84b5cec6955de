"""SimHash groups against all pairs, and the pieces they are made of."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from shardloom.llm import simhash
from shardloom.llm.bloom import SET, _position, bloom_filter, may_hold
from shardloom.llm.components import _forest_of, components

SF = "/root/testdata/sf0.01"


def brute(rows, shingle, distance):
    """Fingerprints bit by bit, links by all pairs, components by search."""
    prints = {}
    for doc, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], dtype=np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= distance
    part = {}
    for i in range(len(ids)):
        if i in part:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in part:
                part[x] = ids[i]
                todo += np.nonzero(near[x])[0].tolist()
    return sorted((d, f"{prints[d]:016x}", part[i]) for i, d in enumerate(ids))


def got(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize(("shingle", "distance", "bucket"), [(4, 4, simhash.BUCKET), (5, 9, simhash.BUCKET), (4, 4, 3)])
def test_all_documents_against_all_pairs(spark, shingle, distance, bucket):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    frame = simhash.near_groups(docs, shingle=shingle, distance=distance, bucket=bucket)
    assert got(frame) == brute(rows, shingle, distance)


@pytest.mark.parametrize("t", range(5))
def test_signatures_meet_up_to_the_threshold(t):
    rng = random.Random(t)
    bits = sorted(rng.sample(range(64), 12))
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for x in rng.sample(bits, t):
            b ^= 1 << x
        for x in set(range(64)) - set(bits):
            b ^= rng.getrandbits(1) << x
        keys = simhash.signatures(np.array([a, b], dtype=np.uint64), [(bits, t)])
        assert set(keys[0]) & set(keys[1])
        assert keys.shape[1] == simhash.signature_rows(12, t)


@pytest.mark.parametrize("distance", [0, 2, 4, 9, 14])
def test_thresholds_cover_the_distance(distance):
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < 0.5).astype(float)
    plan = simhash.allotted((bits.T @ bits).astype(int), 500, distance)
    used = {b for g, _ in plan for b in g}
    assert len(used) == sum(len(g) for g, _ in plan)
    assert sum(t + 1 for _, t in plan) == distance + 1  # a pair that misses every partition differs in more bits


def test_distance_that_cannot_be_covered():
    with pytest.raises(ValueError, match="distance of 40"):
        simhash.allotted(np.eye(64, dtype=int), 10, 40)


def test_odd_rows(spark):
    rows = [(3, None, "x"), (None, "", "y"), (7, " \n", "z"), (1, "a b c d e f", "q"), (1, "a b c d e f", "q"), (9, "A B C D E F", "q"), (None, "zz yy xx ww vv uu", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = simhash.near_groups(frame, shingle=4, distance=0).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == [(1, 1), (1, 1), (3, 3), (7, 3), (9, 1)]
    assert sorted((r.component_id or -1) for r in found if r.doc_id is None) == [-1, 3]
    assert simhash.near_groups(frame.limit(0)).count() == 0


def test_bucket_links_keep_components():
    rng = np.random.default_rng(5)
    for n in (2, 5, 60, 700):
        centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
        w = centre[rng.integers(0, 3, n)]
        for _ in range(3):
            w = w ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        a, b = simhash.bucket_links(np.arange(n), w[:, None], 4, None)
        near = np.bitwise_count(w[:, None] ^ w[None, :]) <= 4
        assert all(near[x, y] for x, y in zip(a, b, strict=True))
        assert len(a) < n
        label = list(range(n))

        def find(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in zip(a, b, strict=True):
            label[find(x)] = find(y)
        reach = np.linalg.matrix_power((near | np.eye(n, dtype=bool)).astype(float), 1) > 0
        for _ in range(10):
            reach = (reach.astype(float) @ reach.astype(float)) > 0
        assert all((find(x) == find(y)) == reach[x, y] for x in range(0, n, 7) for y in range(n))


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([((i * 7919) % 10007, ((i + 1) * 7919) % 10007) for i in range(n)] + [(20001, 20002), (5, 5)], "a long, b long")
    parts = {r.node: r.component for r in components(edges).collect()}
    smallest = min((i * 7919) % 10007 for i in range(n + 1))
    assert set(parts.values()) == {smallest, 20001}
    assert len(parts) == n + 1 - 1 + 1


def test_components_take_few_queries(spark):
    """A round is five queries that the driver plans; edges that a task holds together take one round, however long their paths."""
    n = 500
    at = random.Random(3).sample(range(n), n)
    edges = spark.createDataFrame([(at[i], at[i + 1]) for i in range(n - 1)], "a long, b long").coalesce(1)
    store = spark._jsparkSession.sharedState().statusStore()
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        before = store.executionsCount()
        parts = components(edges)
        assert store.executionsCount() - before <= 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert {(r.node, r.component) for r in parts.collect()} == {(x, 0) for x in range(1, n)}


def test_components_that_one_task_holds_take_no_rounds(spark):
    """However many partitions edges are dealt over, few edges take three queries."""
    n = 500
    at = random.Random(4).sample(range(n), n)
    edges = spark.createDataFrame([(at[i], at[i + 1]) for i in range(n - 1)], "a long, b long").repartition(9)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    parts = components(edges)
    assert store.executionsCount() - before <= 3
    assert {(r.node, r.component) for r in parts.collect()} == {(x, 0) for x in range(1, n)}


def test_components_by_rounds_equal_those_of_one_task(spark):
    """Seven edges a task at most, so that rounds are needed: a path, a ring, a star and chance edges."""
    rng = random.Random(6)
    at = rng.sample(range(1000), 200)
    pairs = [(at[i], at[i + 1]) for i in range(79)] + [(at[100 + i], at[100 + (i + 1) % 20]) for i in range(20)] + [(at[120], x) for x in at[121:150]]
    pairs += [(rng.choice(at[150:]), rng.choice(at[150:])) for _ in range(40)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    one, many = ({(r.node, r.component) for r in components(edges, most=m).collect()} for m in (1 << 18, 7))
    assert one == many
    groups: dict[int, set[int]] = {x: {x} for p in pairs for x in p}
    for x, y in pairs:
        if groups[x] is not groups[y]:
            groups[x] |= groups[y]
            for z in groups[y]:
                groups[z] = groups[x]
    assert one == {(x, min(g)) for x, g in groups.items() if x != min(g)}


def test_contracted_edges_keep_components(spark):
    """Each node comes with the smallest one that it hangs together with, in one batch and over several tasks."""
    pick = random.Random(5)
    pairs = [(pick.randrange(-400, 400), pick.randrange(-400, 400)) for _ in range(500)]
    want = {}
    for x in sorted({y for p in pairs for y in p}):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += [q for p in pairs if y in p for q in p]
    edges = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    batches = [pa.RecordBatch.from_pydict({"u": [p[0] for p in edges[i : i + 90]], "v": [p[1] for p in edges[i : i + 90]]}) for i in range(0, len(edges), 90)]
    (whole,) = _forest_of(pa.Table.from_batches(batches).combine_chunks().to_batches()[0])
    assert dict(zip(*(c.to_pylist() for c in whole.columns), strict=True)) == {x: least for x, least in want.items() if x != least}
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert {x: least for x, least in want.items() if found.get(x, x) != least} == {}


def test_bloom_filter_bit_by_bit(spark):
    keys = np.random.default_rng(7).integers(-(1 << 63), 1 << 63, 700).tolist()
    filled = bloom_filter(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3))
    want = np.zeros(8 * len(filled), bool)
    for probe in range(SET):
        want[_position(np.array(keys, np.int64), probe, 8 * len(filled))] = True
    assert (np.unpackbits(filled, bitorder="little").astype(bool) == want).all()
    assert len(may_hold(filled, np.array(keys, np.int64))) == len(keys)
    assert not bloom_filter(spark.createDataFrame([], "k long")).any()
