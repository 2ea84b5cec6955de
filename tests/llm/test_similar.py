"""Groups by similarity of shingle sets against all pairs."""

import numpy as np
import pytest

from shardloom.llm import simhash

SF = "/root/testdata/sf0.01"


def sets_of(rows, shingle=5):
    out = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        out[doc] = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return out


def grouped(rows, least=0.8):
    """doc -> smallest of its group, by search over all pairs; and the number of pairs."""
    sets = sets_of(rows)
    holders = {}
    for doc, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(doc)
    empty = [d for d, s in sets.items() if not s]
    near, n = {d: set() for d in sets}, 0
    for doc, s in sets.items():
        for other in {o for g in s for o in holders[g]} | (set(empty) if not s else set()):
            if other < doc:
                both = len(s & sets[other])
                if both >= least * (len(s) + len(sets[other]) - both) - 1e-9:
                    near[doc].add(other)
                    near[other].add(doc)
                    n += 1
    part = {}
    for doc in sorted(sets):
        todo = [doc]
        while todo:
            x = todo.pop()
            if x not in part:
                part[x] = doc
                todo += near[x]
    return part, n


@pytest.mark.parametrize("small", [False, True])
def test_all_documents_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want, n = grouped(rows)
    assert n > 50
    settings = {"bucket": 50, "most_sets": 2, "most_shingles": 300} if small else {}
    got = {r.doc_id: (r.component_id, r.kept) for r in simhash.similar_groups(docs, **settings).collect()}
    assert {d: component for d, (component, _) in got.items()} == want
    assert all(kept == (d == component) for d, (component, kept) in got.items())


def test_similar_links():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**32, 60, dtype=np.uint32)) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.93], rng.integers(0, 2**32, 2, dtype=np.uint32)])) for b in base for _ in range(15)] + [np.zeros(0, np.uint32)] * 2
    found = simhash.similar_links(np.arange(len(sets)), sets, 0.8)

    def near(x, y):
        both = len(np.intersect1d(sets[x], sets[y]))
        return both >= 0.8 * (len(sets[x]) + len(sets[y]) - both) - 1e-9

    assert all(near(x, y) for x, y in found)
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in found:
        label[find(x)] = find(y)
    assert all(find(x) == find(y) for x in range(len(sets)) for y in range(x) if near(x, y))


def test_odd_rows(spark):
    rows = [(2, None, "a", 1), (None, "", "b", 2), (5, "one two three four five six", "c", 3), (5, "one two three four five six", "c", 3), (9, "One TWO three  four five six", "d", 4), (None, "other words", "e", 5), (5, "words that differ", "f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, body_hash int")
    kept = sorted((r.doc_id or -1, r.node) for r in simhash.similar_kept(df).collect())
    assert kept == [(-1, "e"), (2, "a"), (5, "c"), (5, "c"), (5, "f")]
    assert simhash.similar_kept(df).columns == df.columns
    assert simhash.similar_kept(df.limit(0)).count() == 0


def test_sets_that_share_half_a_digest_stay_apart(spark):
    rows = [(1, 7, 70), (2, 7, 71), (3, 7, 70), (4, 8, 80)]
    frame = spark.createDataFrame(rows, "doc_id long, node long, twin long")
    apart, numbers = simhash.told_apart(frame)
    got = {r.doc_id: r.node for r in apart.collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8 and len({*got.values()}) == 3
    assert numbers.renamed == {(7, 70): got[1], (7, 71): got[2]}
    same, none = simhash.told_apart(frame.filter("doc_id != 2"))
    assert {r.node for r in same.collect()} == {7, 8} and not none.renamed


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(7)
    parted = 0
    for n in [1, 2, 5, 16, 17, 63, 64, 65, 300, 1000, 4000] * 30:
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.3, 0.7, 0.9, 1.0])], rng.integers(0, 2**63, rng.integers(0, n // 4 + 2), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        differ = simhash.sketches_differ(simhash.sketch(x), simhash.sketch(y))
        assert differ <= len(x) + len(y) - 2 * both
        near, may = both >= 0.8 * (len(x) + len(y) - both) - 1e-9, differ <= (len(x) + len(y)) * 0.2 / 1.8 + 1e-9
        assert may or not near
        parted += not may
    assert parted > 100


def test_very_long_texts(spark):
    words = [f"w{i * i % 9973}-{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-5000])), (3, " ".join(words[30_000:])), (4, "x" * 500_000), (5, "x" * 500_000 + " y")]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def near_threshold_rows(seed=11):
    """Pairs at a similarity of 0.8 or a little above, short and longer ones, and unlike texts that share a common passage."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common = words(9)
    rows = []
    for _ in range(150):
        for n, more in ((8, 1), (16, 3), (24, 5), (204, 50)):
            text = words(n)
            rows += [text, text + words(more)]
        rows.append(common + words(20))
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("settings", [{}, {"bucket": 1}])
def test_no_pair_at_the_threshold_is_missed(spark, settings):
    rows = near_threshold_rows()
    want, n = grouped(rows)
    assert n == 600
    copies = [(d + 10_000, text.upper()) for d, text in rows[::3]]
    found = simhash.similar_groups(spark.createDataFrame(rows + copies, "doc_id long, text string"), **settings)
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert got == want | {d: want[d - 10_000] for d, _ in copies}


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    heavy = np.sort(rng.choice(60, 20, replace=False)).astype("<u8")
    weight = rng.integers(1, 100, 20)
    for _ in range(2000):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 30))).astype("<u8")
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 60, rng.integers(0, 3)).astype("<u8")]))
        both = len(np.intersect1d(x, y))
        if both < 0.8 * (len(x) + len(y) - both) - 1e-9:
            continue
        a, b = (simhash.prefix(s, 0.8, heavy, weight).tolist() for s in (x, y))
        rows = sorted((k, len(s), node, node, place, *simhash.parity(s).tolist()) for node, s, p in ((0, x, a), (1, y, b)) for place, k in enumerate(p))
        assert set(a) & set(b)
        assert any(len(u) for u, _, _ in simhash.run_pairs(np.array(rows, np.int64), 0.8))


def test_copies_that_differ_too_much_make_few_candidates(spark):
    """Sixty texts share all shingles that their prefixes begin with, but no two are similar; candidates grow as the texts, not as their pairs."""
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common = words(900)
    rows = [(i, " ".join(common + words(240))) for i in range(60)]
    slim = spark.createDataFrame([(bytearray(t.encode()),) for _, t in rows], "body binary").repartition(3)
    made = [simhash.shingle_hashes(t.encode(), 5) for _, t in rows]
    groups = [(simhash.set_digest(m)[0], simhash.set_digest(m)[0], *simhash.parity(m).tolist()) for m in made]
    columns = "node long, component long, " + ", ".join(f"p{k} long" for k in range(simhash.PARITY))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        got = simhash.missed_links(slim, spark.createDataFrame(groups, columns), simhash.Nodes({}), 5, 0.8).select("a", "b").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {x for r in got for x in r} == {g[0] for g in groups}
    assert len(got) <= 4 * 59 < 60 * 59 // 2
