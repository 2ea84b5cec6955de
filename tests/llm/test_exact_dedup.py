"""The radix trie and the exact groups."""

import random
from collections import defaultdict

from shardloom.llm import exact_dedup
from shardloom.llm.common import id_order, normal_space
from shardloom.llm.radix import RadixOwners


def test_trie_against_a_table_with_and_without_spill():
    rng = random.Random(7)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(12))) for _ in range(3000)] + [b"x" * 5000 + bytes([i % 7]) for i in range(400)]
    want = defaultdict(lambda: [None, 0])
    for i, k in enumerate(keys):
        mine = want[k]
        owner = None if i % 11 == 0 else (i * 7919) % 5003
        mine[0] = owner if not mine[1] or id_order(owner) < id_order(mine[0]) else mine[0]
        mine[1] += 1
    for limit in (1 << 40, 20_000, 300):
        trie = RadixOwners(limit)
        for i, k in enumerate(keys):
            trie.insert(k, None if i % 11 == 0 else (i * 7919) % 5003, 1, k)
        assert bool(trie.spills) == (limit < 1 << 40)
        assert sorted((t, c, id_order(o)) for o, c, t in trie.rows()) == sorted((k, c, id_order(o)) for k, (o, c) in want.items())


def in_memory(trie):
    """Bytes of the strings and tags that the trie's nodes hold, counted again."""
    total, stack = 0, [(trie.root, 0)]
    while stack:
        x, at = stack.pop()
        total += at + len(x.tag) + 200 if x.count else 0
        stack += [(y, at + len(y.edge)) for y in (x.kids or {}).values()]
    return total


def test_the_limit_holds_after_any_number_of_spills():
    rng = random.Random(11)
    stem = b"s" * 3000
    keys = [stem + b"%05d" % rng.randrange(10**5) + bytes(rng.randrange(300)) for _ in range(4000)]
    keys += [bytes([rng.randrange(256)]) + rng.randbytes(rng.randrange(600)) for _ in range(6000)] + keys[:1000]
    for limit in (1 << 18, 1 << 20):
        trie, most = RadixOwners(limit), 0
        for i, k in enumerate(keys):
            trie.insert(k, i, 1, k[:20])
            most = max(most, trie.held)
            if i % 500 == 0:
                assert trie.held == trie.root.load == in_memory(trie)
        assert trie.spills > 3
        assert 0 <= most <= limit + 4000
        assert trie.held == trie.root.load == in_memory(trie)
        assert sum(c for _, c, _ in trie.rows()) == len(keys)


def test_normal_space():
    import re

    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("ab \t\n\r\x0b\x0c\x1c ") for _ in range(rng.randrange(10))).encode()
        assert normal_space(text) == re.sub(rb"[\x20\x09-\x0D]+", b" ", text)


def test_odd_rows(spark):
    rows = [(5, "a  b", "u"), (3, "a\tb", "v"), (3, "a b", "v"), (None, "a b", "w"), (None, None, "w"), (8, "", "x"), (9, " a b", "y"), (None, "alone", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    out = sorted(((r.doc_id or -1), (r.keep_id or -1), r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert out == [(-1, -1, 1, True), (-1, 3, 4, False), (-1, 8, 2, False), (3, 3, 4, False), (3, 3, 4, True), (5, 3, 4, False), (8, 8, 2, True), (9, 9, 1, True)]
    kept = sorted((r.doc_id or -1, r.text, r.keep_id) for r in exact_dedup.distinct_rows(df, limit=1).collect())
    assert [(a, c) for a, _, c in kept] == [(-1, "z"), (3, "v"), (8, "x"), (9, "y")]
    assert exact_dedup.exact_groups(df.limit(0)).count() == exact_dedup.distinct_rows(df.limit(0)).count() == 0
