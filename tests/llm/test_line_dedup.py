"""Patience alignment and the query against plain Python."""

import random

import pytest

from shardloom.llm import line_dedup
from shardloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def longest_rising(seconds):
    best = []
    for k, x in enumerate(seconds):
        best.append(1 + max([best[i] for i in range(k) if seconds[i] < x], default=0))
    return max(best, default=0)


def test_rising():
    rng = random.Random(2)
    for n in range(60):
        seconds = rng.sample(range(200), n)
        run = line_dedup.rising(list(enumerate(seconds)))
        assert len(run) == longest_rising(seconds)
        assert all(a < c and b < d for (a, b), (c, d) in zip(run, run[1:], strict=False))
        assert all(seconds[i] == j for i, j in run)


def test_aligned():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(25) for _ in range(rng.randrange(30))]
        b = [rng.randrange(25) for _ in range(rng.randrange(30))]
        found = line_dedup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:], strict=False))
    assert line_dedup.aligned([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert line_dedup.aligned([1, 9, 2, 5, 3], [7, 1, 2, 8, 3]) == [(0, 1), (2, 2), (4, 4)]
    assert line_dedup.blocks([1, 2, 9, 3], [1, 2, 3], [5, 5, 1, 5], 8) == [(0, 2)]


def all_pairs(rows, words):
    """Lines with words that a single patience alignment with each earlier document that shares a line deletes."""
    rows = sorted(rows)
    lines = {doc: text.split("\n") if text else [] for doc, text in rows}
    holders = {}
    for doc, mine in lines.items():
        for line in dict.fromkeys(mine):
            if line.split():
                holders.setdefault(line, []).append(doc)
    out = {}
    for doc, mine in lines.items():
        sizes = [len(x.encode().split()) for x in mine]
        out[doc] = set()
        for other in {o for x, n in zip(mine, sizes, strict=True) if n for o in holders[x] if o < doc}:
            for a, b in line_dedup.blocks(mine, lines[other], sizes, words):
                out[doc] |= {k for k in range(a, b) if sizes[k]}
    return out


def in_common(rows, words):
    """Lines with words in any run of `words` words that any earlier document holds too: every equal diagonal of every pair."""
    out, before = {}, []
    for doc, text in sorted(rows):
        mine = text.split("\n") if text else []
        sizes = [len(x.encode().split()) for x in mine]
        out[doc] = set()
        for theirs, at in before:
            for i, line in enumerate(mine):
                for k in at.get(line, ()):
                    if i and k and mine[i - 1] == theirs[k - 1]:
                        continue
                    n = 1
                    while i + n < len(mine) and k + n < len(theirs) and mine[i + n] == theirs[k + n]:
                        n += 1
                    if sum(sizes[i : i + n]) >= words:
                        out[doc] |= {x for x in range(i, i + n) if sizes[x]}
        at = {}
        for k, line in enumerate(mine):
            at.setdefault(line, []).append(k)
        before.append((mine, at))
    return out


def deleted(spark, rows, words=line_dedup.WORDS):
    """Deleted lines with words, by identifier; the text that is left is checked on the way."""
    texts, out = dict(rows), {}
    for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect():
        lines = texts[r.doc_id].split("\n") if texts[r.doc_id] else []
        gone = {k for a, b in r.deleted for k in range(a, b)}
        assert (r.n_lines, r.n_deleted) == (len(lines), len(gone))
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[r.doc_id] = {k for k in gone if lines[k].split()}
    return out


def test_query_deletes_what_any_earlier_document_holds(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: {k for a, b in r.deleted for k in range(a, b)} for r in QUERIES["op5_line_dedup"](spark, SF).collect()}
    texts = {doc: text.split("\n") if text else [] for doc, text in rows}
    got = {doc: {k for k in gone if texts[doc][k].split()} for doc, gone in got.items()}
    pairwise = all_pairs(rows, line_dedup.WORDS)
    assert all(pairwise[doc] <= got[doc] for doc in got)
    assert got == in_common(rows, line_dedup.WORDS)
    assert sum(map(len, got.values())) > 100


@pytest.mark.parametrize("words", [1, 4, 8])
def test_small_tables_against_every_block(spark, words):
    rng = random.Random(words)
    pool = [" ".join(f"w{k}" for k in range(rng.randrange(7))) + f" x{i}" * (i > 3) for i in range(14)]
    rows = []
    for doc in range(150):
        lines = [rng.choice(pool) for _ in range(rng.randrange(9))]
        rows.append((doc, "\n".join(lines + (rng.choices(pool, k=3) if doc % 3 else []))))
    got, pairwise = deleted(spark, rows, words), all_pairs(rows, words)
    assert got == in_common(rows, words)
    assert all(pairwise[doc] <= got[doc] for doc in got)


@pytest.mark.parametrize("copies", [1, 3, 4, 8, 40])
def test_copies_go_however_many_there_are(spark, copies):
    """Two lines first held by two documents apart, then together by many; and two blocks in another order than their owner's."""
    one, two, x, y = "a b c d e", "f g h i j", "k l m n o p q r", "s t u v w x y z"
    rows = [(1, f"{one}\nother"), (2, f"more\n{two}"), (3, f"{x}\n{y}")]
    rows += [(10 + i, f"own {i}\n{one}\n{two}\nend {i}") for i in range(copies + 1)] + [(100 + i, f"{y}\nnew {i}\n{x}") for i in range(copies)]
    got = deleted(spark, rows)
    assert not got[1] and not got[2] and not got[3] and not got[10]
    assert all(got[11 + i] == {1, 2} and got[100 + i] == {0, 2} for i in range(copies))


def test_long_texts_and_a_frequent_owner(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "DEALT", 16)
    passage = [f"line {k} of the passage that everybody quotes" for k in range(40)]
    long = [f"sentence {k} of a very long text of its own" for k in range(20_000)]
    rows = [(1, "\n".join(long + passage)), (2, "\n".join(passage[::-1] + long[::-1]))] + [(k, "\n".join([f"own {k}", *passage[k % 5 : 30]])) for k in range(3, 300)]
    got = deleted(spark, rows)
    assert not got[1] and len(got[2]) == 20_040
    assert all(got[k] == set(range(1, 31 - k % 5)) for k in range(3, 300))


def test_odd_rows(spark):
    long = "one two three four five six seven eight nine"
    rows = [(2, f"{long}\nend", "a"), (None, long, "b"), (1, f"start\n{long}", "c"), (3, None, "d"), (4, "", "e"), (5, f"{long}\n{long}", "f"), (1, f"start\n{long}", "c"), (6, "end", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines string")
    got = sorted((r.doc_id or -1, r.text, r.n_deleted, r.deleted) for r in line_dedup.line_dedup(df).collect())
    assert [x for x in got if x[0] != 5] == [(-1, "", 1, [[0, 1]]), (1, f"start\n{long}", 0, []), (1, f"start\n{long}", 0, []), (2, "end", 1, [[0, 1]]), (3, "", 0, []), (4, "", 0, []), (6, "end", 0, [])]
    assert next(x[2:] for x in got if x[0] == 5) == (2, [[0, 2]])  # each of its lines stands in an earlier document
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_gaps_without_unique_lines():
    p, later = [1, 2, 3], [10, 1, 2, 3, 11, 1, 2, 3, 12]
    for a, b in ((later, [20, *p, 21]), ([20, *p, 21], later)):
        assert [a[i] for i, _ in line_dedup.aligned(a, b)] == p
        assert line_dedup.blocks(a, b, [5] * len(a), 15)
    assert len(line_dedup.aligned([8, *[7, 9] * 2000, 8, 5], [4, *[9, 7] * 2000, 6])) >= 3000
