"""Line dedup by pairwise alignment.

Overlapping documents are found by hashes of shared runs of lines: from each
line with words the shortest run that starts there and holds `words` words, and
the shortest that ends there. Any block of lines that two documents have in
common and that holds `words` words is covered by such runs within it. Each run
pairs a document with the run's owner, the earliest document that holds it, so a
pair comes for each run and document at most, however frequent the run, and no
document that holds a shared block goes without one. Lines that are frequent
only alone (a heading, a closing word) make no pairs.

The pair's line hashes are aligned by patience diff: lines that occur once in
both anchor the alignment by a longest rising run, and the gaps between anchors
are aligned the same way, after equal lines at their ends; a gap without such
lines is anchored by the common lines that are repeated least. A shared run that
the alignment leaves out (the two documents hold their blocks in another order)
is an anchor of its own, and its block goes on from it while lines are equal.
Aligned common blocks of at least `words` words are deleted from the later
document; shorter ones, such as a line of one word, are no evidence of copying
and stay. So exactly those lines with words go that lie in a block of `words`
words which an earlier document holds too.

Only hashes and word counts are shuffled for the search. A pair is aligned once,
whatever the number of runs that lead to it. An owner's lines are sent once to
each block of about DEALT later documents, and those documents' lines once for
each owner they have; texts are read twice and shuffled once, to be joined to
their deletions.

Defined results: null text has no lines; blank lines lead to no pair but are
deleted inside an aligned block; a null identifier comes after all others, and
rows that repeat an identifier are ordered by their text's hash, so equal rows
count as one document and keep their lines alike; repeats within a document
are no overlap; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm.common import arrow_map, cut, in_steps, raw

#: Words that an aligned common block must hold to be deleted.
WORDS = 8
#: Later documents of an owner that are aligned with it in one group, about.
DEALT = 512
#: Pairs of repeated lines up to which a gap is aligned by all of them; beyond it the k-th of one document meets the k-th of the other.
PAIRS = 1 << 20


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, in order of their first number, whose second rises: piles of patience."""
    tops: list[int] = []
    piles: list[list[tuple[int, int, int]]] = []
    for i, j in pairs:
        at = bisect_left(tops, j)
        back = len(piles[at - 1]) - 1 if at else -1
        if at == len(tops):
            tops.append(j)
            piles.append([])
        else:
            tops[at] = j
        piles[at].append((i, j, back))
    out: list[tuple[int, int]] = []
    at, k = len(piles) - 1, -1
    while at >= 0:
        i, j, back = piles[at][k]
        out.append((i, j))
        at, k = at - 1, back
    return out[::-1]


def rarest(a: list[int], b: list[int], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """A longest rising run of the pairs of the common lines of a[i:m] and b[j:n] that make the fewest pairs each."""
    here: dict[int, list[int]] = {}
    for x in range(i, m):
        here.setdefault(a[x], []).append(x)
    there: dict[int, list[int]] = {}
    for y in range(j, n):
        if b[y] in here:
            there.setdefault(b[y], []).append(y)
    fewest = min((len(here[h]) * len(ys) for h, ys in there.items()), default=0)
    few = [(here[h], ys) for h, ys in there.items() if len(here[h]) * len(ys) == fewest]
    if fewest * len(few) > PAIRS:
        return rising(sorted(pair for xs, ys in few for pair in zip(xs, ys, strict=False)))
    return rising(sorted(((x, y) for xs, ys in few for x in xs for y in ys), key=lambda p: (p[0], -p[1])))


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (in a, in b) of equal lines that patience diff aligns."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        here: dict[int, int] = {}
        for x in range(i, m):
            here[a[x]] = -1 if a[x] in here else x
        there: dict[int, int] = {}
        for y in range(j, n):
            there[b[y]] = -1 if b[y] in there else y
        anchors = rising([(x, there[h]) for h, x in here.items() if x >= 0 and there.get(h, -1) >= 0])
        if not anchors:
            anchors = rarest(a, b, i, m, j, n)
        if not anchors:
            continue
        for (x, y), (u, v) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            if (u, v) != (m, n):
                out.append((u, v))
            todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def blocks(a: list[int], b: list[int], sizes: list[int], words: int) -> list[tuple[int, int]]:
    """[start, end) of the runs of a's lines that follow each other in both documents and hold enough words."""
    out, run = [], None
    for i, j in [*aligned(a, b), (-9, -9)]:
        if run and (i, j) == (run[1], run[2]):
            run = (run[0], i + 1, j + 1)
            continue
        if run and sum(sizes[run[0] : run[1]]) >= words:
            out.append((run[0], run[1]))
        run = (i, i + 1, j + 1)
    return out


def runs(lines: list[int], sizes: list[int], words: int) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the shortest runs of `words` words from each line with words, and up to each."""
    raw_lines, found = np.array(lines, np.int64).tobytes(), []
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + n)
    whole, digest, end = upto[-1], xxhash.xxh3_64_intdigest, 0
    for i, n in enumerate(sizes):
        if not n:
            continue
        if whole - upto[i] < words:
            break
        while upto[end] - upto[i] < words:
            end += 1
        found.append((digest(raw_lines[8 * i : 8 * end]) - (1 << 63), i, end))
    start = 0
    for j, n in enumerate(sizes):
        if not n or upto[j + 1] < words:
            continue
        while upto[j + 1] - upto[start + 1] >= words:
            start += 1
        found.append((digest(raw_lines[8 * start : 8 * (j + 1)]) - (1 << 63), start, j + 1))
    return found


def overlaps(a: list[int], b: list[int], sizes: list[int], words: int, theirs: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """[start, end) of a's lines in aligned blocks, and in the blocks around shared runs that the alignment leaves out; theirs: where b holds each of its runs first."""
    out = blocks(a, b, sizes, words)
    gone = bytearray(len(a))
    for i, j in out:
        gone[i:j] = b"\1" * (j - i)
    for h, i, j in runs(a, sizes, words) if 0 in gone else ():
        at = theirs.get(h)
        if at is None or 0 not in gone[i:j] or a[i:j] != b[at[0] : at[1]]:
            continue
        k = at[0]
        n = at[1]
        while i and k and a[i - 1] == b[k - 1]:
            i, k = i - 1, k - 1
        while j < len(a) and n < len(b) and a[j] == b[n]:
            j, n = j + 1, n + 1
        gone[i:j] = b"\1" * (j - i)
        out.append((i, j))
    return out


def hashed_lines(df: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """doc_id, body_hash, lines (array of hashes), sizes (array of word counts), runs (array of hashes) of every row."""

    def over(batch):
        texts = batch.column(1).to_pylist()
        split = [x.split(b"\n") if x else [] for x in texts]
        lines = [[xxhash.xxh3_64_intdigest(y) - (1 << 63) for y in x] for x in split]
        sizes = [[len(y.split()) for y in x] for x in split]
        whole = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in texts]
        found = [list({r[0] for r in runs(x, n, words)}) for x, n in zip(lines, sizes, strict=True)]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), pa.array(lines, longs), pa.array(sizes, pa.list_(pa.int32())), pa.array(found, longs)], names=["doc_id", "body_hash", "lines", "sizes", "runs"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("body"))
    return arrow_map(slim, over, "doc_id long, body_hash long, lines array<long>, sizes array<int>, runs array<long>")


def _key():
    """A document's place: identifier (nulls last), then its text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("body_hash"))


def pairs_of(docs: DataFrame) -> DataFrame:
    """key, owner, n (a power of two), block: every document with the owners of its runs, those of an owner dealt into n blocks."""
    each = docs.select("key", F.explode("runs").alias("run"))
    owners = cut(each.groupBy("run").agg(F.min("key").alias("owner"), F.count("*").alias("documents")).filter("documents > 1"))
    owned = each.join(owners, "run").filter(F.col("key") != F.col("owner")).groupBy("key", "owner").agg(F.max("documents").alias("documents"))
    n = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("documents") / DEALT)))).cast("int")
    return cut(owned.select("key", "owner", n.alias("n")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")).cast("int")))


def deletions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with key, doc_id, lines; deletions with key, blocks)."""
    docs = cut(hashed_lines(df, id_col, text_col, words).withColumn("key", _key()).dropDuplicates(["key"]))
    pairs = pairs_of(docs)
    mine = docs.select("key", "lines", "sizes")
    groups = pairs.select(F.col("owner").alias("key"), "n", "block").distinct()
    heads = groups.join(mine, "key").select(F.col("key").alias("owner"), "n", "block", F.lit(0).alias("later"), "key", "lines", "sizes")
    later = pairs.join(mine, "key").select("owner", "n", "block", F.lit(1).alias("later"), "key", "lines", "sizes")
    dealt = heads.union(later).repartition("owner", "n", "block").sortWithinPartitions("owner", "n", "block", "later").select("later", "key", "lines", "sizes")

    def over(batches):
        theirs, their_runs = [], {}
        for batch in in_steps(batches):
            rows, spans = [], []
            columns = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for row, (later, lines, sizes) in enumerate(zip(*columns, strict=True)):
                if later:
                    found = overlaps(lines, theirs, sizes, words, their_runs)
                    rows += [row] * len(found)
                    spans += found
                else:
                    theirs, their_runs = lines, {h: (i, j) for h, i, j in reversed(runs(lines, sizes, words))}
            spans = np.array(spans, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows, pa.int64())), pa.array(np.ascontiguousarray(spans[:, 0])), pa.array(np.ascontiguousarray(spans[:, 1]))], names=["key", "start", "end"])

    kind = docs.schema["key"].dataType.simpleString()
    spans = dealt.mapInArrow(over, f"key {kind}, start int, end int").distinct()
    return docs, spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("blocks"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, text without the deleted lines, n_lines, n_deleted, deleted (array of [start, end) line numbers) of every row."""
    _, gone = deletions(df, id_col, text_col, words)
    rows = hashed_rows(df, id_col, text_col).join(gone, "key", "left").select(F.col("key.none").alias("none"), F.col("key.doc_id").alias("doc_id"), "body", "blocks")

    def over(batch):
        none, docs, bodies, cuts = (c.to_pylist() for c in batch.columns)
        ids, texts, n, deleted, spans = [], [], [], [], []
        for x, doc, body, found in zip(none, docs, bodies, cuts, strict=True):
            lines = body.decode().split("\n") if body else []
            drop: set[int] = set()
            for s in found or []:
                drop.update(range(s["start"], s["end"]))
            ids.append(None if x else doc)
            texts.append("\n".join(y for k, y in enumerate(lines) if k not in drop))
            n.append(len(lines))
            deleted.append(len(drop))
            merged: list[list[int]] = []
            for k in sorted(drop):
                if merged and merged[-1][1] == k:
                    merged[-1][1] = k + 1
                else:
                    merged.append([k, k + 1])
            spans.append(merged)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((ids, texts, n, deleted, spans), kinds, strict=True)], names=["doc_id", "text", "n_lines", "n_deleted", "deleted"])

    return arrow_map(rows, over, "doc_id long, text string, n_lines long, n_deleted long, deleted array<array<int>>")


def hashed_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key and body of every row."""

    def over(batch):
        whole = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, pa.int64())], names=["doc_id", "body", "body_hash"])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("body"))
    return arrow_map(slim, over, "doc_id long, body binary, body_hash long").select(_key().alias("key"), "body")
