"""Interpolated modified Kneser-Ney models of symbol grams, counted and weighed by shard.

The highest order counts occurrences, each lower order the number of distinct
symbols seen before the gram. With three discounts D(c) for each order, taken
from its counts of counts,

  P_k(g) = (c(g) - D(c(g))) / c(context of g) + lambda_k(context) P_(k-1)(g without its first symbol),

P_0 being uniform. A gram that the model has not seen has lambda times the lower
order's probability, so the log probability of a text is a sum over its gram
occurrences, of

  weight(g) = log P_k(g) - log(lambda_k(context) P_(k-1)(suffix)) + log lambda_(k+1)(g),

the last term being 0 if nothing follows g, and of one constant a symbol. That
is what lets scores be joined by gram and added up by document in any order.
Every text ends in a symbol that nothing follows, and begins after pads that are
given, not predicted.

All grams that have the same two symbols before their last one stand in one row,
as numbers of 21 bits a symbol. Their contexts and their suffixes of three
symbols and more stand in that row too, so it has all counts, totals and
probabilities of these orders, but for those of two symbols and one. Of these
there are no more than pairs of characters; they are worked out in the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.llm import grams
from shardloom.llm.common import cut, in_steps, let_workers_import
from shardloom.llm.simhash import runs

#: Symbols that the lowest order is uniform over.
UNIFORM = 1 << 20
#: Bits of a symbol, and gram occurrences that a task adds up before it sends them.
BITS, HELD = 21, 1 << 21
ONE = (1 << BITS) - 1


def counted(texts: DataFrame, names: list[str], order: int) -> DataFrame:
    """key (group's number and two symbols), grams, n: one row a key, the grams of the highest order that have these symbols before their last one, as the symbols before and the last one, and how often each occurs.

    texts: a group's name and a text.
    """
    number = {g: i for i, g in enumerate(names)}

    def added(parts):
        key, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, n = np.unique(grams.mixed(grams.mixed(key.view(np.uint64)) ^ gram.view(np.uint64)), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(gram[first]), pa.array(n.astype(np.int64))], names=["key", "gram", "n"])

    def over(batches):
        held, size = [], 0
        for batch in in_steps(batches):
            run, sizes = grams.symbols([b or "" for b in batch.column(1).to_pylist()], order)
            group = np.repeat(np.array([number[g] for g in batch.column(0).to_pylist()], np.int64), sizes)
            inside = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(inside >= order - 1)
            run = run.astype(np.int64)
            gram = np.zeros(len(at), np.int64)
            for back in (*range(order - 1, 2, -1), 0):
                gram = gram << BITS | run[at - back]
            held.append((group[at] << 2 * BITS | run[at - 2] << BITS | run[at - 1], gram))
            size += len(at)
            if size > HELD:
                yield from added(held)
                held, size = [], 0
        if size:
            yield from added(held)

    def one_row(batches):
        for rows in runs(batches):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            first = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            n = np.add.reduceat(rows[:, 2], first)
            key, gram = rows[first, 0], np.ascontiguousarray(rows[first, 1])
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            upto = pa.array(np.append(begin, len(key)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(key[begin]), pa.ListArray.from_arrays(upto, pa.array(gram)), pa.ListArray.from_arrays(upto, pa.array(n))], names=["key", "grams", "n"])

    let_workers_import(texts.sparkSession)
    parts = texts.mapInArrow(over, "key long, gram long, n long")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(one_row, "key long, grams array<long>, n array<long>")


class Levels:
    """The grams of rows of counted, for each order k from the highest down to 3: at[k] their row, gram[k] their symbols but the row's two, c[k] their counts, n[k] how often they occur, up[k] the places of their suffixes in order k - 1."""

    def __init__(self, batch: pa.RecordBatch, order: int):
        self.key = batch.column(0).to_numpy()
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        at, gram, c = np.repeat(np.arange(len(sizes)), sizes), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
        self.at, self.gram, self.c, self.n, self.up = {order: at}, {order: gram}, {order: c}, {order: c}, {}
        for k in range(order, 3, -1):
            tail = gram & ((1 << BITS * (k - 3)) - 1)
            by = np.lexsort((tail, at))
            new = np.append(True, (at[by][1:] != at[by][:-1]) | (tail[by][1:] != tail[by][:-1]))[: len(by)]
            self.up[k] = np.empty(len(by), np.int64)
            self.up[k][by] = np.cumsum(new) - 1
            at, gram, c = at[by][new], tail[by][new], np.bincount(self.up[k])
            self.at[k - 1], self.gram[k - 1], self.c[k - 1] = at, gram, c
            self.n[k - 1] = np.bincount(self.up[k], self.n[k]).astype(np.int64)
        self.group = self.key >> 2 * BITS


def discounts(n: np.ndarray) -> np.ndarray:
    """D(1), D(2) and D(3 and more) in columns 1 to 3; n: how many grams occur 1, 2, 3 and 4 times, in columns 1 to 4."""
    n = n.astype(np.float64)
    out = np.zeros((len(n), 4))
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.where(n[:, 1] > 0, n[:, 1] / (n[:, 1] + 2 * n[:, 2]), 0.5)
        for j in (1, 2, 3):
            plain = np.where(n[:, j] > 0, j - (j + 1) * y * n[:, j + 1] / n[:, j], 0.5 * j)
            out[:, j] = np.clip(plain, 0.05, j - 0.05)
    return out


def _shares(c: np.ndarray, d: np.ndarray, context: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """What each gram has of its context's total by itself, and what each context leaves to the lower order."""
    total = np.maximum(np.bincount(context, c, contexts), 1)  # contexts without grams are not asked for
    return (c - d) / total[context], np.bincount(context, d, contexts) / total


def _keys(symbols: list[np.ndarray], seeds: np.ndarray) -> pa.Array:
    """The keys of grams, given symbol by symbol, under the seeds of their groups and order."""
    hashes = np.zeros(len(seeds), np.uint64)
    for x in symbols:
        hashes = hashes * np.uint64(grams.GRAM_FACTOR) + grams._point_hashes()[x]
    return pa.array(grams.key_of(hashes, seeds).view(np.int64))


def _rows(key: pa.Array, k: int, n: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64)), pa.array(weight)], names=["key", "k", "n", "weight"])


def _symbols(packed: np.ndarray, n: int) -> list[np.ndarray]:
    return [packed >> BITS * (n - 1 - i) & ONE for i in range(n)]


def weights(texts: DataFrame, names: list[str], seeds: np.ndarray, order: int = 5) -> tuple[DataFrame, dict[str, float]]:
    """key, k (order), n (how often it occurs), weight of every gram and context of the groups' models; and the constant of a symbol of each group that has texts.

    texts: a group's name and a text; seeds: one row a name, one column an order.
    """
    if order not in (3, 4, 5):
        raise ValueError("grams have 3 to 5 symbols")
    spark = texts.sparkSession
    top = cut(counted(texts, names, order))

    def told(batches):
        for batch in in_steps(batches):
            own = Levels(batch, order)
            pairs = (own.key[own.at[3]] >> 2 * BITS << 2 * BITS) | ((own.key[own.at[3]] & ONE) << BITS) | own.gram[3]
            kind, code, often = [np.full(len(pairs), 2)], [pairs], own.n[3]
            for k in range(3, order + 1):
                few = own.c[k] <= 4
                code.append(own.group[own.at[k]][few] * 8 + own.c[k][few])
                kind.append(np.full(len(code[-1]), k))
            found, of, n = np.unique(np.stack([np.concatenate(kind), np.concatenate(code)], axis=1), axis=0, return_inverse=True, return_counts=True)
            often = np.bincount(of.reshape(-1)[: len(often)], often, len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in found.T), pa.array(n.astype(np.int64)), pa.array(often)], names=["kind", "code", "n", "often"])

    found = top.mapInArrow(told, "kind long, code long, n long, often long").groupBy("kind", "code").agg(F.sum("n").alias("n"), F.sum("often").alias("often")).orderBy("kind", "code").toArrow()
    kind, code, n, often = (found.column(i).to_numpy() for i in range(4))
    times = np.zeros((order + 1, len(names), 5), np.int64)
    for k in range(3, order + 1):
        times[k, code[kind == k] // 8, code[kind == k] % 8] = n[kind == k]

    # orders 2 and 1
    pair, c2, often = code[kind == 2], n[kind == 2], often[kind == 2]
    of2 = pair >> 2 * BITS
    single, up, c1 = np.unique(of2 << BITS | pair & ONE, return_inverse=True, return_counts=True)
    of1 = single >> BITS
    for k, of, c in ((2, of2, c2), (1, of1, c1)):
        np.add.at(times[k], (of[c <= 4], c[c <= 4]), 1)
    cut_by = np.stack([discounts(x) for x in times])
    before, context = np.unique(pair >> BITS, return_inverse=True)
    own1, lam1 = _shares(c1, cut_by[1][of1, np.minimum(c1, 3)], of1, len(names)) if len(c1) else (np.zeros(0), np.zeros(len(names)))
    own2, lam2 = _shares(c2, cut_by[2][of2, np.minimum(c2, 3)], context, len(before))
    p1 = own1 + lam1[of1] / UNIFORM
    p2 = own2 + lam2[context] * p1[up]
    of_before = before >> BITS
    small = pa.Table.from_batches([
        _rows(_keys(_symbols(single, 1), seeds[of1, 0]), 1, np.bincount(up, often, len(c1)), np.log(p1 / (lam1[of1] / UNIFORM))),
        _rows(_keys(_symbols(pair, 2), seeds[of2, 1]), 2, often, np.log(p2 / (lam2[context] * p1[up]))),
        _rows(_keys(_symbols(before, 1), seeds[of_before, 0]), 1, np.bincount(context, often, len(before)), np.log(lam2)),
    ])
    bases = {names[g]: float(np.log(lam1[g]) - np.log(UNIFORM)) for g in np.unique(of1).tolist()}
    shared = spark.sparkContext.broadcast((pair, p2))

    def weighed(batches):
        pair, p2 = shared.value
        for batch in in_steps(batches):
            own = Levels(batch, order)
            two = _symbols(own.key, 2)
            below = p2[np.searchsorted(pair, (own.group[own.at[3]] << 2 * BITS) | ((own.key[own.at[3]] & ONE) << BITS) | own.gram[3])]
            for k in range(3, order + 1):
                at, gram, c = own.at[k], own.gram[k], own.c[k]
                by = np.lexsort((gram >> BITS, at))
                new = np.append(True, (at[by][1:] != at[by][:-1]) | (gram[by][1:] >> BITS != gram[by][:-1] >> BITS))[: len(by)]
                context = np.empty(len(by), np.int64)
                context[by] = np.cumsum(new) - 1
                some = by[new]
                share, lam = _shares(c, cut_by[k][own.group[at], np.minimum(c, 3)], context, len(some))
                lower = lam[context] * (below if k == 3 else below[own.up[k]])
                p = share + lower
                symbols = _symbols(gram, k - 2)
                yield _rows(_keys([*symbols[:-1], *(x[at] for x in two), symbols[-1]], seeds[own.group[at], k - 1]), k, own.n[k], np.log(p / lower))
                first = [x[some] for x in symbols[:-1]]
                yield _rows(_keys([*first, *(x[at[some]] for x in two)], seeds[own.group[at[some]], k - 2]), k - 1, np.bincount(context, own.n[k], len(some)), np.log(lam))
                below = p

    each = cut(top.mapInArrow(weighed, "key long, k int, n long, weight double"))
    # a gram and the context that it is stand in different rows
    lower = each.filter(F.col("k") < order).union(spark.createDataFrame(small, "key long, k int, n long, weight double"))
    lower = cut(lower.groupBy("key", "k").agg(F.max("n").alias("n"), F.sum("weight").alias("weight")))
    return each.filter(F.col("k") == order).union(lower.select("key", "k", "n", "weight")), bases
