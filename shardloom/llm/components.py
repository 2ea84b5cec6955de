"""Connected components of an edge table by alternating large and small stars, or by one task's contraction once it holds all edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.llm.common import cut, let_workers_import

#: Edges that a task contracts at a time.
CONTRACTED = 1 << 18


def _forest_of(batch: pa.RecordBatch):
    """Of the edges (u, v) of a batch: each node with the smallest one that it hangs together with by them, itself left out."""
    parent: dict[int, int] = {}
    for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        while (up := parent.setdefault(y, y)) != y:
            parent[y] = y = parent[up]
        if x != y:
            parent[max(x, y)] = min(x, y)
    ends: list[int] = []
    for x in sorted(parent):  # a parent is smaller than its child, so its own end is known already
        parent[x] = parent[parent[x]]
        ends.append(parent[x])
    u, v = np.array(sorted(parent), np.int64), np.array(ends, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) that join what the edges of each task join, all to the smallest node."""

    def over(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from _forest_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n = [], 0
        if n:
            yield from _forest_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    let_workers_import(edges.sparkSession)
    return edges.mapInArrow(over, "u long, v long")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every v of a u, and u itself, points to the smallest of them; kept where v is on u's larger side by the caller."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, most: int = CONTRACTED) -> DataFrame:
    """node, component (smallest node reachable) of every node that has an edge to another.

    edges may repeat and point either way; self-loops and nulls are left out.
    Each round halves the distance to the smallest node at least, and is cut, so
    the plan stays small; nothing but two figures comes to the driver. The
    smallest neighbours are cut too, so that a hub's edges are joined by a
    shuffle that adaptive execution can split. What each task holds of the edges
    is contracted to stars before a cut: a round is five queries that the driver
    plans and keeps track of, and so there are few rounds. No task's contraction
    makes a node's smallest neighbour larger, and stars stay as they are, so the
    edges stand still only once they are the components' stars.

    A task contracts up to `most` edges at once, so edges are gathered in as few
    tasks as hold them at that, and `most` or fewer need no round: one task's
    contraction of them all is the result.
    """
    e = cut(_contracted(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), most))
    before = _mark(e)
    for _ in range(rounds):
        if before[0] <= most:
            e = cut(_contracted(e.coalesce(1), most)) if before[0] else e
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = cut(large)
        joined = _star(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        e = cut(_contracted(small.filter("u > v").distinct().coalesce(-(-before[0] // most)), most))
        now = _mark(e)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("components: no end after the given rounds")
