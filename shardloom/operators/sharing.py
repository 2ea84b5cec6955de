"""Broadcast lookups, caching, checkpoints, and choices of the storage layer."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.sources.tables import cut

#: Rows and bytes of a lookup side that are broadcast at most; a row counts its values' text and VALUE_BYTES for each.
BROADCAST_ROWS, BROADCAST_BYTES, VALUE_BYTES = 1_000_000, 64 << 20, 16

#: The storage levels by name.
LEVELS = {
    "NONE": StorageLevel(False, False, False, False),
    "DISK_ONLY": StorageLevel(True, False, False, False),
    "DISK_ONLY_2": StorageLevel(True, False, False, False, 2),
    "MEMORY_ONLY": StorageLevel(False, True, False, True),
    "MEMORY_ONLY_2": StorageLevel(False, True, False, True, 2),
    "MEMORY_ONLY_SER": StorageLevel(False, True, False, False),
    "MEMORY_ONLY_SER_2": StorageLevel(False, True, False, False, 2),
    "MEMORY_AND_DISK": StorageLevel(True, True, False, True),
    "MEMORY_AND_DISK_2": StorageLevel(True, True, False, True, 2),
    "MEMORY_AND_DISK_SER": StorageLevel(True, True, False, False),
    "MEMORY_AND_DISK_SER_2": StorageLevel(True, True, False, False, 2),
    "OFF_HEAP": StorageLevel(True, True, True, False),
}


def broadcast_lookup(df: DataFrame, side: DataFrame, on, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES, how: str = "inner") -> DataFrame:
    """A join that broadcasts the side if it has at most `most` rows of `most_bytes` in all; a larger one is left to the planner.

    The side is measured in one job, which stops reading once it has too many rows.
    """
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") + VALUE_BYTES for c in side.columns), F.lit(0).cast("long"))
    rows, size = side.limit(most + 1).select(width.alias("width")).agg(F.count("*"), F.coalesce(F.sum("width"), F.lit(0))).first()
    return df.join(F.broadcast(side) if rows <= most and size <= most_bytes else side, on, how)


def cached(df: DataFrame, level: str = "MEMORY_AND_DISK") -> DataFrame:
    """df kept at a storage level; NONE leaves it alone."""
    return df if level == "NONE" else df.persist(LEVELS[level])


@contextmanager
def keeping(df: DataFrame, level: str = "MEMORY_AND_DISK") -> Iterator[DataFrame]:
    """df kept at a storage level while the block runs."""
    kept = cached(df, level)
    try:
        yield kept
    finally:
        if level != "NONE":
            kept.unpersist()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that all executors share."""
    return cut(df)


def eviction_order(blocks: DataFrame, used: str, block: str, *group: str) -> DataFrame:
    """Blocks numbered from the one used longest ago: the order in which a full store drops them."""
    return blocks.withColumn("turn", F.row_number().over(Window.partitionBy(*group).orderBy(used, block)).cast("long"))


def replica_peers(blocks: DataFrame, block: str, peers: list, held: Column, count: int) -> DataFrame:
    """For each block `count` of the peers that hold no replica yet (held: array of those that do), in an order drawn from its name.

    The draw is a digest, so every run and every node chooses alike. Peers are
    the cluster's nodes, a list; each block orders them in its own row.
    """
    free = F.filter(F.array(*map(F.lit, peers)), lambda p: ~F.array_contains(held, p))
    drawn = F.transform(free, lambda p: F.struct(F.sha2(F.concat_ws(":", F.col(block).cast("string"), p.cast("string")), 256).alias("draw"), p.alias("peer")))
    return blocks.select(block, F.posexplode(F.slice(F.array_sort(drawn), 1, count)).alias("turn", "p")).select(block, (F.col("turn") + 1).cast("long").alias("turn"), F.col("p.peer").alias("peer"))


def spill_choice(consumers: DataFrame, need: int, used: str, *group: str) -> DataFrame:
    """The bytes of the consumer that spills: the smallest that frees enough, else the largest."""
    enough = F.min(F.when(F.col(used) >= need, F.col(used)))
    return consumers.groupBy(*group).agg(F.coalesce(enough, F.max(used)).alias("spills"))


def memory_shares(tasks: DataFrame, pool: int, held: str, *group: str) -> DataFrame:
    """The least and most that each of n active tasks may hold: 1/2n and 1/n of the pool; and what it may still take."""
    n = F.count("*").over(Window.partitionBy(*group))
    most = F.floor(F.lit(pool) / n)
    return tasks.withColumn("least", F.floor(F.lit(pool) / (2 * n)).cast("long")).withColumn("most", most.cast("long")).withColumn("room", F.greatest(F.lit(0), most - F.col(held)).cast("long"))
