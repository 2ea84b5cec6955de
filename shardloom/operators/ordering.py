"""Order within partitions, global order, merging of sorted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sorted_partitions(df: DataFrame, partition: Column, n: int, *keys: str) -> DataFrame:
    """Rows dealt by partition id and ordered by (partition, key) in each task."""
    return df.withColumn("partition", partition).repartition(n, "partition").sortWithinPartitions("partition", *keys)


def first_of_partitions(df: DataFrame, partition: Column, count: int, *keys: str) -> DataFrame:
    """The first rows of each partition in key order, with their place from 1.

    Spark plans the limit below the shuffle too, so each task sends at most
    count rows of a partition.
    """
    place = F.row_number().over(Window.partitionBy("partition").orderBy(*keys))
    return df.withColumn("partition", partition).withColumn("place", place.cast("long")).filter(F.col("place") <= count)


def merge_runs(key: str, *runs: DataFrame) -> DataFrame:
    """Sorted runs as one order by (key, run); place is the position among a key's rows."""
    out = None
    for k, run in enumerate(runs):
        run = run.withColumn("run", F.lit(k))
        out = run if out is None else out.unionByName(run)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("run", *[c for c in out.columns if c not in (key, "run")])).cast("long"))


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Global order: range partitioning, then a sort in each task."""
    return df.orderBy(*keys)


def peek(df: DataFrame, group: str, value: str, *keys: str) -> DataFrame:
    """Each row with the value of the row after it in its group, null after the last."""
    return df.withColumn("head", F.lead(value).over(Window.partitionBy(group).orderBy(*keys)))
