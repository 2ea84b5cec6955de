"""Partitioned block files: written once by partition id, read by any subset of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shardloom.operators.partitioning import on_partitions


def write_blocks(df: DataFrame, path: str, partition: Column, n: int, mode: str = "errorifexists") -> None:
    """Rows dealt by partition id into one folder each; Spark's commit protocol lets one attempt of a task win."""
    df.withColumn("partition", partition.cast("int")).repartition(n, "partition").write.mode(mode).partitionBy("partition").parquet(path)


def read_blocks(spark: SparkSession, path: str, n: int, wanted: list[int] | None = None) -> DataFrame:
    """The rows of some partitions (all without a list); other folders are not opened."""
    rows = spark.read.parquet(path)
    return rows if wanted is None else on_partitions(rows, F.col("partition"), n, wanted)


def append_blocks(df: DataFrame, path: str, partition: Column, n: int) -> None:
    """More rows for the same partitions; what is there stays."""
    write_blocks(df, path, partition, n, "append")
