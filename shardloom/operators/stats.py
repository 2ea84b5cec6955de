"""Sizes of shuffle blocks: sums, offsets, codes, summaries, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Base of the size code and the size from which a block is huge.
LOG_BASE, HUGE = 1.1, 100 * 1024 * 1024


def bytes_by(df: DataFrame, size: Column, *keys: str) -> DataFrame:
    """Bytes of each block; keys name it."""
    return df.groupBy(*keys).agg(F.sum(size).cast("long").alias("bytes"))


def offsets(sizes: DataFrame, order: str, *group: str) -> DataFrame:
    """Each block's [start, stop) in its file: prefix sums by reduce id."""
    window = Window.partitionBy(*[F.col(g) for g in group] or [F.lit(0)]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("bytes").over(window).cast("long")
    return sizes.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("bytes"))


def size_code(size: Column) -> Column:
    """A size in 8 bits: 0, 1, or the base-1.1 logarithm rounded up, at most 255."""
    code = F.least(F.lit(255), F.ceil(F.log(size.cast("double")) / F.log(F.lit(LOG_BASE))))
    return F.when(size == 0, 0).when(size <= 1, 1).otherwise(code).cast("long")


def size_of_code(code: Column) -> Column:
    """The size that a code stands for."""
    return F.when(code == 0, 0).otherwise(F.floor(F.pow(F.lit(LOG_BASE), code))).cast("long")


def summary(sizes: DataFrame, threshold: int = HUGE, *group: str) -> DataFrame:
    """Blocks that are not empty, the average of those below the threshold over all of these, and the huge ones' number."""
    full, small = F.col("bytes") > 0, (F.col("bytes") > 0) & (F.col("bytes") < threshold)
    total = F.coalesce(F.sum(F.when(small, F.col("bytes"))), F.lit(0))
    n = F.count_if(full)
    average = F.when(n > 0, F.floor(total / n)).otherwise(0).cast("long")
    return sizes.groupBy(*group).agg(n.alias("blocks"), F.count_if(~full).alias("empty"), average.alias("average"), F.count_if(F.col("bytes") >= threshold).alias("huge"))


def large_shares(sizes: DataFrame, least: float, group: str) -> DataFrame:
    """The blocks that hold at least a share of their group's bytes."""
    share = F.col("bytes") / F.sum("bytes").over(Window.partitionBy(group))
    return sizes.withColumn("share", share).filter(F.col("share") >= least)


def without_outputs(sizes: DataFrame, lost: DataFrame, on: str) -> DataFrame:
    """The blocks that stay when those of lost executors are dropped."""
    return sizes.join(lost, on, "left_anti")
