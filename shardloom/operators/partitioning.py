"""Partition ids as expressions, so that results do not depend on the physical plan.

The hash of a key is the JVM's: an int's is itself, a long's its halves
exclusive-or, a string's 31*h + c over UTF-16 units. Null goes to partition 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_WORD = 1 << 32


def _signed(h: Column) -> Column:
    """A number below 2**32 as a signed 32-bit one, in a long."""
    return F.when(h >= 1 << 31, h - _WORD).otherwise(h)


def hash_long(key: Column) -> Column:
    key = key.cast("long")
    return _signed(key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(_WORD - 1))


def hash_string(key: Column) -> Column:
    units = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    fold = lambda h, u: (h * 31 + u) % _WORD
    high, low = lambda u: F.floor((u - 65536) / 1024) + 0xD800, lambda u: (u - 65536) % 1024 + 0xDC00
    step = lambda h, u: F.when(u < 65536, fold(h, u)).otherwise(fold(fold(h, high(u)), low(u)))
    return _signed(F.aggregate(units, F.lit(0).cast("long"), step))


def non_negative_hash(h: Column) -> Column:
    """Absolute value; null and the smallest int give 0."""
    return F.coalesce(F.when(h == -(1 << 31), F.lit(0).cast("long")).otherwise(F.abs(h)), F.lit(0).cast("long"))


def partition_of(h: Column, n: int) -> Column:
    """Partition of a key's hash: non-negative remainder, null to 0."""
    return F.coalesce(F.pmod(h, F.lit(n).cast("long")), F.lit(0).cast("long"))


def hash_partitioned(df: DataFrame, partition: Column, n: int) -> DataFrame:
    """df dealt so that rows of one partition id share a task; adds the column partition."""
    return df.withColumn("partition", partition).repartition(n, "partition")


def on_partitions(df: DataFrame, partition: Column, n: int, wanted: list[int]) -> DataFrame:
    """The rows of some partitions; an index out of range is an error, an empty list gives no rows."""
    wrong = [p for p in wanted if not 0 <= p < n]
    if wrong:
        raise IndexError(f"partitions {wrong} are not among 0 to {n - 1}")
    return df.filter(partition.isin(wanted) if wanted else F.lit(False))


def union_ranges(*frames: DataFrame) -> DataFrame:
    """Bag union; the column part says which frame a row is from, as a range of the result's partitions does."""
    out = None
    for k, frame in enumerate(frames):
        frame = frame.withColumn("part", F.lit(k))
        out = frame if out is None else out.unionByName(frame)
    return out


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and the others (null counts as not met)."""
    met = F.coalesce(condition, F.lit(False))
    return df.filter(met), df.filter(~met)


def range_partition(key: Column, bounds: list) -> Column:
    """The range that a key falls in: the number of bounds below it; null to 0."""
    return F.coalesce(sum((key > F.lit(b)).cast("long") for b in bounds), F.lit(0).cast("long"))
