"""Rules of storage, shuffle and tracking, as plans over tables that hold their state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from shardloom.functions.textual import adler32
from shardloom.operators.partitioning import hash_string, non_negative_hash

#: Partitions up to which a writer opens a file for each, and up to which records can be sorted serialized.
BYPASS, SERIALIZED = 200, 1 << 24
#: Maps and reducers from which no locations are preferred, the least share of a preferred one, and reducers beyond which a status holds an average.
PREFER_MAPS, PREFER_REDUCES, PREFER_SHARE, DETAILED = 1000, 1000, 0.2, 2000
#: Growth of the distance between size samples, bytes of a broadcast piece.
SAMPLE_GROWTH, PIECE = 1.1, 4 << 20


def evicted(blocks: DataFrame, space: int, owner: Column, mode: Column, used: list[str], size: str, *group: str) -> DataFrame:
    """The blocks that make room, with their turn, from the one used longest ago; owner, mode: whether a block is the asker's own, and of its memory mode.

    Only blocks of the same mode that are not the asker's own can go, as many as
    it takes; where all of them are not enough, none goes.
    """
    order = Window.partitionBy(*group).orderBy(*used)
    able = blocks.filter(mode & ~F.coalesce(owner, F.lit(False)))
    able = able.withColumn("turn", F.row_number().over(order).cast("long")).withColumn("freed", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    able = able.withColumn("all", F.sum(size).over(Window.partitionBy(*group)))
    return able.filter((F.col("freed") - F.col(size) < space) & (F.col("all") >= space)).drop("freed", "all")


def writer_of(partitions: Column, combines: Column, aggregates: Column, relocatable: Column, bypass: int = BYPASS) -> Column:
    """The writer of a map task: a file for each partition, a sort of serialized records, or a sort of objects."""
    return F.when(~combines & (partitions <= bypass), "bypass").when(relocatable & ~aggregates & (partitions <= SERIALIZED), "serialized").otherwise("sort")


def registered(calls: DataFrame, maps: int) -> DataFrame:
    """shuffle, available (number of map outputs), missing (array of map ids), epoch; calls: shuffle, map, seq, call, location.

    An output is there from its last register on, unless an unregister names
    that location afterwards; every unregister starts a new epoch.
    """
    adds, own = F.col("call") == "register", Window.partitionBy("shuffle", "map")
    last = F.max(F.when(adds, F.struct("seq", "location"))).over(own)
    gone = ~adds & (F.col("seq") > F.col("last.seq")) & (F.col("location") == F.col("last.location"))
    outputs = calls.withColumn("last", last).withColumn("gone", gone).groupBy("shuffle", "map")
    outputs = outputs.agg(F.max("last").isNotNull().alias("known"), F.coalesce(F.bool_or("gone"), F.lit(False)).alias("gone"), F.count_if(~adds).alias("calls"))
    there = F.sort_array(F.collect_set(F.when(F.col("known") & ~F.col("gone"), F.col("map"))))
    every = F.array(*[F.lit(m).cast("long") for m in range(maps)])
    state = outputs.groupBy("shuffle").agg(there.alias("there"), F.sum("calls").alias("epoch"))
    return state.select("shuffle", F.size("there").cast("long").alias("available"), F.array_except(every, "there").alias("missing"), "epoch")


def sample_points(most: int, growth: float = SAMPLE_GROWTH) -> list[int]:
    """The updates after which a growing collection is measured: each the last one times the growth, rounded up."""
    points = [1]
    while points[-1] < most:
        points.append(math.ceil(growth * points[-1]))
    return points


def sampled_growth(updates: DataFrame, size: str, group: str, *order: str, most: int = 1 << 31) -> DataFrame:
    """Each update with its number, the collection's true size and what the last two samples make of it."""
    window = Window.partitionBy(group).orderBy(*order)
    rows = updates.withColumn("n", F.row_number().over(window).cast("long")).withColumn("actual", F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    taken = F.col("n").isin(sample_points(most))
    past = Window.partitionBy(group).orderBy("n")
    upto, before = past.rowsBetween(Window.unboundedPreceding, 0), past.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("sample", F.when(taken, F.struct("n", "actual")))
    rows = rows.withColumn("previous", F.when(taken, F.last("sample", ignorenulls=True).over(before)))
    rows = rows.withColumn("earlier", F.last(F.when(taken, F.struct("previous")), ignorenulls=True).over(upto)["previous"]).withColumn("latest", F.last("sample", ignorenulls=True).over(upto))
    each = (F.col("latest.actual") - F.col("earlier.actual")) / (F.col("latest.n") - F.col("earlier.n"))
    grown = F.coalesce(F.greatest(F.lit(0.0), each), F.lit(0.0)) * (F.col("n") - F.col("latest.n"))
    return rows.select(group, "n", "actual", (F.col("latest.actual") + grown).cast("long").alias("estimate"))


def granted(requests: DataFrame, held: DataFrame, block: str) -> DataFrame:
    """requests (block, writes) with granted: readers share a block, a writer needs it alone; held: block, writes."""
    locks = held.groupBy(block).agg(F.count_if(F.col("writes")).alias("writers"), F.count_if(~F.col("writes")).alias("readers"))
    free = (F.coalesce("writers", F.lit(0)) == 0) & (~F.col("writes") | (F.coalesce("readers", F.lit(0)) == 0))
    return requests.join(locks, block, "left").withColumn("granted", free).drop("writers", "readers")


def locations(replicas: DataFrame, block: str, location: str, lost: Column) -> DataFrame:
    """block and the sorted locations that still hold it."""
    return replicas.filter(~lost).groupBy(F.col(block).alias("block")).agg(F.sort_array(F.collect_set(location)).alias("locations"))


def local_place(name: Column, dirs: int, subdirs: int) -> tuple[Column, Column]:
    """The folder of a block's file by its name's hash: number, and name of the folder below."""
    h = non_negative_hash(hash_string(name))
    return F.pmod(h, F.lit(dirs)), F.lower(F.lpad(F.hex(F.pmod(F.floor(h / dirs), F.lit(subdirs))), 2, "0"))


def pieces(rows: DataFrame, body: str, size: int = PIECE) -> DataFrame:
    """The pieces in which a value is broadcast: number, bytes, checksum."""
    n = F.ceil(F.octet_length(body) / size).cast("int")
    number = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    part = F.substring(F.col(body).cast("binary"), F.col("piece") * size + 1, F.lit(size))
    return rows.withColumn("piece", F.explode(number)).withColumn("part", part).withColumn("bytes", F.octet_length("part")).withColumn("checksum", adler32(F.col("part"))).drop(body, "part")


def preferred(sizes: DataFrame, least: float = PREFER_SHARE, maps: int = PREFER_MAPS, reduces: int = PREFER_REDUCES) -> DataFrame:
    """The map locations that hold at least a share of a reducer's bytes, in shuffles with fewer maps and reducers than the limits; sizes: shuffle, map, reduce, bytes."""
    counts = sizes.groupBy("shuffle").agg(F.count_distinct("map").alias("maps"), F.count_distinct("reduce").alias("reduces"))
    small = counts.filter((F.col("maps") < maps) & (F.col("reduces") < reduces)).select("shuffle")
    share = F.col("bytes") / F.sum("bytes").over(Window.partitionBy("shuffle", "reduce"))
    return sizes.join(small, "shuffle", "left_semi").withColumn("share", share).filter(F.col("share") >= least)


def reported(sizes: DataFrame, code: Column, decoded: Column, detailed: int = DETAILED) -> DataFrame:
    """map, reduce and the size that the map's status reports: its code's, or beyond `detailed` reducers the average of the map's blocks that are not empty."""
    own = Window.partitionBy("map")
    full = F.col("bytes") > 0
    average = F.floor(F.sum("bytes").over(own) / F.greatest(F.lit(1), F.sum(full.cast("int")).over(own)))
    size = F.when(F.count("*").over(own) <= detailed, decoded).when(full, average).otherwise(0).cast("long")
    return sizes.withColumn("code", code).select("map", "reduce", size.alias("reported"))


def scope_json(identifier: Column, name: Column, parent: Column | None = None) -> Column:
    """The label of an operation and of those around it."""
    fields = [identifier.cast("string").alias("id"), name.alias("name")]
    return F.to_json(F.struct(*fields, *([parent.alias("parent")] if parent is not None else [])))


@contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[str]:
    """Labels the jobs inside with a scope that nests in the one around it."""
    context, key = spark.sparkContext, "spark.rdd.scope"
    before = context.getLocalProperty(key)
    label = json.dumps({"name": name} | ({"parent": json.loads(before)} if before else {}))
    context.setLocalProperty(key, label)
    context.setJobDescription(name)
    try:
        yield label
    finally:
        context.setLocalProperty(key, before)
        context.setJobDescription(json.loads(before)["name"] if before else None)


def on_completion(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df, and what hears of its metrics once its rows have been worked out."""
    heard = Observation(name)
    return df.observe(heard, *[m.alias(k) for k, m in metrics.items()]), heard


def string_bytes(text: Column) -> Column:
    """Bytes of a string object: its header and fields, and its array rounded up to words of 8."""
    return (24 + F.floor((16 + F.octet_length(text) + 7) / 8) * 8).cast("long")
