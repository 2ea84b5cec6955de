"""External combining and sorting by rule: runs that overflow, their merge by partition, what a map task writes and a reader fetches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.sources.tables import let_workers_import

#: Records of a serialized batch, bytes from which a block is mapped into memory, and from which map statuses are broadcast.
BATCH, MAP_FROM, BROADCAST_FROM = 10_000, 2 << 20, 512 << 10
#: Tags of map statuses that are sent as they are, and by broadcast.
DIRECT, BROADCAST = 0, 1
#: Fixed value: requests that the bytes in flight are shared by.
REQUESTS = 5


def overflowing(rows: DataFrame, limit: int, arrival: list[str], *task: str) -> DataFrame:
    """rows with their run (`limit` rows each, in order of arrival at their task) and whether it is spilled; the rows after the last full run stay in memory."""
    nth = F.row_number().over(Window.partitionBy(*task).orderBy(*arrival)) - 1
    whole = F.floor(F.count("*").over(Window.partitionBy(*task)) / limit)
    rows = rows.withColumn("run", F.floor(nth / limit).cast("long"))
    return rows.withColumn("spilled", F.col("run") < whole)


def merged(runs: DataFrame, value: str, *keys: str) -> DataFrame:
    """total of value by keys, and the runs that it came from: each run is combined first, then runs with one another, those in memory like those spilled."""
    parts = runs.groupBy("task", "run", *keys).agg(F.sum(value).alias("total"))
    return parts.groupBy(*keys).agg(F.sum("total").cast("long").alias("total"), F.count("*").alias("runs"))


def batches_of(rows: DataFrame, partition: str, keys: list[str], *run: str, size: int = BATCH) -> DataFrame:
    """rows of spilled runs with the batch that each stands in and its place in its partition, as a reader meets them."""
    of_run = Window.partitionBy(*run).orderBy(partition, *keys)
    of_partition = Window.partitionBy(*run, partition).orderBy(*keys)
    rows = rows.withColumn("batch", F.floor((F.row_number().over(of_run) - 1) / size).cast("long"))
    return rows.withColumn("place", (F.row_number().over(of_partition) - 1).cast("long"))


def lengths(sizes: DataFrame, partition: str, size: str, n: int, *task: str) -> DataFrame:
    """The lengths of a task's one output file by partition, 0 where it has no rows."""
    held = F.map_from_entries(F.collect_list(F.struct(F.col(partition).cast("int"), "held")))
    by_task = sizes.groupBy(*task, partition).agg(F.sum(size).cast("long").alias("held")).groupBy(*task).agg(held.alias("held"))
    length = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.coalesce(F.try_element_at("held", p), F.lit(0)).cast("long"))
    return by_task.select(*task, length.alias("lengths"))


def every_partition(results: DataFrame, partition: str, n: int, none: dict) -> DataFrame:
    """One row for each partition from 0 to n - 1, with its result, or with `none` where it has no rows."""
    ids = results.sparkSession.range(n).select(F.col("id").alias(partition))
    return ids.join(results, partition, "left").fillna(none)


def sorted_pairs(pairs: Column) -> Column:
    """An array of keys and values in turn, sorted by key; equal keys by value."""
    pair = F.transform(F.sequence(F.lit(0), F.size(pairs) - 1, F.lit(2)), lambda i: F.array(F.get(pairs, i), F.get(pairs, i + 1)))
    return F.when(F.size(pairs) > 0, F.flatten(F.array_sort(pair))).otherwise(pairs)


def fetch_requests(blocks: DataFrame, local: Column, in_flight: int, most_blocks: int) -> DataFrame:
    """address, block, size, request from blocks (address, block, size).

    Blocks without bytes are not fetched; those of a local address are read
    there (request -1). The others of an address go into one request, in order,
    until it exceeds a fifth of the bytes in flight or holds most_blocks.
    Rows stream through in order of address, so no address is held as a whole.
    """
    target = max(in_flight // REQUESTS, 1)
    let_workers_import(blocks.sparkSession)

    def over(batches):
        at, request, held, count = None, 0, 0, 0
        for batch in batches:
            numbers = []
            for address, size, near in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if address != at:
                    at, request, held, count = address, 0, 0, 0
                elif held > target or count >= most_blocks:
                    request, held, count = request + 1, 0, 0
                held, count = held + size, count + 1
                numbers.append(-1 if near else request)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(numbers, pa.int64())], names=["address", "block", "size", "request"])

    rows = blocks.select("address", "block", F.col("size").cast("long").alias("size"), local.alias("local")).filter("size > 0")
    dealt = rows.repartition("address").sortWithinPartitions("address", "block", "size")
    return dealt.mapInArrow(over, "address long, block long, size long, request long")


def cached_statuses(calls: DataFrame, seq: str, epoch: str, shuffle: str, *worker: str) -> DataFrame:
    """The calls that ask for a shuffle (epoch is null), with the worker's epoch then, and whether its statuses were there.

    A call with a larger epoch than all before clears what the worker holds.
    """
    order = Window.partitionBy(*worker).orderBy(seq)
    calls = calls.withColumn("now", F.coalesce(F.max(epoch).over(order), F.lit(0)).cast("long"))
    asked = calls.filter(F.col(epoch).isNull())
    return asked.withColumn("hit", F.row_number().over(Window.partitionBy(*worker, shuffle, "now").orderBy(seq)) > 1)


def dropped(blocks: DataFrame, use_disk: Column, on_disk: Column, in_memory: Column, size: Column) -> DataFrame:
    """Blocks that are dropped from memory: whether they are written to disk, are on it then, what memory is freed, and whether anything changed."""
    writes = use_disk & ~on_disk
    return blocks.withColumns({"writes": writes, "disk": on_disk | writes, "freed": F.when(in_memory, size).otherwise(0).cast("long"), "updated": writes | in_memory})


def is_mapped(size: Column, least: int = MAP_FROM) -> Column:
    """Whether a block on disk is mapped into memory instead of read."""
    return size >= least


def status_tag(size: Column, least: int = BROADCAST_FROM) -> Column:
    """How packed map statuses of a size go to a worker."""
    return F.when(size >= least, F.lit(BROADCAST)).otherwise(F.lit(DIRECT)).cast("long")


def shuffle_files(outputs: DataFrame, shuffle: str, map_: str) -> DataFrame:
    """The files that go when a shuffle is unregistered: data and index of each map's output."""
    stem = F.concat_ws("_", F.lit("shuffle"), F.col(shuffle).cast("string"), F.col(map_).cast("string"), F.lit("0"))
    kinds = F.explode(F.array(F.lit(".data"), F.lit(".index"))).alias("kind")
    return outputs.select(shuffle, map_).distinct().select(shuffle, stem.alias("stem"), kinds).select(shuffle, F.concat("stem", "kind").alias("file"))
