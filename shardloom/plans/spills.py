"""Queries of external combining, map output, fetching and dropping, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import spilling
from shardloom.plans.policies import SHUFFLES, shuffle_sizes
from shardloom.plans.registry import DOC_BYTES, doc_bytes, register
from shardloom.sources.tables import table

RUNS = "SELECT *, l_suppkey % 4 AS task, (row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey) - 1) // 100 AS run, count(*) OVER (PARTITION BY l_suppkey % 4) // 100 AS whole FROM lineitem"


def line_runs(spark, sf_dir):
    """Lines as they come to four tasks that spill every hundred rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 4).alias("task"))
    return spilling.overflowing(rows, 100, ["l_orderkey", "l_linenumber", "l_partkey"], "task")


@register("spilled_runs", f"SELECT task, run, run < whole AS spilled, count(*) AS n, min(l_orderkey) AS least FROM ({RUNS}) GROUP BY 1, 2, 3")
def spilled_runs(spark, sf_dir):
    return line_runs(spark, sf_dir).groupBy("task", "run", "spilled").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"))


@register("merge_spills", f"SELECT l_partkey % 5 AS partition, l_partkey AS key, CAST(sum(l_linenumber) AS BIGINT) AS total, count(DISTINCT (task, run)) AS runs FROM ({RUNS}) GROUP BY 1, 2")
def merge_spills(spark, sf_dir):
    rows = line_runs(spark, sf_dir).select("task", "run", "l_linenumber", (F.col("l_partkey") % 5).alias("partition"), F.col("l_partkey").alias("key"))
    return spilling.merged(rows, "l_linenumber", "partition", "key")


@register("spill_batches", "SELECT o_orderkey, run, partition, (row_number() OVER (PARTITION BY run ORDER BY partition, o_orderkey) - 1) // 50 AS batch, row_number() OVER (PARTITION BY run, partition ORDER BY o_orderkey) - 1 AS place FROM (SELECT o_orderkey, o_custkey % 3 AS run, o_custkey % 7 AS partition FROM orders)")
def spill_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("run"), (F.col("o_custkey") % 7).alias("partition"))
    return spilling.batches_of(rows, "partition", ["o_orderkey"], "run", size=50)


@register("map_output_lengths", f"WITH t AS ({DOC_BYTES}) SELECT m.map, list(coalesce(bytes, 0) ORDER BY r) AS lengths FROM (SELECT DISTINCT map FROM t) m CROSS JOIN range(16) g(r) LEFT JOIN t ON t.map = m.map AND t.reduce = r GROUP BY 1")
def map_output_lengths(spark, sf_dir):
    """Five map tasks whose files hold sixteen partitions, five of them empty."""
    return spilling.lengths(doc_bytes(spark, sf_dir), "reduce", "bytes", 16, "map")


@register("partition_results", "SELECT r AS partition, count(p_partkey) AS n, coalesce(max(p_partkey), -1) AS last FROM range(64) g(r) LEFT JOIN part ON p_size = r GROUP BY 1")
def partition_results(spark, sf_dir):
    """What each of 64 partitions gives its handler, the empty ones too."""
    found = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("partition")).agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))
    return spilling.every_partition(found, "partition", 64, {"n": 0, "last": -1})


@register("sorted_pairs", "SELECT l_orderkey, flatten(list_sort(list([l_linenumber::BIGINT, l_partkey]))) AS pairs FROM lineitem GROUP BY 1")
def sorted_pairs(spark, sf_dir):
    pair = F.array(F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.flatten(F.collect_list(pair)).alias("pairs"))
    return lines.select("l_orderkey", spilling.sorted_pairs(F.col("pairs")).alias("pairs"))


FETCH_SQL = """
WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY address ORDER BY block, size) AS n
  FROM (SELECT o_custkey AS address, o_orderkey AS block, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 1000 END AS size FROM orders) WHERE size > 0),
r AS (SELECT address, size, n, 0::BIGINT AS request, size::BIGINT AS held, 1::BIGINT AS k FROM b WHERE n = 1
  UNION ALL SELECT b.address, b.size, b.n, r.request + (r.held > 1000 OR r.k >= 4)::BIGINT,
    CASE WHEN r.held > 1000 OR r.k >= 4 THEN 0 ELSE r.held END + b.size, CASE WHEN r.held > 1000 OR r.k >= 4 THEN 0 ELSE r.k END + 1
  FROM r JOIN b ON b.address = r.address AND b.n = r.n + 1)
SELECT address, CASE WHEN address % 10 = 0 THEN -1 ELSE request END AS request, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS bytes FROM r GROUP BY 1, 2"""


@register("fetch_requests", FETCH_SQL)
def fetch_requests(spark, sf_dir):
    """Orders as blocks at their customers; every tenth customer is at hand."""
    size = F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(F.col("o_orderkey") % 1000)
    blocks = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("address"), F.col("o_orderkey").cast("long").alias("block"), size.alias("size"))
    asked = spilling.fetch_requests(blocks, F.col("address") % 10 == 0, 5000, 4)
    return asked.groupBy("address", "request").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"))


@register("worker_cache", "WITH c AS (SELECT user_id, event_id, event_id % 3 AS shuffle, CASE WHEN event_id % 7 = 0 THEN event_id // 100 % 5 END AS epoch FROM events), n AS (SELECT *, coalesce(max(epoch) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS now FROM c) SELECT user_id, event_id, now, row_number() OVER (PARTITION BY user_id, shuffle, now ORDER BY event_id) > 1 AS hit FROM n WHERE epoch IS NULL")
def worker_cache(spark, sf_dir):
    """Users as workers: events ask for one of three shuffles or bring an epoch."""
    event = F.col("event_id")
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", (event % 3).alias("shuffle"), F.when(event % 7 == 0, F.floor(event / 100) % 5).alias("epoch"))
    return spilling.cached_statuses(calls, "event_id", "epoch", "shuffle", "user_id").select("user_id", "event_id", "now", "hit")


@register("drop_from_memory", "SELECT event_id, event_id % 2 = 0 AND event_id % 3 <> 0 AS writes, event_id % 2 = 0 OR event_id % 3 = 0 AS disk, CASE WHEN event_id % 5 <> 0 THEN strlen(coalesce(props, '')) ELSE 0 END AS freed, (event_id % 2 = 0 AND event_id % 3 <> 0) OR event_id % 5 <> 0 AS updated FROM events")
def drop_from_memory(spark, sf_dir):
    event = F.col("event_id")
    out = spilling.dropped(table(spark, sf_dir, "events"), event % 2 == 0, event % 3 == 0, event % 5 != 0, F.octet_length(F.coalesce("props", F.lit(""))))
    return out.select("event_id", "writes", "disk", "freed", "updated")


@register("disk_read_choice", "SELECT o_orderkey, o_orderkey * 1024 >= 2097152 AS mapped, (o_orderkey * 100 >= 524288)::BIGINT AS tag FROM orders")
def disk_read_choice(spark, sf_dir):
    """Blocks that are mapped into memory, and statuses that are broadcast, by their size."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", spilling.is_mapped(n * 1024).alias("mapped"), spilling.status_tag(n * 100).alias("tag"))


@register("unregister_shuffle", f"SELECT DISTINCT shuffle, 'shuffle_' || shuffle || '_' || map || '_0' || kind AS file FROM ({SHUFFLES}) CROSS JOIN (VALUES ('.data'), ('.index')) k(kind)")
def unregister_shuffle(spark, sf_dir):
    return spilling.shuffle_files(shuffle_sizes(spark, sf_dir), "shuffle", "map")
