"""Registry of queries and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shardloom.functions import textual
from shardloom.operators import keyed, ordering, partitioning, sharing, stats
from shardloom.sources import blocks
from shardloom.sources.tables import shared_dir, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    """Adds a query function under a name, with its DuckDB SQL if there is one."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def money(column: str):
    """Doubles as exact decimals, so that sums do not depend on the order of addition."""
    return F.col(column).cast("decimal(18,2)")


def total(column: str):
    return F.sum(money(column)).cast("decimal(38,2)")


# Aggregation by key


@register("reduce_by_key_sum", "SELECT l_orderkey AS key, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS value FROM lineitem GROUP BY 1")
def reduce_by_key_sum(spark, sf_dir):
    return keyed.combine_by_key(table(spark, sf_dir, "lineitem"), "l_orderkey", value=total("l_quantity"))


@register("combine_by_key_count_sum", "SELECT l_suppkey AS key, count(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY 1")
def combine_by_key_count_sum(spark, sf_dir):
    return keyed.combine_by_key(table(spark, sf_dir, "lineitem"), "l_suppkey", n=F.count("*"), total=total("l_extendedprice"))


@register("combine_by_key_total_order", "SELECT p_brand AS key, CAST(min(p_size) AS INTEGER) AS least, CAST(max(p_size) AS INTEGER) AS most, count(*) AS n FROM part GROUP BY 1")
def combine_by_key_total_order(spark, sf_dir):
    return ordering.sort_by_key(keyed.combine_by_key(table(spark, sf_dir, "part"), "p_brand", least=F.min("p_size"), most=F.max("p_size"), n=F.count("*")), "key")


@register("combine_opaque_triple", "SELECT o_custkey AS key, max(o_orderkey) - min(o_orderkey) AS value FROM orders GROUP BY 1")
def combine_opaque_triple(spark, sf_dir):
    """Any three Python functions: here the spread of a key's values."""
    return keyed.combine_opaque(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", lambda v: (v, v), lambda v, c: (min(v, c[0]), max(v, c[1])), lambda c, d: (min(c[0], d[0]), max(c[1], d[1])), lambda c: c[1] - c[0], "long")


@register("group_values_by_key", "SELECT o_custkey AS key, list_sort(list(o_orderkey)) AS values FROM orders GROUP BY 1")
def group_values_by_key(spark, sf_dir):
    return keyed.group_by_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@register("null_key_group", "SELECT key, coalesce(key % 7, 0) AS partition, n FROM (SELECT nullif(c_nationkey, 3) AS key, count(*) AS n FROM customer GROUP BY 1)")
def null_key_group(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("k", F.nullif("c_nationkey", F.lit(3)))
    return keyed.combine_by_key(rows, "k", n=F.count("*")).withColumn("partition", partitioning.partition_of(partitioning.hash_long(F.col("key")), 7)).withColumn("partition", F.col("partition").cast("int"))


@register("upsert_last_wins", "SELECT user_id AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def upsert_last_wins(spark, sf_dir):
    return keyed.upsert(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id")


@register("update_count", "SELECT user_id AS key, 60 + 2 * (count(*) - 1) AS value FROM events GROUP BY 1")
def update_count(spark, sf_dir):
    return keyed.update_counter(table(spark, sf_dir, "events"), "user_id", 60, 2)


@register("lookup_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 32")
def lookup_key(spark, sf_dir):
    return keyed.lookup(table(spark, sf_dir, "orders"), "o_custkey", 32).select("o_orderkey", "o_totalprice")


@register("global_agg", "SELECT count(*) AS n, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total, max(l_shipdate) AS latest FROM lineitem")
def global_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), total("l_extendedprice").alias("total"), F.max("l_shipdate").alias("latest"))


@register("commit_winner", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS winner, count(*) AS attempts FROM events GROUP BY 1, 2")
def commit_winner(spark, sf_dir):
    return keyed.first_committed(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "ts", "event_id")


@register("commit_after_failures", "SELECT user_id, arg_min(event_id, (ts, event_id)) FILTER (value >= 10) AS winner, count(*) AS attempts FROM events GROUP BY 1")
def commit_after_failures(spark, sf_dir):
    """Attempts of low value count as failed."""
    return keyed.first_committed(table(spark, sf_dir, "events"), ["user_id"], "event_id", "ts", "event_id", failed=F.col("value") < 10)


# Projection, filtering, sets


@register("map_project", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(38,4)) AS revenue FROM lineitem")
def map_project(spark, sf_dir):
    revenue = (money("l_extendedprice") * (1 - money("l_discount"))).cast("decimal(38,4)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", revenue.alias("revenue"))


@register("filter_predicate", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_predicate(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@register("flat_map", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flat_map(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@register("split_by_predicate", "SELECT o_orderkey, coalesce(o_totalprice >= 150000, false) AS met FROM orders")
def split_by_predicate(spark, sf_dir):
    met, rest = partitioning.split_by(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") >= 150000)
    return met.withColumn("met", F.lit(True)).unionByName(rest.withColumn("met", F.lit(False))).select("o_orderkey", "met")


@register("partition_function", "SELECT l_orderkey % 16 AS partition, count(*) AS n, max(l_partkey) AS most FROM lineitem GROUP BY 1")
def partition_function(spark, sf_dir):
    """One value for each partition, from all its rows."""
    rows = table(spark, sf_dir, "lineitem").withColumn("partition", partitioning.partition_of(partitioning.hash_long(F.col("l_orderkey")), 16))
    return rows.groupBy("partition").agg(F.count("*").alias("n"), F.max("l_partkey").alias("most"))


@register("union_range", "SELECT c_custkey AS key, c_acctbal AS balance, 0 AS part FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 1 FROM supplier")
def union_range(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return partitioning.union_ranges(customers, suppliers)


@register("set_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def set_membership(spark, sf_dir):
    members = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(members, "o_custkey", "left_semi").select("o_orderkey")


# Partitioning


@register("hash_partition_long", "SELECT l_orderkey AS key, l_orderkey % 7 AS partition FROM lineitem")
def hash_partition_long(spark, sf_dir):
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(key.alias("key"), partitioning.partition_of(partitioning.hash_long(key), 7).alias("partition"))


STRING_HASH = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296)"


@register("hash_partition_string", f"SELECT key, ((s % 7) + 7) % 7 AS partition FROM (SELECT key, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS s FROM (SELECT p_name AS key, {STRING_HASH.format('p_name')} AS h FROM part))")
def hash_partition_string(spark, sf_dir):
    key = F.col("p_name")
    return table(spark, sf_dir, "part").select(key.alias("key"), partitioning.partition_of(partitioning.hash_string(key), 7).alias("partition"))


@register("non_negative_hash", f"SELECT key, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS hash FROM (SELECT c_name AS key, {STRING_HASH.format('c_name')} AS h FROM customer)")
def non_negative_hash(spark, sf_dir):
    key = F.col("c_name")
    return table(spark, sf_dir, "customer").select(key.alias("key"), partitioning.non_negative_hash(partitioning.hash_string(key)).alias("hash"))


@register("partition_subset_agg", "SELECT o_custkey % 8 AS partition, count(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM orders WHERE o_custkey % 8 IN (1, 4, 6) GROUP BY 1")
def partition_subset_agg(spark, sf_dir):
    """A job over some partitions."""
    partition = partitioning.partition_of(partitioning.hash_long(F.col("o_custkey")), 8)
    rows = partitioning.on_partitions(table(spark, sf_dir, "orders"), partition, 8, [1, 4, 6])
    return rows.groupBy(partition.alias("partition")).agg(F.count("*").alias("n"), total("o_totalprice").alias("total"))


@register("block_roundtrip", "SELECT o_orderkey, o_totalprice, CAST(o_custkey % 5 AS INTEGER) AS partition FROM orders WHERE o_custkey % 5 IN (0, 3)")
def block_roundtrip(spark, sf_dir):
    """Partitioned files written and two of their partitions read."""
    path = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    partition = partitioning.partition_of(partitioning.hash_long(F.col("o_custkey")), 5)
    blocks.write_blocks(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), path, partition, 5)
    return blocks.read_blocks(spark, path, 5, [0, 3]).select("o_orderkey", "o_totalprice", "partition")


# Order


@register("sort_within_partition_first_n", "SELECT * FROM (SELECT o_orderkey, o_totalprice, o_custkey % 8 AS partition, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_totalprice, o_orderkey) AS place FROM orders) WHERE place <= 5")
def sort_within_partition_first_n(spark, sf_dir):
    partition = partitioning.partition_of(partitioning.hash_long(F.col("o_custkey")), 8)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return ordering.first_of_partitions(rows, partition, 5, "o_totalprice", "o_orderkey").drop("o_custkey")


@register("sorted_partitions", "SELECT o_orderkey, o_custkey, o_custkey % 8 AS partition FROM orders")
def sorted_partitions(spark, sf_dir):
    partition = partitioning.partition_of(partitioning.hash_long(F.col("o_custkey")), 8)
    return ordering.sorted_partitions(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), partition, 8, "o_custkey", "o_orderkey")


@register("merge_sorted_runs", "SELECT key, id, run, row_number() OVER (PARTITION BY key ORDER BY run, id) AS place FROM (SELECT c_nationkey AS key, c_custkey AS id, 0 AS run FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier)")
def merge_sorted_runs(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"))
    return ordering.merge_runs("key", customers, suppliers)


@register("sort_by_key", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_by_key(spark, sf_dir):
    return ordering.sort_by_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@register("take_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def take_first(spark, sf_dir):
    """A top-k report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@register("peek_next", "SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS head FROM events")
def peek_next(spark, sf_dir):
    return ordering.peek(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", "event_id").select("user_id", "event_id", "head")


# Sizes of blocks

DOC_BYTES = "SELECT doc_id % 5 AS map, doc_id % 11 AS reduce, CAST(SUM(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2"


def doc_bytes(spark, sf_dir):
    """Bytes of each (map, reduce) block if documents were dealt by identifier."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("map"), (F.col("doc_id") % 11).alias("reduce"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return stats.bytes_by(rows, F.col("size"), "map", "reduce")


@register("partition_bytes", f"SELECT reduce, CAST(SUM(bytes) AS BIGINT) AS bytes FROM ({DOC_BYTES}) GROUP BY 1")
def partition_bytes(spark, sf_dir):
    return stats.bytes_by(doc_bytes(spark, sf_dir), F.col("bytes"), "reduce")


@register("partition_offsets", f"SELECT *, stop - bytes AS start FROM (SELECT *, CAST(SUM(bytes) OVER (PARTITION BY map ORDER BY reduce) AS BIGINT) AS stop FROM ({DOC_BYTES}))")
def partition_offsets(spark, sf_dir):
    return stats.offsets(doc_bytes(spark, sf_dir), "reduce", "map")


SIZE_CODE = "CASE WHEN {0} = 0 THEN 0 WHEN {0} <= 1 THEN 1 ELSE CAST(least(255, ceil(ln({0}) / ln(1.1::DOUBLE))) AS BIGINT) END"


@register("block_size_code", f"SELECT map, reduce, bytes, CAST({SIZE_CODE.format('bytes')} AS BIGINT) AS code FROM ({DOC_BYTES})")
def block_size_code(spark, sf_dir):
    return doc_bytes(spark, sf_dir).withColumn("code", stats.size_code(F.col("bytes")))


@register("block_size_decode", f"SELECT map, reduce, code, CAST(CASE WHEN code = 0 THEN 0 ELSE floor(pow(1.1::DOUBLE, code)) END AS BIGINT) AS bytes FROM (SELECT map, reduce, CAST({SIZE_CODE.format('bytes')} AS BIGINT) AS code FROM ({DOC_BYTES}))")
def block_size_decode(spark, sf_dir):
    return doc_bytes(spark, sf_dir).select("map", "reduce", stats.size_code(F.col("bytes")).alias("code")).withColumn("bytes", stats.size_of_code(F.col("code")))


@register("status_summary", f"SELECT map, count(*) FILTER (bytes > 0) AS blocks, count(*) FILTER (bytes <= 0) AS empty, CAST(CASE WHEN count(*) FILTER (bytes > 0) > 0 THEN coalesce(SUM(bytes) FILTER (bytes < 50000), 0) // count(*) FILTER (bytes > 0) ELSE 0 END AS BIGINT) AS average, count(*) FILTER (bytes >= 50000) AS huge FROM ({DOC_BYTES}) GROUP BY 1")
def status_summary(spark, sf_dir):
    return stats.summary(doc_bytes(spark, sf_dir), 50_000, "map")


@register("share_of_total", f"SELECT *, bytes / SUM(bytes) OVER (PARTITION BY reduce) AS share FROM ({DOC_BYTES}) QUALIFY share >= 0.2")
def share_of_total(spark, sf_dir):
    return stats.large_shares(doc_bytes(spark, sf_dir), 0.2, "reduce")


@register("map_output_filter", f"SELECT * FROM ({DOC_BYTES}) WHERE map NOT IN (1, 3)")
def map_output_filter(spark, sf_dir):
    return stats.without_outputs(doc_bytes(spark, sf_dir), spark.createDataFrame([(1,), (3,)], "map long"), "map")


@register("block_enumeration", "SELECT CAST(m AS BIGINT) AS map, CAST(r AS BIGINT) AS reduce FROM range(100) a(m), range(2, 6) b(r)")
def block_enumeration(spark, sf_dir):
    """The blocks of a range of reduce ids: maps times the range."""
    return spark.range(100).select(F.col("id").alias("map"), F.explode(F.sequence(F.lit(2).cast("long"), F.lit(5).cast("long"))).alias("reduce"))


# Sharing and storage policies


@register("broadcast_lookup", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def broadcast_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return sharing.broadcast_lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey").select("c_custkey", "n_name")


REUSE_SQL = "SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1"


def _used_twice(rows):
    by = lambda c: keyed.combine_by_key(rows, c, n=F.count("*"))
    return by("o_orderpriority").union(by("o_orderstatus"))


@register("cached_reuse", REUSE_SQL)
def cached_reuse(spark, sf_dir):
    with sharing.keeping(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")) as orders:
        return sharing.checkpointed(_used_twice(orders))


@register("checkpointed", REUSE_SQL)
def checkpointed(spark, sf_dir):
    return _used_twice(sharing.checkpointed(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")))


@register("storage_levels", "SELECT * FROM (VALUES ('NONE',false,false,false,false,1),('DISK_ONLY',true,false,false,false,1),('DISK_ONLY_2',true,false,false,false,2),('MEMORY_ONLY',false,true,false,true,1),('MEMORY_ONLY_2',false,true,false,true,2),('MEMORY_ONLY_SER',false,true,false,false,1),('MEMORY_ONLY_SER_2',false,true,false,false,2),('MEMORY_AND_DISK',true,true,false,true,1),('MEMORY_AND_DISK_2',true,true,false,true,2),('MEMORY_AND_DISK_SER',true,true,false,false,1),('MEMORY_AND_DISK_SER_2',true,true,false,false,2),('OFF_HEAP',true,true,true,false,1)) t(name, disk, memory, off_heap, deserialized, replication)")
def storage_levels(spark, sf_dir):
    rows = [(n, x.useDisk, x.useMemory, x.useOffHeap, x.deserialized, x.replication) for n, x in sharing.LEVELS.items()]
    return spark.createDataFrame(rows, "name string, disk boolean, memory boolean, off_heap boolean, deserialized boolean, replication int")


@register("lru_order", "SELECT user_id, event_type, used, row_number() OVER (PARTITION BY user_id ORDER BY used, event_type) AS turn FROM (SELECT user_id, event_type, max(event_id) AS used FROM events GROUP BY 1, 2)")
def lru_order(spark, sf_dir):
    used = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("used"))
    return sharing.eviction_order(used, "used", "event_type", "user_id")


@register("cooperative_spill_choice", "SELECT l_suppkey, coalesce(min(CASE WHEN l_quantity >= 40 THEN l_quantity END), max(l_quantity)) AS spills FROM lineitem GROUP BY 1")
def cooperative_spill_choice(spark, sf_dir):
    return sharing.spill_choice(table(spark, sf_dir, "lineitem"), 40, "l_quantity", "l_suppkey")


@register("memory_shares", "SELECT l_orderkey, l_linenumber, CAST(1000 // (2 * n) AS BIGINT) AS least, CAST(1000 // n AS BIGINT) AS most, CAST(greatest(0, 1000 // n - held) AS BIGINT) AS room FROM (SELECT *, CAST(l_quantity AS BIGINT) * 10 AS held, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
def memory_shares(spark, sf_dir):
    tasks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") * 10).alias("held"))
    return sharing.memory_shares(tasks, 1000, "held", "l_orderkey").drop("held")


@register("replica_peers", "SELECT * FROM (SELECT p_partkey, peer, row_number() OVER (PARTITION BY p_partkey ORDER BY sha256(p_partkey || ':' || peer)) AS turn FROM part, range(1, 11) n(peer) WHERE p_partkey % 10 + 1 <> peer) WHERE turn <= 2")
def replica_peers(spark, sf_dir):
    """Two more of ten nodes for each part's block; one holds it already."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    return sharing.replica_peers(parts, "p_partkey", list(range(1, 11)), F.array((F.col("p_partkey") % 10 + 1).cast("int")), 2).withColumn("peer", F.col("peer").cast("long"))


# Scalar functions


@register("time_string", "SELECT t, CAST(trunc(CASE suf WHEN '' THEN n * 1000 WHEN 'us' THEN n WHEN 'ms' THEN n * 1000 WHEN 's' THEN n * 1000000 WHEN 'm' THEN n * 60000000 WHEN 'min' THEN n * 60000000 WHEN 'h' THEN n * 3600000000 WHEN 'd' THEN n * 86400000000 END / 1000.0) AS BIGINT) AS ms FROM (SELECT DISTINCT CAST(p_size * 37 AS VARCHAR) || x AS t, CAST(p_size * 37 AS BIGINT) AS n, x AS suf FROM part, (VALUES (''), ('us'), ('ms'), ('s'), ('m'), ('min'), ('h'), ('d'), ('w')) s(x))")
def time_string(spark, sf_dir):
    suffixes = F.explode(F.array(*map(F.lit, ["", *textual.TIME, "w"])))
    rows = table(spark, sf_dir, "part").select("p_size", suffixes.alias("x")).select(F.concat((F.col("p_size") * 37).cast("string"), "x").alias("t")).distinct()
    return rows.withColumn("ms", textual.time_as(F.col("t"), "ms"))


@register("byte_string", "SELECT t, CAST(CASE lower(x) WHEN '' THEN n * 1024 WHEN 'b' THEN n WHEN 'k' THEN n * 1024 WHEN 'kb' THEN n * 1024 WHEN 'm' THEN n * 1048576 WHEN 'gb' THEN n * 1073741824 WHEN 't' THEN n * 1099511627776 END AS BIGINT) // 1024 AS kb FROM (SELECT DISTINCT ' ' || CAST(p_size * 91 AS VARCHAR) || x || ' ' AS t, CAST(p_size * 91 AS BIGINT) AS n, x FROM part, (VALUES (''), ('b'), ('K'), ('kb'), ('m'), ('GB'), ('t'), ('.5m')) s(x))")
def byte_string(spark, sf_dir):
    suffixes = F.explode(F.array(*map(F.lit, ["", "b", "K", "kb", "m", "GB", "t", ".5m"])))
    rows = table(spark, sf_dir, "part").select("p_size", suffixes.alias("x")).select(F.concat(F.lit(" "), (F.col("p_size") * 91).cast("string"), "x", F.lit(" ")).alias("t")).distinct()
    return rows.withColumn("kb", textual.bytes_as(F.col("t"), "k"))


SIZE_SQL = "CASE " + " ".join(f"WHEN n > {2 * u} THEN CAST(CAST(round(CAST(n AS DECIMAL(38,10)) / {u}, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' {name}'" for name, u in textual.UNITS if 2 * u < 1 << 63) + " ELSE CAST(n AS VARCHAR) || '.0 B' END"


@register("size_string", f"SELECT n, {SIZE_SQL} AS size FROM (SELECT DISTINCT o_orderkey * o_orderkey * o_orderkey AS n FROM orders)")
def size_string(spark, sf_dir):
    """n is a long while every cube fits one, as in SQL, which fails beyond; then all are decimals, of up to 38 digits."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    n = F.col("k").cast("decimal(19,0)")
    cube = (n * n * n).cast("decimal(38,0)")
    most = orders.agg(F.max(F.abs("k"))).first()[0]
    kind = "long" if (most or 0) ** 3 < 1 << 63 else "decimal(38,0)"
    return orders.select(cube.cast(kind).alias("n")).distinct().withColumn("size", textual.size_string(F.col("n")))


@register("host_port", r"SELECT a, CASE WHEN contains(a, ':') THEN trim(regexp_extract(a, '^(.*):[^:]*$', 1)) ELSE a END AS host, CASE WHEN contains(a, ':') THEN CAST(trim(regexp_extract(a, ':([^:]*)$', 1)) AS BIGINT) ELSE 0 END AS port FROM (SELECT DISTINCT split_part(split_part(url, '//', 2), '/', 1) || CASE WHEN page_id % 3 = 0 THEN '' ELSE ' : ' || CAST(page_id AS VARCHAR) END AS a FROM pages)")
def host_port(spark, sf_dir):
    host = F.substring_index(F.split_part("url", F.lit("//"), F.lit(2)), "/", 1)
    address = F.concat(host, F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit(" : "), F.col("page_id").cast("string"))))
    rows = table(spark, sf_dir, "pages").select(address.alias("a")).distinct()
    return rows.withColumn("host", textual.host_of(F.col("a"))).withColumn("port", textual.port_of(F.col("a")))


@register("strip_affixes", "SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN c_name[10:] ELSE c_name END AS without_prefix, CASE WHEN ends_with(c_mktsegment, 'ING') THEN left(c_mktsegment, length(c_mktsegment) - 3) ELSE c_mktsegment END AS without_suffix FROM customer")
def strip_affixes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", textual.strip_prefix(F.col("c_name"), "Customer#").alias("without_prefix"), textual.strip_suffix(F.col("c_mktsegment"), "ING").alias("without_suffix"))


@register("resolve_uri", "SELECT page_id, p, CASE WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN p WHEN starts_with(p, '/') THEN 'file:' || p ELSE 'file:/home/x/' || p END AS uri FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '/' || split_part(url, '//', 2) ELSE split_part(url, '//', 2) END AS p FROM pages)")
def resolve_uri(spark, sf_dir):
    tail = F.split_part("url", F.lit("//"), F.lit(2))
    path = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), tail)).otherwise(tail)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("p")).withColumn("uri", textual.resolve_uri(F.col("p"), "/home/x"))


@register("next_power_of_two", "SELECT o_orderkey AS n, CASE WHEN o_orderkey <= 1 THEN o_orderkey ELSE CAST(1 AS BIGINT) << CAST(length(bin(o_orderkey - 1)) AS INTEGER) END AS power FROM orders")
def next_power_of_two(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), textual.next_power_of_two(F.col("o_orderkey")).alias("power"))


@register("whole_words", "SELECT o_orderkey AS n, (o_orderkey + 7) // 8 * 8 AS size FROM orders")
def whole_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), textual.whole_words(F.col("o_orderkey")).alias("size"))


@register("bytes_equal", "SELECT doc_id, min(doc_id) OVER k AS least, count(*) OVER k AS n FROM documents WINDOW k AS (PARTITION BY source, encode(text))")
def bytes_equal(spark, sf_dir):
    """Each document with the smallest of its source that has equal bytes, and their number: digests meet, then bytes are compared."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source"), F.col("text").cast("binary").alias("body"))
    docs = docs.withColumn("digest", F.coalesce(F.sha2("body", 256), F.lit(""))).withColumn("length", F.coalesce(F.octet_length("body"), F.lit(-1)))
    least = docs.groupBy("source", "digest", "length").agg(F.min("doc_id").alias("least"), F.min_by("body", "doc_id").alias("first"), F.count("*").alias("n"))
    same = F.col("body").eqNullSafe(F.col("first"))
    joined = docs.join(least, ["source", "digest", "length"])
    return joined.select("doc_id", F.when(same, F.col("least")).otherwise(F.col("doc_id")).alias("least"), F.when(same, F.col("n")).otherwise(1).alias("n"))


ADLER = "list_reduce(list_prepend({{'a': 1::BIGINT, 'b': 0::BIGINT}}, list_transform(string_split({0}, ''), lambda c: {{'a': ascii(c)::BIGINT, 'b': 0::BIGINT}})), lambda s, x: {{'a': (s.a + x.a) % 65521, 'b': (s.b + s.a + x.a) % 65521}})"


@register("adler32_checksum", f"SELECT key, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS checksum FROM (SELECT key, s.b * 65536 + s.a AS w FROM (SELECT DISTINCT p_name AS key, {ADLER.format('p_name')} AS s FROM part))")
def adler32_checksum(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct().withColumn("checksum", textual.adler32(F.col("key")))


@register("page_offset_pack", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS BIGINT) * 2251799813685248 + l_orderkey * 4096 AS address, CAST(l_linenumber AS BIGINT) AS page, l_orderkey * 4096 AS \"offset\" FROM lineitem")
def page_offset_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", textual.pack_address(F.col("l_linenumber"), F.col("l_orderkey") * 4096).alias("address"))
    return rows.withColumn("page", textual.page_of(F.col("address"))).withColumn("offset", textual.offset_of(F.col("address")))


@register("byte_units", "SELECT o_orderkey AS n, o_orderkey * 1048576 AS kb, o_orderkey // 1024 AS tb FROM orders")
def byte_units(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("n"), textual.convert_bytes(n, "gb", "kb").alias("kb"), textual.convert_bytes(n, "gb", "tb").alias("tb"))
