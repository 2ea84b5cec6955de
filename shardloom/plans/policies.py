"""Queries of the storage, shuffle and tracking rules, and of keyed sets, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions import textual
from shardloom.operators import keyed, partitioning, policies, sharing, stats
from shardloom.plans.registry import ADLER, SIZE_CODE, SIZE_SQL, STRING_HASH, register
from shardloom.sources.tables import table

BIG = 9007199254740992


@register("combine_opaque_nulls", f"SELECT CASE WHEN c_nationkey <> 3 THEN {BIG} + c_nationkey END AS key, sum(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE {BIG} + c_custkey END)::BIGINT - {BIG} * count(*) FILTER (c_custkey % 3 <> 0) AS value FROM customer GROUP BY 1")
def combine_opaque_nulls(spark, sf_dir):
    """Null keys, null values, and longs that doubles cannot hold."""
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") + BIG).alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") + BIG).alias("v"))
    number = lambda v: 0 if v is None else v - BIG
    return keyed.combine_opaque(rows, "k", "v", number, lambda v, c: c + number(v), lambda c, d: c + d, lambda c: c, "long")


@register("cogroup_parents", "SELECT coalesce(a.k, b.k) AS key, coalesce(customers, []) AS customers, coalesce(suppliers, []) AS suppliers FROM (SELECT c_nationkey AS k, list_sort(list(c_custkey)) AS customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, list_sort(list(s_suppkey)) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k")
def cogroup_parents(spark, sf_dir):
    """The values of two keyed parents side by side."""
    return keyed.cogroup("key", customers=(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "key"), "c_custkey"), suppliers=(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "key"), "s_suppkey"))


@register("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@register("intersect_keys", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_keys(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).intersect(rich)


@register("except_keys", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("key")))


@register("range_partition", "SELECT o_orderkey, CAST((o_totalprice > 50000)::INT + (o_totalprice > 100000)::INT + (o_totalprice > 200000)::INT AS BIGINT) AS partition FROM orders")
def range_partition(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", partitioning.range_partition(F.col("o_totalprice"), [50000, 100000, 200000]).alias("partition"))


@register("hash_partitioned", "SELECT o_orderkey, o_custkey % 6 AS partition FROM orders")
def hash_partitioned(spark, sf_dir):
    partition = partitioning.partition_of(partitioning.hash_long(F.col("o_custkey")), 6)
    return partitioning.hash_partitioned(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), partition, 6).select("o_orderkey", "partition")


EVICT_SQL = """
SELECT user_id, event_id, turn FROM (SELECT user_id, event_id, row_number() OVER w AS turn, sum(size) OVER w - size AS before, sum(size) OVER (PARTITION BY user_id) AS "all"
  FROM (SELECT user_id, event_id, ts, event_type, CAST(floor(coalesce(value, 0)) AS BIGINT) + 1 AS size FROM events)
  WHERE event_id % 2 = 0 AND coalesce(event_type <> 'click', true) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before < 100 AND "all" >= 100"""


@register("evict_for_block", EVICT_SQL)
def evict_for_block(spark, sf_dir):
    """Every user's store makes room for a block of 'click': events are blocks, even ones are of the wanted memory mode."""
    blocks = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", (F.floor(F.coalesce("value", F.lit(0))) + 1).cast("long").alias("size"))
    out = policies.evicted(blocks, 100, F.col("event_type") == "click", F.col("event_id") % 2 == 0, ["ts", "event_id"], "size", "user_id")
    return out.select("user_id", "event_id", "turn")


@register("shuffle_writer_choice", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 AND n <= 200 THEN 'bypass' WHEN p_size % 2 = 0 AND p_partkey % 2 = 1 AND p_partkey % 3 <> 0 AND n <= 16777216 THEN 'serialized' ELSE 'sort' END AS writer FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN p_size ELSE p_size * p_partkey * 1000 END AS n FROM part)")
def shuffle_writer_choice(spark, sf_dir):
    n = F.when(F.col("p_size") % 5 == 0, F.col("p_size").cast("long")).otherwise(F.col("p_size") * F.col("p_partkey") * 1000)
    combines = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select("p_partkey", policies.writer_of(n, combines, combines | (F.col("p_partkey") % 3 == 0), F.col("p_size") % 2 == 0).alias("writer"))


REGISTRY_SQL = """
WITH c AS (SELECT user_id AS shuffle, event_id % 7 AS map, event_id AS seq, event_id % 5 % 2 = 1 AS adds, event_id % 3 AS loc FROM events),
r AS (SELECT shuffle, map, max(seq) AS seq, arg_max(loc, seq) AS loc FROM c WHERE adds GROUP BY 1, 2),
a AS (SELECT shuffle, map FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE NOT c.adds AND c.shuffle = r.shuffle AND c.map = r.map AND c.seq > r.seq AND c.loc = r.loc)),
e AS (SELECT shuffle, count(*) FILTER (NOT adds) AS epoch FROM c GROUP BY 1),
m AS (SELECT e.shuffle, list(n ORDER BY n) AS missing FROM e CROSS JOIN range(7) r(n) LEFT JOIN a ON a.shuffle = e.shuffle AND a.map = n WHERE a.map IS NULL GROUP BY 1)
SELECT e.shuffle, (SELECT count(*) FROM a WHERE a.shuffle = e.shuffle) AS available, coalesce(missing, []::BIGINT[]) AS missing, e.epoch FROM e LEFT JOIN m ON m.shuffle = e.shuffle"""


@register("map_output_registry", REGISTRY_SQL)
def map_output_registry(spark, sf_dir):
    """Events as calls of a tracker: each user's shuffle has seven maps on three executors."""
    event = F.col("event_id")
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("shuffle"), (event % 7).alias("map"), event.alias("seq"), F.when(event % 5 % 2 == 1, "register").otherwise("unregister").alias("call"), (event % 3).alias("location"))
    return policies.registered(calls, 7)


GROWTH_SQL = """
WITH RECURSIVE p(n) AS (SELECT 1::BIGINT UNION ALL SELECT CAST(ceil(1.1::DOUBLE * n) AS BIGINT) FROM p WHERE n < 100000),
u AS (SELECT user_id, row_number() OVER w AS n, CAST(sum(strlen(coalesce(props, ''))) OVER w AS BIGINT) AS actual FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, n, actual, lag(n) OVER k AS n0, lag(actual) OVER k AS a0 FROM u WHERE n IN (SELECT n FROM p) WINDOW k AS (PARTITION BY user_id ORDER BY n))
SELECT u.user_id, u.n, u.actual, CAST(trunc(s.actual + coalesce(greatest(0, (s.actual - s.a0) / (s.n - s.n0)::DOUBLE), 0) * (u.n - s.n)) AS BIGINT) AS estimate
FROM u ASOF JOIN s ON u.user_id = s.user_id AND u.n >= s.n"""


@register("size_sampling", GROWTH_SQL)
def size_sampling(spark, sf_dir):
    """A user's events as updates of a collection: its true size beside the extrapolated one."""
    updates = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.octet_length(F.coalesce("props", F.lit(""))).alias("size"))
    return policies.sampled_growth(updates, "size", "user_id", "ts", "event_id")


@register("block_locks", "SELECT o_orderkey, coalesce(w, 0) = 0 AND (o_orderkey % 2 = 0 OR coalesce(r, 0) = 0) AS granted FROM orders LEFT JOIN (SELECT o_custkey AS b, count(*) FILTER (o_orderstatus = 'P') AS w, count(*) FILTER (o_orderstatus = 'O') AS r FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) ON b = o_custkey WHERE o_orderstatus = 'F'")
def block_locks(spark, sf_dir):
    """Customers as blocks: open orders read them, pending ones write, filled ones ask."""
    orders = table(spark, sf_dir, "orders")
    held = orders.filter("o_orderstatus IN ('O', 'P')").select("o_custkey", (F.col("o_orderstatus") == "P").alias("writes"))
    asked = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 2 == 1).alias("writes"))
    return policies.granted(asked, held, "o_custkey").select("o_orderkey", "granted")


@register("block_locations", "SELECT l_partkey AS block, list_sort(list(DISTINCT l_suppkey)) AS locations FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1")
def block_locations(spark, sf_dir):
    return policies.locations(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", F.col("l_suppkey") % 5 == 0)


@register("local_dirs", f"SELECT name, h % 4 AS dir, printf('%02x', (h // 4) % 64) AS subdir FROM (SELECT name, CASE WHEN h = 2147483648 THEN 0 WHEN h > 2147483648 THEN 4294967296 - h ELSE h END AS h FROM (SELECT name, {STRING_HASH.format('name')} AS h FROM (SELECT 'shuffle_0_' || o_orderkey || '_' || o_custkey AS name FROM orders)))")
def local_dirs(spark, sf_dir):
    name = F.concat(F.lit("shuffle_0_"), F.col("o_orderkey").cast("string"), F.lit("_"), F.col("o_custkey").cast("string"))
    place, sub = policies.local_place(F.col("name"), 4, 64)
    return table(spark, sf_dir, "orders").select(name.alias("name")).withColumn("dir", place.cast("long")).withColumn("subdir", sub)


@register("broadcast_pieces", f"SELECT p_partkey, piece, length(part) AS bytes, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS checksum FROM (SELECT p_partkey, piece, part, s.b * 65536 + s.a AS w FROM (SELECT p_partkey, piece, part, {ADLER.format('part')} AS s FROM (SELECT p_partkey, CAST(i AS INTEGER) AS piece, p_name[i * 7 + 1 : i * 7 + 7] AS part FROM part, range(0, 100) r(i) WHERE i * 7 < strlen(p_name))))")
def broadcast_pieces(spark, sf_dir):
    return policies.pieces(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 7).withColumn("bytes", F.col("bytes").cast("long"))


SHUFFLES = "SELECT doc_id % 4 AS shuffle, doc_id // 4 % (3 + 2 * (doc_id % 4)) AS map, doc_id // 16 % 5 AS reduce, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2, 3"


def shuffle_sizes(spark, sf_dir):
    """Bytes of each block of four shuffles with 3, 5, 7 and 9 maps."""
    shuffle = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select(shuffle.alias("shuffle"), (F.floor(F.col("doc_id") / 4) % (3 + 2 * shuffle)).alias("map"), (F.floor(F.col("doc_id") / 16) % 5).alias("reduce"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return stats.bytes_by(rows, F.col("size"), "shuffle", "map", "reduce")


@register("preferred_locations", f"WITH s AS ({SHUFFLES}) SELECT *, bytes / sum(bytes) OVER (PARTITION BY shuffle, reduce) AS share FROM s WHERE shuffle IN (SELECT shuffle FROM s GROUP BY 1 HAVING count(DISTINCT map) < 7 AND count(DISTINCT reduce) < 1000) QUALIFY share >= 0.2")
def preferred_locations(spark, sf_dir):
    """None in shuffles of seven maps or more."""
    return policies.preferred(shuffle_sizes(spark, sf_dir), maps=7)


@register("status_sizes", f"WITH s AS (SELECT doc_id % 5 AS map, doc_id // 5 % (6 + 2 * (doc_id % 5)) AS reduce, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2) SELECT map, reduce, CAST(CASE WHEN count(*) OVER k <= 10 THEN CASE WHEN bytes = 0 THEN 0 ELSE floor(pow(1.1::DOUBLE, {SIZE_CODE.format('bytes')})) END WHEN bytes > 0 THEN sum(bytes) OVER k // greatest(1, count(*) FILTER (bytes > 0) OVER k) ELSE 0 END AS BIGINT) AS reported FROM s WINDOW k AS (PARTITION BY map)")
def status_sizes(spark, sf_dir):
    """Maps with up to ten reducers report each size by its code, others their average."""
    doc = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select((doc % 5).alias("map"), (F.floor(doc / 5) % (6 + 2 * (doc % 5))).alias("reduce"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return policies.reported(stats.bytes_by(rows, F.col("size"), "map", "reduce"), stats.size_code(F.col("bytes")), stats.size_of_code(F.col("code")), 10)


@register("frame_storage_level", "SELECT * FROM (VALUES ('before', false, false, 1), ('kept', true, false, 1), ('after', false, false, 1)) t(moment, disk, memory, replication)")
def frame_storage_level(spark, sf_dir):
    """The storage level of a frame before, while and after it is kept."""
    frame = table(spark, sf_dir, "nation").select("n_nationkey")
    level = lambda moment: (moment, frame.storageLevel.useDisk, frame.storageLevel.useMemory, frame.storageLevel.replication)
    found = [level("before")]
    with sharing.keeping(frame, "DISK_ONLY"):
        found.append(level("kept"))
    return spark.createDataFrame([*found, level("after")], "moment string, disk boolean, memory boolean, replication int")


@register("operation_scope", "SELECT n_nationkey, '{\"id\":\"' || n_nationkey || '\",\"name\":\"' || n_name || '\",\"parent\":{\"id\":\"' || r_regionkey || '\",\"name\":\"' || r_name || '\"}}' AS scope FROM nation JOIN region ON n_regionkey = r_regionkey")
def operation_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    around = F.struct(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"))
    return rows.select("n_nationkey", policies.scope_json(F.col("n_nationkey"), F.col("n_name"), around).alias("scope"))


@register("completion_metrics", "SELECT count(*) AS n, count(*) FILTER (o_totalprice IS NULL) AS failed, max(o_orderkey) AS last FROM orders")
def completion_metrics(spark, sf_dir):
    """What a listener hears once a job over orders has ended."""
    with policies.scope(spark, "completion_metrics"):
        rows, heard = policies.on_completion(table(spark, sf_dir, "orders"), "orders", n=F.count("*"), failed=F.count_if(F.col("o_totalprice").isNull()), last=F.max("o_orderkey"))
        rows.write.format("noop").mode("overwrite").save()
    found = heard.get
    return spark.createDataFrame([(found["n"], found["failed"], found["last"])], "n long, failed long, last long")


@register("object_size", "SELECT doc_id, 24 + (16 + strlen(text) + 7) // 8 * 8 AS size FROM documents")
def object_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", policies.string_bytes(F.col("text")).alias("size"))


@register("megabytes_string", f"SELECT DISTINCT o_orderkey AS mb, {SIZE_SQL} AS size FROM (SELECT o_orderkey, o_orderkey * 1048576 AS n FROM orders)")
def megabytes_string(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mb")).distinct().withColumn("size", textual.megabytes_string(F.col("mb")))


@register("large_units", f"SELECT DISTINCT n, n // 1000 AS ms, n // 1024 AS kb, n // 1048576 AS mb FROM (SELECT {BIG * 3} + p_partkey AS n FROM part)")
def large_units(spark, sf_dir):
    """Numbers that doubles cannot hold."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") + BIG * 3).alias("n")).distinct()
    text = lambda suffix: F.concat(F.col("n").cast("string"), F.lit(suffix))
    return rows.select("n", textual.time_as(text("us"), "ms").alias("ms"), textual.bytes_as(text("b"), "k").alias("kb"), textual.convert_bytes(F.col("n"), "b", "mb").alias("mb"))
