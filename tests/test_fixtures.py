"""Small fixtures with values worked out by hand, and edge cases."""

import array
import math
import zlib

import pytest
from pyspark.sql import functions as F

from shardloom.functions import textual
from shardloom.operators import keyed, ordering, partitioning, sharing, stats
from shardloom.sources import blocks
from shardloom.streaming.keyed import combine_windows


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_sum_by_key_in_order_within_partitions(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (5, 5), (5, 6), (7, 7), (9, 3)], "key int, value int")
    summed = keyed.combine_by_key(df, "key", value=F.sum("value"))
    assert rows(summed) == [(1, 3), (5, 11), (7, 7), (9, 3)]
    dealt = ordering.sorted_partitions(summed, partitioning.partition_of(partitioning.hash_long(F.col("key")), 7), 7, "key")
    by = {}
    for r in dealt.withColumn("task", F.spark_partition_id()).collect():
        by.setdefault((r.task, r.partition), []).append(r.key)
    assert all(v == sorted(v) for v in by.values())
    assert {p for _, p in by} == {1, 5, 0, 2}


def test_group_values(spark):
    data = {"A": [1, 2, 3], "B": [11, 12, 13], "C": [21, 22, 23], "D": [31, 32, 33], "E": [51, 52, 53, 55]}
    pairs = [(k, v[i]) for i in range(4) for k, v in data.items() if i < len(v)]
    df = spark.createDataFrame(pairs, "key string, value int")
    assert {r.key: r["values"] for r in keyed.group_by_key(df, "key", "value").collect()} == data
    opaque = keyed.combine_opaque(df, "key", "value", lambda v: [v], lambda v, c: [*c, v], lambda a, b: a + b, lambda c: sorted(c), "array<int>")
    assert {r.key: list(r.value) for r in opaque.collect()} == data


def test_opaque_combiner_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (2, 5), (None, 3)], "key long, value long")
    got = keyed.combine_opaque(df, "key", "value", lambda v: v, lambda v, c: v + c, lambda a, b: a + b, lambda c: c, "long")
    assert rows(got) == [(2, 5), (None, 4)]
    assert keyed.combine_opaque(df.limit(0), "key", "value", lambda v: v, lambda v, c: c, lambda a, b: a, lambda c: c, "long").count() == 0


def test_order_by_partition(spark):
    df = spark.createDataFrame([(2, "D", 21), (2, "E", 22), (2, "F", 23), (1, "A", 11), (1, "B", 12), (1, "C", 13)], "p int, key string, value int")
    got = ordering.sorted_partitions(df, F.col("p"), 1, "key").select("partition", "key").collect()
    assert [tuple(r) for r in got] == [(1, "A"), (1, "B"), (1, "C"), (2, "D"), (2, "E"), (2, "F")]


def test_upserts(spark):
    df = spark.createDataFrame([("A", 65, 1), ("B", 66, 2), ("C", 67, 3), ("A", 66, 4), ("D", 0, 5)], "key string, value int, seq int")
    assert rows(keyed.upsert(df, "key", "value", "seq")) == [("A", 66), ("B", 66), ("C", 67), ("D", 0)]
    ups = spark.createDataFrame([(3,), (2,), (2,)], "key int")
    assert rows(keyed.update_counter(ups, "key", 60, 2)) == [(2, 62), (3, 60)]
    assert rows(keyed.lookup(df, "key", "C"), "value") == [(67,)]
    assert rows(keyed.lookup(df, "key", "Z")) == []


def test_hashes_are_the_jvms(spark):
    texts = ["", "abc", "Customer#000000001", "é", "日本", "😀x", "a" * 200]
    longs = [0, 1, -1, 2**31, -(2**31), 2**63 - 1, -(2**63), 123456789012345]

    def word(h):
        h %= 2**32
        return h - 2**32 if h >= 2**31 else h

    def of_text(t):
        h = 0
        for unit in array.array("H", t.encode("utf-16-le")):
            h = word(31 * h + unit)
        return h

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.h for r in df.select("t", partitioning.hash_string(F.col("t")).alias("h")).collect()} == {t: of_text(t) for t in texts}
    df = spark.createDataFrame([(x,) for x in longs], "x long")
    assert of_text("abc") == 96354
    for x, h, p in df.select("x", partitioning.hash_long(F.col("x")).alias("h"), partitioning.partition_of(partitioning.hash_long(F.col("x")), 7)).collect():
        assert h == word((x ^ (x % 2**64 >> 32)) % 2**32)
        assert p == h % 7
    got = one(spark, a=partitioning.non_negative_hash(F.lit(-(2**31)).cast("long")), b=partitioning.non_negative_hash(F.lit(None).cast("long")), c=partitioning.non_negative_hash(F.lit(-5).cast("long")), d=partitioning.partition_of(F.lit(None).cast("long"), 9))
    assert tuple(got) == (0, 0, 5, 0)


def test_some_partitions(spark):
    df = spark.range(20).withColumn("p", F.col("id") % 4)
    assert partitioning.on_partitions(df, F.col("p"), 4, []).count() == 0
    assert partitioning.on_partitions(df, F.col("p"), 4, [0, 3]).count() == 10
    with pytest.raises(IndexError):
        partitioning.on_partitions(df, F.col("p"), 4, [4])
    with pytest.raises(IndexError):
        partitioning.on_partitions(df, F.col("p"), 4, [-1])


def test_union_and_split(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "x int"), spark.createDataFrame([(1,), (7,)], "x int")
    assert rows(partitioning.union_ranges(a, b)) == [(1, 0), (1, 1), (7, 1), (None, 0)]
    met, rest = partitioning.split_by(partitioning.union_ranges(a, b), F.col("x") > 1)
    assert (rows(met, "x"), rows(rest, "x")) == ([(7,)], [(1,), (1,), (None,)])


def test_block_files(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "blocks")
    blocks.write_blocks(df, path, F.col("id") % 10, 10)
    blocks.append_blocks(df, path, F.col("id") % 10, 10)
    assert blocks.read_blocks(spark, path, 10).count() == 2000
    some = blocks.read_blocks(spark, path, 10, [2, 5])
    assert some.count() == 400
    assert "PartitionFilters: [isnotnull(partition" in some._jdf.queryExecution().toString() or "PartitionFilters: [partition" in some._jdf.queryExecution().toString()


def test_sizes(spark):
    sizes = [0, 1, 2, 10, 1000, 10**6, 35 * 10**9, 10**12]
    df = spark.createDataFrame([(s,) for s in sizes], "bytes long")
    got = {r.bytes: (r.code, r.back) for r in df.withColumn("code", stats.size_code(F.col("bytes"))).withColumn("back", stats.size_of_code(F.col("code"))).collect()}
    for s in sizes:
        assert got[s][0] == (0 if s == 0 else 1 if s == 1 else min(255, math.ceil(math.log(s) / math.log(1.1))))
        if 1 < s < 35 * 10**9:
            assert s * 0.89 <= got[s][1] <= s * 1.11 + 1
    table = spark.createDataFrame([(0, 10), (1, 0), (2, 200), (3, 21)], "reduce int, bytes long")
    assert rows(stats.summary(table, 100), "blocks", "empty", "average", "huge") == [(3, 1, 10, 1)]
    assert rows(stats.offsets(table, "reduce"), "reduce", "start", "stop") == [(0, 0, 10), (1, 10, 10), (2, 10, 210), (3, 210, 231)]
    assert stats.summary(table.limit(0), 100).first().average == 0


def test_times_and_sizes(spark):
    def time(text, unit):
        return one(spark, x=textual.time_as(F.lit(text), unit)).x

    assert [time(t, "s") for t in ("50s", "100ms", " 2MIN ", "-3h", "1d", "7", "1999ms", "-1999ms")] == [50, 0, 120, -10800, 86400, 7, 1, -1]
    assert [time(t, "ms") for t in ("5w", "x", "1.5s", "", "99999999999999999999s")] == [None] * 5

    def size(text, unit):
        return one(spark, x=textual.bytes_as(F.lit(text), unit)).x

    assert [size(t, "m") for t in ("1g", "2048k", "5", "1023k", "1.5g", "-1k", "9z")] == [1024, 2, 5, 0, None, None, None]
    shown = [one(spark, x=textual.size_string(F.lit(n).cast("long"))).x for n in (0, 100, 2048, 2049, 5 << 20, 3 << 30, 5 << 40, 5 << 50, 5 << 60)]
    assert shown == ["0.0 B", "100.0 B", "2048.0 B", "2.0 KB", "5.0 MB", "3.0 GB", "5.0 TB", "5.0 PB", "5.0 EB"]
    assert one(spark, x=textual.megabytes_string(F.lit(5000).cast("long"))).x == "4.9 GB"
    assert one(spark, a=textual.convert_bytes(F.lit(1).cast("long"), "m", "k"), b=textual.convert_bytes(F.lit(2047).cast("long"), "k", "m"))[:] == (1024, 1)


def test_addresses_and_paths(spark):
    assert one(spark, a=textual.host_of(F.lit("h : 80")), b=textual.port_of(F.lit("h : 80")), c=textual.host_of(F.lit("a:b:9")), d=textual.port_of(F.lit("plain")), e=textual.host_of(F.lit("plain")))[:] == ("h", 80, "a:b", 0, "plain")
    assert one(spark, a=textual.strip_prefix(F.lit("abc"), "ab"), b=textual.strip_suffix(F.lit("abc"), "bc"), c=textual.strip_prefix(F.lit("abc"), "x"), d=textual.strip_suffix(F.lit("abc"), "abc"))[:] == ("c", "a", "abc", "")
    assert one(spark, a=textual.resolve_uri(F.lit("hdfs://n/x"), "/h"), b=textual.resolve_uri(F.lit("/x"), "/h"), c=textual.resolve_uri(F.lit("x/y"), "/h/"))[:] == ("hdfs://n/x", "file:/x", "file:/h/x/y")


def test_numbers(spark):
    assert [one(spark, x=textual.next_power_of_two(F.lit(n).cast("long"))).x for n in (33, 32, 4, 5, 1)] == [64, 32, 4, 8, 1]
    assert [one(spark, x=textual.whole_words(F.lit(n))).x for n in (0, 1, 8, 9)] == [0, 8, 8, 16]
    for text in ("", "abc", "é日😀", "z" * 9000):
        want = zlib.adler32(text.encode())
        assert one(spark, x=textual.adler32(F.lit(text))).x == (want - 2**32 if want >= 2**31 else want)
    packed = textual.pack_address(F.lit(8191), F.lit(2**51 - 1).cast("long"))
    assert one(spark, a=packed, b=textual.page_of(packed), c=textual.offset_of(packed))[:] == (-1, 8191, 2**51 - 1)


def test_sharing(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    side = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    small, large = sharing.broadcast_lookup(df, side, "k"), sharing.broadcast_lookup(df, side, "k", most=1)
    assert "strategy=broadcast" in small._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in large._jdf.queryExecution().toString()
    assert small.count() == large.count() == 67
    kept = sharing.cached(df, "DISK_ONLY")
    assert kept.storageLevel == sharing.LEVELS["DISK_ONLY"]
    kept.unpersist()
    assert not sharing.cached(df, "NONE").storageLevel.useMemory
    cut = sharing.checkpointed(df)
    assert rows(cut) == rows(df) and "Range" not in cut._jdf.queryExecution().toString()
    spill = spark.createDataFrame([(1, 5), (1, 50), (1, 20), (2, 3), (2, 4)], "g int, used int")
    assert rows(sharing.spill_choice(spill, 15, "used", "g")) == [(1, 20), (2, 4)]
    tasks = spark.createDataFrame([(1, 400), (1, 100)], "g int, held long")
    assert rows(sharing.memory_shares(tasks, 1000, "held", "g")) == [(1, 100, 250, 500, 400), (1, 400, 250, 500, 100)]


def test_peek(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 9)], "g int, v int")
    assert rows(ordering.peek(df, "g", "v", "v")) == [(1, 1, 2), (1, 2, 3), (1, 3, None), (2, 9, None)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    for k in range(3):
        events.filter(F.pmod(F.xxhash64("ts"), F.lit(3)) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    made = combine_windows(stream, "ts", "event_type", "1 day", "3650 days", n=F.count("*"))
    query = made.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    assert rows(spark.table("windows")) == rows(combine_windows(events, "ts", "event_type", "1 day", "0 days", n=F.count("*")))
