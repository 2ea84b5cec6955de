"""What sets of rows do not show: order, limits, sizes, and the rules' edges."""

import time
import zlib

import pytest
from pyspark.sql import functions as F

from shardloom.functions import textual
from shardloom.operators import keyed, policies, sharing
from shardloom.plans.registry import QUERIES
from shardloom.sources import tables

SF = "/root/testdata/sf0.001"


def test_order_of_rows(spark):
    got = [(r.o_orderdate, r.o_orderkey) for r in QUERIES["sort_by_key"](spark, SF).collect()]
    assert got == sorted(got) and len(got) == 1500
    got = [r.key for r in QUERIES["combine_by_key_total_order"](spark, SF).collect()]
    assert got == sorted(got)
    parts = QUERIES["sorted_partitions"](spark, SF).withColumn("task", F.spark_partition_id()).collect()
    by = {}
    for r in parts:
        by.setdefault(r.task, []).append((r.partition, r.o_custkey, r.o_orderkey))
    assert all(x == sorted(x) for x in by.values())
    assert sum(len({p for p, _, _ in x}) for x in by.values()) == 8


def test_adler_of_large_blocks(spark):
    took = []
    for n in (100_000, 1_600_000):
        body = bytes((i * 31 + i // 7) % 251 for i in range(n))
        began = time.time()
        got = spark.createDataFrame([(body,)], "b binary").select(textual.adler32(F.col("b"))).first()[0]
        took.append(time.time() - began)
        assert got % 2**32 == zlib.adler32(body)
    assert took[1] < 40 * max(took[0], 0.3)
    rows = [("",), ("é😀",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(textual.adler32(F.col("t"))).collect()]
    assert got == [1, zlib.adler32("é😀".encode()), None]


def test_opaque_keys_and_values_stay_what_they_are(spark):
    big = 2**53
    rows = [(big + 1, 1), (big + 2, None), (None, 2), (None, None), (big + 1, big + 3), (-(2**63), 5)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(3)
    got = {r.key: r.value for r in keyed.combine_opaque(df, "k", "v", lambda v: [v], lambda v, c: [*c, v], lambda c, d: c + d, lambda c: repr(sorted(c, key=lambda x: (x is None, x or 0))), "string").collect()}
    assert got == {big + 1: f"[1, {big + 3}]", big + 2: "[None]", None: "[2, None]", -(2**63): "[5]"}
    assert keyed.combine_opaque(df.limit(0), "k", "v", list, list, list, list, "long").count() == 0


def test_wide_sides_are_not_broadcast(spark):
    left, side = spark.range(10), spark.range(4).withColumn("wide", F.repeat(F.lit("x"), 100_000))
    small = sharing.broadcast_lookup(left, side, "id", most_bytes=1 << 20)
    large = sharing.broadcast_lookup(left, side, "id", most_bytes=1 << 18)
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(small) and not hint(large) and large.count() == 4
    assert not hint(sharing.broadcast_lookup(left, side, "id", most=3))


def test_kept_frames_are_let_go(spark):
    QUERIES["cached_reuse"](spark, SF).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_only_a_lone_driver_has_a_folder_of_its_own(monkeypatch):
    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {}

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

        def __init__(self, master):
            self.sparkContext = Context(master)

    assert tables.shared_dir(Session("local[4]")).startswith("/tmp")
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.shared_dir(Session(master))


def test_settled_stages_leave_one_result(spark):
    tables.drop_cuts()
    base = tables.cut(spark.range(5))
    one = tables.settled(lambda: tables.cut(tables.cut(base.selectExpr("id + 1 AS id"))))
    assert len(tables._cuts) == 2
    two = tables.settled(lambda: tables.cut(one.selectExpr("id + 1 AS id")), one)
    assert len(tables._cuts) == 2
    assert [r.id for r in two.orderBy("id").collect()] == [2, 3, 4, 5, 6] and base.count() == 5
    tables.drop_cuts()


def test_sample_points():
    assert policies.sample_points(20) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 21]  # worked out by hand


def test_registry_calls(spark):
    calls = [(0, 0, 1, "register", "a"), (0, 0, 2, "unregister", "b"), (0, 1, 3, "register", "a"), (0, 1, 4, "unregister", "a"), (0, 1, 5, "register", "b"), (0, 2, 6, "unregister", "a"), (1, 0, 7, "register", "a"), (1, 0, 8, "unregister", "a")]
    df = spark.createDataFrame(calls, "shuffle long, map long, seq long, call string, location string")
    assert sorted(map(tuple, policies.registered(df, 3).collect())) == [(0, 2, [2], 3), (1, 0, [0, 1, 2], 1)]


def test_scopes_nest(spark):
    context = spark.sparkContext
    with policies.scope(spark, "outer"), policies.scope(spark, "inner") as label:
        assert label == '{"name": "inner", "parent": {"name": "outer"}}' == context.getLocalProperty("spark.rdd.scope")
    assert context.getLocalProperty("spark.rdd.scope") is None


def test_sizes_beyond_a_long(spark, tmp_path):
    """Cubes of keys as orders has at 60 times sf0.1; the column is a long as long as all of them fit."""
    for name, keys in (("small", [3, 2_097_151, 3]), ("large", [3, 2_097_152, 8_999_999])):
        spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/{name}/orders.parquet")
    small, large = (QUERIES["size_string"](spark, f"{tmp_path}/{name}") for name in ("small", "large"))
    assert small.schema["n"].dataType.simpleString() == "bigint"
    assert {r.n: r["size"] for r in small.collect()} == {27: "27.0 B", 2_097_151**3: "8.0 EB"}
    assert {int(r.n): r["size"] for r in large.collect()} == {27: "27.0 B", 2**63: "8.0 EB", 8_999_999**3: "632.3 EB"}
