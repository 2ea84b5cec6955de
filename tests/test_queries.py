"""Every registered query against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

from shardloom.plans.registry import ORACLE_SQL, QUERIES
from shardloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else list(value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want
    assert got or name == "lookup_key"


@pytest.mark.parametrize("parts", ["1", "13"])
@pytest.mark.parametrize("name", ["combine_by_key_count_sum", "combine_opaque_triple", "group_values_by_key", "merge_sorted_runs", "partition_offsets", "sort_within_partition_first_n", "upsert_last_wins"])
def test_any_number_of_partitions(spark, name, parts):
    want = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(map(repr, QUERIES[name](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
