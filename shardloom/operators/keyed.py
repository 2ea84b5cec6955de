"""Keyed aggregation: combining, grouping, upserts.

An aggregator is three functions: make a combiner of a value, merge a value
into it, merge two of them. Where the algebra is known it is written as Spark's
aggregate functions, which Catalyst plans as partial and final aggregation. For
opaque Python functions combine_opaque folds within each batch first, so that a
key's rows shrink before the shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def combine_by_key(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """key and one column for each aggregate; nulls are one key."""
    return df.groupBy(F.col(key).alias("key")).agg(*[a.alias(name) for name, a in aggregates.items()])


def group_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and the sorted array of its values, repeats included."""
    return combine_by_key(df, key, values=F.array_sort(F.collect_list(value)))


def combine_opaque(df: DataFrame, key: str, value: str, create: Callable, merge_value: Callable, merge_combiners: Callable, finish: Callable, result: str) -> DataFrame:
    """key and finish(combiner) for any triple of Python functions; merge_value takes (value, combiner).

    Functions get values as Python objects, nulls as None. Nulls are one key.
    Combiners travel pickled; only they are shuffled, one for each key and batch,
    and merged as each task streams its keys in order.
    """
    key_type = df.schema[key].dataType
    key_arrow, value_arrow = to_arrow_type(key_type), to_arrow_type(_parse_datatype_string(result))

    def partial(batches):
        for batch in batches:
            held = {}
            for k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[k] = merge_value(v, held[k]) if k in held else create(v)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), key_arrow), pa.array([pickle.dumps(c) for c in held.values()], pa.binary())], names=["key", "combiner"])

    def final(batches):
        last, whole = None, None  # whole: a list of the one combiner so far

        def rows(keys, values):
            return pa.RecordBatch.from_arrays([pa.array(keys, key_arrow), pa.array(values, value_arrow)], names=["key", "value"])

        for batch in batches:
            keys, values = [], []
            for k, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = pickle.loads(packed)
                if whole and k == last:
                    whole = [merge_combiners(whole[0], c)]
                    continue
                if whole:
                    keys.append(last)
                    values.append(finish(whole[0]))
                last, whole = k, [c]
            yield rows(keys, values)
        if whole:
            yield rows([last], [finish(whole[0])])

    pairs = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    dealt = pairs.mapInArrow(partial, f"key {key_type.simpleString()}, combiner binary").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(final, f"key {key_type.simpleString()}, value {result}")


def cogroup(key: str, **parents: tuple[DataFrame, str]) -> DataFrame:
    """key and for each parent (frame, value column) the sorted array of its values, empty where it has none; nulls are one key.

    One shuffle: the parents' rows are grouped together, not joined.
    """
    rows = None
    for name, (frame, value) in parents.items():
        columns = [F.struct(F.col(value).alias("v")).alias(n) if n == name else F.lit(None).alias(n) for n in parents]
        frame = frame.select(F.col(key).alias("key"), *columns)
        rows = frame if rows is None else rows.union(frame)
    values = [F.array_sort(F.transform(F.collect_list(n), lambda s: s["v"])).alias(n) for n in parents]
    return rows.groupBy("key").agg(*values)


def upsert(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The value written last of each key, in the given order of writing."""
    return combine_by_key(df, key, value=F.max_by(value, F.struct(*order)))


def update_counter(df: DataFrame, key: str, first: int, step: int) -> DataFrame:
    """The first update of a key sets a value, each further one adds a step."""
    return combine_by_key(df, key, value=F.lit(first).cast("long") + step * (F.count("*") - 1))


def lookup(df: DataFrame, key: str, wanted) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return df.filter(F.col(key) == wanted)


def first_committed(df: DataFrame, keys: list[str], attempt: str, *order: str, failed: Column | None = None) -> DataFrame:
    """The attempt that asks first of each group wins the right to commit; a failed one gives it back to the next."""
    able = F.col(attempt) if failed is None else F.when(~failed, F.col(attempt))
    place = F.struct(*order) if failed is None else F.when(~failed, F.struct(*order))
    return df.groupBy(*keys).agg(F.min_by(able, place).alias("winner"), F.count("*").alias("attempts"))
