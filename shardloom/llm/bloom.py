"""Bloom filters over columns of longs, bounded in size whatever the number of keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.llm.common import arrow_map

#: Bits of a filter, at most (8 MB), bits for each key, and bits that a key sets.
FILTER_BITS, BITS_EACH, SET = 1 << 26, 16, 4


def _position(keys: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit that each key sets as its probe-th; keys are hashes already."""
    k = keys.view(np.uint64)
    return ((k + np.uint64(probe) * (k >> np.uint64(29) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """Bytes of a filter over the one column of longs; at most FILTER_BITS bits."""
    n = keys.count()
    bits = min(FILTER_BITS, 1 << max(10, (BITS_EACH * n).bit_length()))

    def over(batch):
        own = batch.column(0).to_numpy().astype(np.int64)
        at = np.unique(np.concatenate([_position(own, i, bits) for i in range(SET)]))
        first = np.flatnonzero(np.append(True, at[1:] >> 6 != at[:-1] >> 6)) if len(at) else at
        mask = np.bitwise_or.reduceat(np.int64(1) << (at & 63), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array((at[first] >> 6).astype(np.int32)), pa.array(mask)], names=["word", "mask"])

    # in words of 64 bits: their numbers and masks that come to the driver are 1.5 times the filter at most
    found = arrow_map(keys, over, "word int, mask long", 10_000).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    filled = np.zeros(bits // 64, "<i8")
    filled[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return filled.view(np.uint8)


def may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter's keys may include; later probes see only what earlier ones leave."""
    left = np.arange(len(keys))
    for probe in range(SET):
        at = _position(keys[left], probe, 8 * len(filled))
        left = left[(filled[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
    return left
