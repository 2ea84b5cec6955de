"""Exact dedup: Patricia-trie owners.

Rows go to partitions by length and content hash of the normalised text; each
partition inserts the full byte strings into one radix trie whose terminal
nodes hold the smallest identifier. Copies within an Arrow batch are folded
before the shuffle, so a text that fills a third of the table sends one row a
batch, not one a copy.

Defined results: null text is empty; a null identifier comes after all others
and is kept only if its group has no other; rows that repeat identifier and
text are one group and one of them stays; an empty table gives an empty table;
other columns are ignored (owners) or carried along (distinct_rows).
"""

from __future__ import annotations

import hashlib
import pickle

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from shardloom.llm.common import arrow_map, id_order, in_steps, normal_space, raw
from shardloom.llm.radix import RadixOwners

#: Bytes of strings that one task's trie holds before it spills a subtree.
TRIE_BYTES = 64 << 20
#: Rows among which copies are folded before the shuffle.
FOLD = 2048


def _folded(batch: pa.RecordBatch) -> tuple[list[int], list[pa.Array]]:
    """The owner's row of each distinct text of the batch, and columns n, h, doc, copies, body."""
    first: dict[bytes, list] = {}
    for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
        mine = first.setdefault(normal_space(text), [doc, 0, row])
        mine[1] += 1
        if id_order(doc) < id_order(mine[0]):
            mine[0], mine[2] = doc, row
    rows = [x[2] for x in first.values()]
    numbers = [[len(x) for x in first], [xxhash.xxh3_64_intdigest(x) - 2**63 for x in first], [x[0] for x in first.values()], [x[1] for x in first.values()]]
    return rows, [*(pa.array(x, pa.int64()) for x in numbers), batch.column(1).take(pa.array(rows, pa.int64()))]


def _owners(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """text_sha (binary), keep_id, group_size: one row for each distinct text."""
    schema = "n long, h long, doc long, copies long, body binary"

    def fold(batch):
        yield pa.RecordBatch.from_arrays(_folded(batch)[1], names=["n", "h", "doc", "copies", "body"])

    slim = df.select(F.col(id_col).cast("long").alias("doc"), raw(text_col).alias("body"))
    dealt = arrow_map(slim, fold, schema, FOLD).repartition("n", "h")

    def insert(batches):
        trie = RadixOwners(limit)
        for batch in in_steps(batches):
            for doc, copies, body in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                text = normal_space(body)
                trie.insert(text, doc, copies, hashlib.sha256(text).digest())
        rows = trie.rows()
        while part := [x for _, x in zip(range(20_000), rows)]:
            yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in part], pa.binary()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["text_sha", "keep_id", "group_size"])

    return dealt.mapInArrow(insert, "text_sha binary, keep_id long, group_size long")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    owners = _owners(df, id_col, text_col, limit)
    schema = "doc_id long, text_sha binary"

    def digest(batch):
        shas = [hashlib.sha256(normal_space(x)).digest() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary())], names=["doc_id", "text_sha"])

    rows = arrow_map(df.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("body")), digest, schema)
    rows = rows.groupBy("doc_id", "text_sha").agg(F.count("*").alias("times"))
    joined = rows.join(owners, "text_sha").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("text_sha")).alias("text_sha256"),
    )


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """The owner's row of each distinct text, with all columns of df.

    One shuffle of the rows that are left after folding. A trie's tags hold what
    the owner's row has besides its normalised text.
    """
    names = df.columns
    at = names.index(text_col)
    others = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names) if i != at]
    wide = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), raw(text_col).alias("__body"), F.col(f"`{text_col}`").isNull().alias("__null"), *others)
    types = to_arrow_schema(df.schema)

    def fold(batch):
        rows, columns = _folded(batch)
        values = list(zip(*(c.take(pa.array(rows, pa.int64())).to_pylist() for c in batch.columns[2:]), strict=True))
        yield pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(x, 5) for x in values], pa.binary())], names=["n", "h", "doc", "copies", "body", "rest"])

    dealt = arrow_map(wide, fold, "n long, h long, doc long, copies long, body binary, rest binary", FOLD).repartition("n", "h").select("doc", "body", "rest")

    def insert(batches):
        trie = RadixOwners(limit)
        for batch in in_steps(batches):
            for doc, body, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(normal_space(body), doc, 1, pickle.dumps((body, rest), 5))
        rows = trie.rows()
        while part := [pickle.loads(x[2]) for _, x in zip(range(512), rows)]:
            made = [(None if (values := pickle.loads(rest))[0] else body.decode(), values[1:]) for body, rest in part]
            columns = [[values[i - (i > at)] if i != at else body for body, values in made] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], names=[f"__c{i}" for i in range(len(names))])

    fields = ", ".join(f"__c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    return dealt.mapInArrow(insert, fields).select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
