"""Document fingerprints: canonical exact digests.

The canonical form is NFKC, case folded, NFKC again, runs of white space folded
to one space and the ends stripped; the fingerprint is its 128-bit XXH3. Rows
are grouped by digest and compared byte by byte inside a group: a group whose
smallest and largest canonical form differ is a collision, and its members get
the rank of their form as a suffix, so equal fingerprints mean equal forms.

Only rows whose digest occurs more than once can collide. A bloom filter of
those digests (at most FILTER_BITS bits) goes to the second reading of the
texts, which therefore shuffles the repeated forms only, folded within a batch.

Defined results: null text is empty; a null identifier comes after all others
and rows that repeat one are ordered by text; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm.common import arrow_map, cut, raw

#: Bits of the filter of repeated digests, at most (8 MB), and bits for each digest.
FILTER_BITS, BITS_EACH = 1 << 26, 16
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def canonical(text: str) -> bytes:
    """The canonical form, in UTF-8."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode()


def wide(form: bytes) -> bytes:
    """128-bit digest of a canonical form."""
    return xxhash.xxh3_128_digest(form)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=wide) -> DataFrame:
    """doc_id, fingerprint of every row; equal exactly if the canonical forms are."""

    def over(batch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(x.decode())).hex() for x in batch.column(1).to_pylist()])], names=["doc_id", "fingerprint"])

    rows = cut(arrow_map(_slim(df, id_col, text_col), over, "doc_id long, fingerprint string"))
    return told_apart(rows, df, id_col, text_col, digest)


def _slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("body"))


def _positions(digest: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(digest, 1), xxhash.xxh64_intdigest(digest, 2) | 1
    return [(a + k * b) % bits for k in range(4)]


def repeated_filter(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Bytes of a bloom filter over the fingerprints that occur more than once, and its bits (a power of two)."""
    repeated = cut(rows.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    n = repeated.count()
    bits = min(FILTER_BITS, 1 << max(10, (BITS_EACH * n - 1).bit_length())) if n else 0
    filled = np.zeros(bits // 8, np.uint8)
    if n:

        def over(batch):
            at = np.unique([x for d in batch.column(0).to_pylist() for x in _positions(bytes.fromhex(d), bits)]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // 8), pa.array(1 << (at % 8))], names=["byte", "mask"])

        masks = arrow_map(repeated, over, "byte long, mask long", 10_000).groupBy("byte").agg(F.bit_or("mask").alias("mask")).toArrow()
        filled[masks.column(0).to_numpy()] = masks.column(1).to_numpy().astype(np.uint8)
    return filled, bits


def collisions(rows: DataFrame, df: DataFrame, id_col: str, text_col: str, digest=wide) -> DataFrame | None:
    """The fingerprints under which different canonical forms stand; None if there are none."""
    filled, bits = repeated_filter(rows)
    if not bits:
        return None
    shared = df.sparkSession.sparkContext.broadcast(filled)

    def repeated(batch):
        table, found = shared.value, {}
        for body in batch.column(1).to_pylist():
            form = canonical(body.decode())
            d = digest(form)
            if all(table[x >> 3] >> (x & 7) & 1 for x in _positions(d, bits)):
                found[form] = d
        yield pa.RecordBatch.from_arrays([pa.array([d.hex() for d in found.values()], pa.string()), pa.array(list(found), pa.binary())], names=["fingerprint", "form"])

    forms = arrow_map(_slim(df, id_col, text_col), repeated, "fingerprint string, form binary", 10_000)
    clash = forms.groupBy("fingerprint").agg(F.min("form").alias("a"), F.max("form").alias("b")).filter("a != b").select("fingerprint")
    clash = cut(clash)
    return None if clash.isEmpty() else clash


def told_apart(rows: DataFrame, df: DataFrame, id_col: str, text_col: str, digest=wide) -> DataFrame:
    """rows with a suffix on fingerprints that stand for several canonical forms; rows: doc_id, fingerprint, others."""
    clash = collisions(rows, df, id_col, text_col, digest)
    if clash is None:
        return rows

    def over(batch):
        forms = [canonical(x.decode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x).hex() for x in forms]), pa.array(forms, pa.binary())], names=["doc_id", "fingerprint", "form"])

    members = arrow_map(_slim(df, id_col, text_col), over, "doc_id long, fingerprint string, form binary").join(clash, "fingerprint")
    ranks = members.select("fingerprint", "form").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")) - 1)
    # a repeated identifier keeps one rank for each of its forms: the n-th row of (identifier, fingerprint) takes the n-th form
    order = Window.partitionBy("doc_id", "fingerprint").orderBy("rank")
    ranked = members.join(ranks, ["fingerprint", "form"]).select("doc_id", "fingerprint", "rank").withColumn("nth", F.row_number().over(order))
    named = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "fingerprint").orderBy(F.lit(0))))
    on = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.fingerprint") == F.col("k.fingerprint")) & (F.col("r.nth") == F.col("k.nth"))
    suffix = F.when(F.col("k.rank") > 0, F.concat(F.lit("-"), F.col("k.rank").cast("string"))).otherwise(F.lit(""))
    other = [F.col(f"r.{c}") for c in rows.columns if c not in ("doc_id", "fingerprint")]
    return named.alias("r").join(ranked.alias("k"), on, "left").select(F.col("r.doc_id"), F.concat(F.col("r.fingerprint"), suffix).alias("fingerprint"), *other).select(*rows.columns)


def edited(text: str, following: str) -> str:
    """The last half of the text's code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judged(doc, text: str, following: str, digest) -> tuple:
    changed = edited(text, following)
    own, new, after = canonical(text), canonical(changed), canonical(following)
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(own).hex(), digest(new).hex(), float(own == new), float(own == after)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=wide) -> DataFrame:
    """Each row against its edited text and against the next row, by falling identifier; after the last comes the first.

    Rows are dealt by range of the identifier, so each but the last of a
    partition meets its next one there. Of every partition the first and the
    last row come out with their texts and the partition's number; the numbers
    alone are put in order, and each last row is joined to the first row of the
    partition that comes next and judged in a second step.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("body").desc()]
    dealt = _slim(df, id_col, text_col).repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32(), pa.binary(), pa.int32()]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")] + ["edge", "body", "part"]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def over(batches):
        held, part_id = None, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if held is None:
                        rows.append((doc, *[None] * 6, 0, body, part_id))
                    else:
                        rows.append((*_judged(held[0], held[1], text := body.decode(), digest), None, None, None))
                    held = (doc, text if held is not None else body.decode())
                if rows:
                    yield made(rows)
        if held is not None:
            yield made([(held[0], *[None] * 6, 1, held[1].encode(), part_id)])

    rows = cut(dealt.mapInArrow(over, SCHEMA + ", edge int, body binary, part int"))
    firsts = rows.filter("edge = 0").select("part", F.col("body").alias("following"))
    lasts = rows.filter("edge = 1").select(F.col("part").alias("of"), "doc_id", "body")
    # one number a partition that holds rows: the first of them comes after the last
    numbers = Window.partitionBy(F.lit(0)).orderBy("part")
    least = F.min("part").over(numbers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nexts = rows.filter("edge = 0").select("part").select(F.col("part").alias("of"), F.coalesce(F.lead("part").over(numbers), least).alias("part"))
    ends = lasts.join(nexts, "of").join(firsts, "part").select("doc_id", "body", "following")

    def last(batch):
        out = [_judged(d, t.decode(), f.decode(), digest) for d, t, f in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds[:7])], names=names[:7])

    whole = rows.filter("edge IS NULL").drop("edge", "body", "part").union(arrow_map(ends, last, SCHEMA))
    return told_apart(whole, df, id_col, text_col, digest)
