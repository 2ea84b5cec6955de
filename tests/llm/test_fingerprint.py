"""Fingerprints against the contract in plain Python."""

import hashlib

import pytest

from shardloom.llm import fingerprint
from shardloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain(rows):
    """doc_id -> (n_chars, edited_sha256, near_edited, near_next), rows in order of falling identifier."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        fold = fingerprint.canonical
        out[doc] = (len(text), hashlib.sha256(new.encode()).hexdigest(), float(fold(text) == fold(new)), float(fold(text) == fold(after)))
    return out


def test_query_against_plain_python(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows)
    got = QUERIES["op4_fingerprints"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == want
    form = {d: fingerprint.canonical(t) for d, t in rows}
    by = {}
    for r in got:
        assert by.setdefault(r.fingerprint, form[r.doc_id]) == form[r.doc_id]
    assert len(by) == len({*form.values()})


def test_canonical():
    assert fingerprint.canonical("  Ｆｉne\tSTRASSE\n") == fingerprint.canonical("ﬁne straße") == b"fine strasse"
    assert fingerprint.canonical("é") == fingerprint.canonical("É")
    assert fingerprint.canonical("") == fingerprint.canonical(" \n") == b""


def test_byte_comparison_inside_equal_buckets(spark):
    rows = [(i, f"text {i % 9}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df, digest=lambda form: bytes([form[-1] % 2])).collect()}
    for i, a in rows:
        for j, b in rows:
            assert (got[i] == got[j]) == (a == b)


@pytest.mark.parametrize("parts", [1, 5])
def test_odd_rows(spark, parts):
    rows = [(4, None, "x"), (None, "Last ONE", "y"), (2, "ab", "z"), (2, "ab", "z"), (9, "four five", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(parts)
    got = sorted((r.doc_id or -1, r.n_chars, r.near_next) for r in fingerprint.edited_fingerprints(df).collect())
    assert got == [(-1, 8, 0.0), (2, 2, 0.0), (2, 2, 1.0), (4, 0, 0.0), (9, 9, 0.0)]
    one = fingerprint.edited_fingerprints(df.filter("doc_id = 9")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(9, 1.0)]
    assert fingerprint.edited_fingerprints(df.limit(0)).count() == fingerprint.fingerprints(df.limit(0)).count() == 0
