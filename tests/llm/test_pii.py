"""Base spans against regular expressions, disclosure against counts in plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from itertools import accumulate

import pytest
import regex
from pyspark.sql import functions as F

from shardloom.llm import pii
from shardloom.llm.common import running, running_sums
from shardloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end(), m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def plain(rows, support, partial, full):
    """(base, further) of each text by direct counting."""
    held = [base(t) for t in rows]
    words = [[(m.start(), m.end(), m[0]) for m in regex.finditer(r"[\p{L}\p{N}]+", t)] for t in rows]
    n = len(rows)
    c_e, c_t, c_et = Counter(), Counter(), Counter()
    for spans, own in zip(held, words, strict=True):
        entities, terms = {(k, v) for k, _, _, v in spans}, {w.lower() for _, _, w in own}
        c_e.update(entities)
        c_t.update(terms)
        c_et.update((e, t) for e in entities for t in terms)
    out = []
    for spans, own in zip(held, words, strict=True):
        entities, more = {(k, v) for k, _, _, v in spans}, []
        for a, b, w in own:
            best = max((math.log(n * c_et[e, w.lower()] / (c_e[e] * c_t[w.lower()])) / math.log(n / c_e[e]) for e in entities if support <= c_e[e] < n and c_et[e, w.lower()] >= support), default=-1)
            if best >= partial - 1e-9 and not any(a < d and c < b for _, c, d, _ in spans):
                more.append(("removed" if best >= full - 1e-9 else "generalised", a, b))
        out.append(([x[:3] for x in spans], sorted(more)))
    return out


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_against_plain_python(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, plain([r.text or "" for r in rows], pii.SUPPORT, pii.PARTIAL, pii.FULL), strict=True)}
    got = QUERIES["op10_pii"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        found, more = want[r.doc_id]
        n = Counter(k for k, _, _ in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(written(found).encode()).hexdigest()
        assert r.spans == written([*found, *more])
    assert any(more for _, more in want.values())


HARD = [
    "a@b.c_d@e.f..x@y.z", "me@host", "x@-.-", "é1.2.3.4.5.6.7.8", "1.2.3.256 01.002.0003.255 1..2.3.4", "4111 1111 1111 1111-4111111111111111", "0000000000000 00000000000000000000",
    "+1 (743) 555-3824 x +12 ++123456789- +1.2.3.4.5.6.7.8.9.0", "1 " * 6000, "7" * 3000, "a." * 4000 + "@b.c", "u@" + "a." * 4000 + "b", "%" * 3000, "", "@", "+", "😀 joe@ex.org 😀 10.0.0.1",
]


def test_hard_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "i int, text string")
    for r in df.select("i", pii.base_spans(F.col("text")).alias("s")).collect():
        assert [tuple(x) for x in r.s] == base(HARD[r.i]), HARD[r.i][:40]


@pytest.mark.parametrize("most", [0, pii.BROADCAST_TERMS])
def test_disclosure(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    texts = ["call +1 234 567 8901 about zebra finch", "Zebra +1 234 567 8901 owner", "owner finch calls", "owner of lines", "lines", None, "call zebra joe@x.org", *["filler text"] * 30]
    df = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, pii_tuple(r.base), pii_tuple(r.further)) for r in pii.find_spans(df, partial=0.5).collect())
    want = [(i, x, y) for i, (x, y) in enumerate(plain([t or "" for t in texts], 2, 0.5, 1.0))]
    assert got == want
    clean = {r.doc_id or 0: r.text for r in pii.sanitised(df, partial=0.5).collect()}
    assert clean[0] == "call <phone> about <generalised> finch"
    assert clean[5] is None and clean[4] == "lines"
    assert pii.sanitised(df).columns == df.columns
    assert pii.find_spans(df.limit(0)).count() == 0


def test_short_terms_and_terms_with_digits_are_judged(spark):
    texts = [f"Bo x{k}9 mail bo@ex.org id u77 the 李" for k in range(3)] + [f"the rest {k} the" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(s.kind, s.value) for s in r.further} for r in pii.find_spans(df).collect()}
    assert all(got[k] == {("removed", w) for w in ("Bo", "mail", "id", "u77", "李")} for k in range(3))
    assert not any(got[k] for k in range(3, 63))
    assert {r.text for r in pii.sanitised(df).collect() if r.doc_id == 1} == {" x19  <email>   the "}


def test_many_matches_take_time_in_proportion(spark):
    numbers = [random.Random(4).randrange(50) for _ in range(70_000)]
    row = spark.createDataFrame([(numbers,)], "x array<int>")
    got = row.select(running_sums(F.col("x")).alias("s"), running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).first()
    assert got.s == list(accumulate(numbers)) and got.m == list(accumulate(numbers, max))
    took = []
    for n in (4000, 32_000):
        text = "😀 ".join(f"user{i}@ex{i}.org and" for i in range(n))
        began = time.time()
        spans = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).first().s
        took.append(time.time() - began)
        assert [tuple(s) for s in spans] == base(text)
    assert took[1] < 30 * max(took[0], 0.3)


def test_overlaps_in_long_texts(spark):
    """Terms of the entities' own texts are left to the entities, wherever they stand."""
    text = " ".join(f"+1 234 567 {k:04d} zebra user{k}@ex.org" for k in range(3000))
    df = spark.createDataFrame([(0, text), (1, text)] + [(k, "filler text") for k in range(2, 20)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert {s.value for s in got[0].further} == {"zebra"} and len(got[0].further) == 3000
    assert pii.sanitised(df).filter("doc_id = 1").first().text == " ".join(["<phone>  <email>"] * 3000)


def pii_tuple(spans):
    return [(s.kind, s.start, s.end) for s in spans]
