"""BPE against the library on real and odd texts."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from tokenizers import Tokenizer

from shardloom.llm import bpe
from shardloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


OWN = bpe.Encoder(bpe.read_vocabulary(PATH))


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=80))
def test_any_text(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids
    assert OWN.decode(OWN.encode(text)).decode() == text


def test_odd_texts(library):
    rng = random.Random(3)
    texts = ["", " ", "\n \n", "a" * 4000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "'s 't 'LL", "\x1c\x85​　", "é" * 99]
    texts += ["".join(rng.choice("aeiou theing,.!0123\n\t ") for _ in range(500)) for _ in range(50)]
    for text in texts:
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_small_tables_give_the_same_ids(library):
    small = bpe.Encoder(bpe.read_vocabulary(PATH), pieces=3)
    text = "one two three four five two one six seven one " * 3
    assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_files_with_other_rules_are_refused():
    with pytest.raises(ValueError, match="normalizer.*end_of_word_suffix"):
        bpe.Encoder(bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    spec = json.loads(bpe.read_vocabulary(PATH))
    for change in ({"pre_tokenizer": None}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError, match="not supported"):
            bpe.refuse_others(spec | change)


def test_odd_rows(spark):
    rows = [(1, None, 5, None), (None, "", 6, "x"), (2, "hello world", 7, "y"), (2, "hello world", 7, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens string")
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).select("doc_id", "text", "n_tokens", "decoded", bpe.ids_array().alias("list")).collect()
    assert sorted((r.n_tokens, r.decoded) for r in out) == [(0, ""), (0, ""), (2, "hello world"), (2, "hello world")]
    assert [r.list for r in out if r.n_tokens] == [[31373, 995]] * 2
    once = bpe.bpe_roundtrip(df, PATH).select("doc_id", "n_tokens", "decoded", bpe.ids_array().alias("list")).collect()
    assert sorted(map(repr, once)) == sorted(repr(type(once[0])(doc_id=r.doc_id, n_tokens=r.n_tokens, decoded=r.decoded, list=r.list)) for r in out)
    assert bpe.bpe_encode(df.limit(0), PATH).count() == bpe.bpe_roundtrip(df.limit(0), PATH).count() == 0
