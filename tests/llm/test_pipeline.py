"""The pipeline against plain Python, stage by stage on what came before."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shardloom.llm import mixing, quality
from shardloom.llm.common import cut, normal_space
from shardloom.sources import tables
from tests.llm.test_mixing import reshared
from tests.llm.test_similar import grouped

SF = "/root/testdata/sf0.01"


def taken(rows):
    """Copies of each doc by ordering each source in full by random odds over inclusion odds."""
    sizes = {d: len(r.text.encode().split()) for d, r in rows.items()}
    sources = sorted({r.source for r in rows.values()})
    words = [sum(sizes[d] for d, r in rows.items() if r.source == s) for s in sources]
    out = {}
    for s, total, target in zip(sources, words, reshared(words, [(5, 2, 1)[i % 3] for i in range(len(sources))], 3), strict=True):
        whole = int(target // total) if total else 0
        rest, spent, more = target - whole * total, 0, True
        own = [d for d, r in rows.items() if r.source == s]
        p = rest / total if total else 0
        mean = sum(sizes[d] * sizes[d].bit_length() for d in own) / total if total else 0

        def rank(d, p=p, mean=mean):
            u = int(hashlib.sha256(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 2**52
            chance = p + p * (1 - p) * mixing.TILT * (sizes[d].bit_length() - mean) / mixing.DOUBLINGS
            return (u / (1 - u)) / (chance / (1 - chance))

        for d in sorted(own, key=rank) if p else own:
            more = more and rest > 0 and spent + sizes[d] / 2 <= rest
            spent += sizes[d]
            out[d] = whole + more
    return out


def test_run_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stay = {r.doc_id for r in quality.judged(docs, model, ["doc_id"]).collect() if r.kept}
    rows = {d: r for d, r in rows.items() if d in stay}
    first = {}
    for d in sorted(rows):
        first.setdefault(normal_space(rows[d].text.encode()), d)
    rows = {d: rows[d] for d in first.values()}
    part, _ = grouped([(d, r.text) for d, r in rows.items()])
    rows = {d: r for d, r in rows.items() if part[d] == d}
    copies = {d: n for d, n in taken(rows).items() if n}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(copies)
    for r in got:
        ids = library.encode(rows[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest()


def test_stages_keep_the_columns_and_bear_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert (out.columns, out.count()) == (docs.columns, 0), name


def test_stages_bear_nulls_repeats_and_clashing_columns(spark):
    """Columns named as the stages' own are carried along; rows without texts, identifiers or sources have defined results."""
    sf = "/root/testdata/sf0.001"
    own = ["kept", "n_tokens", "__n", "node", "component", "copies", "__c0", "group", "key"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, 1), (7, "", "en", None, 1), (7, "", "en", None, 1), (None, "a b c", None, "src1", 1), (9, "word " * 30_000, "en", "src2", 1)], docs.schema)
    wide = docs.union(odd).select("*", *[F.lit(i).alias(c) for i, c in enumerate(own)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, wide, sf))
        assert out.columns == wide.columns, name
        assert out.count() > 20, name
        assert all(tuple(r[c] for c in own) == tuple(range(len(own))) for r in out.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).count() == wide.count()


def test_quality_stage_holds_no_files_of_its_fit(spark):
    """While texts are judged, only the model's tail and the scored rows are on disk, and whatever is left of the stage is read by its result."""
    before = {path for _, path in tables._cuts}
    out = corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    left = [path for _, path in tables._cuts if path not in before]
    assert len(left) <= 2 and all(any(path in f for f in out.inputFiles()) for path in left)
