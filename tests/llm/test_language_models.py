"""N-gram models against dictionaries, the classifier against held-out labels."""

import math
import pickle
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import grams, kneser_ney, lm_score, quality
from shardloom.llm.queries import QUERIES
from shardloom.sources import tables

TEXTS = ["the cat sat", "the cat sat on the the the mat", "a dog  ran\nran ran", "", "éa é\U0001f600 zz", "the dog sat on a cat", " \t", "日本語の文 mixed 中文", "aa aa aaa", "x" * 3000 + " y"]
SPACE = "\x20\t\n\x0b\x0c\r"


def symbols_of(text, order):
    out, last = [], None
    for word in re.findall(f"[^{SPACE}]+", text):
        out += [grams.AGAIN if word == last else 32, *map(ord, word)]
        last = word
    return [grams.PAD] * (order - 1) + out + [grams.END]


def words_of(text):
    single = "".join(f"{chr(a)}-{chr(b)}" for a, b in grams.UNSPACED)
    return re.findall(f"[{single}]|[^{SPACE}{single}]+", text)


@pytest.mark.parametrize("order", [2, 3, 5])
def test_symbols(order):
    run, sizes = grams.symbols(TEXTS, order)
    want = [symbols_of(t, order) for t in TEXTS]
    assert sizes.tolist() == [len(w) for w in want]
    assert run.tolist() == [s for w in want for s in w]
    assert grams.symbols(["", ""], 2)[0].tolist() == [grams.PAD, grams.END] * 2


def test_words():
    words = grams.Words(*grams.code_points(TEXTS), single=True)
    want = [(i, w) for i, t in enumerate(TEXTS) for w in words_of(t)]
    assert words.texts.tolist() == [i for i, _ in want]
    by = {}
    for h, (_, w) in zip(words.hashes.tolist(), want, strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_words_pattern_is_sparks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    got = dict(df.select("i", F.regexp_count("t", F.lit(grams.WORDS_PATTERN))).collect())
    assert got == {i: len(words_of(t)) for i, t in enumerate(TEXTS)}


def test_table_finds_all_but_what_is_left_over():
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 700, np.uint64))
    table = grams.Table(keys, np.arange(len(keys)) + 1.0, 10)
    assert 0 < len(table.left_over) < 150
    found, missing = table.find(np.concatenate([keys, keys + np.uint64(1)]))
    left = set(table.left_over.tolist())
    assert [int(x) for x in found[: len(keys)]] == [0 if i in left else i + 1 for i in range(len(keys))]
    assert set(missing.tolist()) == left | set(range(len(keys), 2 * len(keys)))


def test_table_is_sent_without_its_free_places_and_leaves_over_what_comes_last():
    keys = grams.mixed(np.arange(1, 30_001, dtype=np.uint64))
    table = grams.Table(keys, np.arange(len(keys)) + 1.0, 16)
    assert len(table.left_over) and table.left_over.min() > 5_000
    sent = pickle.dumps(grams.Table(keys[:100], np.ones(100), 16), 5)
    assert len(sent) < 10_000
    again = pickle.loads(pickle.dumps(table, 5))
    assert all((a == b).all() for a, b in zip(again.find(keys), table.find(keys), strict=True)) and (again.left_over == table.left_over).all()


class Plain:
    """Interpolated modified Kneser-Ney by recursion over dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        runs = [symbols_of(t, order) for t in texts]
        top = Counter(tuple(s[i - order + 1 : i + 1]) for s in runs for i in range(order - 1, len(s)))
        self.levels = {order: top}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in {x[order - k - 1 :] for x in top})
        self.d, self.totals, self.cuts = {}, {}, {}
        for k, level in self.levels.items():
            n = Counter(level.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            self.d[k] = {j: min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] else 0.5 * j, 0.05), j - 0.05) for j in (1, 2, 3)}
            self.totals[k], self.cuts[k] = Counter(), Counter()
            for g, c in level.items():
                self.totals[k][g[:-1]] += c
                self.cuts[k][g[:-1]] += self.d[k][min(c, 3)]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / kneser_ney.UNIFORM
        total = self.totals[k][gram[:-1]]
        if not total:
            return self.p(gram[1:])
        c = self.levels[k][gram]
        return (c - (self.d[k][min(c, 3)] if c else 0) + self.cuts[k][gram[:-1]] * self.p(gram[1:])) / total

    def loss(self, text):
        s = symbols_of(text, self.order)
        at = range(self.order - 1, len(s))
        return -sum(math.log(self.p(tuple(s[i - self.order + 1 : i + 1]))) for i in at) / len(at)


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of three languages, the third one too small for a model of its own, and labels."""
    rng = random.Random(8)
    stock = {"aa": ["tree", "stone", "river", "é", "a"], "bb": ["木", "石の", "川", "水"], "cc": ["x", "yz"]}
    rows = []
    for i in range(420):
        lang = "aa" if i % 3 else "bb"
        lang = None if i % 60 == 1 else "cc" if i % 60 == 2 else lang
        rows.append((i, " ".join(rng.choice(stock[lang or "cc"]) for _ in range(rng.randrange(1, 25))), lang, 1.0, "k"))
    odd = [(1000, "", "aa", 0.5, "k"), (1001, None, "bb", 0.5, None), (None, "tree stone", "aa", 0.5, "k"), (1002, "QQ## QQ##", "aa", 1.5, "k"), (1002, "QQ## QQ##", "aa", 1.5, "k"), (1003, "tree " * 40_000, "aa", 2.5, "k"), (1004, "木" * 60_000, "bb", 2.5, "k"), (1005, "zz", "dd", 2.5, "k")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, n_tokens double, kept string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i in range(420)] + [(None, 1), (5, 1), (9, None)], "doc_id long, quality int")
    return docs, labels


@pytest.mark.parametrize("head", [0, 40, 1 << 19])
def test_classifier_against_dictionaries(spark, labelled, head):
    """The same losses whether all, some or none of the grams are joined by shards; thresholds are the quantiles of the halves not trained on."""
    docs, labels = labelled
    order, fewest = 3, 20
    model = quality.fit(docs, labels, order=order, fewest=fewest, quantile=0.9, head=head)
    assert (model.tail is None or head < 1 << 19) and model.groups == ["aa", "bb"]
    sample = quality._sample(docs, labels, quality.TRUSTED).collect()
    assert len({r.doc_id for r in sample}) == len(sample) == sum(1 for i in range(420) if i % 7 != 0)
    of = lambda lang: lang if lang in ("aa", "bb") else ""
    plain = {g: Plain([r.text for r in sample if of(r.lang) == g and r.held == 0], order) for g in ("aa", "bb", "")}
    limits = {}
    for g in plain:
        held = [plain[g].loss(r.text) for r in sample if of(r.lang) == g and r.held == 1]
        if len(held) >= fewest:
            limits[g] = float(np.quantile(held, 0.9))
    assert set(limits) == {"aa", "bb"}
    got = quality.judged(docs, model, ["doc_id", "text", "lang", "n_tokens", "kept"]).toPandas()
    assert len(got) == docs.count()
    columns = ["doc_id", "text", "lang", "own", "flag", "n", "perplexity", "threshold", "stays"]
    for r in got.set_axis(columns, axis=1).itertuples():
        text, g = r.text or "", of(r.lang)
        if not text.split():
            assert (r.n, r.stays) == (0, True) and math.isnan(r.perplexity)
            continue
        assert r.n == len(symbols_of(text, order)) - order + 1
        assert math.log(r.perplexity) == pytest.approx(plain[g].loss(text), abs=1e-6)
        assert (math.log(r.threshold) == pytest.approx(limits[g], abs=1e-6)) if g in limits else math.isnan(r.threshold)
        assert r.stays == (g not in limits or plain[g].loss(text) <= limits[g] + 1e-9)
    rejected = got.set_axis(columns, axis=1).query("not stays")
    assert 1002 in set(rejected.doc_id) and 1005 not in set(rejected.doc_id)
    kept = quality.kept_rows(docs, model)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert kept.count() == len(got) - len(rejected)


def test_classifier_on_odd_tables(spark, labelled):
    docs, labels = labelled
    none = quality.fit(docs, labels.limit(0))
    assert all(r.kept for r in quality.judged(docs, none, ["doc_id"]).collect())
    assert quality.judged(docs.limit(0), none, ["doc_id"]).count() == 0
    model = quality.fit(docs.limit(0), labels)
    assert quality.kept_rows(docs, model).count() == docs.count()
    few = quality._sample(docs, labels, 30).collect()
    assert len(few) == 30 and Counter(r.lang for r in few)["cc"] >= 5


def test_classifier_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels, most=2000)
    used = {r.doc_id for r in quality._sample(docs, labels, 2000).select("doc_id").collect()}
    rows = quality.judged(docs, model, ["doc_id"]).join(labels.dropDuplicates(["doc_id"]), "doc_id").collect()
    rows = [r for r in rows if r.doc_id not in used]
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 1000 and sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.05


def scores_of(rows, target):
    """Cross-entropy differences with dictionaries; each document's own counts are taken off."""
    texts = [(i, words_of(t or "")) for i, t in rows]
    full = [(i, w) for i, w in texts if w]
    grams_of = lambda w: Counter(w) + Counter(zip([None, *w], w, strict=False))
    every, near = Counter(), Counter()
    n = {"all": 0, "near": 0, "texts": len(full), "near texts": 0}
    for i, w in full:
        every += grams_of(w)
        n["all"] += len(w)
        if i in target:
            near += grams_of(w)
            n["near"] += len(w)
            n["near texts"] += 1
    scale = n["near"] / n["all"] if n["near"] else 1
    out = []
    for i, w in texts:
        own, mine = grams_of(w), i in target

        def loss(counts, words, begins, share, factor, w=w, own=own):
            total = 0
            for v, x in zip([None, *w], w, strict=False):
                low = (factor * (counts[x] - share * own[x]) + lm_score.WORD_MASS / lm_score.UNIFORM) / (factor * (words - share * len(w)) + lm_score.WORD_MASS)
                context = begins - share if v is None else counts[v] - share * own[v]
                total -= math.log((factor * (counts[v, x] - share * own[v, x]) + lm_score.PAIR_MASS * low) / (factor * context + lm_score.PAIR_MASS))
            return total / len(w)

        out.append((i, len(w), *((loss(near, n["near"], n["near texts"], int(mine), 1), loss(every, n["all"], n["texts"], 1, scale)) if w else (None, None))))
    return out


@pytest.mark.parametrize("split_bytes", [1 << 23, 300])
def test_scores_against_dictionaries(spark, split_bytes):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, None), (None, "the cat"), (3, "the cat")]
    rows += [(100 + i, " ".join(rng.choice(["the", "cat", "語", "中", "on", "a", "é"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, n_tokens string, split double")
    marks = [1, 1, 5, 7, 105, 110, 120, None]
    target = spark.createDataFrame([(x,) for x in marks], "doc_id long")
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in lm_score.lm_scores(docs, target, split_bytes=split_bytes).collect()), key=order)
    want = sorted(scores_of(rows, {x for x in marks if x is not None}), key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for (_, n, near, far, score), (_, _, a, b) in zip(got, want, strict=True):
        assert (near, far, score) == ((None, None, None) if not n else pytest.approx((a, b, a - b), abs=1e-9))
    assert lm_score.lm_scores(docs.limit(0), target).count() == 0
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in lm_score.lm_scores(docs, target.limit(0)).filter("n_tokens > 0").collect())


def test_scores_tell_scripts_apart(spark):
    """Texts of one script, once in the target and once not, beside documents of another script."""
    rows = [(i, "今日は天気がいい") for i in range(6)] + [(10 + i, "我们明天去北京") for i in range(6)] + [(20 + i, "오늘 날씨가 좋다") for i in range(6)] + [(30 + i, "it rains a lot") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.lm_scores(docs, spark.createDataFrame([(i,) for i in range(6)], "doc_id long")).collect()}
    assert max(got[i] for i in range(6)) < min(v for k, v in got.items() if k >= 6) - 1
    assert len({round(got[i], 6) for i in (10, 20, 30)}) == 3


def test_query_against_dictionaries(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 AND toxic = 0").collect()}
    want = {r[0]: r[1:] for r in scores_of(rows, target)}
    got = QUERIES["op1_lm_scoring"](spark, sf).collect()
    assert len(got) == len(want) == 200
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_tokens == n and (r.score is None if not n else r.score == pytest.approx(a - b, abs=1e-8))


def test_quality_query_against_dictionaries(spark):
    """The registered query with its own parameters, document by document."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sample = quality._sample(docs, labels, quality.TRUSTED).collect()
    plain = Plain([r.text for r in sample if r.held == 0], quality.ORDER)  # too few of each language: one group
    held = [plain.loss(r.text) for r in sample if r.held == 1]
    limit = float(np.quantile(held, quality.QUANTILE)) if len(held) >= quality.FEWEST else None
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = QUERIES["op6_quality"](spark, sf).collect()
    assert len(got) == len(texts) == 200
    for r in got:
        loss = plain.loss(texts[r.doc_id])
        assert math.log(r.perplexity) == pytest.approx(loss, abs=1e-6)
        assert r.kept == (limit is None or loss <= limit)


def test_classifier_is_fitted_on_all_trusted_rows(spark, monkeypatch):
    """More rows than any bound on them that there was; all train or are held out."""
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("tree "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    halves = {r.held: r["count"] for r in quality._sample(docs, labels, quality.TRUSTED).groupBy("held").count().collect()}
    assert sum(halves.values()) == 20_500
    seen = []
    real = kneser_ney.weights
    monkeypatch.setattr(kneser_ney, "weights", lambda texts, *rest: seen.append(texts.count()) or real(texts, *rest))
    model = quality.fit(docs, labels)
    assert seen == [halves[0]] and model.groups == ["aa"] and set(model.thresholds) == {"aa"}


def test_head_holds_what_occurs_most_and_the_fit_leaves_only_the_tail(spark, labelled):
    """Of all orders the grams that occur most go to every task, as many as there is room for; files cut on the way are gone."""
    docs, labels = labelled
    before = {path for _, path in tables._cuts}
    model = quality.fit(docs, labels, order=3, fewest=20, head=60)
    left = [path for _, path in tables._cuts if path not in before]
    assert len(left) == 1 and all(left[0] in f for f in model.tail.inputFiles())
    assert {x.name for x in Path(left[0]).parent.glob("cut-*")} <= {Path(x).name for x in (*before, *left)}
    occurs = Counter()
    for r in quality._sample(docs, labels).filter("held = 0").collect():
        group = r.lang if r.lang in ("aa", "bb") else ""
        run, _ = grams.symbols([r.text or ""], 3)
        for k, hashes in grams.gram_keys(run, 3):
            occurs.update(grams.key_of(hashes[2:], quality._seeds(group, 3)[k - 1]).tolist())
    held = set(model.table.keys[model.table.keys != 0].tolist())
    tail = {x.key % 2**64: x.weight for x in model.tail.collect()}
    assert 55 <= len(held) <= 60 and not held & set(tail) and set(occurs) <= held | set(tail)
    fewest = min(occurs[x] for x in held & set(occurs))
    assert max(occurs[x] for x in tail) <= fewest * 2 ** (1 / 16) + 1
