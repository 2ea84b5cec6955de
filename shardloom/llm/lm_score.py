"""LM scoring by cross-entropy difference.

A target model is counted over the documents marked as target, a background
model over all documents: bigrams and words of an open vocabulary, which both
models share, whatever their script. The background's counts are scaled to the
target's mass, so that neither model is favoured by its size. A document's score
is the mean over its words of the target's loss less the background's: the
lower, the more the document is like the target.

Each order is drawn to the order below by a fixed mass, words to a uniform
distribution over UNIFORM of them:

  P(w | v) = (c(v w) + PAIR_MASS * P(w)) / (c(v) + PAIR_MASS),
  P(w) = (c(w) + WORD_MASS / UNIFORM) / (all words + WORD_MASS).

A document is in the models that score it, so its own counts are taken off
first; else a text seen once would be likely only because it was counted.

Documents are dealt by identifier into splits of about SPLIT_BYTES, where they
meet the target's identifiers. A split's distinct grams go, sorted by hash and
packed, with their two counts to the shards of the hash space; a shard adds them
up over all splits and sends each split the totals of the grams that it sent, in
the order in which it sent them. There its documents, which are dealt the same
way and not shuffled again, are scored. What is counted and sent grows with the
corpus; only five totals reach the driver.

Defined results: null or empty text has no tokens and null losses; a null
identifier is kept, and is no target; repeated rows count and come out as often
as they come in; without target rows the target is uniform; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shardloom.llm import grams
from shardloom.llm.common import let_workers_import

#: Text that a split holds, about.
SPLIT_BYTES = 8 << 20
#: Words that the lowest order is uniform over, and the masses of the two orders.
UNIFORM, WORD_MASS, PAIR_MASS = 1 << 20, 8.0, 8.0
#: Texts that are turned into words at a time.
STEP = 512
#: What marks the hash of a word; the begin of a text as a context.
BEGIN = np.uint64(0x2545F4914F6CDD1D)


class _Grams:
    """The words and bigrams of a split's texts.

    keys: the distinct hashes, sorted; words, pairs: their numbers in keys for each token;
    texts: the text of each token; first: whether a token begins its text.
    """

    def __init__(self, texts: list[str]):
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), STEP):
            words = grams.Words(*grams.code_points(texts[at : at + STEP]), single=True)
            hashes.append(words.hashes)
            owners.append(words.texts + at)
        own, self.texts = np.concatenate(hashes), np.concatenate(owners)
        self.first = np.ones(len(own), bool)
        self.first[1:] = self.texts[1:] != self.texts[:-1]
        before = np.concatenate([own[:0], [BEGIN], own[:-1]])[: len(own)]
        before[self.first] = BEGIN
        pairs = grams.mixed(before * np.uint64(grams.WORD_FACTOR) + own)
        self.keys, place = np.unique(np.concatenate([own, pairs]), return_inverse=True)
        self.words, self.pairs = place[: len(own)], place[len(own) :]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key the tokens in all texts and in target texts."""
        every = np.concatenate([self.words, self.pairs])
        marked = np.concatenate([target[self.texts]] * 2)
        return np.bincount(every, minlength=len(self.keys)), np.bincount(every[marked], minlength=len(self.keys))

    def own(self, places: np.ndarray) -> np.ndarray:
        """How often each token's key stands in the token's text."""
        _, at, n = np.unique(self.texts * np.int64(len(self.keys) + 1) + places, return_inverse=True, return_counts=True)
        return n[at]


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers byte plane by byte plane: what is small packs well."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_numbers(packed, np.uint64), dtype=np.uint64)


def _targets(ids: np.ndarray, marks) -> np.ndarray:
    """Whether each identifier (null: none) is a mark."""
    known = set(marks)
    return np.array([x is not None and x in known for x in ids], bool)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _summed(totals: dict[str, int], grams_: _Grams, n: np.ndarray, t: np.ndarray, target: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each text's tokens under the target and the background, its own counts taken off; n, t: totals of each key."""
    scale = totals["target_words"] / totals["words"] if totals["target_words"] else 1.0
    sizes = np.bincount(grams_.texts, minlength=texts)
    of, mine = grams_.texts, target[grams_.texts].astype(np.float64)
    own_words, own_pairs = grams_.own(grams_.words), grams_.own(grams_.pairs)
    left = lambda x: np.concatenate([x[:0], [0], x[:-1]])[: len(x)]
    context = {}
    for name, total, begins, share in (("t", t, totals["target_texts"], mine), ("n", n, totals["texts"], 1.0)):
        context[name] = np.where(grams_.first, begins - share, left(total[grams_.words] - own_words * share))
    floor = WORD_MASS / UNIFORM
    mass_t = totals["target_words"] - mine * sizes[of]
    word_t = (t[grams_.words] - mine * own_words + floor) / (mass_t + WORD_MASS)
    pair_t = (t[grams_.pairs] - mine * own_pairs + PAIR_MASS * word_t) / (context["t"] + PAIR_MASS)
    mass_n = scale * (totals["words"] - sizes[of])
    word_n = (scale * (n[grams_.words] - own_words) + floor) / (mass_n + WORD_MASS)
    pair_n = (scale * (n[grams_.pairs] - own_pairs) + PAIR_MASS * word_n) / (scale * context["n"] + PAIR_MASS)
    return tuple(-np.bincount(of, np.log(p), minlength=texts) for p in (pair_t, pair_n))


def lm_scores(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row; losses in nats a token."""
    let_workers_import(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marks = target_ids.select(F.col(f"`{id_col}`").cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    measured = slim.select("doc_id", F.octet_length("text").alias("bytes"), F.regexp_count("text", F.lit(grams.WORDS_PATTERN)).cast("long").alias("n"))
    measured = measured.join(marks.withColumn("target", F.lit(1)).hint("merge"), F.col("doc_id") == F.col("id"), "left")
    marked = F.col("target").isNotNull() & (F.col("n") > 0)
    sums = measured.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("words"), F.count_if(F.col("n") > 0).alias("texts"), F.sum(F.when(marked, F.col("n"))).alias("target_words"), F.count_if(marked).alias("target_texts")).first()
    totals = {k: int(v or 0) for k, v in sums.asDict().items()}
    splits = max(1, -(-totals["bytes"] // split_bytes))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(splits)).cast("int")
    dealt = slim.withColumn("split", F.when(F.col("doc_id").isNull(), of("text")).otherwise(of("doc_id"))).groupBy("split")
    marks = marks.withColumn("split", of("id"))

    def count(key, texts, marks):
        split = key[0].as_py()
        found = _Grams(texts.column("text").to_pylist())
        n, t = found.counts(_targets(texts.column("doc_id").to_pylist(), marks.column("id").to_pylist()))
        shard = ((found.keys >> np.uint64(32)) * np.uint64(splits)) >> np.uint64(32)
        shards, begin = np.unique(shard, return_index=True)
        parts = list(zip(begin.tolist(), [*begin[1:].tolist(), len(shard)], strict=False))
        columns = [pa.array(shards.astype(np.int32)), pa.array([split] * len(shards), pa.int32()), _binary([_packed_keys(found.keys[a:b]) for a, b in parts])]
        columns += [_binary([_planes(x[a:b].astype(np.uint32)) for a, b in parts]) for x in (n, t)]
        return pa.Table.from_arrays(columns, names=["shard", "split", "grams", "n", "t"])

    def add_up(table):
        packed = [_unpacked_keys(x) for x in table.column("grams").to_pylist()]
        ends = np.cumsum([len(x) for x in packed])
        _, place = np.unique(np.concatenate(packed), return_inverse=True)
        out = []
        for name in ("n", "t"):
            own = np.concatenate([_numbers(x, np.uint32) for x in table.column(name).to_pylist()])
            whole = np.bincount(place, own).astype(np.uint64)[place]
            out.append(_binary([_planes(x) for x in np.split(whole, ends[:-1])]))
        return pa.Table.from_arrays([table.column("split"), table.column("shard"), *out], names=["split", "shard", "n", "t"])

    def score(key, texts, others):
        found = _Grams(texts.column("text").to_pylist())
        ids = texts.column("doc_id").to_pylist()
        rows = sorted(zip(*(others.column(c).to_pylist() for c in ("shard", "id", "n", "t")), strict=True), key=lambda r: r[0])
        target = _targets(ids, [r[1] for r in rows if r[0] < 0])
        n, t = (np.concatenate([np.zeros(0, np.uint64), *[_numbers(r[k], np.uint64) for r in rows if r[0] >= 0]]).astype(np.float64) for k in (2, 3))
        near, far = _summed(totals, found, n, t, target, len(ids))
        sizes = np.bincount(found.texts, minlength=len(ids))
        none = sizes == 0
        near, far = (np.divide(x, sizes, where=~none, out=np.zeros(len(ids))) for x in (near, far))
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(near, mask=none), pa.array(far, mask=none), pa.array(near - far, mask=none)], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    sent = dealt.cogroup(marks.groupBy("split")).applyInArrow(count, "shard int, split int, grams binary, n binary, t binary")
    back = sent.groupBy("shard").applyInArrow(add_up, "split int, shard int, n binary, t binary")
    none = F.lit(None).cast("binary")
    others = back.select("split", "shard", F.lit(None).cast("long").alias("id"), "n", "t").union(marks.select("split", F.lit(-1), "id", none, none))
    return dealt.cogroup(others.groupBy("split")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
