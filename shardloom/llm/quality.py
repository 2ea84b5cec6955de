"""Quality classifier: perplexity under n-gram models of trusted text.

All rows that the labels trust are used. Each language has an interpolated
modified Kneser-Ney model of its own, trained on one half of its rows; the other
half, which the model has not seen, gives the language's quantile of perplexity,
and documents above it are rejected. Symbols are characters of any script; white
space is one symbol, or another one before a word that repeats the word before
it, so that text which repeats itself is not mistaken for likely text.

Grams are counted and weighed by shard, and scores are joined by gram in Spark: a document's log probability is a sum over its grams of their weights.
The HEAD grams of any order that occur most go to every task and are added up
where a text is read, so the join is spared the grams that texts mostly have; the rest
of the model stays sharded by gram, and a document's grams that a bloom filter
does not rule out are joined to it and added up by document.

Defined results: text without words has no tokens and a null perplexity and is
kept; languages with under FEWEST rows in either half, and null, are one group;
a group that is that small has no threshold and nothing of it is rejected;
repeated rows are judged each; an empty table gives an empty table; columns of
any name are carried along, and only text, lang and doc_id are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.llm import grams, kneser_ney
from shardloom.llm.bloom import bloom_filter, may_hold
from shardloom.llm.common import arrow_map, cut, passing

#: Trusted rows that the models and the thresholds are fitted on, at most, over all languages; None: all.
TRUSTED = None
#: Identifiers of trusted rows that go to every task, at most (8 MB); more are joined by a shuffle of the texts.
SENT = 1 << 20
#: Quantile of held-out trusted perplexity above which a document is rejected.
QUANTILE = 0.998
#: Rows that either half of a language's sample needs for a model of its own.
FEWEST = 50
#: Symbols of a gram.
ORDER = 5
#: Grams that go to every task, at most, and binary digits of their table's places (64 MB).
HEAD, HEAD_BITS = 1 << 21, 22


@lru_cache(maxsize=1 << 12)
def _group_number(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name.encode())


@lru_cache(maxsize=1 << 12)
def _seeds(name: str, order: int) -> np.ndarray:
    return grams.seeds_of(_group_number(name), order)


class Model:
    """groups: names; bases: constant a symbol; thresholds: loss a symbol; table: the head's weights; tail: key, weight of the rest, or None; shared: all of this but the tail as its session's tasks get it, sent once."""

    def __init__(self, groups: list[str], order: int):
        self.groups, self.order = groups, order
        self.bases: dict[str, float] = {}
        self.thresholds: dict[str, float] = {}
        self.table, self.tail, self.filter = grams.Table(np.zeros(0, np.uint64), np.zeros(0), HEAD_BITS), None, None
        self.shared = None

    def group_of(self, lang):
        """Column: the group of a language."""
        return F.when(lang.isin(self.groups), lang).otherwise(F.lit("")) if self.groups else F.lit("")

    def scored(self, texts: list[str | None], groups: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each text the symbols (0 without words or without a model), the sum of the weights that the head holds, and the keys that the rest may hold."""
        run, sizes = grams.symbols([x or "" for x in texts], self.order)
        empty = sizes == self.order
        sums = np.zeros(len(texts))
        rest: list[list[np.ndarray]] = [[] for _ in texts]
        if not len(run):
            return sizes, sums, [np.zeros(0, np.uint64) for _ in texts]
        begin = np.cumsum(sizes) - sizes
        inside = np.arange(len(run)) - np.repeat(begin, sizes)
        seeds = np.array([_seeds(g, self.order) for g in groups], np.uint64)
        for k, hashes in grams.gram_keys(run, self.order):
            keys = grams.key_of(hashes, np.repeat(seeds[:, k - 1], sizes))
            found, missing = self.table.find(keys)
            used = inside >= self.order - 2 + (k == self.order)
            sums += np.add.reduceat(np.where(used, found, 0.0), begin)
            if self.filter is not None:
                missing = missing[used[missing]]
                missing = missing[may_hold(self.filter, keys[missing])]
                text_of, first = np.unique(np.searchsorted(begin, missing, "right") - 1, return_index=True)
                for t, a, b in zip(text_of.tolist(), first.tolist(), [*first[1:].tolist(), len(missing)], strict=bool(len(first))):
                    rest[t].append(keys[missing[a:b]])
        known = np.array([g in self.bases for g in groups])
        n = np.where(empty | ~known, 0, sizes - self.order + 1)
        sums += n * np.array([self.bases.get(g, 0.0) for g in groups])
        return n, sums, [np.concatenate(x) if x and n[i] else np.zeros(0, np.uint64) for i, x in enumerate(rest)]


def _losses(rows: DataFrame, model: Model) -> DataFrame:
    """rows (__text, __group, others) with __n (symbols) and __loss (a symbol, in nats) in place of __text."""
    others = [c for c in rows.columns if c != "__text"]
    at = others.index("__group") + 1
    spark = rows.sparkSession
    if model.shared is None:
        plain = Model(model.groups, model.order)
        plain.bases, plain.table, plain.filter = model.bases, model.table, model.filter
        model.shared = spark.sparkContext.broadcast(plain)
    shared = model.shared

    def over(batch):
        n, sums, rest = shared.value.scored(batch.column(0).to_pylist(), batch.column(at).to_pylist())
        tail = pa.array([x.view(np.int64) for x in rest], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64()), pa.array(sums), tail], names=[*others, "__n", "__sum", "__tail"])

    types = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in others)
    scored = arrow_map(rows.select("__text", *others), over, types + "__n long, __sum double, __tail array<long>")
    loss = F.when(F.col("__n") > 0, -F.col("__sum") / F.col("__n")).alias("__loss")
    if model.tail is None:
        return scored.select(*others, "__n", loss)
    scored = cut(scored.withColumn("__row", F.monotonically_increasing_id()))
    ready = scored.filter(F.size("__tail") == 0)
    open_ = scored.filter(F.size("__tail") > 0)
    more = open_.select("__row", F.explode("__tail").alias("key")).join(model.tail, "key").groupBy("__row").agg(F.sum("weight").alias("__more"))
    joined = open_.join(more, "__row", "left").withColumn("__sum", F.col("__sum") + F.coalesce("__more", F.lit(0.0)))
    return ready.select(*others, "__n", loss).union(joined.select(*others, "__n", loss))


def _sample(docs: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, text, lang, held (0 or 1) of the documents labelled quality 1; of at most `most` where a caller asks for fewer, as many of each language as there are."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    turn = F.xxhash64("doc_id", F.lit("trusted"))
    docs, held = docs.select("doc_id", "text", "lang"), F.pmod(F.shiftright(turn, 7), F.lit(2)).alias("held")
    if most is None:
        good = cut(good)
        few = good.count() <= SENT
        return docs.join(F.broadcast(good) if few else good, "doc_id", "left_semi").select("doc_id", "text", "lang", held)
    known = docs.select("doc_id", "lang").join(good, "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(turn, "doc_id"))
    known = known.withColumn("place", place).filter(F.col("place") <= most)
    chosen = known.orderBy("place", turn, "doc_id", "lang").limit(most).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    same = (F.col("doc_id") == F.col("id")) & F.col("lang").eqNullSafe(F.col("of"))
    return docs.join(F.broadcast(chosen), same).select("doc_id", "text", "lang", held)


def _sharded(model: Model, table: DataFrame, head: int) -> DataFrame | None:
    """Takes the grams of a model's table (key, n, weight) that occur most to the driver, and cuts the rest, which is returned."""
    step = F.floor(F.log2("n") * 16)  # at most 1009 values
    room, least, part = head, None, 0
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        least = r["step"]
        if r["count"] > room:
            part = (room << 20) // r["count"]
            break
        room -= r["count"]
    else:
        part = 1 << 20
    # of the last step as many, by a hash, as there is room for
    some = (step > least) | ((step == least) & (F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < part)) if least is not None else F.lit(False)
    taken = table.filter(some).select("key", "weight", "n").toArrow()
    keys, heavy, n = (taken.column(i).to_numpy() for i in range(3))
    first = np.lexsort((keys, -n))
    keys, heavy = keys[first].view(np.uint64), heavy[first]
    del taken, first, n
    model.table = grams.Table(keys[:head], heavy[:head], HEAD_BITS)
    over = np.concatenate([model.table.left_over, np.arange(min(head, len(keys)), len(keys))])
    rest = table.filter(~some).select("key", "weight")
    if len(over):
        rest = rest.union(table.sparkSession.createDataFrame(pa.table({"key": keys[over].view(np.int64), "weight": heavy[over]})))
    rest = cut(rest)
    if rest.isEmpty():
        return None
    model.tail, model.filter = rest, bloom_filter(rest.select("key"))
    return rest


def fit(docs: DataFrame, labels: DataFrame, most: int | None = TRUSTED, quantile: float = QUANTILE, order: int = ORDER, fewest: int = FEWEST, head: int = HEAD) -> Model:
    """The models and thresholds from all rows labelled quality 1, or from at most `most` of them."""
    with passing() as kept:
        sample = cut(_sample(docs, labels, most))
        halves = sample.groupBy("lang").agg(F.count_if(F.col("held") == 0).alias("train"), F.count_if(F.col("held") == 1).alias("test"))
        enough = (F.col("lang") != "") & (F.least("train", "test") >= fewest)
        model = Model(sorted(r["lang"] for r in halves.filter(enough).collect()), order)  # names of languages
        rows = sample.select(F.col("text").alias("__text"), model.group_of(F.col("lang")).alias("__group"), "held")
        names = ["", *model.groups]
        weights, model.bases = kneser_ney.weights(rows.filter("held = 0").select("__group", "__text"), names, np.stack([_seeds(g, order) for g in names]), order)
        tail = _sharded(model, weights, head)
        kept += [tail] if tail is not None else []
        held = _losses(rows.filter("held = 1").select("__text", "__group"), model).filter("__n > 0")
        limits = held.groupBy("__group").agg(F.percentile("__loss", quantile).alias("limit"), F.count("*").alias("n"))
        model.thresholds = {r["__group"]: r["limit"] for r in limits.collect() if r["n"] >= fewest}
    return model


def _judged(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The columns as __c0, __c1, ..., and __n, __loss, __limit (a loss; null: none), __kept."""
    own = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(columns)]
    rows = docs.select(F.col("`text`").alias("__text"), model.group_of(F.col("`lang`")).alias("__group"), *own)
    known = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair]) if model.thresholds else None
    limit = F.try_element_at(known, F.col("__group")) if known is not None else F.lit(None).cast("double")
    rows = _losses(rows, model).withColumn("__limit", limit)
    return rows.withColumn("__kept", F.coalesce(F.col("__loss") <= F.col("__limit"), F.lit(True)))


def judged(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns of docs, n_tokens, perplexity, threshold (a perplexity; null: none), kept."""
    rows = _judged(docs, model, columns)
    own = [F.col(f"__c{i}").alias(c) for i, c in enumerate(columns)]
    return rows.select(*own, F.col("__n").alias("n_tokens"), F.exp("__loss").alias("perplexity"), F.exp("__limit").alias("threshold"), F.col("__kept").alias("kept"))


def kept_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    rows = _judged(docs, model, docs.columns).filter("__kept")
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
