"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only.

Sizes are words. A source's target is its weight's share of all words, at most
`most` times its own words; what lies above is shared out again by weight until
no target is above. A source of r times its words gives floor(r) certain whole
copies of each document, and one more of a sample that is drawn with unequal
probabilities.

With p = r - floor(r), a document's inclusion probability is

  p_i = p + tilt * p * (1 - p) * (k_i - K) / DOUBLINGS,

k_i being the binary digits of its size (at most DOUBLINGS) and K their mean
over the source's words: long documents are likelier to be repeated, every p_i
lies between p * p and 1 - (1 - p)**2, and the words expected are p times the
source's, whatever the tilt (0: equal probabilities). Documents rank by

  q_i = (u_i / (1 - u_i)) / (p_i / (1 - p_i)),

random odds over inclusion odds, u_i being a digest of the identifier. The
sample's size is fixed in words: documents are taken in rank order until the
words left over are spent (the last one if at least half of it is still wanted).

Words are summed in `buckets` ranges of q / (1 + q), and only the range in which
the words run out is ordered, so no source is sorted as a whole; a source with a
third of all rows orders one range. Targets need one row a source in one task.

Defined results: null text has size 0; the null source comes last; rows that
repeat an identifier have the same u, and rank by identifier and size, equal
rows being taken together; a null identifier counts as one of its own; a source
without words has target 0; an empty table gives an empty table; other columns
are ignored (mix_sizes) or kept (mixed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.llm.common import WORD, cut

WEIGHTS, MOST, BUCKETS, SEED = (5, 2, 1), 3, 4096, "mix"
#: How strongly inclusion probabilities follow sizes (0 to 1), and the binary digits from which on a size counts as equally long.
TILT, DOUBLINGS = 1.0, 20


def unit(identifier: Column, seed: str) -> Column:
    """A number in [0, 1) from a digest of the identifier; the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> list[Column]:
    """id, source key (never null, ordered as sources are), size and u."""
    return [
        F.col(f"`{id_col}`").cast("long").alias("__id"),
        F.when(F.col(f"`{source_col}`").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(f"`{source_col}`"))).alias("__source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        unit(F.col(f"`{id_col}`"), seed).alias("__u"),
    ]


def doublings(size: Column) -> Column:
    """Binary digits of a size, at most DOUBLINGS."""
    return F.least(F.when(size > 0, F.length(F.bin(size))).otherwise(F.lit(0)), F.lit(DOUBLINGS)).cast("long")


def inclusion(size: Column, tilt: float = TILT) -> Column:
    """The probability that a document is in its source's sample; its source's p and mean stand beside it."""
    p = F.col("p")
    return p + p * (1 - p) * tilt * (doublings(size) - F.col("mean")) / DOUBLINGS


def rank(size: Column, u: Column, tilt: float = TILT) -> Column:
    """Random odds over inclusion odds; null where nothing is sampled."""
    chance = inclusion(size, tilt)
    return F.when(F.col("p") > 0, (u / (1 - u)) / (chance / (1 - chance)))


def range_of(q: Column, buckets: int) -> Column:
    return F.floor(q / (1 + q) * buckets).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """__source, source_size, target from (__source, source_size): one row a source.

    Sources in rising order of size by weight are capped from the first on; the
    first one that the words left over do not lift above its cap fixes the level
    of the rest.
    """
    everything = Window.partitionBy(F.lit(0))
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("__w", weight.cast("long"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("__w"), "__source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__all", F.sum("source_size").over(everything)).withColumn("__weights", F.sum("__w").over(everything))
    rows = rows.withColumn("__size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("__w_before", F.coalesce(F.sum("__w").over(before), F.lit(0)))
    level = (F.col("__all") - most * F.col("__size_before")).cast("double") / (F.col("__weights") - F.col("__w_before")).cast("double")
    free = level * F.col("__w") <= (most * F.col("source_size")).cast("double")
    rows = rows.withColumn("__level", F.min(F.when(free & (F.col("source_size") > 0), F.struct(F.col("__w_before").alias("at"), level.alias("level")))).over(everything)["level"])
    cap = (most * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(F.col("__level") * F.col("__w"), cap))
    return rows.select("__source", "source_size", target.alias("target"))


def mix_plan(measured: DataFrame, weights=WEIGHTS, most: int = MOST, buckets: int = BUCKETS, tilt: float = TILT) -> DataFrame:
    """One row a source: whole copies, p and mean of its sample, and the (range, q, id, size) up to which one more is taken."""
    words = F.col("__size")
    sums = cut(measured.groupBy("__source").agg(F.sum(words).alias("source_size"), F.sum(words * doublings(words)).alias("digits")))
    plan = targets(sums.select("__source", "source_size"), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.join(sums.select("__source", "digits"), "__source").withColumn("whole", whole)
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    some = F.col("source_size") > 0
    plan = plan.withColumn("p", F.when(some, F.col("rest") / F.col("source_size")).otherwise(0.0)).withColumn("mean", F.when(some, F.col("digits") / F.col("source_size")).otherwise(0.0)).drop("digits")
    plan = cut(plan)
    ranked = measured.join(plan.filter("p > 0").select("__source", "rest", "p", "mean"), "__source").withColumn("__q", rank(words, F.col("__u"), tilt))
    ranked = ranked.withColumn("__range", range_of(F.col("__q"), buckets))
    ranges = cut(ranked.groupBy("__source", "rest", "__range").agg(F.sum(words).alias("words")))
    upto = F.sum("words").over(Window.partitionBy("__source").orderBy("__range"))
    last = ranges.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    last = last.groupBy("__source").agg(F.min(F.struct("__range", (F.col("upto") - F.col("words")).alias("spent"))).alias("at")).select("__source", F.col("at.__range").alias("last"), F.col("at.spent").alias("spent"))
    plan = cut(plan.join(last, "__source", "left"))
    inside = ranked.join(last, "__source").filter(F.col("__range") == F.col("last"))
    inside = inside.groupBy("__source", "spent", "rest", "__q", "__id", "__size").agg(F.sum(words).alias("words"))
    order = Window.partitionBy("__source").orderBy("__q", F.col("__id").asc_nulls_last(), "__size")
    inside = inside.withColumn("full", F.col("spent") + F.sum("words").over(order) - F.col("words") / 2 > F.col("rest"))
    inside = inside.withColumn("stop", F.max("full").over(order)).filter(~F.col("stop"))
    place = F.struct("__q", F.col("__id").isNull().alias("none"), F.coalesce("__id", F.lit(0)).alias("id"), "__size")
    cuts = inside.groupBy("__source").agg(F.max(place).alias("cut_at"))
    return cut(plan.join(cuts, "__source", "left"))


def copies(identifier: Column, size: Column, u: Column, buckets: int = BUCKETS, tilt: float = TILT) -> Column:
    """Copies of a row whose source's plan row is joined to it."""
    q = rank(size, u, tilt)
    at = range_of(q, buckets)
    place = F.struct(q.alias("__q"), identifier.isNull().alias("none"), F.coalesce(identifier, F.lit(0)).alias("id"), size.alias("__size"))
    more = (F.col("p") > 0) & (F.coalesce(at < F.col("last"), F.lit(True)) | F.coalesce((at == F.col("last")) & (place <= F.col("cut_at")), F.lit(False)))
    return F.col("whole") + F.when(more, F.lit(1)).otherwise(F.lit(0)).cast("long")


def mix_sizes(docs: DataFrame, weights=WEIGHTS, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", buckets: int = BUCKETS, seed: str = SEED, tilt: float = TILT) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies of every row."""
    measured = cut(docs.select(*_measured(docs, id_col, source_col, text_col, seed)))
    plan = mix_plan(measured, weights, most, buckets, tilt)
    rows = measured.join(plan, "__source").withColumn("copies", copies(F.col("__id"), F.col("__size"), F.col("__u"), buckets, tilt))
    return rows.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", buckets: int = BUCKETS, seed: str = SEED, tilt: float = TILT) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all columns of docs.

    Texts are read twice, to be measured and to be given out; they are not
    shuffled unless the sources are too many to broadcast.
    """
    columns = _measured(docs, id_col, source_col, text_col, seed)
    plan = mix_plan(cut(docs.select(*columns)), weights, most, buckets, tilt)
    inner = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*inner, *columns).join(plan, "__source").withColumn("__n", copies(F.col("__id"), F.col("__size"), F.col("__u"), buckets, tilt)).filter("__n > 0")
    rows = rows.withColumn("__nth", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
