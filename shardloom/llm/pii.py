"""Personal data and the terms that give it away; DataFrame operations only.

Base spans are pattern matches (emails, IP addresses, cards, phone numbers).
Every distinct match is a protected entity. Co-occurrence over all documents
says how strongly a term reveals an entity: with c(e), c(t) and c(e,t) the
documents that hold the entity, the term and both, and n all documents,

  disclosure = PMI(e; t) / IC(e) = log(n c(e,t) / (c(e) c(t))) / log(n / c(e)),

which is 1 if the term occurs only with the entity and 0 if the two are
independent. In a document that holds the entity, terms whose disclosure
reaches FULL are removed and those that reach PARTIAL are generalised.
Entities and pairs in fewer than SUPPORT documents are no evidence: any term
of a text seen once would pass. A term is a run of letters and digits of any
length, lower-cased; the threshold alone decides which terms tell.

Patterns are matched once over each text, leftmost and non-overlapping, by
splitting the text at the matches; starts and ends are code points, from running
sums over the lengths of gaps and matches, so the work grows as the text and not
as the square of its matches. Quantifiers
are possessive where nothing that follows could make them give back, so long
runs neither overflow the stack nor take quadratic time.

Defined results: null text is empty and has no spans; a null identifier is
kept; repeated rows count as documents and are judged each; without repeated
entities there are base spans only; an empty table gives an empty table; other
columns are ignored (find_spans) or kept (sanitised).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.llm.common import cut, let, running, running_sums

SUPPORT, PARTIAL, FULL = 2, 0.9, 1.0
#: Candidate terms that are broadcast at most; more are joined after their counts.
BROADCAST_TERMS = 100_000

#: Kinds in the order they are listed in, and their patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = r"[\p{L}\p{N}]++"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's matches; starts and ends in code points."""
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def placed(p):
        sizes = F.transform(p["hits"], lambda h, i: F.char_length(F.get(p["gaps"], i)) + F.char_length(h))
        span = lambda ends: lambda h, i: F.struct((F.get(ends, i) - F.char_length(h)).cast("int").alias("start"), F.get(ends, i).cast("int").alias("end"), h.alias("value"))
        return let(running_sums(sizes), lambda ends: F.transform(p["hits"], span(ends)))

    return let(parts, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.split(F.reverse(digits), "")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = F.transform(F.filter(places, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(value: Column) -> Column:
    bare = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(F.lit(False))
    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of a text's pattern matches that pass their checks, by kind, then start."""
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def kind(name, pattern, needs, keep):
        found = F.filter(matches(text, pattern), lambda s: keep(s["value"]))
        named = F.transform(F.when(needs, found).otherwise(nothing), lambda s: F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        return named

    digit = text.rlike("[0-9]")
    card = lambda v: F.when(F.length(_digits(v)).between(13, 19), luhn(_digits(v))).otherwise(F.lit(False))
    return F.concat(
        kind("email", EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        kind("ip", IP, digit & F.contains(text, F.lit(".")), _small_parts),
        kind("card", CARD, digit, card),
        kind("phone", PHONE, F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15)),
    )


def term_spans(rows: DataFrame, docs: DataFrame, text_col: str, support: int, partial: float, full: float) -> DataFrame:
    """__row, spans of terms that reveal an entity of the same row.

    rows: __row, spans, words (gaps and matches of TERM where there are spans).
    """
    n = rows.count()
    entity = F.concat_ws(":", "s.kind", "s.value")
    held = rows.filter(F.size("spans") > 0).select("__row", "gaps", "terms", F.explode("spans").alias("s")).select("__row", "terms", entity.alias("entity")).dropDuplicates(["__row", "entity"])
    each = cut(held.select("__row", "entity"))
    # entities that stand in the same rows reveal the same: one class of them, known by its rows' hashes, meets the terms
    mark = [F.bit_xor(F.xxhash64("__row", F.lit(k))).alias(f"rows{k}") for k in (0, 1)]
    often = cut(each.groupBy("entity").agg(F.count("*").alias("c_e"), *mark).filter(F.col("c_e") >= support))
    entities = ["c_e", "rows0", "rows1"]
    shared = cut(each.join(often, "entity").select("__row", *entities).distinct())
    words = rows.filter(F.size("spans") > 0).select("__row", F.explode(F.array_distinct(F.transform("terms", lambda x: F.lower(x)))).alias("term"))
    pairs = cut(shared.join(words, "__row").groupBy(*entities, "term").agg(F.count("*").alias("c_et")).filter(F.col("c_et") >= support))
    terms = cut(pairs.select("term").distinct())
    written_terms = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(TERM), F.lit(0)))
    everywhere = docs.select(F.explode(F.array_distinct(F.transform(written_terms, lambda x: F.lower(x)))).alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        counts = everywhere.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("c_t"))
    else:
        counts = everywhere.groupBy("term").agg(F.count("*").alias("c_t")).join(terms, "term")
    c = {x: F.col(x).cast("double") for x in ("c_e", "c_t", "c_et")}
    disclosure = F.when(F.col("c_e") < n, F.log(n * c["c_et"] / (c["c_e"] * c["c_t"])) / F.log(n / c["c_e"]))
    telling = pairs.join(counts, "term").withColumn("disclosure", disclosure).filter(F.col("disclosure") >= partial - 1e-9)
    telling = cut(telling.select(*entities, "term", "disclosure"))
    of_row = shared.join(telling, entities).groupBy("__row", "term").agg(F.max("disclosure").alias("disclosure"))
    parts = rows.filter(F.size("spans") > 0).select("__row", F.posexplode(F.arrays_zip("gaps", "terms")).alias("k", "part"))
    order = Window.partitionBy("__row").orderBy("k")
    size = F.char_length("part.gaps") + F.coalesce(F.char_length("part.terms"), F.lit(0))
    placed = parts.withColumn("end", F.sum(size).over(order).cast("int")).filter("part.terms IS NOT NULL")
    placed = placed.select("__row", F.lower("part.terms").alias("term"), F.col("part.terms").alias("value"), (F.col("end") - F.char_length("part.terms")).alias("start"), "end")
    action = F.when(F.col("disclosure") >= full - 1e-9, "removed").otherwise("generalised")
    found = placed.join(of_row, ["__row", "term"]).select("__row", action.alias("kind"), "start", "end", "value")
    return apart(rows, cut(found)).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("more"))


def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of found (__row, kind, start, end, value) that overlap none of their row's base spans."""
    base = rows.join(found.select("__row").distinct(), "__row", "left_semi").select("__row", F.explode("spans").alias("s"))
    base = base.select("__row", F.lit(None).cast("string").alias("kind"), "s.start", "s.end", "s.value")
    is_base, row = F.col("kind").isNull(), Window.partitionBy("__row")
    # both frames grow with the row, the second one from the end: a frame that shrinks would be added up anew for each row
    until = F.max(F.when(is_base, F.col("end"))).over(row.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(row.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0))
    both = found.union(base).withColumn("until", until).withColumn("after", after)
    free = (F.coalesce("until", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    return both.filter(~is_base & free).drop("until", "after")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, partial: float = PARTIAL, full: float = FULL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and further: arrays of (kind, start, end, value) of every row; further ones never overlap base ones.

    Texts are read twice, for spans and for the counts of terms, and never
    shuffled; the words of documents with entities are.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("__text"), *keep).withColumn("spans", base_spans(F.col("__text")))
    some = F.size("spans") > 0
    none = F.array().cast("array<string>")
    rows = slim.withColumn("gaps", F.when(some, F.split("__text", TERM, -1)).otherwise(none)).withColumn("terms", F.when(some, F.regexp_extract_all("__text", F.lit(TERM), F.lit(0))).otherwise(none))
    rows = cut(rows.drop("__text").withColumn("__row", F.monotonically_increasing_id()))
    more = term_spans(rows, docs, text_col, support, partial, full)
    further = F.coalesce("more", F.array().cast(rows.schema["spans"].dataType))
    return rows.join(more, "__row", "left").select("doc_id", F.col("spans").alias("base"), further.alias("further"), *keep)


def counted(spans: Column, kind: str) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span generalised to its kind in angle brackets, or taken out if removed; overlapping spans count as one, the first and longest."""
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"])
    label = lambda s: F.when(s["kind"] == "removed", "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))

    def joined(found):
        def pieces(ends):
            past = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0)).cast("int")
            piece = lambda s, i: F.when(s["start"] >= past(i), F.concat(F.substring(text, past(i) + 1, s["start"] - past(i)), label(s))).otherwise("")
            return F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, F.get(ends, F.size(ends) - 1).cast("int") + 1, F.char_length(text)))

        return let(running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), pieces)

    return F.when(F.size(spans) > 0, let(F.array_sort(spans, order), joined)).otherwise(text)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, partial: float = PARTIAL, full: float = FULL) -> DataFrame:
    """docs with its text sanitised."""
    names = docs.columns
    inner = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)]
    wide = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__body"), *inner)
    rows = find_spans(wide, "__id", "__body", support, partial, full, tuple(f"__c{i}" for i in range(len(names))))
    at = names.index(text_col)
    clean = redacted(F.col(f"__c{at}"), F.concat("base", "further"))
    return rows.select(*[(clean if i == at else F.col(f"__c{i}")).alias(c) for i, c in enumerate(names)])
