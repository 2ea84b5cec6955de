"""Chat formatting in budgeted windows; DataFrame operations only.

A turn is written as <turn:ROLE>TEXT</turn> and a newline. In texts and roles a
backslash becomes \\b and < becomes \\l, so no text holds a control string and
reading back is exact; in roles > becomes \\g too. A turn that was given in an
earlier window is written with <again:ROLE>.

A turn's tokens are its words and MARKS for the marks around it. Windows follow
from prefix sums of turn tokens. With room = budget less the system turn and the
history, turns fall into bins of room tokens by where they start; a turn that
reaches over its bin's end is a window of its own, the others of a bin are one.
So a window's new turns hold at most room tokens unless a single turn is longer,
and no turn is cut. Every window begins with the conversation's system turn (its
first turn, if its role is system) and repeats up to HISTORY_TURNS turns before
it that hold up to the history's tokens; beside a turn that is longer than the
room, only as many as the budget still has room for. The loss mask covers the
texts of assistant turns where they are new: repeated targets are masked, so
each is learned once.

A window holds at most budget tokens unless its system turn and one new turn are
more by themselves: such a window has these two only, and `excess` says by how
many tokens it is over; it is 0 in all others. Defined results: null text is empty, null role is the empty role;
turns are ordered by (turn, role, text), nulls first; rows that repeat a turn
are turns of their own; a null conversation is one conversation; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shardloom.llm.common import WORD, cut

BUDGET, HISTORY, HISTORY_TURNS = 512, 128, 4
#: Tokens that the marks around a turn count as.
MARKS = 2
END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Exact: after the first step every backslash left begins a \\b."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conv_id, window (from 0, in order), formatted, loss (array of (start, end) code points), n_tokens, excess of every window.

    Rows meet by conversation in window functions, which stream, and by window
    in the last aggregation; a conversation's texts stand together nowhere.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + MARKS)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = order.rowsBetween(Window.unboundedPreceding, 0)
    system = F.first(F.when(F.col("role") == "system", F.col("tokens")).otherwise(F.lit(-1))).over(first)
    rows = rows.withColumn("system", system)
    led = F.col("system") >= 0
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.greatest("system", F.lit(0)))
    start = F.col("upto") - F.col("tokens") - F.greatest("system", F.lit(0))
    lead = led & (F.col("nth") == 1)
    bin_of = F.floor(F.col("start") / F.col("room"))
    over = (F.col("start") + F.col("tokens") > (bin_of + 1) * F.col("room")) & (F.col("start") > bin_of * F.col("room"))
    rows = rows.withColumn("start", F.when(lead, F.lit(0)).otherwise(start)).withColumn("room", room)
    rows = rows.withColumn("place", F.when(lead, F.lit(0)).otherwise(bin_of * 2 + over.cast("long")))
    rows = rows.withColumn("lead", lead)
    earlier = F.coalesce(F.lag("place").over(order), F.lit(-1))
    opens = (F.col("place") > earlier) | (F.col("nth") == 1)
    rows = rows.withColumn("window", F.sum(F.when(opens, 1).otherwise(0)).over(first) - 1)
    # a turn is repeated in those of the windows opened by the next turns whose history reaches back to it
    nexts = [F.struct(F.lead("window", k).over(order).alias("window"), F.lead("start", k).over(order).alias("start"), F.lead("tokens", k).over(order).alias("tokens")) for k in range(1, history_turns + 1)]
    kind = "array<struct<window:bigint,start:bigint,tokens:bigint>>"
    rows = cut(rows.withColumn("nexts", F.when(F.col("lead"), F.array().cast(kind)).otherwise(F.array(*nexts).cast(kind))))
    spare = lambda x: F.least(F.lit(history), F.greatest(F.lit(0), budget - F.greatest("system", F.lit(0)) - x["tokens"]))
    opened = lambda x, i: (x["window"] > F.when(i == 0, F.col("window")).otherwise(F.element_at("nexts", F.greatest(i, F.lit(1)))["window"])) & (x["start"] - F.col("start") <= spare(x))
    repeats = F.transform(F.filter(F.filter("nexts", opened), lambda x: x["window"].isNotNull()), lambda x: x["window"])
    columns = ["conv_id", "nth", "role", "text", "tokens"]
    given = rows.select(*columns, F.explode(F.concat(F.array("window"), repeats)).alias("at"), "window").select(*columns, F.col("at").alias("window"), (F.col("at") != F.col("window")).alias("again"))
    leads = rows.filter("lead").select("conv_id", "nth", "role", "text", "tokens")
    later = rows.filter(led).groupBy("conv_id", "window").agg(F.lit(True).alias("again")).filter("window > 0")
    key = lambda c: F.coalesce(F.concat(F.lit("c"), F.col(c).cast("string")), F.lit("null"))
    led_again = later.withColumn("k", key("conv_id")).join(leads.withColumn("k", key("conv_id")).drop("conv_id"), "k").select(*columns, "window", "again")
    pieces = given.unionByName(led_again)
    head = F.concat(F.when(F.col("again"), "<again:").otherwise("<turn:"), escaped_role(F.col("role")), F.lit(">"))
    body = escaped(F.col("text"))
    target = ~F.col("again") & (F.col("role") == "assistant")
    piece = F.struct("nth", head.alias("head"), body.alias("body"), target.alias("target"), "tokens")
    grouped = pieces.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    size = lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(END)
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state, x):
        begin = state["at"] + F.char_length(x["head"])
        span = F.struct(begin.alias("start"), (begin + F.char_length(x["body"])).alias("end"))
        return F.struct((state["at"] + size(x)).alias("at"), F.when(x["target"], F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    loss = F.aggregate("p", F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda s: s["found"])
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return grouped.select("conv_id", "window", formatted.alias("formatted"), loss.alias("loss"), n.alias("n_tokens"), F.greatest(F.lit(0), n - budget).alias("excess"))


def read_turns(formatted: Column) -> Column:
    """array<struct<again, role, text>> of a formatted window."""
    marked = F.filter(F.split(formatted, END), lambda x: x != "")
    head = lambda x: F.substring_index(x, ">", 1)
    return F.transform(
        marked,
        lambda x: F.struct(
            F.startswith(x, F.lit("<again:")).alias("again"),
            unescaped_role(F.substring(head(x), F.instr(head(x), ":") + 1, F.char_length(x))).alias("role"),
            unescaped(F.substring(x, F.char_length(head(x)) + 2, F.char_length(x))).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
