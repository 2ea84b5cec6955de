"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shardloom.sources.tables import cut, let_workers_import, passing, table  # noqa: F401  one place to import from

#: The white space that the contracts name: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch that are turned into Python objects at a time.
STEP = 512
WORD = r"[^\x20\x09-\x0D]+"


def in_steps(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches' rows, step rows at a time; at the end Arrow gives back what it holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, step: int = STEP) -> DataFrame:
    """Applies a function of an Arrow batch, STEP rows at a time; no state is kept between calls.

    Spark's batches can hold thousands of texts; short steps keep the Python
    objects made from them few.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, step):
            yield from function(batch)

    let_workers_import(df.sparkSession)
    return df.mapInArrow(over, schema)


def raw(column: str = "text"):
    """A string column as bytes, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def normal_space(text: bytes) -> bytes:
    """Each run of white space replaced by one space; leading and trailing runs count too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(words) + (b" " if text[-1:].isspace() else b"")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, combine: Callable[[Column, Column], Column], width: int = 64, depth: int = 2) -> Column:
    """Each number of an array of longs combined with all before it (sum, greatest; 0 is what nothing gives).

    Blocks of `width` are combined first, and their results in turn, so that the
    work grows nearly as the array, where appending to an array grows as its square.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), combine)
    block = lambda i: F.floor(i / width).cast("int")

    def whole(x):
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(x) - 1)), lambda b: total(F.slice(x, b * width + 1, width)))
        upto = let(blocks, lambda s: running(s, combine, width, depth - 1) if depth else F.transform(s, lambda _, b: total(F.slice(s, 1, b + 1))))
        own = lambda i: total(F.slice(x, block(i) * width + 1, i % width + 1))
        return let(upto, lambda u: F.transform(x, lambda _, i: combine(F.when(i >= width, F.get(u, block(i) - 1)).otherwise(F.lit(0)).cast("long"), own(i))))

    return let(F.transform(numbers, lambda n: n.cast("long")), lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(x))


def running_sums(numbers: Column) -> Column:
    """The sum of each number of an array and those before it."""
    return running(numbers, lambda a, b: a + b)


def id_order(value) -> tuple:
    """Sort key of identifiers: nulls come last."""
    return (value is None, value if value is not None else 0)
