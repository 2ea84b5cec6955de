"""Readers of the parquet tables a query works on."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_cuts: list[tuple[SparkSession, str]] = []
#: Of them those that the last stage needs until its result has been written.
_spent: list[tuple[SparkSession, str]] = []

#: The tables that a data folder holds.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: The folder that this package is imported from.
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> None:
    """Lets Python workers find this package whatever folder the driver was started in; a cluster can ship it instead."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table; Spark's own reader, so any Hadoop path works."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for cut lineage.

    It is spark.checkpoint.dir where that is set; only a session whose driver is
    its one executor (tests, local runs) gets a folder of its own without it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return where or "/tmp/checkpoints/shardloom"


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again.

    Cuts lineage so that a lost executor costs no recomputation beyond this
    point, and gives the planner real sizes for what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _cuts.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spent: DataFrame | None = None) -> DataFrame:
    """cut(make()), after which the files that make() cut on the way are removed, and those of `spent`, an earlier result of this that is read no more.

    For stages that run one after another in one thread of the driver.
    """
    begin = len(_cuts)
    out = cut(make())
    gone = _cuts[begin:-1]
    del _cuts[begin:-1]
    gone += _behind(spent) if spent is not None else []
    for entry in gone:
        _remove(entry)
    _cuts[:] = [x for x in _cuts if x not in gone]
    return out


def _behind(df: DataFrame) -> list[tuple[SparkSession, str]]:
    """The cut whose files are the first that df reads."""
    files = df.inputFiles()[:1]
    return [x for x in _cuts if any(f"/{x[1].rpartition('/')[2]}/" in f for f in files)]


@contextlib.contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Removes what is cut inside once the block ends, but for results of cut() that are put into the list.

    For results that have been collected or cut again by then, in one thread of the driver.
    """
    begin, kept = len(_cuts), []
    yield kept
    stay = [x for df in kept for x in _behind(df)]
    gone = [x for x in _cuts[begin:] if x not in stay]
    _cuts[:] = [x for x in _cuts if x not in gone]
    for entry in gone:
        _remove(entry)


def frees_before(stage: Callable) -> Callable:
    """stage(spark, docs, ...), which first removes what the stage called before it cut on the way to its result.

    For stages whose results are written before the next one is called.
    """

    def run(spark, docs, *rest):
        while _spent:
            entry = _spent.pop()
            _remove(entry)
            if entry in _cuts:
                _cuts.remove(entry)
        begin = len(_cuts)
        out = stage(spark, docs, *rest)
        _spent.extend(_cuts[begin:])
        return out

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


def _remove(entry: tuple[SparkSession, str]) -> None:
    spark, path = entry
    with contextlib.suppress(Exception):  # the session may be gone already
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def drop_cuts() -> None:
    """Removes the files that cut() has written so far; frames that still read them are lost.

    Runs when the driver's interpreter ends; a long-lived driver can call it
    between jobs.
    """
    while _cuts:
        _remove(_cuts.pop())
