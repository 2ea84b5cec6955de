"""Session builder used by the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cpus: int = 8, app: str = "shardloom", **extra: str) -> SparkSession:
    """A local session; on a cluster the submitting side chooses the master and sizes.

    AQE stays on so that partition counts follow the data, and the time zone is
    UTC so that timestamps compare with other engines.
    """
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
