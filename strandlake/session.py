"""Session set-up shared by all operators."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, if it is not installed."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line; ``conf`` keys have __ for dots."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
