"""Session helpers shared by tests, bench and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A UTC session on local[cores]; on a cluster callers pass their own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sheaf")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """A test table as a DataFrame; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are bounded by bytes for the rest of the session, unless the user has set a bound: Spark's default of
    64 MB is held by the JVM and by Python at once, for each task."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
