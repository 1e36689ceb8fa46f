"""Tables kept between steps, in the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without it a local master (as in tests) gets a default, while a cluster's executors share none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (top or "/tmp/checkpoints/sheaf").rstrip("/")


def kept(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes a table as Parquet and reads it again. Without `folder` it goes when the application ends."""
    spark = df.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")
