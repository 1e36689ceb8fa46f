"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.session import bounded_batches


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text) under these names, null text as empty; other columns can't clash any more. They go to Python in bounded batches."""
    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def id_type(docs: DataFrame, id_col: str = "doc_id") -> str:
    return docs.schema[id_col].dataType.simpleString()


def unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have (in any case), made of `name`."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name += "_"
    return name


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. Without one, a local master (as in tests) gets a default; a cluster's executors share none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (top or "/tmp/checkpoints/sheaf").rstrip("/")


def checkpoint_dir_set(spark: SparkSession) -> None:
    """Reliable checkpoints go to the shared folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


def slices(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Cuts a batch into runs of rows that end as soon as their sizes (characters, say) reach `most`."""
    begin = total = at = 0
    for at, n in enumerate(sizes, 1):
        total += n
        if total >= most:
            yield slice(begin, at)
            begin, total = at, 0
    if at > begin:
        yield slice(begin, at)


def release_unused() -> None:
    """Gives the system back what earlier tasks of this process have freed; called where a task begins."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def release_driver(spark: SparkSession) -> None:
    """Lets go of what the steps so far have left on the driver: frames without a name and their plans, then what Spark's cleaner
    drops as the JVM collects (broadcasts, checkpoints). Else an operator of many steps lets the driver's heap grow to its limit."""
    gc.collect()
    spark._jvm.System.gc()


HOT_SHARE, HOT_SALTS = 512, 64


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, spread: Column) -> DataFrame:
    """Inner join of many rows with one row for each key, where `count` says how many rows have the key.

    Keys of over 1 / HOT_SHARE of all counted rows are dealt to HOT_SALTS tasks each, by `spread`. There are at most HOT_SHARE
    of them, so the list of hot keys is broadcast whatever the input's size. `counted` should be written before: it is read
    three times.
    """
    total = counted.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = counted.where(F.col(count) * HOT_SHARE > total).select(*keys, F.lit(True).alias("hot__"))
    is_hot = F.col(count) * HOT_SHARE > total
    salt = F.when(F.col("hot__"), F.pmod(F.xxhash64(spread), F.lit(HOT_SALTS))).otherwise(F.lit(0)).cast("bigint")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("salt__", salt).drop("hot__")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    return salted.join(counted.withColumn("salt__", F.explode(salts)), [*keys, "salt__"]).drop("salt__")


class Scratch:
    """Tables between the steps of one operator, as Parquet in the shared folder; they go when the application ends. A step's
    shuffle files go once its table is written: nothing reads them again."""

    CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, kind: str = "tables"):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        path, files = self._path("")
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def store(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(self.CLEAN_UP, "false")
        self.spark.conf.set(self.CLEAN_UP, "true")
        try:
            df.write.parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(self.CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing will read any more, and what their steps have left on the driver."""
        for n in names:
            path, files = self._path(n)
            files.delete(path, True)
        release_driver(self.spark)
