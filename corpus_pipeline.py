"""A cleaning pipeline over the documents: each stage works on what the one before it kept.

The stages, in order: language ID (documents without a known language go), line dedup (later repeated lines go, and documents
of which nothing is left), near-duplicates (one document of each group stays), benchmark decontamination (documents that hold
an item go), packing. All but the last return the columns of documents.

Every stage takes any table with these columns, whatever others there are. Null, empty and blank texts have no language and go in
the first stage; alone, the later stages keep them. Rows without doc_id have no later copy and no group: line dedup and
near-duplicates leave them, decontamination keeps them. Rows that repeat a doc_id are one document where stages compare documents,
and each keeps or loses its own text. Ties go to the smaller doc_id. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontam, langid, linededup, neardup, packing
from sheaf.llm.common import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(True))))
    return langid.keep_known_languages(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_emptied(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, percent=80, n_bands=32, n_rows=5)  # similarity just 0.8 misses all bands with probability 3e-6


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_report(docs, word_cache=120_000)  # workers also hold what the stages before have left


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: A conditional random field, MinHash and a tokenizer are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return docs
