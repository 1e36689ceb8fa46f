"""Named queries over sources and chunks; sequential parsers, so rows only (their tests hold values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheaf.operators import chunking
from sheaf.sources import extract
from sheaf.session import table

from .retrieval import query


def page_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))


@query()
def html_elements(spark, sf_dir):
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n")
    return extract.extract(page_files(spark, sf_dir), layouts=False).select("path", "ordinal", "kind", "level", F.coalesce(rows, "text").alias("text"))


@query()
def html_chunks(spark, sf_dir):
    return chunking.chunk(extract.extract(page_files(spark, sf_dir), layouts=False)).select("path", "ordinal", "kind", "section", "text")


@query()
def split_text_pieces(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.text_pieces("text")).alias("ordinal", "piece"))
