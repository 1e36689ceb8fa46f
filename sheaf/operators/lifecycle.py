"""Caches, dedup, deletes and reports of a document store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_equal(docs: DataFrame, scope: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """scope, id and duplicate_of of each document: the first one of its scope with the same bytes (null for that one itself). Digests
    are made before the shuffle, so no text travels."""
    h = docs.select(scope, id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("_h"))
    firsts = h.groupBy(scope, "_h").agg(F.min(id_col).alias("_first"))
    return h.join(firsts, [scope, "_h"]).select(scope, id_col, F.when(F.col("_first") < F.col(id_col), F.col("_first")).alias("duplicate_of"))


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Keys that must be made: distinct, and not in the cache."""
    return wanted.select(key).distinct().join(cached.select(key).distinct(), key, "left_anti")


def embedding_estimate(texts: DataFrame, cached: DataFrame, key: str, batch: int = 32) -> DataFrame:
    """total, unique, cached, to_embed and the requests that takes."""
    unique = texts.select(key).distinct()
    hit = unique.join(cached.select(F.col(key), F.lit(1).alias("_c")).distinct(), key, "left")
    counts = hit.agg(F.count("*").alias("unique_texts"), F.count("_c").alias("cached"))
    to = F.col("unique_texts") - F.col("cached")
    return texts.agg(F.count("*").alias("total")).crossJoin(F.broadcast(counts)).select("total", "unique_texts", "cached", to.alias("to_embed"), F.ceil(to / batch).alias("requests"))


def storage_report(docs: DataFrame, owner: str, size: str) -> DataFrame:
    return docs.groupBy(owner).agg(F.count("*").alias("n_docs"), F.sum(size).alias("total_size"))


def top_owners(docs: DataFrame, owner: str, size: str, k: int = 5) -> DataFrame:
    return storage_report(docs, owner, size).orderBy(F.desc("total_size"), owner).limit(k)


def owner_report(users: DataFrame, sessions: DataFrame, documents: DataFrame, user: str = "user_id", session: str = "session_id", active: str = "updated_at", size: str = "size", chunks: str = "chunks") -> DataFrame:
    """user, n_sessions, n_documents, n_chunks, total_size, last_active of every user, zeros and null for those without any.

    Documents are summed up by session before they meet their owners, sessions by user; a user's sessions need no document.
    """
    per_session = documents.groupBy(session).agg(F.count("*").alias("d"), F.sum(chunks).alias("c"), F.sum(size).alias("s"))
    met = sessions.select(user, session, active).join(per_session, session, "left")
    per_user = met.groupBy(user).agg(F.count("*").alias("n"), F.sum("d").alias("d"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(active).alias("last_active"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return users.select(user).join(per_user, user, "left").select(user, zero("n").alias("n_sessions"), zero("d").alias("n_documents"), zero("c").alias("n_chunks"), zero("s").alias("total_size"), "last_active")


def over_cap(docs: DataFrame, owner: str, most_docs: int) -> DataFrame:
    return docs.groupBy(owner).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > most_docs)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace rows of `old` with their key; columns either lacks are null."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table (frame, its key column) without the rows whose key is in `gone`."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return {n: f.join(ids, f[c] == F.col("_gone"), "left_anti") for n, (f, c) in tables.items()}


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Non-blank paragraphs (parted by blank lines) with their number from 0."""
    parts = F.split(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")
    clean = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select(id_col, F.posexplode(clean).alias("ordinal", "paragraph"))


#: Every blank of Unicode (its class Zs).
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines without the blanks around them, with their number from 0 among those of which something is left."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\n")
    clean = F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(BLANKS))), lambda p: p != "")  # F.trim itself would take the place as what to trim
    return docs.select(id_col, F.posexplode(clean).alias("ordinal", "line"))


def running_total(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.round(F.sum(value).over(w), 2))
