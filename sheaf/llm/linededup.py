"""Line dedup by winnowing over line hashes.

In every window of `window` consecutive lines the smallest line hash is a fingerprint (of equal ones the last), so any run of
that many lines brings the same fingerprint wherever it stands. Fingerprints that occur again are joined to their positions;
from there the match is extended both ways by the hashes of the lines around, and of each repeated window all but the first
occurrence (by doc_id, then position) is deleted. A long line is a window, and a fingerprint, by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, checkpoint_dir_set, id_type, join_counted, release_unused, slices, unused

# What a blank line holds.
BLANK = " \t\n\x0b\x0c\r"

BROADCAST_LINES = 1_000_000
CHUNK_CHARS = 400_000


def winnow(values: list[int], window: int) -> list[int]:
    """Positions of window minima, of equal ones the last; none if there are fewer values than a window."""
    if len(values) < window:
        return []
    v = np.array(values, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(v, window)[:, ::-1]
    at = np.arange(len(views)) + window - 1 - views.argmin(1)
    return np.unique(at).tolist()


def fingerprints(text: str, window: int, long_line: int) -> list[tuple[int, list[int], list[int], list[int], int, bool, bool]]:
    """Of each fingerprint: its hash, the context's line numbers and two hashes of each of its lines, the fingerprint's place in
    the context, whether it is a window's minimum, and whether it is a long line."""
    lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(BLANK)]
    if not lines:
        return []
    digests = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass")) for _, x in lines]
    one = [(d >> 64) - (1 << 63) for d in digests]
    two = [(d & (1 << 64) - 1) - (1 << 63) for d in digests]
    minima = set(winnow(one, window))
    long = {k for k, (_, x) in enumerate(lines) if len(x) >= long_line}
    out = []
    for k in sorted(minima | long):
        a, b = (max(0, k - window + 1), min(len(lines), k + window)) if k in minima else (k, k + 1)
        out.append((one[k], [i for i, _ in lines[a:b]], one[a:b], two[a:b], k - a, k in minima, k in long))
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, long_line: int = 60) -> DataFrame:
    """doc_id, version (hash of the text) and lines: numbers of the lines to delete. Documents without any are not in it.

    Line k is deleted if it lies in a window of `window` consecutive lines that aren't blank, or is a line of at least
    `long_line` characters, and the same lines stand at an earlier place: in a document of smaller id, or earlier in its own.
    Blank lines don't count and stay. Null and empty texts have no lines; rows that repeat an id are at the same place and
    don't delete each other's lines; rows without id are left alone; empty tables give no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    checkpoint_dir_set(docs.sparkSession)
    version = F.xxhash64(docs[text_col])
    own = docs.select(docs[id_col].alias("doc_id"), version.alias("version"), docs[text_col].cast("string").alias("text")).where("doc_id is not null and text is not null and text <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_unused()
        columns = ["doc_id", "version", "print", "numbers", "one", "two", "at", "minimum", "long"]
        for b in batches:
            for part in slices(b["text"].str.len(), CHUNK_CHARS):
                p = b.iloc[part]
                rows = [(d, v, *f) for d, v, t in zip(p["doc_id"], p["version"], p["text"], strict=True) for f in fingerprints(t, window, long_line)]
                yield pd.DataFrame(rows, columns=columns)

    schema = f"doc_id {id_type(docs, id_col)}, version bigint, print bigint, numbers array<int>, one array<bigint>, two array<bigint>, at int, minimum boolean, long boolean"
    scratch = Scratch(docs.sparkSession)
    prints = scratch.store(own.mapInPandas(run, schema), "prints")
    again = scratch.store(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "again")
    held = join_counted(prints, again, ["print"], "n", F.col("doc_id")).drop("n")

    # extend both ways: every window around the fingerprint, and the long line alone
    starts = F.when(
        F.col("minimum"),
        F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.least(F.col("at"), F.size("one") - window)),
    ).otherwise(F.array().cast("array<int>"))
    cut = lambda i, n: F.struct(F.slice("numbers", i + 1, n).alias("numbers"), F.slice("one", i + 1, n).alias("one"), F.slice("two", i + 1, n).alias("two"))
    windows = F.transform(starts, lambda i: cut(i, F.lit(window)))
    single = F.when(F.col("long"), F.array(cut(F.col("at"), F.lit(1)))).otherwise(F.array().cast("array<struct<numbers:array<int>,one:array<bigint>,two:array<bigint>>>"))
    spread = held.select("doc_id", "version", F.explode(F.concat(windows, single)).alias("w"))
    spread = spread.select("doc_id", "version", "w.numbers", F.xxhash64("w.one", "w.two").alias("k1"), F.xxhash64(F.lit(1), "w.two", "w.one").alias("k2")).distinct()
    spread = scratch.store(spread, "spread")
    scratch.drop("prints", "again")
    place = F.struct("doc_id", F.get("numbers", F.lit(0)).alias("line"))
    first = scratch.store(spread.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "first")
    later = join_counted(spread, first, ["k1", "k2"], "n", F.col("doc_id")).where(place > F.col("first"))
    return later.select("doc_id", "version", F.explode("numbers").alias("line")).groupBy("doc_id", "version").agg(F.array_sort(F.collect_set("line")).alias("lines"))


@F.pandas_udf(T.StringType())
def without_lines(text: pd.Series, lines: pd.Series) -> pd.Series:
    out = []
    for t, gone in zip(text, lines, strict=True):
        if gone is None or not len(gone):
            out.append(t)
        else:
            gone = set(gone)
            out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


without_lines = without_lines.asNondeterministic()  # or a filter on its result would run it once more, in workers of its own


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with the repeated lines deleted from its texts, and how many in a last column, `removed` (or unused(docs, "removed"))."""
    found = repeated_lines(docs, id_col, text_col, **options)
    renamed = {c: unused(docs, c) for c in found.columns}
    found = found.withColumnsRenamed(renamed).checkpoint()
    at, version, lines = (found[renamed[c]] for c in ("doc_id", "version", "lines"))
    n = found.agg(F.coalesce(F.sum(F.size(lines)), F.lit(0))).first()[0]
    small = F.broadcast(found) if n <= BROADCAST_LINES else found
    both = docs.join(small, (docs[id_col] == at) & (F.xxhash64(docs[text_col]) == version), "left")
    text = F.when(lines.isNull(), docs[text_col]).otherwise(without_lines(docs[text_col], lines))
    columns = [docs[c] if c != text_col else text.alias(c) for c in docs.columns]
    return both.select(*columns, F.coalesce(F.size(lines), F.lit(0)).alias(unused(docs, "removed")))


def drop_emptied(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """dedup_lines(), without the rows of whose text nothing but white space is left, if something was deleted."""
    r = dedup_lines(docs, text_col=text_col, **options)
    empty = (F.col(r.columns[-1]) > 0) & (F.trim(F.col(text_col), F.lit(BLANK)) == "")
    return r.where(~empty).drop(r.columns[-1])


def line_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: its lines (null text: none), those deleted, and a digest of what is left."""
    n = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).alias("n_lines"), "text")
    r = dedup_lines(n, **options)
    return r.select("doc_id", F.col("n_lines").cast("long"), F.col("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), full_lines AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')
), windows AS (
  SELECT a.doc_id, a.i AS place, 'w' || a.line || chr(10) || b.line || chr(10) || c.line AS content, [a.i, b.i, c.i] AS own
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN full_lines c ON a.doc_id = c.doc_id AND c.k = a.k + 2
  UNION ALL SELECT doc_id, i, 's' || line, [i] FROM full_lines WHERE length(line) >= 60
), firsts AS (
  SELECT content, min((doc_id, place)) AS f FROM windows GROUP BY content
), gone AS (
  SELECT DISTINCT w.doc_id, unnest(w.own) AS i FROM windows w JOIN firsts USING (content) WHERE (w.doc_id, w.place) > f
)
SELECT d.doc_id, coalesce(max(l.n), 0)::BIGINT AS n_lines, coalesce(max(l.r), 0)::BIGINT AS n_removed, sha256(coalesce(max(l.kept), '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n, count(g.i) AS r, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
) l ON d.doc_id = l.doc_id GROUP BY d.doc_id
"""
