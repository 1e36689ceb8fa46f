"""Sheets as typed tables: rows out of files, tables written by version with a catalog, and the views of a session."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import tables
from sheaf.sources import extract

ROWS = "path string, sheet string, error string, header array<string>, `_row` bigint, cells array<string>"
CATALOG = "session string, document string, table_name string, filename string, sheet string, columns string, row_count bigint, first_row bigint, last_row bigint, location string"
SLICE = 2_000  # rows that leave a task at once


def sheet_rows(files: DataFrame) -> DataFrame:
    """One row for each data row of each sheet of the CSV, TSV and XLSX files given (path, content): path, sheet, header, _row (in the
    sheet), cells. A file that can't be read gives one row with `error`; a sheet with a header alone gives none."""

    def sheets(path: str, raw: bytes) -> Iterator[tuple[str | None, list[list]]]:
        kind = extract.FORMATS.get(extract.suffix(path))
        if kind == "xlsx":
            yield from extract.xlsx_sheets(raw)
        elif kind in ("csv", "tsv"):
            yield None, extract.csv_rows(raw, "\t" if kind == "tsv" else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet", "error", "header", "_row", "cells"]
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    for name, rows in sheets(path, bytes(raw or b"")):
                        clean = extract.clean_rows(rows)
                        h = extract.header_at(clean) if clean else 0
                        for at in range(h + 1, len(clean), SLICE):
                            part = clean[at : at + SLICE]
                            yield pd.DataFrame([(path, name, None, clean[h][1], n, cells) for n, cells in part], columns=columns)
                except Exception as e:  # a broken file must not fail the others
                    yield pd.DataFrame([(path, None, f"{type(e).__name__}: {str(e)[:200]}", None, None, None)], columns=columns).astype({"_row": "Int64"})

    return files.select("path", "content").mapInPandas(run, ROWS)


def synthetic_sales(numbers: DataFrame) -> DataFrame:
    """An order made by formulas for each number (column i): _row, Order_ID, Date, Region, Product, Units, Revenue, Returned."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("i") % len(names) + 1).cast("int"))
    r = numbers.select(F.col("i").cast("bigint").alias("i")).withColumn("Units", 5 + (7 * F.col("i")) % 23)
    return r.select(
        (F.col("i") + 2).alias("_row"), F.concat(F.lit("ORD-"), (1001 + F.col("i")).cast("string")).alias("Order_ID"), F.date_add(F.lit("2025-01-01").cast("date"), F.col("i").cast("int")).cast("string").alias("Date"),
        pick(("North", "South", "East", "West")).alias("Region"), pick(("Widget", "Gadget", "Gizmo")).alias("Product"), "Units",
        (F.col("Units") * pick((20, 35, 50))).alias("Revenue"), (F.col("i") % 9 == 0).cast("long").alias("Returned"),
    )


def synthetic_campaigns(numbers: DataFrame) -> DataFrame:
    """A campaign made by formulas for each number (column i): Campaign, Channel, Spend, Clicks, Converted."""
    i = F.col("i").cast("bigint")
    channel = F.element_at(F.array(*map(F.lit, ("Email", "Search", "Social", "Display"))), ((3 * i) % 4 + 1).cast("int"))
    return numbers.select(
        F.concat(F.lit("CMP-"), F.lpad((i + 1).cast("string"), 3, "0")).alias("Campaign"), channel.alias("Channel"), (50 + (37 * i) % 400 + 0.5).cast("double").alias("Spend"),
        (20 + (11 * i) % 180).alias("Clicks"), ((5 * i) % 7 < 3).cast("long").alias("Converted"),
    )


class TableStore:
    """Typed tables below a folder of any store Spark writes, and the catalog of them.

    A table is written to a new place; then the catalog that names it replaces the old one, then the old place goes. The catalog has
    one row for each table, so the driver may hold it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def catalog(self) -> list[dict]:
        """Rows of the newest catalog (they are numbered; an unfinished one has no mark of success)."""
        path, files = self._files(f"{self.folder}/catalog")
        if not files.exists(path):
            return []
        done = [s.getPath().getName() for s in files.listStatus(path) if files.exists(self._files(f"{self.folder}/catalog/{s.getPath().getName()}/_SUCCESS")[0])]
        if not done:
            return []
        rows = self.spark.read.schema(CATALOG).parquet(f"{self.folder}/catalog/{max(done)}").collect()
        return [r.asDict() for r in rows]

    def _swap(self, rows: list[dict], gone: list[dict]) -> None:
        path, files = self._files(f"{self.folder}/catalog")
        number = max([0, *(int(s.getPath().getName()) for s in files.listStatus(path))] if files.exists(path) else [0]) + 1
        columns = [c.strip().split(" ")[0] for c in CATALOG.split(",")]
        self.spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], CATALOG).coalesce(1).write.parquet(f"{self.folder}/catalog/{number:012d}")
        for r in gone:
            p, f = self._files(r["location"])
            f.delete(p, True)

    def replace(self, session: str, document: str, rows: DataFrame) -> list[dict]:
        """The document's tables are those of `rows` (as sheet_rows() gives them for its file) from now on."""
        sheets = rows.where("error is null").groupBy("path", "sheet").agg(
            F.first("header").alias("header"), F.count("*").alias("n"), F.min("_row").alias("first"), F.max("_row").alias("last"), F.max(F.size("cells")).alias("width")
        ).orderBy("sheet").collect()  # one row for each sheet
        old = self.catalog()
        kept = [r for r in old if (r["session"], r["document"]) != (session, document)]
        taken = {r["table_name"] for r in kept if r["session"] == session}
        added = []
        for s in sheets:
            filename = s.path.rsplit("/", 1)[-1]
            name = tables.table_name(filename, s.sheet, len(sheets) > 1, taken)
            taken.add(name)
            header = [*s.header, *[""] * (s.width - len(s.header))]
            names = tables.column_names(header)
            own = rows.where((F.col("path") == s.path) & F.col("sheet").eqNullSafe(s.sheet))
            text = own.select("_row", *(F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))
            kinds = {r.column: (r.kind, r.nulls) for r in tables.column_kinds(text, names).collect()}
            typed = tables.typed(text, {n: k for n, (k, _) in kinds.items()})
            location = f"{self.folder}/tables/{name}-{uuid.uuid4().hex}"
            typed.write.parquet(location)
            stored = self.spark.read.schema(typed.schema).parquet(location)
            added.append({
                "session": session, "document": document, "table_name": name, "filename": filename, "sheet": s.sheet, "row_count": s.n, "first_row": s.first, "last_row": s.last, "location": location,
                "columns": json.dumps(tables.described(stored, [(n, h, *kinds[n]) for n, h in zip(names, header, strict=False)])),
            })
        self._swap(kept + added, [r for r in old if r not in kept])
        return added

    def drop(self, session: str, document: str | None = None) -> None:
        old = self.catalog()
        kept = [r for r in old if r["session"] != session or document not in (None, r["document"])]
        self._swap(kept, [r for r in old if r not in kept])

    def session_tables(self, session: str) -> list[dict]:
        """Catalog rows of a session by name, their columns decoded."""
        own = sorted((r for r in self.catalog() if r["session"] == session), key=lambda r: r["table_name"])
        return [r | {"columns": json.loads(r["columns"])} for r in own]

    def views(self, session: str) -> dict[str, DataFrame]:
        """The tables of just this session, by name."""
        return {r["table_name"]: self.spark.read.parquet(r["location"]) for r in self.session_tables(session)}

    def load(self, session: str, documents: dict[str, DataFrame]) -> dict[str, str | None]:
        """Tables of several documents (files by document id); what is wrong with one doesn't stop the others."""
        out: dict[str, str | None] = {}
        for document, files in documents.items():
            rows = sheet_rows(files)
            bad = rows.where("error is not null").select("error").first()
            out[document] = bad.error if bad else None
            if bad is None:
                self.replace(session, document, rows)
        return out
