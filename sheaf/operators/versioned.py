"""Tables that change by key: replace and delete without rewriting, snapshot reads, compaction.

A table is a folder of Parquet parts and numbered manifests that list them. A change writes its part first and then the next
manifest, so a reader sees the table before or after it, never between. Rows of a key (a document, say) are those of the last
part that has the key; a deletion is a part of keys alone. Parts that no manifest names any more go when they are vacuumed.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "seq bigint, path string, kind string, batch string, keys bigint"
BROADCAST_KEYS = 500_000  # changed keys sent to all tasks; more are shuffled


class VersionedTable:
    """key: the columns by which rows are replaced. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    # ---- manifests

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, files = self._files(name)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def versions(self) -> list[int]:
        """Finished versions; one whose writer was lost has no mark of success."""
        done = []
        for n in self._names("manifests"):
            path, files = self._files(f"manifests/{n}/_SUCCESS")
            if files.exists(path):
                done.append(int(n))
        return done

    def parts(self, version: int | None = None) -> list[dict]:
        """What a version (the newest one) is made of, in order of writing: a row for each change since it was last compacted."""
        done = self.versions()
        if not done or version == 0:
            return []
        at = max(done) if version is None else version
        if at not in done:
            raise ValueError(f"there is no version {at}")
        return sorted((r.asDict() for r in self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{at:012d}").collect()), key=lambda r: r["seq"])

    def _publish(self, parts: list[dict]) -> int:
        # a number that a lost writer has begun is not used again
        number = max([0, *map(int, self._names("manifests"))]) + 1
        rows = [tuple(p[c.split()[0]] for c in MANIFEST.split(", ")) for p in parts]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.folder}/manifests/{number:012d}")
        return number

    # ---- changes

    def _add(self, rows: DataFrame, kind: str, batch: str | None) -> int:
        parts = self.parts()
        if batch is not None and any(p["batch"] == batch for p in parts):
            return max(self.versions())
        seq = max([0, *(p["seq"] for p in parts)]) + 1
        path = f"parts/{seq:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{path}/rows")
        keys = self.spark.read.parquet(f"{self.folder}/{path}/rows").select(*self.key).distinct() if kind != "base" else None
        n = 0
        if keys is not None:
            keys.write.parquet(f"{self.folder}/{path}/keys")
            n = self.spark.read.parquet(f"{self.folder}/{path}/keys").count()
        return self._publish([*parts, {"seq": seq, "path": path, "kind": kind, "batch": batch, "keys": n}])

    def replace(self, rows: DataFrame, batch: str | None = None) -> int:
        """From now on the rows of each key in `rows` are these; other keys stay. Returns the version.

        batch: a name for the change; one that the table holds already is not made again, so a streaming batch may be repeated.
        Columns may come and go: rows lack what their part doesn't have.
        """
        return self._add(rows, "delta", batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> int:
        """Keys without rows from now on."""
        return self._add(keys.select(*self.key).distinct(), "gone", batch)

    def compact(self) -> int:
        """Writes the live rows as one part; batches made so far are remembered by it."""
        parts = self.parts()
        if not parts or [p["kind"] for p in parts] == ["base"]:
            return max([0, *self.versions()])
        seq, path = parts[-1]["seq"], f"parts/{parts[-1]['seq']:012d}-{uuid.uuid4().hex}"
        self.live().write.parquet(f"{self.folder}/{path}/rows")
        # names of batches stay as rows without a part
        base = {"seq": seq, "path": path, "kind": "base", "batch": None, "keys": 0}
        return self._publish([*({"seq": 0, "path": "", "kind": "done", "batch": p["batch"], "keys": 0} for p in parts if p["batch"]), base])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the newest `keep` versions and the parts that these don't name; readers of older versions end. Returns what went."""
        done = self.versions()
        stay = done[-keep:]
        named = {p["path"].split("/")[-1] for v in stay for p in self.parts(v)}
        gone = [f"parts/{n}" for n in self._names("parts") if n not in named] + [f"manifests/{n}" for n in self._names("manifests") if int(n) not in stay]
        for name in gone:
            path, files = self._files(name)
            files.delete(path, True)
        return gone

    # ---- reading

    def _read(self, part: dict, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part['path']}/{what}")

    def live(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version (the newest one); None if the table has never had any.

        Only what has changed since the table was compacted is joined: the keys of changes, each with the last one that has it.
        """
        parts = [p for p in self.parts(version) if p["kind"] != "done"]
        changes = [p for p in parts if p["kind"] != "base"]
        held = [p for p in parts if p["kind"] != "gone"]
        if not held:
            return None
        if not changes:
            return self._read(parts[0], "rows")
        tagged = [self._read(p, "keys").withColumn("seq__", F.lit(p["seq"])) for p in changes]
        last = reduce(DataFrame.unionByName, tagged).groupBy(*self.key).agg(F.max("seq__").alias("seq__"))
        last = F.broadcast(last) if sum(p["keys"] for p in changes) <= BROADCAST_KEYS else last
        out = []
        for p in held:
            rows = self._read(p, "rows")
            if p["kind"] == "base":
                out.append(rows.join(last, self.key, "left_anti"))
            else:
                out.append(rows.withColumn("seq__", F.lit(p["seq"])).join(last, [*self.key, "seq__"], "left_semi").drop("seq__"))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def upsert_stream(table: VersionedTable):
    """For foreachBatch: each batch replaces its keys, once, however often it is run."""

    def run(batch: DataFrame, number: int) -> None:
        table.replace(batch, f"batch-{number}")

    return run
