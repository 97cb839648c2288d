"""Tables in a folder: parts that are only ever added, and one manifest that names those that count.

A commit writes what is new as parts, then puts the next manifest in place by one rename, so readers see all of a commit or
nothing. An insert adds a part; an update or a delete adds the ids that are gone, which hide older parts' rows, and rows instead.
Compaction writes a table anew as one part and drops what no manifest names any more.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.plans.catalog import SPARK_TYPE, Column_, Table


class Folder:
    """Files of a folder on any file system that Spark reads, through its own interface."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.new_path = jvm.org.apache.hadoop.fs.Path

    def at(self, name: str):
        return self.new_path(self.path, name)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def write_new(self, name: str, text: str) -> bool:
        """False if the file is there already: another writer was first."""
        temporary = self.at(f".{uuid.uuid4().hex}")
        out = self.fs.create(temporary)
        out.write(bytearray(text.encode()))
        out.close()
        done = not self.fs.exists(self.at(name)) and self.fs.rename(temporary, self.at(name))
        if not done:
            self.fs.delete(temporary, False)
        return done

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class StoreConflict(RuntimeError):
    """Another commit came first."""


def table_record(t: Table) -> dict:
    return {**asdict(t), "columns": [asdict(c) for c in t.columns.values()], "relations": {}}


def table_of(record: dict) -> Table:
    columns = {c["name"]: Column_(**{**c, "allowed": tuple(c["allowed"])}) for c in record["columns"]}
    return Table(**{**record, "columns": columns, "unique": tuple(map(tuple, record["unique"]))})


class Store:
    def __init__(self, path: str):
        self.path, self.version, self.manifest, self.saved = path.rstrip("/"), 0, {"tables": {}, "parts": {}}, {}

    def last_version(self, spark: SparkSession) -> int:
        return max((int(n.split(".")[0][1:]) for n in Folder(spark, self.path).names() if n.startswith("m") and n.endswith(".json")), default=0)

    def load(self, spark: SparkSession):
        from inkfold.plans.database import State

        self.version = self.last_version(spark)
        if self.version:
            text = "".join(r.value for r in spark.read.text(f"{self.path}/m{self.version:08}.json").collect())  # one small file
            self.manifest = json.loads(text)
        tables = {n: table_of(t) for n, t in self.manifest["tables"].items()}
        frames = {n: self.frame(spark, parts) for n, parts in self.manifest["parts"].items()}
        self.saved = dict(frames)
        return State(tables, frames)

    def frame(self, spark: SparkSession, parts: list[dict]) -> DataFrame:
        """Rows of all parts, without those that a later part says are gone."""
        schema, out, gone = parts[-1]["schema"], None, None
        for k, p in enumerate(parts):
            rows = spark.read.schema(p["schema"]).parquet(f"{self.path}/{p['rows']}")
            if p["schema"] != schema:
                raise StoreConflict("parts of one table differ in their columns")
            rows = rows.withColumn("_at", F.lit(k))
            out = rows if out is None else out.unionByName(rows)
            if p.get("gone"):
                ids = spark.read.schema("id string").parquet(f"{self.path}/{p['gone']}").withColumn("_until", F.lit(k))
                gone = ids if gone is None else gone.unionByName(ids)
        if gone is None:
            return out.drop("_at")
        last = gone.groupBy("id").agg(F.max("_until").alias("_until"))
        return out.join(last, "id", "left").filter("_until IS NULL OR _at >= _until").drop("_at", "_until")

    def save(self, spark: SparkSession, state):
        """Writes what differs from the last commit and swaps the manifest; returns the state as it is read back."""
        from inkfold.plans.database import Database, State

        parts, frames = {}, {}
        for name, frame in state.frames.items():
            old = self.manifest["parts"].get(name)
            if old and self.saved.get(name) is frame:
                parts[name], frames[name] = old, frame
                continue
            kinds = Database.columns(state.tables[name]) if name in state.tables else {}
            schema = ", ".join(f"`{n}` {SPARK_TYPE[kinds[n]] if n in kinds else 'string'}" for n in frame.columns)
            before = self.saved.get(name)
            if old and before is not None and old[-1]["schema"] == schema:
                made = {"schema": schema, "rows": f"{name}-{uuid.uuid4().hex}"}
                new = frame.exceptAll(before.select(frame.columns)).persist()
                new.write.parquet(f"{self.path}/{made['rows']}")
                lost = before.select(frame.columns).exceptAll(frame).select("id")
                if not lost.isEmpty():
                    made["gone"] = f"{name}-{uuid.uuid4().hex}"
                    lost.distinct().write.parquet(f"{self.path}/{made['gone']}")
                new.unpersist()
                parts[name] = [*old, made]
            else:
                made = {"schema": schema, "rows": f"{name}-{uuid.uuid4().hex}"}
                frame.write.parquet(f"{self.path}/{made['rows']}")
                parts[name] = [made]
            frames[name] = self.frame(spark, parts[name])
        manifest = {"tables": {n: table_record(t) for n, t in state.tables.items()}, "parts": parts}
        if not Folder(spark, self.path).write_new(f"m{self.version + 1:08}.json", json.dumps(manifest)):
            raise StoreConflict(f"version {self.version + 1} is there already")
        self.version, self.manifest, self.saved = self.version + 1, manifest, dict(frames)
        return State(state.tables, frames)

    def is_fresh(self, spark: SparkSession) -> bool:
        """Whether what was loaded is the last commit."""
        return self.version == self.last_version(spark)

    def compact(self, spark: SparkSession, most_parts: int = 8, keep: int = 1) -> list[str]:
        """Tables of more parts become one part each; parts and manifests that the last `keep` versions don't name go. Returns what was removed."""
        changed = {}
        for name, parts in self.manifest["parts"].items():
            if len(parts) > most_parts:
                made = {"schema": parts[-1]["schema"], "rows": f"{name}-{uuid.uuid4().hex}"}
                self.frame(spark, parts).write.parquet(f"{self.path}/{made['rows']}")
                changed[name] = [made]
        folder = Folder(spark, self.path)
        if changed:
            self.manifest = {**self.manifest, "parts": {**self.manifest["parts"], **changed}}
            if not folder.write_new(f"m{self.version + 1:08}.json", json.dumps(self.manifest)):
                raise StoreConflict(f"version {self.version + 1} is there already")
            self.version += 1
            self.saved = {}
        named = set()
        for v in range(max(1, self.version - keep + 1), self.version + 1):
            text = "".join(r.value for r in spark.read.text(f"{self.path}/m{v:08}.json").collect())
            named |= {f"m{v:08}.json"} | {p[k] for parts in json.loads(text)["parts"].values() for p in parts for k in ("rows", "gone") if p.get(k)}
        old = [n for n in folder.names() if n not in named and not n.startswith(".")]
        for n in old:
            folder.remove(n)
        return old
