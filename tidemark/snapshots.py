"""Versions of a store on disk: a write replaces the files of its own projects, all tables and the keyword index change with one commit, or none does.

A version is a manifest: for each table, the folders that hold it and the projects that each folder is read for; and the segments of the keyword index. Folders are
written first and never changed. Then the manifest gets its name, the next number, by a rename that fails if another writer was first (`Conflict`); what a writer
left that failed before is read by nobody, and `vacuum` deletes it. Readers keep the version that they loaded.

Tables without a project of their own are filed under their records': vectors, sections, states, todos and memberships by record, edges by their source. Rows
whose record is not there are filed under the project ''.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import kept_index
from tidemark.operators.kept_index import KeptIndex, Segment
from tidemark.tables import SCHEMAS, Store, StoreError

#: The column that each table is filed by: a project, or a record.
PROJECT_OF = {"memories": "project_id", "projects": "id", "clusters": "project_id", "adrs": "project_id", "trash": "project_id"}
RECORD_OF = {"embeddings": "memory_id", "relationships": "source_id", "cluster_members": "memory_id", "handoffs": "memory_id", "status": "memory_id", "todos": "memory_id"}
PART = "__project"
#: Segments of the index that a commit leaves before it turns them into one.
MOST_SEGMENTS = 8


class Conflict(StoreError):
    """Another writer committed first; the write is to be made again from the version that is there now."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, store: Store, folder: str) -> Snapshots:
        """Version 0 of a store, in a folder that has none."""
        self = cls(store.memories.sparkSession, folder)
        if self.versions():
            raise StoreError(f"there is a store in {folder}")
        self._commit(store, None, -1, None)
        return self

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return [s.getPath().getName() for s in self._files().listStatus(root)] if self._files().exists(root) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names() if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = self.versions()[-1]
        return json.loads(self.spark.read.text(f"{self.folder}/v{version:010d}.json", wholetext=True).first()[0])

    def load(self, version: int | None = None, projects: Sequence[str] | None = None) -> Store:
        """The store of a version, or those rows of it that are filed under some projects: other projects' files are not read."""
        tables = self.manifest(version)["tables"]
        out = {}
        for name, schema in SCHEMAS.items():
            table = self.spark.createDataFrame([], schema)
            for folder, held in tables[name].items():
                asked = [p for p in held if projects is None or p in projects]
                if asked:
                    rows = self.spark.read.schema(f"{schema}, `{PART}` string").parquet(f"{self.folder}/{folder}")
                    table = table.unionByName(rows.where(F.col(PART).isin(asked)).drop(PART))
            out[name] = table
        return Store(**out)

    def index(self, version: int | None = None) -> KeptIndex:
        return KeptIndex(self.spark, [Segment(**s) for s in self.manifest(version)["index"]])

    def commit(self, store: Store, projects: Sequence[str], base: int, since: Store | None = None) -> int:
        """The next version: the rows of `store` that are filed under `projects` (all that the write changed) replace theirs, all else stays as in version `base`.

        since: the store that was loaded from that version and that the write began with; tables that the write passed on as they were are not written again.
        """
        return self._commit(store, projects, base, since)

    def _filed(self, store: Store, name: str) -> DataFrame:
        table = getattr(store, name)
        if name in PROJECT_OF:
            return table.withColumn(PART, F.coalesce(PROJECT_OF[name], F.lit("")))
        key = RECORD_OF[name]
        own = store.memories.select(F.col("id").alias(key), F.col("project_id").alias(PART))
        return table.join(own, key, "left").withColumn(PART, F.coalesce(PART, F.lit(""))).select(*table.columns, PART)

    def _commit(self, store: Store, projects: Sequence[str] | None, base: int, since: Store | None) -> int:
        version = base + 1
        if projects is None:
            known = store.projects.select("id").union(store.memories.select("project_id")).union(store.trash.select("project_id"))
            projects = [r[0] for r in known.where("id is not null").distinct().collect()] + [""]
        old = self.manifest(base) if base >= 0 else {"tables": {name: {} for name in SCHEMAS}, "index": []}
        names = sorted({*projects, ""})
        tables = {}
        for f in fields(store):
            if since is not None and getattr(since, f.name) is getattr(store, f.name):
                tables[f.name] = old["tables"][f.name]
                continue
            folder = f"{f.name}-{uuid.uuid4().hex}"
            rows = self._filed(store, f.name).where(F.col(PART).isin(names))
            rows.repartition(F.col(PART), F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(16))).write.partitionBy(PART).parquet(f"{self.folder}/{folder}")
            held = {k: [p for p in v if p not in names] for k, v in old["tables"][f.name].items()}
            if [n for n in self._children(folder) if n.startswith(PART)]:
                held[folder] = names
            tables[f.name] = {k: v for k, v in held.items() if v}
        fresh = [Segment(**x) for x in old["index"]]
        if since is None or since.memories is not store.memories:
            own = store.memories.where(F.coalesce("project_id", F.lit("")).isin(names))
            if len(fresh) >= MOST_SEGMENTS:
                others = self.load(base).memories.where(~F.coalesce("project_id", F.lit("")).isin(names))
                fresh = [kept_index.rebuilt(others.unionByName(own), kept_index.new_folder(self.folder), version)]
            else:
                before = self.load(base, names).memories if base >= 0 else store.memories.limit(0)
                new, gone = kept_index.changes(kept_index.texts(before), kept_index.texts(own))
                fresh.append(kept_index.write(new, gone, kept_index.new_folder(self.folder), version))
        self._name(version, {"tables": tables, "index": kept_index.to_json(fresh)})
        return version

    def _children(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._files().listStatus(self._path(folder))]

    def _name(self, version: int, manifest: dict) -> None:
        files, draft, final = self._files(), self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"v{version:010d}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {version} is there already")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete what none of the last `keep` versions reads, and their manifests; the names of what went. Not while others write."""
        versions = self.versions()
        used = set()
        for v in versions[-keep:]:
            m = self.manifest(v)
            used |= {f for t in m["tables"].values() for f in t} | {s["folder"].rsplit("/", 1)[-1] for s in m["index"]} | {f"v{v:010d}.json"}
        gone = [n for n in self._names() if n not in used and not n.startswith(".")]
        for n in gone:
            self._files().delete(self._path(n), True)
        return gone
