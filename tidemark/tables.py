"""The tables of a store, as Spark schemas, and their snapshots on disk.

A store is a set of immutable DataFrames. Reads never write: what a query would do to the access counters is
returned as a log and applied by an explicit write (`operators.writes.reinforced`).
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

MERGE_SOURCE = "array<struct<id:string,content_preview:string,content:string,merged_at:bigint>>"
SCHEMAS = {
    "memories": f"id string, project_id string, memory_type string, content string, summary string, tags array<string>, importance double, relevance_score double, access_count bigint, created_at bigint, updated_at bigint, last_accessed_at bigint, branch string, merged_from {MERGE_SOURCE}, external_artifacts array<string>, pinned boolean, `global` boolean",
    "embeddings": "memory_id string, vector array<float>, model_version string",
    "relationships": "id string, source_id string, target_id string, relation_type string, strength double, created_at bigint",
    "projects": "id string, name string, root_path string, decay_rate double, created_at bigint",
    "clusters": "id string, project_id string, summary string, member_count int, centroid array<double>, created_at bigint, updated_at bigint",
    "cluster_members": "cluster_id string, memory_id string",
    "handoffs": "memory_id string, summary string, decisions array<string>, todos array<string>, blockers array<string>, mental_model string, next_steps array<string>, notes string, continues_from string, tried array<string>, sections array<struct<section:string,vector:array<float>>>",
    "adrs": "memory_id string, project_id string, adr_number int, status string, title string, context string, decision string, consequences string, created_at bigint, updated_at bigint",
    "status": "memory_id string, dead boolean, reason string, marked_at bigint",
    "trash": "trash_id bigint, memory_id string, project_id string, op string, memory string, relationships string, vector array<float>, model_version string, trashed_at bigint",
    "todos": "memory_id string, status string, reason string, closed_at bigint",
}
MEMORY_TYPES = ("fact", "decision", "preference", "pattern", "debug", "entity", "handoff", "adr", "todo")
RELATION_TYPES = ("relates_to", "supersedes", "derived_from")
TODO_STATUSES = ("open", "done", "dropped")
#: From each status of a decision record, those that it may turn into, besides itself.
ADR_TRANSITIONS = {"proposed": ("accepted", "rejected", "deprecated"), "accepted": ("deprecated", "superseded"), "rejected": ("proposed",), "deprecated": ("accepted",), "superseded": ()}


class StoreError(ValueError):
    """A request that the store refuses."""


class NotFound(StoreError):
    """A record, decision record or handoff that is not there."""


class InvalidType(StoreError):
    """A record whose type is none, or whose content is not of its type."""


class EmbeddingError(StoreError):
    """A record without the vector that it needs."""


class FormatError(StoreError):
    """A document of another version, or a codec's bytes that do not fit."""


class InvalidArguments(StoreError):
    """A request that says too little, too much or what does not go together."""


class UnknownProject(StoreError):
    def __init__(self, asked: str, known: list[str]):
        super().__init__(f"unknown project {asked!r}; known: {', '.join(known)}")


@dataclass(frozen=True)
class Store:
    """One DataFrame for each table."""

    memories: DataFrame
    embeddings: DataFrame
    relationships: DataFrame
    projects: DataFrame
    clusters: DataFrame
    cluster_members: DataFrame
    handoffs: DataFrame
    adrs: DataFrame
    status: DataFrame
    trash: DataFrame
    todos: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Store:
        """A snapshot: one Parquet folder for each table."""
        return cls(**{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()})

    def save(self, folder: str) -> None:
        """Write a snapshot to a folder that does not exist; memories lie by project, so that a project's scan reads only its own files."""
        for f in fields(self):
            writer = getattr(self, f.name).write.mode("errorifexists")
            (writer.partitionBy("project_id") if f.name == "memories" else writer).parquet(f"{folder}/{f.name}")

    def with_(self, **tables: DataFrame) -> Store:
        return replace(self, **tables)

    def check_project(self, project: str) -> str:
        """The project if the store knows it; else an error that lists those it knows."""
        known = self.projects.select("id").union(self.memories.select("project_id")).distinct()
        if known.where(known["id"] == project).isEmpty():
            raise UnknownProject(project, [r[0] for r in known.orderBy("id").limit(50).collect()])
        return project
