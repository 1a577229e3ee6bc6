"""Counts and reports over a store. Each is one aggregation over the table, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scope import in_project


def project_listing(projects: DataFrame, memories: DataFrame) -> DataFrame:
    """Every project that is named or has records, the last changed first."""
    every = projects.select("id").union(memories.select("project_id")).distinct()
    per = memories.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("memory_type") == "handoff").alias("h"), F.count_if(F.col("memory_type") == "adr").alias("a"), F.max("updated_at").alias("latest"))
    rows = every.join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("memory_count"), F.coalesce("h", F.lit(0)).alias("handoff_count"), F.coalesce("a", F.lit(0)).alias("adr_count"), "latest")
    return rows.orderBy(F.desc_nulls_last("latest"), "id")


def project_stats(memories: DataFrame, relationships: DataFrame, project: str, clusters: DataFrame | None = None, dead: DataFrame | None = None, trash: DataFrame | None = None) -> DataFrame:
    """One row of counts of a project; the count of global records is of the whole store."""
    own = F.col("project_id") == project
    counts = memories.agg(
        F.count_if(own).alias("memory_count"),
        F.coalesce(F.avg(F.when(own, F.col("relevance_score"))), F.lit(0.0)).alias("avg_relevance"),
        F.count_if(own & F.col("pinned")).alias("pinned_count"),
        F.count_if(F.col("global")).alias("global_count"),
        F.count_if(own & (F.col("memory_type") == "handoff")).alias("handoff_count"),
        F.max(F.when(own & (F.col("memory_type") == "handoff"), F.col("created_at"))).alias("last_handoff_at"),
        F.count_if(own & (F.col("memory_type") == "adr")).alias("adr_count"),
    )
    ids = memories.where(own).select("id")
    scalars = {"relationship_count": project_edges(relationships, memories, project)}
    if clusters is not None:
        scalars["cluster_count"] = clusters.where(own)
    if dead is not None:
        scalars["dead_count"] = dead.join(ids, "id", "left_semi")
    if trash is not None:
        scalars["trash_count"] = trash.where(own)
    for name, rows in scalars.items():
        counts = counts.withColumn("k", F.lit(1)).join(rows.agg(F.count("*").alias(name)).withColumn("k", F.lit(1)), "k").drop("k")
    return counts


def project_edges(relationships: DataFrame, memories: DataFrame, project: str) -> DataFrame:
    return relationships.join(memories.where(F.col("project_id") == project).select(F.col("id").alias("source_id")), "source_id", "left_semi")


def type_distribution(memories: DataFrame, project: str) -> DataFrame:
    return memories.where(in_project(project)).groupBy("memory_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "memory_type")


def branch_stats(memories: DataFrame, project: str) -> DataFrame:
    """Records of each branch; no branch is one of them."""
    return memories.where(in_project(project)).groupBy("branch").agg(F.count("*").alias("n"))


def insights(memories: DataFrame, project: str, now: int, rate_days: int = 7, stale_days: int = 30, low: float = 0.2) -> DataFrame:
    """One row: records a day lately, never used, faded, both, and the healthy rest."""
    never = (F.col("access_count") == 0) & (F.col("created_at") < now - stale_days * 86400)
    faded = F.col("relevance_score") < low
    row = memories.where(in_project(project)).agg(
        F.count("*").alias("total"),
        (F.count_if(F.col("created_at") >= now - rate_days * 86400) / float(rate_days)).alias("per_day"),
        F.count_if(never).alias("never_accessed"),
        F.count_if(faded).alias("faded"),
        F.count_if(never & faded).alias("both"),
    )
    return row.withColumn("healthy", F.col("total") - (F.col("never_accessed") + F.col("faded") - F.col("both")))


def top_accessed(memories: DataFrame, project: str, n: int = 5) -> DataFrame:
    return memories.where(in_project(project)).orderBy(F.desc("access_count"), "id").limit(n).select("id", "access_count")


def duplicate_pair_count(members: DataFrame, memories: DataFrame) -> DataFrame:
    """The number of pairs of one cluster and type. A group of n has n(n-1)/2 of them, so none is formed."""
    sizes = members.join(memories.select("id", "memory_type"), "id").groupBy("cluster_id", "memory_type").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"))


def todo_counts(todos: DataFrame, memories: DataFrame, project: str) -> DataFrame:
    rows = todos.join(memories.where(in_project(project)).select("id"), "id", "left_semi")
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("open", "done", "dropped")])


def captures_today(memories: DataFrame, project: str, now: int) -> DataFrame:
    """Records that hooks captured since midnight UTC."""
    return memories.where(in_project(project) & F.array_contains("tags", "hook") & (F.col("created_at") >= now - now % 86400)).agg(F.count("*").alias("n"))


def next_adr_number(adrs: DataFrame, project: str) -> DataFrame:
    return adrs.where(F.col("project_id") == project).agg((F.coalesce(F.max("adr_number"), F.lit(0)) + 1).alias("next_number"))
