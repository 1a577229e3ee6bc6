"""What replaces or retires a record: supersession chains and dead records, applied to rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOPS = 6


def supersessions(relationships: DataFrame, memories: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """(id, successor): for each superseded record its newest successor whose own project is the given one."""
    edges = relationships.where("relation_type = 'supersedes'")
    if project is not None:
        edges = edges.join(memories.where(F.col("project_id") == project).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.max_by("source_id", F.struct("created_at", "id")).alias("successor"))


def terminals(direct: DataFrame) -> DataFrame:
    """(id, successor): the end of each chain, at most `HOPS` steps on; a chain that meets itself stops before."""
    step = direct.select(F.col("id").alias("at"), F.col("successor").alias("next"))
    chain = direct.select("id", F.col("successor").alias("at"), F.array("id", "successor").alias("seen"), F.lit(False).alias("ended"))
    for _ in range(HOPS - 1):
        chain = chain.join(step, "at", "left")
        ended = F.col("ended") | F.col("next").isNull() | (F.array_contains(F.slice("seen", 2, HOPS + 1), F.col("next")))
        chain = chain.select("id", F.when(ended, F.col("at")).otherwise(F.col("next")).alias("at"), F.when(ended, F.col("seen")).otherwise(F.array_append("seen", F.col("next"))).alias("seen"), ended.alias("ended"))
    return chain.select("id", F.col("at").alias("successor"))


def curated(ranking: DataFrame, memories: DataFrame, dead: DataFrame, successors: DataFrame) -> DataFrame:
    """A ranking (id, rank, score) in which superseded records give way to their successors, and dead ones go.

    A successor takes over rank and score; duplicates fold at the best rank, and the first `matched_via` is kept. dead: (id).
    """
    gone = dead.select("id").distinct()
    rows = ranking.join(gone, "id", "left_anti").join(successors, "id", "left")
    rows = rows.join(gone.select(F.col("id").alias("successor")), "successor", "left_anti")
    via = memories.select("id", F.substring(F.regexp_extract("content", r"(?m)^[^\S\n]*(\S.*)$", 1), 1, 120).alias("preview"))
    rows = rows.join(via, "id", "left").withColumn("effective", F.coalesce("successor", "id"))
    redirected = F.col("successor").isNotNull()
    best = rows.groupBy(F.col("effective").alias("id")).agg(
        F.min("rank").alias("rank"),
        F.min_by("score", "rank").alias("score"),
        F.min(F.when(redirected, F.struct("rank", "id", "preview"))).alias("via"),
    )
    return best.join(memories.select("id"), "id", "left_semi").select("id", "rank", "score", F.col("via.id").alias("via_id"), F.col("via.preview").alias("via_preview"))


def context_curated(ranking: DataFrame, memories: DataFrame, dead: DataFrame, successors: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """A context's variant of `curated`: a successor that stands in has to be of the wanted types itself, and via_id is of the first hit that became the record, if that one was redirected."""
    gone = dead.select("id").distinct()
    rows = ranking.join(gone, "id", "left_anti").join(successors, "id", "left")
    rows = rows.join(gone.select(F.col("id").alias("successor")), "successor", "left_anti")
    rows = rows.select(F.coalesce("successor", "id").alias("id"), F.when(F.col("successor").isNotNull(), F.col("id")).alias("via_id"), "rank", "score")
    rows = rows.join(memories.select("id", "memory_type"), "id")
    if types:
        rows = rows.where(F.col("via_id").isNull() | F.col("memory_type").isin(*types))
    return rows.groupBy("id").agg(F.min_by(F.struct("rank", "score", "via_id"), "rank").alias("r")).select("id", "r.*")
