"""Who sees which records: project, branch, type, tag, and limits on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL, GLOBAL_ONLY = "all", "global"


def in_project(project: str, with_global: bool = False) -> Column:
    """Records of the project; vector searches also see those marked global."""
    own = F.col("project_id") == project
    return own | F.col("global") if with_global else own


def on_branch(mode: str = ALL, current: str | None = None) -> Column:
    """Three-way: all; only records of no branch; or those of no branch and of one branch. `current` without a known branch means all."""
    if mode == ALL or mode == "current" and current is None:
        return F.lit(True)
    if mode == GLOBAL_ONLY:
        return F.col("branch").isNull()
    return F.col("branch").isNull() | (F.col("branch") == (current if mode == "current" else mode))


def matching(types: Sequence[str] | None = None, tags: Sequence[str] | None = None, min_relevance: float | None = None) -> Column:
    """Any of the types, any of the tags, and a decay value of at least min_relevance."""
    out = F.lit(True)
    if types:
        out = out & F.col("memory_type").isin(*types)
    if tags:
        out = out & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    if min_relevance is not None:
        out = out & (F.col("relevance_score") >= min_relevance)
    return out


def filtered(memories: DataFrame, project: str, branch: Column | None = None, types=None, tags=None, min_relevance: float | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Records by relevance. Tags are filtered before the limit, so that a page is full if it can be."""
    rows = memories.where(in_project(project)).where(F.lit(True) if branch is None else branch).where(matching(types, tags, min_relevance))
    return rows.orderBy(F.desc("relevance_score"), "id").offset(offset).limit(limit)


def listing(memories: DataFrame, dead: DataFrame, successors: DataFrame, project: str, status: str = "live", types=None, tags=None, by: str = "created_at", limit: int = 20, offset: int = 0, width: int = 200) -> DataFrame:
    """A page of records with their state. dead: (id); successors: (id, successor). An unknown status means live."""
    rows = memories.where(in_project(project)).where(matching(types, tags))
    rows = rows.join(dead.select("id", F.lit(True).alias("dead")).distinct(), "id", "left").join(successors.select("id", F.col("successor").alias("superseded_by")), "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    gone = F.col("superseded_by").isNotNull()
    wanted = {"all": F.lit(True), "dead": F.col("dead"), "superseded": gone}.get(status, ~F.col("dead") & ~gone)
    rows = rows.where(wanted).orderBy(F.desc(by), "id").offset(offset).limit(limit)
    return rows.select("id", "memory_type", F.substring("content", 1, width).alias("content"), by, "dead", "superseded_by")


def prefiltered(memories: DataFrame, project: str, cap: int = 500) -> DataFrame:
    """Candidates of a context search: the most recently used `cap` records that the project sees, and all pinned ones."""
    seen = memories.where(in_project(project, with_global=True))
    return seen.orderBy(F.desc("last_accessed_at"), "id").limit(cap).unionByName(seen.where("pinned")).dropDuplicates(["id"])


def prunable(memories: DataFrame, project: str, below: float = 0.2, with_pinned: bool = False) -> DataFrame:
    """Records whose decay value is under a threshold; with_pinned is the command line's variant."""
    return memories.where(in_project(project) & (F.col("relevance_score") < below) & (F.lit(with_pinned) | ~F.col("pinned")))


def auto_prunable(memories: DataFrame, now: int, days: int = 30, at_most: float = 0.1) -> DataFrame:
    """Records that upkeep removes: faded, never used, old, neither pinned nor global."""
    return memories.where(~F.col("pinned") & ~F.col("global") & (F.col("relevance_score") <= at_most) & (F.col("access_count") == 0) & (F.col("created_at") < now - days * 86400))
