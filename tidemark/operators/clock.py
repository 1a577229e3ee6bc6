"""Decay on the store's own clock: days on which something was stored, not days of the calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FLOOR, BOOST, MAX_USES, FADE = 0.1, 0.1, 50.0, 0.02


def advances(tags: str = "tags") -> Column:
    """Records that move the clock: all but those captured by hooks."""
    return F.coalesce(~F.array_contains(tags, "hook"), F.lit(True))


def store_days(memories: DataFrame) -> DataFrame:
    """(project_id, day): the days on which the project's clock moved."""
    return memories.where(advances()).select("project_id", F.floor(F.col("created_at") / 86400).alias("day")).distinct()


def elapsed_days(memories: DataFrame, days: DataFrame, since: str = "last_accessed_at") -> DataFrame:
    """memories with `elapsed`: store-days of their project after the day of `since`.

    Days are numbered from the last one back, and a record joins the number of its own day: a day and project have one row, so records are
    never multiplied. A day on which the clock did not move counts as many as the next day that it did, and itself not.
    """
    own = memories.select("project_id", F.floor(F.col(since) / 86400).alias("day")).distinct()
    marks = days.withColumn("moved", F.lit(1)).unionByName(own.join(days, ["project_id", "day"], "left_anti").withColumn("moved", F.lit(0)))
    later = F.sum("moved").over(Window.partitionBy("project_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))
    numbered = marks.select("project_id", "day", F.coalesce(later, F.lit(0)).alias("elapsed"))
    return memories.withColumn("day", F.floor(F.col(since) / 86400)).join(numbered, ["project_id", "day"], "left").drop("day").withColumn("elapsed", F.coalesce("elapsed", F.lit(0)))


def relevance(elapsed: Column, importance: Column, uses: Column, rate: Column | float = 0.01) -> Column:
    """Importance that decays with store-days, and a bonus for use that saturates and fades; between 0.1 and 1."""
    d = F.greatest(elapsed.cast("double"), F.lit(0.0))
    weight = 0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance))
    used = F.least(F.lit(1.0), F.log1p(uses.cast("double")) / F.log1p(F.lit(MAX_USES)))
    value = F.exp(-(F.lit(rate) if isinstance(rate, float) else rate) * d) * weight + BOOST * used * F.exp(-FADE * d)
    return F.greatest(F.lit(FLOOR), F.least(F.lit(1.0), value))


def refreshed(memories: DataFrame, projects: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """memories with their relevance_score as of now; pinned records keep theirs. With a project, only its records change."""
    rows = elapsed_days(memories, store_days(memories))
    rate: Column | float = 0.01
    if projects is not None:
        rows = rows.join(projects.select(F.col("id").alias("project_id"), "decay_rate"), "project_id", "left")
        rate = F.coalesce("decay_rate", F.lit(0.01))
    due = ~F.col("pinned") & (F.lit(True) if project is None else F.col("project_id") == project)
    score = F.when(due, relevance(F.col("elapsed"), F.col("importance"), F.col("access_count"), rate)).otherwise(F.col("relevance_score"))
    return rows.withColumn("relevance_score", score).select(memories.columns)


def recency(elapsed: Column) -> Column:
    return F.exp(-FADE * F.greatest(elapsed.cast("double"), F.lit(0.0)))


def additive(similarity: Column, elapsed: Column, importance: Column) -> Column:
    return 0.6 * similarity + 0.2 * recency(elapsed) + 0.2 * importance


def multiplicative(base: Column, elapsed: Column, importance: Column) -> Column:
    return base * (0.6 + 0.2 * recency(elapsed) + 0.2 * importance)
