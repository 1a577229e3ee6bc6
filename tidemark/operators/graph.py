"""Walks over the relationship graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import kept


def neighbourhood(relationships: DataFrame, root, depth: int = 2, relation: str | None = None) -> DataFrame:
    """(id, relation_type, direction, depth) of what is at most depth steps from root, each record once, by its first step: outgoing before incoming, then the smallest edge."""
    edges = relationships if relation is None else relationships.where(F.col("relation_type") == relation)
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("id"), "relation_type", F.lit("outgoing").alias("direction"), F.lit(0).alias("turn"), F.col("id").alias("edge"))
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("id"), "relation_type", F.lit("incoming").alias("direction"), F.lit(1).alias("turn"), F.col("id").alias("edge"))
    both = out.unionByName(back)
    start = edges.select(F.lit(root).alias("id")).limit(1)
    frontier = seen = start.select("id")
    found = both.where(F.lit(False)).select("id", "relation_type", "direction", F.lit(0).alias("depth"))
    for level in range(1, depth + 1):
        met = both.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").join(seen, "id", "left_anti")
        new = kept(met.groupBy("id").agg(F.min_by(F.struct("relation_type", "direction"), F.struct("turn", "edge")).alias("r")).select("id", "r.*", F.lit(level).alias("depth")))
        found = found.unionByName(new)
        frontier = new.select("id")
        seen = seen.unionByName(frontier)
    return found


#: Folders that a stored adjacency is dealt into by node.
BUCKETS = 64


def _steps(edges: DataFrame) -> DataFrame:
    """(at, id, relation_type, direction, turn, edge): every edge from both of its ends."""
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("id"), "relation_type", F.lit("outgoing").alias("direction"), F.lit(0).alias("turn"), F.col("id").alias("edge"))
    back = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("id"), "relation_type", F.lit("incoming").alias("direction"), F.lit(1).alias("turn"), F.col("id").alias("edge"))
    return out.unionByName(back)


def _bucket(node: str):
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


def store_steps(relationships: DataFrame, folder: str) -> None:
    """Write what walks read: every edge from both ends, in folders by node, sorted by node. A hub's edges are dealt over several files."""
    rows = _steps(relationships).withColumn("bucket", _bucket("at")).repartition("bucket", F.pmod(F.xxhash64("edge"), F.lit(4)))
    rows.sortWithinPartitions("bucket", "at").write.partitionBy("bucket").parquet(folder)


def walks(steps: DataFrame, roots: DataFrame, depth: int = 2, relation: str | None = None) -> DataFrame:
    """(root, id, relation_type, direction, depth): `neighbourhood` of many roots (root) in one plan, over the stored steps.

    All roots take a step together. Only folders that hold a node of the frontier are read.
    """
    if relation is not None:
        steps = steps.where(F.col("relation_type") == relation)
    frontier = kept(roots.select("root", F.col("root").alias("at")).distinct())
    seen = frontier.select("root", F.col("at").alias("id"))
    found = None
    for level in range(1, depth + 1):
        own = [r[0] for r in frontier.select(_bucket("at")).distinct().collect()]  # BUCKETS at most
        met = steps.where(F.col("bucket").isin(own)).join(frontier, "at").join(seen, ["root", "id"], "left_anti")
        best = met.groupBy("root", "id").agg(F.min_by(F.struct("relation_type", "direction"), F.struct("turn", "edge")).alias("r"))
        new = kept(best.select("root", "id", "r.*", F.lit(level).alias("depth")))
        found = new if found is None else found.unionByName(new)
        frontier = new.select("root", F.col("id").alias("at"))
        seen = seen.unionByName(new.select("root", "id"))
    return found


def chains(next_of: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """(start, id, position): `chain` from each of many starts (start), all of them a step at a time. (id, next) has each id once."""
    step = next_of.select(F.col("id").alias("at"), "next")
    path = starts.select("start", F.array("start").alias("path"), F.col("start").alias("at"))
    for _ in range(most - 1):
        path = path.join(step, "at", "left")
        on = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        path = path.select("start", F.when(on, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"), F.when(on, F.col("next")).alias("at"))
    return path.select("start", F.posexplode(F.reverse("path")).alias("position", "id")).select("start", "id", "position")


def chain(next_of: DataFrame, start, most: int = 5) -> DataFrame:
    """(id, position): the nodes from start on along (id, next), at most `most`, the oldest first; a chain that meets itself stops. An unknown node is still listed."""
    path = next_of.sparkSession.range(1).select(F.array(F.lit(start)).alias("path"), F.lit(start).alias("id"))
    for _ in range(most - 1):
        path = path.join(next_of.select("id", "next"), "id", "left")
        on = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        path = path.select(F.when(on, F.array_append("path", F.col("next"))).otherwise(F.col("path")).alias("path"), F.when(on, F.col("next")).alias("id"))
    return path.select(F.posexplode(F.reverse("path")).alias("position", "id")).select("id", "position")


def linked(relationships: DataFrame, source, source_type: str = "source_id") -> DataFrame:
    """Targets of derived_from edges of a record."""
    return relationships.where((F.col(source_type) == source) & (F.col("relation_type") == "derived_from")).select(F.col("target_id").alias("id"))
