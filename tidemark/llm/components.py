"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _to_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours v. Only the least is gathered; the hash in the join's key has both sides dealt anew, so that Spark can split a node with very many edges."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumn("h", F.xxhash64("u"))
    return edges.withColumn("h", F.xxhash64("u")).join(least, ["h", "u"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = _to_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return down.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (u, v), u other than v: the least node reachable."""
    edges = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        edges = cut(_small_star(_large_star(edges)).where("u != v").distinct())
    # A star now: each node but the least has an edge to it.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
