"""Aggregates that writes keep: what rows add is added, what they take away is subtracted, and no row that stays is read again.

Numbers are kept as whole multiples of 2^-40, so that sums are exact and a row that is taken away leaves nothing behind: after any writes an aggregate is that of a
recount. A write's own rows are summed where they lie; then a few sums for each group meet those that there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 1 << 40


def _whole(x: Column) -> Column:
    return F.round(x.cast("double") * F.lit(float(UNIT))).cast("decimal(38,0)")


def _signed(added: DataFrame, removed: DataFrame) -> DataFrame:
    return added.withColumn("sign", F.lit(1)).unionByName(removed.withColumn("sign", F.lit(-1)))


def vector_sums(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(cluster_id, pos, n, total) by which members (cluster_id, vector) that come and go change the sums of their clusters; at pos -1, the members themselves, n of them, with a vector or without."""
    rows = _signed(added.select("cluster_id", "vector"), (added.limit(0) if removed is None else removed).select("cluster_id", "vector"))
    parts = rows.select("cluster_id", "sign", F.posexplode("vector").alias("pos", "v")).select("cluster_id", "pos", F.col("sign").alias("n"), (_whole(F.col("v")) * F.col("sign")).alias("total"))
    members = rows.select("cluster_id", F.lit(-1).alias("pos"), F.col("sign").alias("n"), F.lit(0).cast("decimal(38,0)").alias("total"))
    return _totals(parts.unionByName(members))


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster_id", "pos").agg(F.sum("n").cast("bigint").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))


def with_change(sums: DataFrame, change: DataFrame) -> DataFrame:
    """Sums after a change of `vector_sums`; clusters that are left without members go."""
    rows = _totals(sums.unionByName(change))
    left = rows.where("pos = -1 and n > 0").select("cluster_id")
    return rows.join(left, "cluster_id", "left_semi").where("n > 0")


def centroids(sums: DataFrame) -> DataFrame:
    """(cluster_id, centroid, member_count), as `similarity.centroids` counts them anew."""
    mean = F.struct("pos", (F.col("total").cast("double") / F.lit(float(UNIT)) / F.col("n")).alias("v"))
    per = sums.groupBy("cluster_id").agg(F.max(F.when(F.col("pos") < 0, F.col("n"))).alias("member_count"), F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, mean))).alias("c"))
    return per.select("cluster_id", F.when(F.size("c") > 0, F.transform("c", lambda x: x["v"])).alias("centroid"), "member_count")


#: Counts of a project, as SQL over its records.
STATS = {
    "memory_count": "1",
    "pinned_count": "int(pinned)",
    "global_count": "int(`global`)",
    "handoff_count": "int(memory_type = 'handoff')",
    "adr_count": "int(memory_type = 'adr')",
}


def record_sums(added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(project_id, counts..., relevance) by which records that come and go change the statistics of their projects."""
    rows = _signed(added, added.limit(0) if removed is None else removed)
    sums = [F.sum(F.coalesce(F.expr(value), F.lit(0)) * F.col("sign")).cast("bigint").alias(name) for name, value in STATS.items()]
    return rows.groupBy("project_id").agg(*sums, F.sum(_whole(F.coalesce("relevance_score", F.lit(0.0))) * F.col("sign")).cast("decimal(38,0)").alias("relevance"))


def with_record_change(sums: DataFrame, change: DataFrame) -> DataFrame:
    kinds = {**dict.fromkeys(STATS, "bigint"), "relevance": "decimal(38,0)"}
    rows = sums.unionByName(change).groupBy("project_id").agg(*[F.sum(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return rows.where("memory_count > 0")


def project_stats(sums: DataFrame) -> DataFrame:
    """(project_id, counts..., avg_relevance) of every project that has records."""
    return sums.select("project_id", *STATS, (F.col("relevance").cast("double") / F.lit(float(UNIT)) / F.col("memory_count")).alias("avg_relevance"))
