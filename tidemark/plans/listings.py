"""Queries of the trash, of clusters that lose members, of derived records, of parsed decision records and of sampled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import graph, records, stats, writes
from tidemark.plans import demo
from tidemark.plans.demo import CTE, NOW, PROJECT
from tidemark.plans.queries import query
from tidemark.plans.upkeep import _shaped, _store


def _trash(spark: SparkSession, d: str) -> DataFrame:
    """Every eighth record in the trash, each since a moment of its own."""
    store = _store(spark, d)
    gone = writes.snapshots(store, store.memories.where("cast(id as bigint) % 8 = 1").select("id"), "delete", NOW)
    return gone.withColumn("trashed_at", F.lit(NOW) - F.col("memory_id").cast("bigint") * 3600)


@query(
    f"""WITH {CTE} SELECT CAST(id AS VARCHAR) AS memory_id, 'delete' AS op, ({NOW} - id * 3600)::BIGINT AS trashed_at
FROM mem WHERE id % 8 = 1 AND project_id = '{PROJECT}' ORDER BY trashed_at DESC LIMIT 20"""
)
def trash_page(spark: SparkSession, d: str) -> DataFrame:
    """The last twenty entries of a project's trash."""
    return writes.trash_listing(_trash(spark, d), PROJECT).select("memory_id", "op", "trashed_at")


@query(f"WITH {CTE} SELECT CAST(id AS VARCHAR) AS memory_id, project_id FROM mem WHERE id % 8 = 1 AND id * 3600 <= 30 * 86400")
def trash_after_sweep(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the trash after thirty days."""
    return writes.swept(_trash(spark, d), NOW, 30).select("memory_id", "project_id")


@query(f"WITH {CTE} SELECT (SELECT count(*) FROM mem WHERE project_id = '{PROJECT}') AS memory_count, (SELECT count(*) FROM mem WHERE project_id = '{PROJECT}' AND id % 8 = 1) AS trash_count")
def trash_count(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.project_stats(demo.memories(spark, d), demo.relationships(spark, d), PROJECT, trash=_trash(spark, d))
    return rows.select("memory_count", "trash_count")


@query(
    f"""WITH {CTE}, own AS (SELECT emb.cluster_id, emb.id FROM emb JOIN mem USING (id) WHERE cluster_id % 3 <> 0 AND emb.id % 2 = 1)
SELECT CAST(cluster_id AS VARCHAR) AS id, count(*)::INTEGER AS member_count FROM own GROUP BY cluster_id"""
)
def clusters_after_removal(spark: SparkSession, d: str) -> DataFrame:
    """Every third cluster loses all its records and goes; the others lose half of theirs and count anew."""
    members = demo.labels(spark, d).join(demo.memories(spark, d).select("id"), "id").select("cluster_id", F.col("id").alias("memory_id"))
    sizes = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("member_count"))
    store = _store(spark, d).with_(clusters=_shaped(sizes, "clusters"), cluster_members=_shaped(members, "cluster_members"))
    gone = members.where("cluster_id % 3 = 0 or memory_id % 2 = 0").select(F.col("memory_id").cast("string").alias("id"))
    return writes.removed(store, gone).clusters.select("id", "member_count")


_HUB = 1


@query(f"WITH {CTE} SELECT target_id AS id FROM rel WHERE source_id % 97 = {_HUB} AND relation_type = 'relates_to'")
def derived_records(spark: SparkSession, d: str) -> DataFrame:
    """What a record was derived from. Records whose ids leave one remainder by 97 are one record here, and relations derivations."""
    edges = demo.relationships(spark, d).where("relation_type = 'relates_to'")
    edges = edges.withColumn("source_id", F.col("source_id") % 97).withColumn("relation_type", F.lit("derived_from"))
    return graph.linked(edges, _HUB)


@query(
    """SELECT c_custkey AS id, c_name AS title, c_mktsegment || chr(10) || chr(10) || 'balance ' || c_custkey AS context,
CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE 'nation ' || c_nationkey END AS decision, c_mktsegment AS consequences, c_nationkey % 5 <> 0 AS valid FROM customer"""
)
def adr_sections(spark: SparkSession, d: str) -> DataFrame:
    """Decision records written as Markdown and read back; those without a decision are not valid."""
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    adrs = demo.read(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_custkey").alias("adr_number"),
        F.lit("accepted").alias("status"),
        F.col("c_name").alias("title"),
        F.concat("c_mktsegment", F.lit("\n\nbalance "), key).alias("context"),
        F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("nation "), nation)).alias("decision"),
        F.col("c_mktsegment").alias("consequences"),
    )
    # The files' names are slugs of titles; the number at their beginning is the record.
    files = records.adr_markdown(adrs).select(F.regexp_extract("path", r"^([0-9]+)-", 1).cast("bigint").alias("id"), "text")
    return records.parsed_adrs(files)


@query()
def question_sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred of the users' turns, the same ones on every run."""
    turns = demo.read(spark, d, "conversations").where("role = 'user'")
    return metrics.sampled(turns.select(F.concat_ws("-", "conv_id", "turn").alias("question_id")), 100)
