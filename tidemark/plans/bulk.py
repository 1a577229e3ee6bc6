"""Queries of pruned searches and joins, walks from many roots and aggregates that writes keep, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph, maintained, metric
from tidemark.plans import demo
from tidemark.plans.demo import CTE
from tidemark.plans.queries import _PAIRS, _six, query
from tidemark.session import kept, remove, shared_dir


@query(f"WITH {CTE}, s AS (SELECT emb.id, round(list_cosine_similarity(vector, q), 9) AS cosine FROM emb, qv) SELECT id, round(cosine, 6) AS cosine FROM s ORDER BY s.cosine DESC, id LIMIT 20")
def pruned_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest twenty by cells, with their triangle bounds."""
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    index = metric.VectorIndex.write(demo.embeddings(spark, d), folder, most=32)
    found, _ = index.nearest(demo.vector(spark, d), 20)
    out = kept(found.select("id", _six("cosine")))
    remove(spark, folder)
    return out


@query(f"WITH {CTE}, {_PAIRS} SELECT id_a, id_b, round(round(cosine, 9), 6) AS cosine FROM pr")
def metric_pairs(spark: SparkSession, d: str) -> DataFrame:
    return metric.near_pairs(demo.embeddings(spark, d), 0.35, most=32)[0].select("id_a", "id_b", _six("cosine"))


@query(
    f"""WITH {CTE}, e AS (SELECT source_id AS pos, target_id AS id, relation_type, 'outgoing' AS direction, 0 AS turn, id AS edge FROM rel UNION ALL SELECT target_id, source_id, relation_type, 'incoming', 1, id FROM rel),
l1 AS (SELECT pos AS root, id, min_by(relation_type, turn * 1000000000 + edge) AS relation_type, min_by(direction, turn * 1000000000 + edge) AS direction, 1 AS depth FROM e WHERE pos <> id AND pos IN (SELECT doc_id FROM documents) GROUP BY pos, id),
l2 AS (SELECT root, e.id, min_by(e.relation_type, turn * 1000000000 + edge) AS relation_type, min_by(e.direction, turn * 1000000000 + edge) AS direction, 2 AS depth FROM l1 JOIN e ON e.pos = l1.id
  WHERE e.id <> root AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.root = l1.root AND x.id = e.id) GROUP BY root, e.id)
SELECT * FROM l1 UNION ALL SELECT * FROM l2"""
)
def graph_walks(spark: SparkSession, d: str) -> DataFrame:
    """Two steps from every record at once."""
    folder = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    graph.store_steps(demo.relationships(spark, d), folder)
    out = graph.walks(spark.read.parquet(folder), demo.read(spark, d, "documents").select(F.col("doc_id").alias("root")))
    remove(spark, folder)  # every level is a checkpoint by now
    return out


@query(
    """WITH RECURSIVE w AS (SELECT doc_id AS start, doc_id AS id, 0 AS hop FROM documents UNION ALL SELECT w.start, d.doc_id // 2, hop + 1 FROM w JOIN documents d ON d.doc_id = w.id WHERE hop < 4 AND d.doc_id // 2 <> d.doc_id)
SELECT start, id, CAST(max(hop) OVER (PARTITION BY start) - hop AS INTEGER) AS position FROM w"""
)
def handoff_chains(spark: SparkSession, d: str) -> DataFrame:
    """The chain back from every record."""
    docs = demo.read(spark, d, "documents")
    back = docs.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 2).alias("next"))
    return graph.chains(back, docs.select(F.col("doc_id").alias("start")))


@query(
    f"""WITH {CTE}, m AS (SELECT * FROM emb WHERE id % 3 <> 0 OR id % 6 = 0), sp AS (SELECT cluster_id, generate_subscripts(vector, 1) AS pos, unnest(vector) AS v FROM m), c AS (SELECT cluster_id, count(*) AS member_count FROM m GROUP BY cluster_id)
SELECT cluster_id, member_count, CAST(pos - 1 AS INTEGER) AS pos, round(avg(v), 6) AS v FROM sp JOIN c USING (cluster_id) GROUP BY ALL"""
)
def maintained_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Centroids after every third member left and half of these came back, from the sums alone."""
    rows = demo.embeddings(spark, d).join(demo.labels(spark, d), "id")
    sums = kept(maintained.vector_sums(rows))
    sums = kept(maintained.with_change(sums, maintained.vector_sums(rows.limit(0), rows.where("id % 3 = 0"))))
    sums = maintained.with_change(sums, maintained.vector_sums(rows.where("id % 6 = 0")))
    return maintained.centroids(sums).select("cluster_id", "member_count", F.posexplode("centroid").alias("pos", "v")).select("cluster_id", "member_count", "pos", _six("v"))


@query(
    f"""WITH {CTE}, a AS (SELECT project_id, memory_type, pinned OR id % 4 = 1 AS pinned, global, relevance_score FROM mem WHERE id % 5 <> 2)
SELECT project_id, count(*) AS memory_count, count(*) FILTER (pinned) AS pinned_count, count(*) FILTER (global) AS global_count, count(*) FILTER (memory_type = 'handoff') AS handoff_count, 0::BIGINT AS adr_count, round(avg(relevance_score), 6) AS avg_relevance FROM a GROUP BY project_id"""
)
def maintained_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of all projects after every fourth record was pinned and every fifth deleted."""
    rows = demo.memories(spark, d)
    pinned = rows.where("id % 4 = 1")
    now = rows.withColumn("pinned", F.col("pinned") | (F.col("id") % 4 == 1))
    sums = kept(maintained.record_sums(rows))
    sums = kept(maintained.with_record_change(sums, maintained.record_sums(now.where("id % 4 = 1"), pinned)))
    sums = maintained.with_record_change(sums, maintained.record_sums(now.limit(0), now.where("id % 5 = 2")))
    return maintained.project_stats(sums).withColumn("avg_relevance", F.round("avg_relevance", 6))
