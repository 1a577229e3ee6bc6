"""Queries of contexts in all their modes and gates, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import curation, retrieval, scope, similarity
from tidemark.plans import demo
from tidemark.plans.demo import BM25, CTE, ELAPSED, PROJECT, QUERY, TERMINAL
from tidemark.plans.queries import _six, query

_SEEN = f"""seen AS (SELECT * FROM mem WHERE project_id = '{PROJECT}' OR global),
cand AS (SELECT id FROM (SELECT id FROM seen ORDER BY last_accessed_at DESC, id LIMIT 500) UNION SELECT id FROM seen WHERE pinned),
near AS (SELECT id, list_cosine_similarity(vector, q) AS cosine FROM emb JOIN cand USING (id), qv)"""


@query(
    f"""WITH {CTE}, {BM25}, {ELAPSED}, {_SEEN},
rk AS (SELECT near.id, 1e0 / (60 + row_number() OVER (ORDER BY bm.score DESC, near.id)) AS base FROM near JOIN bm ON bm.id = near.id),
sc AS (SELECT id, relevance_score, base * (6e-1 + 2e-1 * exp(-2e-2 * elapsed) + 2e-1 * importance) AS score FROM rk JOIN mem USING (id) JOIN el USING (id)), top AS (SELECT * FROM sc ORDER BY score DESC, id LIMIT 20)
SELECT id, round(score, 9) AS score FROM top WHERE relevance_score >= 2e-1 ORDER BY top.score DESC, id LIMIT 10"""
)
def context_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.context(demo.memories(spark, d), demo.embeddings(spark, d), QUERY, demo.vector(spark, d), PROJECT, mode="bm25", min_score=0.2, limit=10, index=demo.index(spark, d))
    return out.select("id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {CTE}, {ELAPSED}, {_SEEN}, sc AS (SELECT id, 6e-1 * cosine + 2e-1 * exp(-2e-2 * elapsed) + 2e-1 * importance AS score FROM near JOIN mem USING (id) JOIN el USING (id) WHERE cosine >= 1e-1)
SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, id LIMIT 10"""
)
def context_by_vector(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.context(demo.memories(spark, d), demo.embeddings(spark, d), QUERY, demo.vector(spark, d), PROJECT, mode="vector", min_score=0.1, limit=10).select("id", _six("score"))


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    memories, vectors = demo.memories(spark, d), demo.embeddings(spark, d)
    members = demo.labels(spark, d).join(memories.where(scope.in_project(PROJECT, True)).select("id"), "id", "left_semi")
    return memories, vectors, similarity.centroids(members, vectors), members


_CENTRES = f"""sp AS (SELECT cluster_id, generate_subscripts(vector, 1) AS p, unnest(vector) AS v FROM emb JOIN mem USING (id) WHERE project_id = '{PROJECT}' OR global),
mean AS (SELECT cluster_id, p, avg(v) AS v FROM sp GROUP BY ALL), cen AS (SELECT cluster_id, list(v ORDER BY p) AS c FROM mean GROUP BY cluster_id),
best AS (SELECT cluster_id, row_number() OVER (ORDER BY near DESC, cluster_id) AS cr, count(*) OVER () AS hit FROM (SELECT cluster_id, list_cosine_similarity(c, q) AS near FROM cen, qv) WHERE near >= 1e-1 ORDER BY near DESC, cluster_id LIMIT 10),
ro AS (SELECT emb.id, emb.cluster_id, cr, hit, relevance_score, list_cosine_similarity(vector, q) AS s, bm.score AS w FROM emb JOIN mem USING (id) JOIN best ON best.cluster_id = emb.cluster_id LEFT JOIN bm ON bm.id = emb.id, qv WHERE project_id = '{PROJECT}' OR global)"""


@query(
    f"""WITH {CTE}, {BM25}, {_CENTRES},
fus AS (SELECT *, 1e0 / (60 + row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, id)) + CASE WHEN w IS NULL THEN 0 ELSE 1e0 / (60 + row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC NULLS LAST, id)) END AS base FROM ro),
own AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY base DESC, id) AS r FROM fus WHERE relevance_score >= 1e-1)
SELECT id, cluster_id, round(base, 9) AS score FROM own WHERE r <= greatest(1, 10 // hit) + 1 ORDER BY cr, r LIMIT 10"""
)
def context_clusters_fused(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.context_hierarchical(*_clusters(spark, d), QUERY, demo.vector(spark, d), PROJECT, mode="hybrid", min_score=0.1, limit=10, index=demo.index(spark, d))
    return out.select("id", "cluster_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {CTE}, {BM25}, {_CENTRES}, word AS (SELECT *, 1e0 / (60 + row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, id)) AS base FROM ro WHERE w IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY base DESC, id) AS r FROM word WHERE relevance_score >= 1e-1)
SELECT id, cluster_id, round(base, 9) AS score FROM own WHERE r <= greatest(1, 10 // hit) + 1 ORDER BY cr, r LIMIT 10"""
)
def context_clusters_by_keyword(spark: SparkSession, d: str) -> DataFrame:
    """A cluster without a record that has a word of the query gives none: there is no way back to vectors."""
    out = retrieval.context_hierarchical(*_clusters(spark, d), QUERY, demo.vector(spark, d), PROJECT, mode="bm25", min_score=0.1, limit=10, index=demo.index(spark, d))
    return out.select("id", "cluster_id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {CTE}, {ELAPSED}, {_SEEN}, sc AS (SELECT id, 6e-1 * cosine + 2e-1 * exp(-2e-2 * elapsed) + 2e-1 * importance AS score FROM near JOIN mem USING (id) JOIN el USING (id) WHERE cosine >= 1e-1)
SELECT id, NULL::INTEGER AS cluster_id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, id LIMIT 10"""
)
def context_without_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A project without clusters gets the flat context, though it asks for the hierarchical one."""
    memories, vectors, means, members = _clusters(spark, d)
    return retrieval.context_hierarchical(memories, vectors, means, members.limit(0), QUERY, demo.vector(spark, d), PROJECT, mode="vector", min_score=0.1, limit=10).select("id", "cluster_id", _six("score"))


@query(
    f"""WITH RECURSIVE {CTE}, {TERMINAL}, near AS (SELECT emb.id, list_cosine_similarity(vector, q) AS score FROM emb JOIN mem USING (id), qv WHERE project_id = '{PROJECT}' OR global ORDER BY score DESC, emb.id LIMIT 20),
rk AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM near WHERE score >= 1e-1),
res AS (SELECT coalesce(successor, rk.id) AS id, CASE WHEN successor IS NOT NULL THEN rk.id END AS via, rank, score FROM rk LEFT JOIN term ON term.id = rk.id WHERE rk.id NOT IN (SELECT id FROM dead) AND coalesce(successor, -1) NOT IN (SELECT id FROM dead)),
best AS (SELECT id, min(rank) AS rank, arg_min(score, rank) AS score, arg_min_null(via, rank) AS via_id FROM res WHERE id IN (SELECT id FROM mem) GROUP BY id)
SELECT id, round(score, 6) AS score, via_id FROM best ORDER BY rank, id LIMIT 10"""
)
def context_plain_curated(spark: SparkSession, d: str) -> DataFrame:
    successors = curation.terminals(curation.supersessions(demo.relationships(spark, d)))
    out = retrieval.context_plain(demo.memories(spark, d), demo.embeddings(spark, d), demo.vector(spark, d), PROJECT, 0.1, 10, demo.dead(spark, d), successors)
    return out.select("id", _six("score"), "via_id")
