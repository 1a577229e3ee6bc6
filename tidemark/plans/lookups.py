"""Queries of lookups, indexes and clusters, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import curation, lookup, retrieval, scope
from tidemark.plans import demo
from tidemark.plans.demo import BM25, CTE, NOW, PROJECT, QUERY, TERMINAL
from tidemark.plans.queries import _HYBRID, _STOP, GREEDY, query


def _six(column: str):
    return F.round(column, 6).alias(column)


@query(f"WITH {CTE} SELECT id, project_id, memory_type, tags FROM mem WHERE id = 17")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_id(demo.memories(spark, d), 17).select("id", "project_id", "memory_type", "tags")


@query(f"WITH {CTE} SELECT id, project_id, importance FROM mem WHERE id IN (SELECT vec_id // 2 FROM embeddings)")
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    ids = demo.embeddings(spark, d).select(F.floor(F.col("id") / 2).alias("id"))
    return lookup.by_ids(demo.memories(spark, d), ids).select("id", "project_id", "importance")


@query(f"WITH {CTE}, v AS (SELECT generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS v FROM emb WHERE id = 7) SELECT CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM v")
def single_embedding(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_id(demo.embeddings(spark, d), 7).select(F.posexplode("vector").alias("pos", "v")).select("pos", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(
    f"""WITH {CTE}, k AS (SELECT id FROM dead) SELECT source_id AS id, 'outgoing' AS direction, target_id AS other, relation_type, id AS edge FROM rel WHERE source_id IN (FROM k)
UNION ALL SELECT target_id, 'incoming', source_id, relation_type, id FROM rel WHERE target_id IN (FROM k)"""
)
def edge_fetch(spark: SparkSession, d: str) -> DataFrame:
    return lookup.edges_of(demo.relationships(spark, d), demo.dead(spark, d))


@query("SELECT c_custkey AS memory_id, c_name AS title FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def adr_lookup(spark: SparkSession, d: str) -> DataFrame:
    adrs = demo.read(spark, d, "customer").select(F.col("c_custkey").alias("memory_id"), F.col("c_mktsegment").alias("project_id"), F.col("c_nationkey").alias("adr_number"), F.col("c_name").alias("title"))
    return lookup.adr_by_number(adrs, "BUILDING", 7).select("memory_id", "title")


@query(
    f"""WITH {CTE}, o AS (SELECT * FROM mem WHERE project_id = '{PROJECT}'), g AS (SELECT cluster_id, memory_type, count(*) AS n FROM emb JOIN o USING (id) GROUP BY ALL)
SELECT 'total' AS metric, count(*) AS value FROM o UNION ALL SELECT 'never_accessed', count(*) FROM o WHERE access_count = 0 AND created_at < {NOW} - 30 * 86400 UNION ALL SELECT 'faded', count(*) FROM o WHERE relevance_score < 2e-1
UNION ALL SELECT 'both', count(*) FROM o WHERE relevance_score < 2e-1 AND access_count = 0 AND created_at < {NOW} - 30 * 86400 UNION ALL SELECT 'duplicate_pairs', coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM g"""
)
def health(spark: SparkSession, d: str) -> DataFrame:
    return lookup.health(demo.memories(spark, d), demo.labels(spark, d), PROJECT, NOW)


@query(f"WITH {CTE}, {BM25} SELECT id, round(score / (SELECT max(score) FROM bm), 6) AS share FROM bm")
def keyword_shares(spark: SparkSession, d: str) -> DataFrame:
    return lookup.keyword_shares(demo.index(spark, d).bm25(QUERY)).select("id", _six("share"))


@query(
    f"""WITH {CTE}, b AS (SELECT id, tok FROM (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS tok FROM mem)),
p AS (SELECT id, len(tok) AS len, len(list_filter(range(1, len(tok)), lambda i: tok[i] = 'of' AND tok[i + 1] = 'the'))::DOUBLE AS tf FROM b), s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (tf > 0) AS df FROM p)
SELECT id, round(greatest(ln((n - df + 5e-1) / (df + 5e-1)), 1e-6) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * len / mean)), 6) AS score FROM p, s WHERE tf > 0"""
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return demo.index(spark, d).bm25("of-the").select("id", _six("score"))


@query(
    """SELECT s_suppkey AS id, CAST(unnest([0, 1, 100, 255]) AS INTEGER) AS pos, round(unnest([x[1], x[2], x[101], x[256]]) / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS v
FROM (SELECT s_suppkey, list_transform(range(0, 256), lambda i: s_suppkey * cos(i + 1e0) + sin(1e-1 * i)) AS x FROM supplier)"""
)
def synthetic_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = demo.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), lookup.synthetic_vector(F.col("s_suppkey")).alias("vector"))
    return v.select("id", F.posexplode("vector").alias("pos", "v")).where("pos in (0, 1, 100, 255)").select("id", "pos", _six("v"))


@query(
    """WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'turn-' || conv_id || '-' || turn AS id, 'p' AS project_id, 'fact' AS memory_type, 'USER: ' || text || chr(10) || 'ASSISTANT: ' || CASE WHEN nr = 'assistant' AND trim(nt) <> '' THEN nt ELSE '<none>' END AS content, ['session:' || conv_id] AS tags
FROM n WHERE role = 'user' AND trim(text) <> ''"""
)
def turn_records(spark: SparkSession, d: str) -> DataFrame:
    return lookup.turn_records(metrics.turn_pairs(demo.read(spark, d, "conversations")), "p")


@query(
    f"""WITH {CTE}, w AS (SELECT cluster_id, lower(regexp_replace(unnest(regexp_split_to_array(coalesce(content, ''), '\\s+')), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS word FROM mem JOIN emb USING (id)),
c AS (SELECT cluster_id, word, count(*) AS n FROM w WHERE strlen(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY ALL) SELECT cluster_id, list(word ORDER BY n DESC, word)[1:3] AS words FROM c GROUP BY cluster_id"""
)
def cluster_keywords(spark: SparkSession, d: str) -> DataFrame:
    return lookup.cluster_keywords(demo.labels(spark, d), demo.memories(spark, d))


@query()
def cluster_summaries(spark: SparkSession, d: str) -> DataFrame:
    return lookup.cluster_summaries(demo.labels(spark, d), demo.memories(spark, d))


@query(
    f"""WITH RECURSIVE {CTE}, own AS (SELECT emb.id, vector, cluster_id, memory_type FROM emb JOIN mem USING (id) WHERE memory_type <> 'handoff'),
pr AS (SELECT a.id AS id_a, b.id AS id_b FROM own a JOIN own b ON a.id < b.id AND a.cluster_id = b.cluster_id AND a.memory_type = b.memory_type WHERE list_cosine_similarity(a.vector, b.vector) >= 25e-2), {GREEDY},
k AS (SELECT leader, min_by(dup.id, (CASE WHEN global THEN 0 ELSE 2 END + CASE WHEN dup.id = leader THEN 0 ELSE 1 END) * 1000000000::BIGINT + dup.id) AS keeper FROM dup JOIN mem ON mem.id = dup.id GROUP BY leader)
SELECT id, keeper FROM dup JOIN k USING (leader)"""
)
def cluster_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of these tables are no nearer than 0.52, so that the threshold is one that some pairs of a cluster and type reach."""
    return lookup.cluster_duplicates(demo.labels(spark, d), demo.memories(spark, d), demo.embeddings(spark, d), 0.25)


@query(
    f"""WITH {CTE}, {BM25}, word AS (SELECT bm.id, row_number() OVER (ORDER BY bm.score DESC, bm.id) - 1 AS rank FROM bm JOIN mem USING (id) WHERE project_id = '{PROJECT}' ORDER BY bm.score DESC, bm.id LIMIT 50)
SELECT id, round((1e0 / (61 + rank) + least(15e-2, 5e-2 * len(list_filter(['the', 'nation', 'with', 'house'], lambda w: len(list_filter(tags, lambda t: contains(lower(t), w) OR contains(w, lower(t)))) > 0)))) * relevance_score, 9) AS score
FROM word JOIN mem USING (id) WHERE relevance_score >= 1e-1 ORDER BY score DESC, id LIMIT 10"""
)
def keyword_query(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.query(demo.memories(spark, d), demo.embeddings(spark, d), QUERY, demo.vector(spark, d), PROJECT, mode="bm25", index=demo.index(spark, d), digits=9)
    return out.select("id", F.round("score", 9).alias("score"))


@query(
    f"""WITH {CTE} SELECT id, round((list_cosine_similarity(vector, q) + least(15e-2, 5e-2 * len(list_filter(['the', 'nation', 'with', 'house'], lambda w: len(list_filter(tags, lambda t: contains(lower(t), w) OR contains(w, lower(t)))) > 0)))) * relevance_score, 6) AS score
FROM emb JOIN mem USING (id), qv WHERE (project_id = '{PROJECT}' OR global) AND relevance_score >= 1e-1 ORDER BY score DESC, id LIMIT 10"""
)
def vector_query(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.query(demo.memories(spark, d), demo.embeddings(spark, d), QUERY, demo.vector(spark, d), PROJECT, mode="vector", digits=6)


@query(
    f"""WITH RECURSIVE {CTE}, {BM25}, {_HYBRID}, {TERMINAL},
rk AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM sc WHERE score IS NOT NULL),
res AS (SELECT coalesce(successor, rk.id) AS id, successor IS NOT NULL AS moved, rank, score FROM rk LEFT JOIN term ON term.id = rk.id
  WHERE rk.id NOT IN (SELECT id FROM dead) AND coalesce(successor, -1) NOT IN (SELECT id FROM dead)),
fit AS (SELECT res.* FROM res JOIN mem USING (id) WHERE NOT moved OR memory_type IN ('fact', 'decision'))
SELECT id, min(rank) AS rank, round(min_by(score, rank), 9) AS score FROM fit GROUP BY id"""
)
def context_curation(spark: SparkSession, d: str) -> DataFrame:
    """Every hit of the hybrid ranking resolved as a context does it: a successor has to be of the wanted types itself."""
    memories = demo.memories(spark, d)
    hits = retrieval.scored(memories, demo.embeddings(spark, d), QUERY, demo.vector(spark, d), PROJECT, index=demo.index(spark, d))
    out = curation.context_curated(retrieval.ranking.ranked(hits, "score", "rank"), memories, demo.dead(spark, d), curation.terminals(curation.supersessions(demo.relationships(spark, d))), ["fact", "decision"])
    return out.select("id", "rank", F.round("score", 9).alias("score"))


@query(f"WITH {CTE} SELECT id, relevance_score AS score FROM mem WHERE project_id = '{PROJECT}' AND relevance_score >= 1e-1 ORDER BY relevance_score DESC, id LIMIT 10")
def textless_query(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.query(demo.memories(spark, d), demo.embeddings(spark, d), " ", [], PROJECT)


@query(f"WITH {CTE} SELECT id, round(cosine, 6) AS cosine FROM (SELECT id, list_cosine_similarity(vector, q) AS cosine FROM emb JOIN mem USING (id), qv WHERE project_id = '{PROJECT}' ORDER BY cosine DESC, id LIMIT 5) WHERE cosine >= 3e-1")
def recall_prompt(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.recalled(demo.memories(spark, d), demo.embeddings(spark, d), demo.vector(spark, d), PROJECT).select("id", _six("cosine"))


@query(f"WITH {CTE}, t AS (SELECT * FROM mem WHERE project_id = '{PROJECT}' AND branch IS NULL) SELECT id, branch FROM t")
def no_branch_scan(spark: SparkSession, d: str) -> DataFrame:
    return demo.memories(spark, d).where(scope.in_project(PROJECT) & scope.on_branch(scope.GLOBAL_ONLY)).select("id", "branch")
