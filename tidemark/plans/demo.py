"""A store made from the driver's tables: documents as records, events as activity, conversations as chat."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyword_index import Index
from tidemark.session import shared_dir

#: The moment that every query takes for now.
NOW = 1_750_000_000
QUERY = "the nation with house"
PROJECT = "en"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    created = (F.lit(NOW) - (d % 90) * 86400).cast("bigint")
    return read(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.col("lang").alias("project_id"),
        F.element_at(F.array(*map(F.lit, ("fact", "decision", "pattern", "debug", "handoff"))), (d % 5 + 1).cast("int")).alias("memory_type"),
        F.col("text").alias("content"),
        F.when(d % 10 == 3, F.array(F.col("source"), F.lit("hook"))).otherwise(F.array("source")).alias("tags"),
        ((d % 10) / F.lit(10.0)).alias("importance"),
        ((d * 7 % 100) / F.lit(100.0)).alias("relevance_score"),
        (d % 6).alias("access_count"),
        created.alias("created_at"),
        (created + d % 1000).alias("updated_at"),
        (created + d % 50 * 3600).alias("last_accessed_at"),
        F.when(d % 3 == 1, F.lit("main")).when(d % 3 == 2, F.lit("dev")).alias("branch"),
        (d % 17 == 0).alias("pinned"),
        (d % 23 == 0).alias("global"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each block of seven, records 1, 2 and 3 supersede the one before; every record relates to the one of half its id."""
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select("doc_id")
    newer = docs.where(d % 7 < 3).select((d * 2).alias("id"), (d + 1).alias("source_id"), d.alias("target_id"), F.lit("supersedes").alias("relation_type"), (F.lit(NOW) - d).cast("bigint").alias("created_at"))
    related = docs.where(d > 1).select((d * 2 + 1).alias("id"), d.alias("source_id"), F.floor(d / 2).alias("target_id"), F.lit("relates_to").alias("relation_type"), (F.lit(NOW) - d).cast("bigint").alias("created_at"))
    return newer.unionByName(related)


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("doc_id % 19 = 5").select(F.col("doc_id").alias("id"))


def vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query's vector: that of record 0."""
    row = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0]


_indexes: dict[tuple, str] = {}


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """When a table was last written, its files and their bytes: another state is another table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = files.getContentSummary(at)
    return files.getFileStatus(at).getModificationTime(), size.getFileCount(), size.getLength()


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The keyword index of the records: written once for a session and table, as a store's writes would keep it, then read."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _indexes:
        folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        Index.of(memories(spark, sf_dir)).save(folder)
        _indexes[key] = folder
    return Index.load(spark, _indexes[key])


#: The same tables as SQL.
CTE = f"""
mem AS (SELECT doc_id AS id, lang AS project_id, (['fact','decision','pattern','debug','handoff'])[CAST(doc_id % 5 AS INTEGER) + 1] AS memory_type, text AS content,
  CASE WHEN doc_id % 10 = 3 THEN [source, 'hook'] ELSE [source] END AS tags, CAST(doc_id % 10 AS DOUBLE) / 10e0 AS importance, CAST(doc_id * 7 % 100 AS DOUBLE) / 100e0 AS relevance_score,
  doc_id % 6 AS access_count, {NOW} - (doc_id % 90) * 86400 AS created_at, {NOW} - (doc_id % 90) * 86400 + doc_id % 1000 AS updated_at, {NOW} - (doc_id % 90) * 86400 + doc_id % 50 * 3600 AS last_accessed_at,
  CASE doc_id % 3 WHEN 1 THEN 'main' WHEN 2 THEN 'dev' END AS branch, doc_id % 17 = 0 AS pinned, doc_id % 23 = 0 AS global FROM documents),
emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS cluster_id FROM embeddings),
qv AS (SELECT vector AS q FROM emb WHERE id = 0),
rel AS (SELECT doc_id * 2 AS id, doc_id + 1 AS source_id, doc_id AS target_id, 'supersedes' AS relation_type, {NOW} - doc_id AS created_at FROM documents WHERE doc_id % 7 < 3
  UNION ALL SELECT doc_id * 2 + 1, doc_id, doc_id // 2, 'relates_to', {NOW} - doc_id FROM documents WHERE doc_id > 1),
dead AS (SELECT doc_id AS id FROM documents WHERE doc_id % 19 = 5)"""

#: BM25 of the query over all records: bm(id, score).
BM25 = """
tok AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM mem),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)::DOUBLE) AS mean FROM tok),
qt AS (SELECT unnest(['the', 'nation', 'with', 'house']) AS w),
tf AS (SELECT id, len(t)::DOUBLE AS len, w, len(list_filter(t, lambda x: x = w))::DOUBLE AS tf FROM tok, qt),
df AS (SELECT w, count(*) FILTER (tf > 0)::DOUBLE AS df FROM tf GROUP BY w),
idf AS (SELECT w, CASE WHEN ln((n - df + 5e-1) / (df + 5e-1)) > 0 THEN greatest(ln((n - df + 5e-1) / (df + 5e-1)), 1e-6) ELSE 1e-6 END AS idf FROM df, st),
bm AS (SELECT id, sum(idf * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * len / mean))) AS score FROM tf JOIN idf USING (w), st GROUP BY id HAVING sum(tf) > 0)"""

#: Elapsed store-days: el(id, elapsed).
ELAPSED = """
days AS (SELECT DISTINCT project_id, created_at // 86400 AS day FROM mem WHERE NOT list_contains(tags, 'hook')),
el AS (SELECT id, (SELECT count(*) FROM days WHERE days.project_id = mem.project_id AND days.day > mem.last_accessed_at // 86400) AS elapsed FROM mem)"""

#: Ends of supersession chains: term(id, successor).
TERMINAL = """
direct AS (SELECT target_id AS id, max_by(source_id, created_at) AS successor FROM rel WHERE relation_type = 'supersedes' GROUP BY target_id),
walk AS (SELECT id, successor AS pos, 1 AS hop FROM direct UNION ALL SELECT walk.id, direct.successor, hop + 1 FROM walk JOIN direct ON direct.id = walk.pos WHERE hop < 6),
term AS (SELECT id, max_by(pos, hop) AS successor FROM walk GROUP BY id)"""
