"""Ranked retrieval: queries, contexts, and their command-line variants. All are pure; `used` gives the access log of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import clock, curation, ranking, scope
from tidemark.operators.keyword_index import Index


def _keywords(memories: DataFrame, text: str, index: Index | None) -> DataFrame:
    """(id, score) of the keyword hits in all records: from the index, or from the texts if there is none."""
    return ranking.bm25(memories, text) if index is None else index.bm25(text)


def _similar(memories: DataFrame, embeddings: DataFrame, vector: Sequence[float]) -> DataFrame:
    """(id, cosine) of the records that have a vector. embeddings: (id, vector)."""
    return embeddings.join(memories.select("id"), "id", "left_semi").select("id", ranking.cosine_to(vector)("vector").alias("cosine"))


def _page(rows: DataFrame, memories: DataFrame, dead, successors, limit: int, offset: int) -> DataFrame:
    """A curated page of rows (id, score), best first; curation sees only as many rows as could reach the page."""
    if dead is None:
        return rows.orderBy(F.desc("score"), "id").offset(offset).limit(limit)
    ordered = ranking.ranked(rows.select("id", "score"), "score", "rank")
    return curation.curated(ordered, memories, dead, successors).orderBy("rank", "id").offset(offset).limit(limit).select("id", "score", "via_id")


def scored(memories: DataFrame, embeddings: DataFrame, text: str, vector: Sequence[float], project: str, mode: str = "hybrid", branch: Column | None = None, types=None, tags=None, min_relevance: float = 0.1, hits: int = 50, index: Index | None = None) -> DataFrame:
    """(id, score) of every record that a query finds: (base + tag boost) x decay value; the base is cosine, a pseudo score of the keyword rank, or both fused.

    Vectors rank over all records that the project sees; keywords over the project's own on the branch, statistics over the whole store. Only the best `hits` of them take part.
    """
    branch = F.lit(True) if branch is None else branch
    lists, base = {}, None
    if mode in ("vector", "hybrid"):
        near = _similar(memories.where(scope.in_project(project, with_global=True)), embeddings, vector)
        lists["v"] = near if mode == "vector" else ranking.ranked(near, "cosine", "rank").select("id", "rank")
    if mode in ("bm25", "hybrid"):
        words = _keywords(memories, text, index).join(memories.where(scope.in_project(project) & branch).select("id"), "id", "left_semi")
        top = words.orderBy(F.desc("score"), "id").limit(hits)  # at most so many rows are numbered in one task
        lists["k"] = top.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).cast("bigint").alias("rank"))
    if mode == "vector":
        base = lists["v"].select("id", F.col("cosine").alias("base"))
    elif mode == "bm25":
        base = lists["k"].select("id", (1.0 / (ranking.RRF_K + F.col("rank") + 1)).alias("base"))
    else:
        base = ranking.fused([lists["v"], lists["k"]]).select("id", F.col("score").alias("base"))
    rows = base.join(memories, "id").where(branch & scope.matching(types, tags, min_relevance))
    score = (F.col("base") + ranking.tag_boost(ranking.query_words(text))) * F.col("relevance_score")
    return rows.select("id", score.alias("score"))


def query(memories: DataFrame, embeddings: DataFrame, text: str, vector: Sequence[float], project: str, mode: str = "hybrid", branch: Column | None = None, types=None, tags=None, min_relevance: float = 0.1, limit: int = 10, offset: int = 0, dead: DataFrame | None = None, successors: DataFrame | None = None, index: Index | None = None, digits: int | None = None) -> DataFrame:
    """(id, score): a page of `scored`, of the best 5 x limit keyword hits. Without text, records come by decay value. digits: what scores are rounded to before they are ranked, so that equal ones go by id."""
    if not text.strip():
        return scope.filtered(memories, project, branch, types, tags, min_relevance, limit, offset).select("id", F.col("relevance_score").alias("score"))
    rows = scored(memories, embeddings, text, vector, project, mode, branch, types, tags, min_relevance, 5 * limit, index)
    if digits is not None:
        rows = rows.withColumn("score", ranking.rounded("score", digits))
    return _page(rows, memories, dead, successors, limit, offset)


def query_linear(memories: DataFrame, embeddings: DataFrame, text: str, vector: Sequence[float], project: str, branch: Column | None = None, min_score: float = 0.3, limit: int = 10, index: Index | None = None) -> DataFrame:
    """The command line's query: (0.7 x cosine + 0.3 x keyword score over the best one) x decay value, at least min_score."""
    words = _keywords(memories, text, index).join(memories.where(scope.in_project(project)).select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(5 * limit)
    words = words.select("id", (F.col("score") / F.max("score").over(Window.partitionBy())).alias("word"))  # at most 5 x limit rows
    near = _similar(memories.where(scope.in_project(project, with_global=True)), embeddings, vector)
    both = near.join(words, "id", "full_outer").join(memories, "id")
    if branch is not None:
        both = both.where(branch)
    score = (0.7 * F.coalesce("cosine", F.lit(0.0)) + 0.3 * F.coalesce("word", F.lit(0.0))) * F.col("relevance_score")
    return both.select("id", score.alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(limit)


def _context_scores(rows: DataFrame, text: str, memories: DataFrame, mode: str, within: list[str], index: Index | None = None) -> DataFrame:
    """rows (id, cosine, ...) with `base`, by the mode: cosine, the keyword pseudo score, or both fused; ranks are within the groups of columns `within`, or over all rows if it is empty."""
    if mode == "vector":
        return rows.withColumn("base", F.col("cosine"))
    words = _keywords(memories, text, index).withColumnRenamed("score", "word")
    rows = rows.join(words, "id", "left")
    if not within:  # over all rows, in ranges of the score
        word = ranking.ranked(rows.where("word is not null").select("id", "word"), "word", "place").select("id", F.col("place").alias("word_place"))
        rows = rows.join(word, "id", "left")
        word = 1.0 / (ranking.RRF_K + 1 + F.col("word_place"))
        if mode == "bm25":
            return rows.withColumn("base", word).where("base is not null").drop("word_place")
        near = ranking.ranked(rows.select("id", "cosine"), "cosine", "near_place").select("id", "near_place")
        base = 1.0 / (ranking.RRF_K + 1 + F.col("near_place")) + F.coalesce(word, F.lit(0.0))
        return rows.join(near, "id").withColumn("base", base).drop("word_place", "near_place")
    by_word = Window.partitionBy(*within).orderBy(F.desc_nulls_last("word"), "id")
    word = F.when(F.col("word").isNotNull(), 1.0 / (ranking.RRF_K + F.row_number().over(by_word)))
    if mode == "bm25":
        return rows.withColumn("base", word).where("base is not null")
    near = 1.0 / (ranking.RRF_K + F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("cosine"), "id")))
    return rows.withColumn("base", near + F.coalesce(word, F.lit(0.0)))


def context(memories: DataFrame, embeddings: DataFrame, text: str, vector: Sequence[float], project: str, mode: str = "hybrid", branch: Column | None = None, types=None, min_score: float = 0.3, limit: int = 5, cap: int = 500, dead: DataFrame | None = None, successors: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """(id, score) of what bears on a text, among at most cap recent records and the pinned ones.

    The best 2 x limit by score are taken first; branch, types and the gate (cosine, or the decay value for the modes with keywords) come after.
    """
    candidates = scope.prefiltered(memories, project, cap)
    near = _similar(candidates, embeddings, vector)
    if mode == "vector":
        near = near.where(F.col("cosine") >= min_score)
    based = _context_scores(near, text, memories, mode, [], index)
    timed = clock.elapsed_days(candidates, clock.store_days(memories))
    rows = timed.join(based.select("id", "cosine", "base"), "id")
    blend = clock.additive if mode == "vector" else clock.multiplicative
    rows = rows.withColumn("score", blend(F.col("base"), F.col("elapsed"), F.col("importance"))).orderBy(F.desc("score"), "id").limit(2 * limit)
    gate = F.col("cosine") if mode == "vector" else F.col("relevance_score")
    rows = rows.where((F.lit(True) if branch is None else branch) & scope.matching(types) & (gate >= min_score))
    if dead is None:
        return _page(rows.select("id", "score"), memories, None, None, limit, 0)
    ordered = ranking.ranked(rows.select("id", "score"), "score", "rank")
    return curation.context_curated(ordered, memories, dead, successors, types).orderBy("rank", "id").limit(limit).select("id", "score", "via_id")


def context_by_cluster(memories: DataFrame, embeddings: DataFrame, centroids: DataFrame, members: DataFrame, text: str, vector: Sequence[float], project: str, mode: str = "vector", branch: Column | None = None, types=None, min_score: float = 0.1, limit: int = 10, dead: DataFrame | None = None, successors: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """(id, cluster_id, score): the best clusters first, and in each at most one more than its share of the limit.

    centroids: (cluster_id, centroid); members: (cluster_id, id). Superseded and dead records go before members are counted; a successor stands in for what it supersedes.
    """
    best = centroids.select("cluster_id", ranking.cosine_to(vector)("centroid").alias("near")).where(F.col("near") >= min_score).orderBy(F.desc("near"), "cluster_id").limit(limit)
    best = best.select("cluster_id", F.row_number().over(Window.orderBy(F.desc("near"), "cluster_id")).alias("cluster_rank"), F.count("*").over(Window.partitionBy()).alias("hit"))  # at most limit rows
    seen = memories.where(scope.in_project(project, with_global=True))
    near = _similar(seen, embeddings, vector).join(members, "id").join(F.broadcast(best), "cluster_id")
    gate = F.col("cosine") if mode == "vector" else F.col("relevance_score")
    rows = _context_scores(near, text, memories, mode, ["cluster_id"], index).join(memories, "id").where((F.lit(True) if branch is None else branch) & scope.matching(types) & (gate >= min_score))
    if dead is not None:
        gone = dead.select("id").distinct()
        rows = rows.join(gone, "id", "left_anti").join(successors, "id", "left").join(gone.select(F.col("id").alias("successor")), "successor", "left_anti")
        rows = rows.withColumn("id", F.coalesce("successor", "id")).groupBy("id").agg(F.min_by(F.struct("cluster_id", "cluster_rank", "hit", "base"), F.struct("cluster_rank", -F.col("base"))).alias("r")).select("id", "r.*")
    own = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("base"), "id"))
    rows = rows.withColumn("own", own).where(F.col("own") <= F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("hit"))) + 1)
    return rows.orderBy("cluster_rank", "own").limit(limit).select("id", "cluster_id", F.col("base").alias("score"))


def context_hierarchical(memories: DataFrame, embeddings: DataFrame, centroids: DataFrame, members: DataFrame, text: str, vector: Sequence[float], project: str, least_records: int = 10, **options) -> DataFrame:
    """(id, cluster_id, score): `context_by_cluster` if the project has a cluster and at least `least_records` records; else `context`, without clusters. options are of both."""
    own = memories.where(scope.in_project(project)).select("id")
    clustered = members.join(own, "id", "left_semi").join(centroids.where("centroid is not null").select("cluster_id"), "cluster_id", "left_semi")
    if own.limit(least_records).count() == least_records and not clustered.isEmpty():
        return context_by_cluster(memories, embeddings, centroids, members, text, vector, project, **options)
    flat = context(memories, embeddings, text, vector, project, **options)
    return flat.select("id", F.lit(None).cast(centroids.schema["cluster_id"].dataType).alias("cluster_id"), "score")


def context_plain(memories: DataFrame, embeddings: DataFrame, vector: Sequence[float], project: str, min_score: float = 0.3, limit: int = 5, dead: DataFrame | None = None, successors: DataFrame | None = None) -> DataFrame:
    """The command line's context: cosine alone over all that the project sees, the best 2 x limit, then the gate; with dead and successors, then curation (and via_id)."""
    near = _similar(memories.where(scope.in_project(project, with_global=True)), embeddings, vector)
    rows = near.select("id", F.col("cosine").alias("score")).orderBy(F.desc("score"), "id").limit(2 * limit).where(F.col("score") >= min_score)
    if dead is None:
        return rows.orderBy(F.desc("score"), "id").limit(limit)
    found = curation.context_curated(ranking.ranked(rows, "score", "rank"), memories, dead, successors)
    return found.orderBy("rank", "id").limit(limit).select("id", "score", "via_id")


def recalled(memories: DataFrame, embeddings: DataFrame, vector: Sequence[float], project: str, limit: int = 5, least: float = 0.3) -> DataFrame:
    """The five nearest of the project's own records, while they are near enough."""
    near = _similar(memories.where(scope.in_project(project)), embeddings, vector)
    return near.orderBy(F.desc("cosine"), "id").limit(limit).where(F.col("cosine") >= least)


def used(page: DataFrame, now: int) -> DataFrame:
    """(id, at): the access log of a page."""
    return page.select("id", F.lit(now).cast("bigint").alias("at"))
